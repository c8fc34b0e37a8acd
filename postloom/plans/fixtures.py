"""Postings derived from the given tables, so that work grows with them."""

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import strip
from ..lexicons import ALWAYS_OPEN, SITES
from ..schema import RAW_SEQ
from ..session import spread

ROLES = ("백엔드 개발자", "시설보안 요원", "보안엔지니어", "Frontend Developer", "데이터 분석", "경호 담당",
         "DevOps Engineer", "마케팅 매니저", "AI Engineer 인턴", "software intern", "영업 관리", "클라우드 아키텍트")
TECHS = ("Python", "Java Spring", "C++", "Go/Golang", "Node.js", "AWS, Kubernetes", "")
PLACES = ("서울 강남구", "경기 성남시", "서울, 판교", "부산", "", "대전 유성구", "원격", "Seoul", "서울 마포구")
CAREERS = ("신입", "경력 3~5년", "5년 이상", "경력무관", "경력 7년", "1-3년", "10년↑", "", "신입·경력", "2년")
KEYWORDS = ("백엔드", "보안", "인턴", "데이터", "React", "클라우드")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def postings_from_orders(orders: DataFrame) -> DataFrame:
    """One raw posting per order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return orders.select(
        k.alias("ingest_seq"),
        F.concat_ws(" ", pick(ROLES, k % 12), pick(TECHS, k % 7), (k % 40).cast("string")).alias("title"),
        F.when(c % 10 == 0, "").otherwise(F.concat(F.lit("Company "), (c % 97).cast("string"))).alias("company"),
        pick(PLACES, c % 9).alias("location"),
        pick(CAREERS, (k + c) % 10).alias("experience"),
        F.when(k % 13 == 0, "")
        .when(k % 5 == 0, ALWAYS_OPEN)
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("deadline"),
        F.when(k % 11 == 0, "")
        .otherwise(F.concat(F.lit("https://jobs.example.com/"), (k % 9000).cast("string")))
        .alias("url"),
        pick(SITES, c % 11).alias("source"),
        pick(KEYWORDS, k % 6).alias("keyword"),
    ).select(*RAW_SEQ.names)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return postings_from_orders(spread(orders))


def document_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting per document: its first line is the title, its whole text the search text."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    key = F.col("doc_id")
    return d.select(
        key.alias("ingest_seq"),
        F.sha2(key.cast("string"), 256).alias("uid"),
        strip(F.substring_index("text", "\n", 1)).alias("title"),
        F.when(key % 50 == 0, "").otherwise(F.col("source")).alias("company"),
        F.concat(F.lit("2026-"), F.lpad((key % 12 + 1).cast("string"), 2, "0")).alias("deadline"),
        "source",
        F.col("text").alias("_search_text"),
    )


def part_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting per part: brand as company, name as title, type as deadline text."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("ingest_seq"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("company"),
        F.lit("").alias("url"),
        F.col("p_type").alias("deadline"),
    )


def landed(postings: DataFrame, content, size=20) -> DataFrame:
    """Postings bundled into pages of at most `size` records, as the sites deliver them.

    `content` is the record as it stands in the page; `page` numbers the pages.
    """
    # a page costs far more to parse than to move
    tasks = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        postings.withColumn("page", F.floor(F.col("ingest_seq") / size))
        .repartition(tasks, "page")
        .groupBy("page")
        .agg(F.array_sort(F.collect_list(F.struct("ingest_seq", content.alias("body")))).alias("records"))
        .select("page", F.transform("records", lambda r: r["body"]).alias("bodies"))
    )


def json_pages(postings: DataFrame, record, wrap) -> DataFrame:
    """JSON replies: `record` is a struct, `wrap` puts the array of records into the reply."""
    pages = landed(postings, record)
    return pages.select("page", F.to_json(wrap(F.col("bodies"))).alias("payload"), F.lit("개발").alias("label"))


def html_pages(postings: DataFrame, card, head="", tail="") -> DataFrame:
    pages = landed(postings, card)
    html = F.concat(F.lit("<html><body>" + head), F.array_join("bodies", "\n"), F.lit(tail + "</body></html>"))
    return pages.select("page", F.lit("https://list.example.com/jobs").alias("url"), html.alias("html"), F.lit("개발").alias("label"))


def fill(template: str, **columns):
    """Text with {name} places taken from columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[columns[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])
