"""Landed JSON replies of the job sites as raw postings.

Input: one reply per row, column `payload`; `label` is the search the reply came from. Everything
is null-safe: a record with a hole in it loses only that field. Replies that are no JSON at all
yield nothing here and are listed by `unreadable`.
"""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import contains_any, or_default, strip, text
from ..lexicons import ALWAYS_OPEN, COUPANG_TERMS, DEV_LABEL
from ..schema import RAW_COLUMNS

WANTED = """data array<struct<id: string, position: string, company: struct<name: string>,
    address: struct<location: string>, experience_level: struct<display: string>, due_time: string>>"""
JUMPIT = """result struct<positions: array<struct<id: string, title: string, companyName: string,
    locations: array<string>, minCareer: int, maxCareer: int, closeDate: string>>, totalCount: int>"""
SARAMIN = """jobs struct<job: array<struct<url: string, `expiration-date`: string,
    position: struct<title: string, location: struct<name: string>, `experience-level`: struct<name: string>>,
    company: struct<detail: struct<name: string>>>>>"""
COUPANG = """jobs array<struct<id: string, title: string, absolute_url: string,
    departments: array<struct<name: string>>, offices: array<struct<name: string>>>>"""


def raw_posting(df: DataFrame, source: str, keep=("ingest_seq",), **fields: Column) -> DataFrame:
    """Fixed raw schema: every field stripped, absent ones blank."""
    values = {c: strip(text(fields[c])) if c in fields else F.lit("") for c in RAW_COLUMNS}
    values["source"] = F.lit(source)
    return df.select(*[c for c in keep if c in df.columns], *[v.alias(c) for c, v in values.items()])


def _parted(schema: str, path: str) -> tuple[T.StructType, T.StructType]:
    """The schema of a reply with its records as texts, and the schema of a record."""
    whole = T.StructType.fromDDL(schema)
    names, record = path.split("."), whole
    for name in names:
        record = record[name].dataType
    outer: T.DataType = T.ArrayType(T.StringType())
    for name in reversed(names):
        outer = T.StructType([T.StructField(name, outer)])
    return outer, record.elementType


def records(landed: DataFrame, schema: str, path: str) -> DataFrame:
    """One row per record of a reply, as column `i`; each is parsed by itself, so that one of the wrong shape costs no other."""
    outer, record = _parted(schema, path)
    parsed = landed.withColumn("_r", F.from_json("payload", outer))
    return parsed.select("*", F.explode(f"_r.{path}").alias("_i")).withColumn("i", F.from_json("_i", record)).drop("_r", "_i")


def unreadable(landed: DataFrame) -> DataFrame:
    """Replies that are no JSON."""
    return landed.where(F.try_parse_json("payload").isNull())


# Where a feed's records are, and the field without which a record is no posting.
SHAPES = {
    "wanted": (WANTED, "data", "position"),
    "jumpit": (JUMPIT, "result.positions", "title"),
    "saramin": (SARAMIN, "jobs.job", None),
    "coupang": (COUPANG, "jobs", "title"),
}


def rejects(landed: DataFrame, feed: str, keep=("page",)) -> DataFrame:
    """What a feed's reader leaves out and why: the `keep` columns, nth (place in the reply, null for a whole reply), reason.

    "not json": the reply is no JSON; "wrong shape": it has no array of records where the feed has them; "null record";
    "wrong record": it is no object; "no title". A reply with an empty array is neither read nor rejected: it holds no record.
    """
    schema, path, title = SHAPES[feed]
    outer, record = _parted(schema, path)
    parsed = landed.select(*keep, "payload", F.from_json("payload", outer).alias("_r"))
    whole = F.when(F.try_parse_json("payload").isNull(), "not json").when(F.col(f"_r.{path}").isNull(), "wrong shape")
    replies = parsed.select(*keep, F.lit(None).cast("int").alias("nth"), whole.alias("reason"))
    each = parsed.where(whole.isNull()).select(*keep, F.posexplode(f"_r.{path}").alias("nth", "i"))
    blank = F.lit(False) if title is None else text(F.from_json("i", record)[title]) == ""
    why = F.when(F.col("i").isNull(), "null record").when(~F.col("i").startswith("{"), "wrong record").when(blank, "no title")
    return replies.unionByName(each.select(*keep, "nth", why.alias("reason"))).where("reason IS NOT NULL")


def known_id(c: Column, prefix: str) -> Column:
    return F.when(text(c).isin("", "0"), "").otherwise(F.concat(F.lit(prefix), c))


def wanted(landed: DataFrame) -> DataFrame:
    i = lambda path: F.col(f"i.{path}")
    rows = records(landed, WANTED, "data").where(text(i("position")) != "")
    return raw_posting(
        rows, "원티드",
        title=i("position"), company=i("company.name"), location=i("address.location"),
        experience=i("experience_level.display"), deadline=or_default(i("due_time"), ALWAYS_OPEN),
        url=known_id(i("id"), "https://www.wanted.co.kr/wd/"), keyword=F.col("label"),
    )


def career(low: Column, high: Column) -> Column:
    least = F.coalesce(low, F.lit(0))
    return (
        F.when(F.coalesce(high, F.lit(0)) != 0, F.concat(least.cast("string"), F.lit("~"), high.cast("string"), F.lit("년")))
        .when(least == 0, "신입")
        .otherwise(F.concat(least.cast("string"), F.lit("년 이상")))
    )


def jumpit(landed: DataFrame) -> DataFrame:
    i = lambda path: F.col(f"i.{path}")
    rows = records(landed, JUMPIT, "result.positions").where(text(i("title")) != "")
    return raw_posting(
        rows, "점핏",
        title=i("title"), company=i("companyName"), location=F.array_join(i("locations"), ", "),
        experience=career(i("minCareer"), i("maxCareer")), deadline=or_default(i("closeDate"), ALWAYS_OPEN),
        url=known_id(i("id"), "https://jumpit.saramin.co.kr/position/"), keyword=F.col("label"),
    )


def saramin(landed: DataFrame) -> DataFrame:
    i = lambda path: F.col(f"i.{path}")
    return raw_posting(
        records(landed, SARAMIN, "jobs.job"), "사람인",
        title=i("position.title"), company=i("company.detail.name"), location=i("position.location.name"),
        experience=i("position.`experience-level`.name"), deadline=i("`expiration-date`"),
        url=i("url"), keyword=F.col("label"),
    )


def coupang(landed: DataFrame, terms=COUPANG_TERMS) -> DataFrame:
    i = lambda path: F.col(f"i.{path}")
    department = text(F.get(i("departments"), F.lit(0))["name"])
    title = text(i("title"))
    rows = records(landed, COUPANG, "jobs").where(
        (title != "") & contains_any(F.lower(F.concat_ws(" ", title, department)), terms)
    )
    built = F.concat(F.lit("https://www.coupang.jobs/jobs/"), text(i("id")))
    return raw_posting(
        rows, "쿠팡",
        title=title, company=F.lit("쿠팡"), location=F.get(i("offices"), F.lit(0))["name"],
        deadline=F.lit(ALWAYS_OPEN), url=F.coalesce(i("absolute_url"), built), keyword=or_default(department, DEV_LABEL),
    )
