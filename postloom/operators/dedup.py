"""Exact duplicate removal. Order comes from columns, never from partitions."""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import posting_uid, strip, text


def first_per(df: DataFrame, keys, order) -> DataFrame:
    """The first row of each key.

    Spark limits each key to one row before the shuffle as well (WindowGroupLimit), so a key
    that holds a third of the rows sends one row per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def with_uid(df: DataFrame) -> DataFrame:
    return df.withColumn("uid", posting_uid())


def dedup_uid(df: DataFrame, order=("ingest_seq",)) -> DataFrame:
    return first_per(df, ["uid"], [F.col(c) for c in order])


def dedup_rules(df: DataFrame, seq="ingest_seq") -> DataFrame:
    """Three rules in order of arrival, first one wins.

    With a company, (title, company) must be new. Without one, the url must be new, also among
    the urls of kept company rows that came before. Without either, the title must be new, also
    among the titles of kept url-only rows that came before. Rows without a title go.
    """
    order = [F.col(seq)]
    rows = (
        df.withColumn("_t", strip(text("title")))
        .withColumn("_c", strip(text("company")))
        .withColumn("_u", strip(text("url")))
        .where("_t <> ''")
    )
    with_company = first_per(rows.where("_c <> ''"), ["_t", "_c"], order)

    by_url = rows.where("_c = '' AND _u <> ''").withColumn("_own", F.lit(True))
    seen_urls = with_company.where("_u <> ''").select("_u", seq, F.lit(False).alias("_own"))
    url_only = first_per(
        by_url.unionByName(seen_urls, allowMissingColumns=True), ["_u"], order
    ).where("_own")

    by_title = rows.where("_c = '' AND _u = ''").withColumn("_own", F.lit(True))
    seen_titles = url_only.select("_t", seq, F.lit(False).alias("_own"))
    title_only = first_per(
        by_title.unionByName(seen_titles, allowMissingColumns=True), ["_t"], order
    ).where("_own")

    return (
        with_company.unionByName(url_only.drop("_own"))
        .unionByName(title_only.drop("_own"))
        .drop("_t", "_c", "_u")
    )
