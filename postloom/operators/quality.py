"""Feed checks per source."""

from pyspark.sql import DataFrame, functions as F

from ..functions.text import is_blank, text
from ..schema import RAW_COLUMNS

REQUIRED = ("title", "company", "url", "source")


def feed_quality(df: DataFrame, expected: DataFrame | None = None, fields: str | None = None) -> DataFrame:
    """One row per feed with its findings and a verdict.

    `df` has a `feed` column naming the site a row was collected from. `fields`, if given, is the
    column with the field names each landed record really had. `expected` is a table of feed names:
    those without rows get a WARN line. Counts aggregate before the shuffle, and what is collected
    per feed are distinct field names only.
    """
    have = F.col(fields) if fields else F.array(*[F.lit(c) for c in RAW_COLUMNS])
    known = F.array(*[F.lit(c) for c in RAW_COLUMNS])
    marked = df.withColumn("_extra", F.array_except(have, known))
    checks = [
        F.count("*").alias("row_cnt"),
        F.count_if(is_blank("title")).alias("blank_title"),
        F.count_if(is_blank("url")).alias("blank_url"),
        F.count_if(text("source") != F.col("feed")).alias("wrong_source"),
    ]
    checks += [F.count_if(~F.array_contains(have, c)).alias(f"_no_{c}") for c in REQUIRED]
    out = marked.groupBy("feed").agg(*checks)
    extras = (
        marked.select("feed", F.explode("_extra").alias("field"))
        .groupBy("feed", "field")
        .agg(F.count("*").alias("n"))
        .groupBy("feed")
        .agg(F.array_join(F.array_sort(F.collect_list("field")), ",").alias("unexpected"))
    )
    out = out.join(extras, "feed", "left")
    if expected is not None:
        out = expected.select("feed").join(out, "feed", "left")
    missing = F.array_compact(F.array(*[F.when(F.col(f"_no_{c}") > 0, F.lit(c)) for c in REQUIRED]))
    rows = F.coalesce("row_cnt", F.lit(0))
    result = out.select(
        "feed",
        rows.alias("row_cnt"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("blank_title", "blank_url", "wrong_source")],
        F.coalesce(F.array_join(missing, ","), F.lit("")).alias("missing"),
        text("unexpected").alias("unexpected"),
    )
    issue = (
        (F.col("row_cnt") == 0)
        | (F.col("blank_title") > 0)
        | (F.col("blank_url") * 10 > F.col("row_cnt") * 3)
        | (F.col("wrong_source") > 0)
        | (F.col("missing") != "")
        | (F.col("unexpected") != "")
    )
    return result.withColumn("verdict", F.when(issue, "WARN").otherwise("PASS"))
