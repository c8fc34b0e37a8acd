"""Fixed schemas. Nothing in this package infers one."""

from pyspark.sql import DataFrame, functions as F, types as T

from .lexicons import DISPLAY_NAMES

RAW_COLUMNS = ("title", "company", "location", "experience", "deadline", "url", "source", "keyword")

RAW = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
RAW_SEQ = T.StructType([T.StructField("ingest_seq", T.LongType())] + RAW.fields)

POSTING = T.StructType(
    [
        T.StructField("uid", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("company", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("deadline", T.StringType()),
        T.StructField("min_exp", T.IntegerType()),
        T.StructField("max_exp", T.IntegerType()),
        T.StructField("tech_stack", T.ArrayType(T.StringType(), False)),
        T.StructField("posted_date", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
    ]
)


def conform(df: DataFrame, columns=RAW_COLUMNS) -> DataFrame:
    """Fixed columns in fixed order: a missing one becomes null, an extra one is dropped."""
    have = set(df.columns)
    keep = ["ingest_seq"] if "ingest_seq" in have else []
    return df.select(
        *keep,
        *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in columns],
    )


def to_display(df: DataFrame, drop=("_search_text", "uid")) -> DataFrame:
    """Listing projection: headers as shown to people, internal columns left out."""
    return df.drop(*drop).withColumnsRenamed(DISPLAY_NAMES)


def from_display(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({shown: name for name, shown in DISPLAY_NAMES.items()})
