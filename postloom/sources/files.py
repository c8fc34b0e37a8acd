"""Landed files in, listings and statistics out."""

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.codecs import decode_literal
from ..schema import RAW, RAW_COLUMNS, conform, from_display, to_display
from ..lexicons import DISPLAY_NAMES

SHOWN = T.StructType([T.StructField(DISPLAY_NAMES[c], T.StringType()) for c in RAW_COLUMNS])


def read_raw_json(spark: SparkSession, path: str) -> DataFrame:
    """One posting per line; unknown fields are dropped, missing ones are null."""
    return spark.read.schema(RAW).json(path)


def read_raw_parquet(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path))


def _csv(spark: SparkSession, schema=SHOWN):
    # quotes are doubled in these files and a field may span lines
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True)


def read_csv(spark: SparkSession, path, schema=SHOWN) -> DataFrame:
    """A listing with headers as shown to people; a byte order mark is skipped, blank is null."""
    return from_display(_csv(spark, schema).csv(path))


def read_refined_csv(spark: SparkSession, path) -> DataFrame:
    """A refined listing: years as numbers, technologies from their printed list."""
    schema = T.StructType(
        SHOWN.fields
        + [
            T.StructField("uid", T.StringType()),
            T.StructField("min_exp", T.IntegerType()),
            T.StructField("max_exp", T.IntegerType()),
            T.StructField("tech_stack", T.StringType()),
        ]
    )
    return read_csv(spark, path, schema).withColumn("tech_stack", decode_literal("tech_stack"))


def csv_names(spark: SparkSession, folder: str, pattern="*.csv") -> DataFrame:
    """Paths of the listings in a folder, newest name first. No file content is read."""
    try:
        files = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{pattern}")
    except AnalysisException:  # nothing there
        return spark.createDataFrame([], "path string")
    # a listing is one file, or a folder of parts
    listing = F.regexp_replace("path", r"(\.csv)/part-[^/]*$", "$1")
    return files.select(listing.alias("path")).distinct().orderBy(F.desc("path"))


def newest_csv(spark: SparkSession, folder: str, pattern="*.csv") -> DataFrame:
    """The listing whose name sorts last; an empty frame if there is none."""
    newest = csv_names(spark, folder, pattern).head()
    if newest is None:
        return from_display(spark.createDataFrame([], SHOWN))
    return read_csv(spark, newest["path"])


def save_csv(df: DataFrame, folder: str, name: str | None = None, prefix="postings") -> str:
    """Write a listing to a fresh, time-stamped place; an existing one is never overwritten."""
    name = name or f"{prefix}_{datetime.now():%Y%m%d_%H%M%S}.csv"
    path = f"{folder.rstrip('/')}/{name}"
    shown = to_display(conform(df).drop("ingest_seq"))
    shown.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
    return path


def save_stats(stats: DataFrame, path: str) -> None:
    """One small JSON record: statistics have one row whatever the feed's size."""
    stats.coalesce(1).write.mode("overwrite").json(path)
