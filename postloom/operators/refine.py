"""From raw postings to rows of the stored table."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import (
    clean,
    experience_source,
    search_text,
    tech_stack,
    text,
    years,
)
from ..lexicons import TECH_KEYWORDS
from ..schema import POSTING, RAW_COLUMNS
from .dedup import with_uid
from .fuzzy import fuzzy_dedup


def clean_columns(df: DataFrame, columns=RAW_COLUMNS) -> DataFrame:
    """Legacy files hold the word nan where nothing was known; blank it."""
    return df.withColumns({c: clean(c) for c in columns if c in df.columns})


def add_experience(df: DataFrame) -> DataFrame:
    low, high = years(experience_source())
    return df.withColumns({"min_exp": low, "max_exp": high})


def add_tech_stack(df: DataFrame, keywords=TECH_KEYWORDS) -> DataFrame:
    return df.withColumn(
        "tech_stack", tech_stack(F.concat_ws(" ", text("title"), text("keyword")), keywords)
    )


def add_search_text(df: DataFrame) -> DataFrame:
    return df.withColumn("_search_text", search_text())


def enrich(df: DataFrame) -> DataFrame:
    """All row-wise steps, one pass, no shuffle."""
    return df.transform(add_experience).transform(add_tech_stack).transform(add_search_text)


def refine(df: DataFrame, threshold: int = 90) -> DataFrame:
    """uid, duplicate removal, then enrichment of the rows that stay."""
    return df.transform(with_uid).transform(fuzzy_dedup, threshold).transform(enrich)


def to_records(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Refined rows as rows of the stored table."""
    now = F.current_timestamp() if now is None else now
    return df.select(
        text("uid").alias("uid"),
        text("title").alias("title"),
        text("company").alias("company"),
        text("_search_text").alias("description"),
        text("url").alias("link"),
        text("location").alias("location"),
        text("source").alias("source"),
        text("keyword").alias("keyword"),
        text("deadline").alias("deadline"),
        F.col("min_exp").cast("int").alias("min_exp"),
        F.col("max_exp").cast("int").alias("max_exp"),
        F.coalesce("tech_stack", F.array().cast("array<string>")).alias("tech_stack"),
        now.alias("posted_date"),
        now.alias("updated_at"),
    ).select(*POSTING.names)


def from_records(df: DataFrame) -> DataFrame:
    """Stored rows as search input: the table keeps no experience text."""
    return df.withColumnsRenamed({"link": "url"}).withColumn("experience", F.lit(""))
