"""Facets and summary statistics. Every ranking breaks ties by key."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.filters import is_intern_title
from ..functions.text import is_blank, text
from ..lexicons import DIRECT_SOURCES, NO_LOCATION, ROLLUP_LABEL

ISO_DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}"


def facet(df: DataFrame, value: Column, name: str, top: int | None = None) -> DataFrame:
    """Rows per value, most frequent first; nulls are not counted."""
    out = (
        df.select(value.alias(name))
        .where(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.count("*").alias("cnt"))
        .orderBy(F.desc("cnt"), name)
    )
    return out if top is None else out.limit(top)


def snapshot(df: DataFrame) -> DataFrame:
    """One row about a raw feed, taken before any duplicate is removed."""
    return df.agg(
        F.count("*").alias("total_raw"),
        F.count_if(is_intern_title()).alias("intern_count"),
        F.count_if(~is_blank("deadline")).alias("has_deadline"),
        F.count_if(is_blank("company")).alias("no_company"),
    )


def by_source(df: DataFrame) -> DataFrame:
    return facet(df, F.col("source"), "source")


def dedup_effect(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows left and removed, and how many of the rest have years and technologies."""
    after = kept.agg(
        F.count("*").alias("total_after_dedup"),
        F.count("min_exp").alias("experience_parsed"),
        F.count_if(F.size("tech_stack") > 0).alias("tech_found"),
    )
    total = raw.agg(F.count("*").alias("n"))
    return after.withColumn("removed_by_dedup", total.scalar() - F.col("total_after_dedup"))


def pipeline_report(raw: DataFrame, kept: DataFrame, label: str, now: Column) -> DataFrame:
    """The whole statistics record of one run, ready for the JSON sink."""
    sources = by_source(raw).agg(
        F.map_from_entries(F.array_agg(F.struct("source", "cnt"))).alias("by_source")
    )
    return (
        snapshot(raw)
        .withColumn("generated_at", F.date_format(now, "yyyy-MM-dd HH:mm:ss"))
        .withColumn("source", F.lit(label))
        .withColumn("by_source", sources.scalar())
        .withColumn("total_after_dedup", kept.agg(F.count("*").alias("n")).scalar())
        .withColumn("removed_by_dedup", F.col("total_raw") - F.col("total_after_dedup"))
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("cnt"))


def source_names(df: DataFrame) -> DataFrame:
    return df.select("source").where("source <> ''").distinct().orderBy("source")


def table_summary(df: DataFrame) -> DataFrame:
    """Stored-table figures: a deadline of spaces counts as given here."""
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("title").ilike("%인턴%") | F.col("title").ilike("%intern%")).alias("intern_count"),
        F.count_if(F.col("deadline") != "").alias("has_deadline"),
    )


def source_rollup(df: DataFrame, direct=DIRECT_SOURCES) -> DataFrame:
    """Rows per source, with the employers' own boards as one line that names those present."""
    raw = df.where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("cnt"))
    own = F.col("source").isin(*direct)
    present = raw.where(own).agg(F.array_join(F.array_sort(F.collect_set("source")), " · ").alias("names"))
    label = F.concat(F.lit(f"{ROLLUP_LABEL} ("), present.scalar(), F.lit(")"))
    return (
        raw.groupBy(F.when(own, label).otherwise(F.col("source")).alias("source"))
        .agg(F.sum("cnt").alias("cnt"))
        .orderBy(F.desc("cnt"), "source")
    )


def top_locations(df: DataFrame, top=10) -> DataFrame:
    return facet(df, F.coalesce("location", F.lit(NO_LOCATION)), "location", top)


def top_keywords(df: DataFrame, top=10) -> DataFrame:
    return facet(df, F.col("keyword"), "keyword", top)


def iso_deadline_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(text("deadline").rlike(ISO_DATE)).alias("iso_deadline_count"))


def top_tech(df: DataFrame, top=15) -> DataFrame:
    return facet(df, F.explode("tech_stack"), "tech", top)


def experience_distribution(df: DataFrame) -> DataFrame:
    """Rows per minimum years; label only where the chart shows the bar."""
    return (
        df.where("min_exp IS NOT NULL")
        .groupBy("min_exp")
        .agg(F.count("*").alias("cnt"))
        .withColumn(
            "label",
            F.when(F.col("min_exp") >= 0, F.concat(F.col("min_exp").cast("string"), F.lit("년"))),
        )
        .orderBy("min_exp")
    )


def location_tokens(df: DataFrame, top=20) -> DataFrame:
    tokens = F.filter(F.split(text("location"), r"(?U)[,\s]+"), lambda t: t != "")
    return facet(df, F.explode(tokens), "token", top)


def direct_sources(df: DataFrame, direct=DIRECT_SOURCES) -> DataFrame:
    return by_source(df.where(F.col("source").isin(*direct)))


def headline(df: DataFrame, direct=DIRECT_SOURCES) -> DataFrame:
    """Total, sources after the roll-up, dated deadlines, locations."""
    rolled = F.when(F.col("source").isin(*direct), F.lit(ROLLUP_LABEL)).otherwise(F.col("source"))
    places = F.count_distinct(F.coalesce("location", F.lit(NO_LOCATION)))
    return df.agg(
        F.count("*").alias("total"),
        F.count_distinct(rolled).alias("sources"),
        F.count_if(text("deadline").rlike(ISO_DATE)).alias("iso_deadline_count"),
        places.alias("locations"),
    )


def newest(df: DataFrame, limit: int | None = None) -> DataFrame:
    out = df.orderBy(F.desc("posted_date"), "uid")
    return out if limit is None else out.limit(limit)


def browse(df: DataFrame) -> DataFrame:
    """Latest deadline first, compared as text."""
    return df.orderBy(F.desc_nulls_last("deadline"), "uid")


def badges(df: DataFrame, n=5) -> DataFrame:
    return df.withColumn("badges", F.slice("tech_stack", 1, n))


def score_bar(score) -> Column:
    return F.least(score, F.lit(100.0))


def facet_board(df: DataFrame, tops: dict[str, int] | None = None) -> DataFrame:
    """(facet, value, cnt, rank): the leading values of all facets, from one scan.

    Every row is taken apart into its (facet, value) pairs, which are counted before the shuffle. `tops` names how
    many values of a facet are listed; a facet that it doesn't name is listed whole. Ties are ranked by value.
    """
    tops = {"location": 10, "keyword": 10, "tech": 15, "token": 20} | (tops or {})
    tokens = F.filter(F.split(text("location"), r"(?U)[,\s]+"), lambda t: t != "")
    one = lambda facet, value: F.array(F.struct(F.lit(facet).alias("facet"), value.cast("string").alias("value")))
    many = lambda facet, values: F.transform(values, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))
    pairs = F.concat(
        one("location", F.coalesce("location", F.lit(NO_LOCATION))), one("keyword", F.col("keyword")), one("source", F.col("source")),
        one("min_exp", F.col("min_exp")), many("tech", F.coalesce("tech_stack", F.array().cast("array<string>"))), many("token", tokens),
    )
    counted = df.select(F.explode(pairs).alias("p")).where("p.value IS NOT NULL").groupBy("p.facet", "p.value").agg(F.count("*").alias("cnt"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("cnt"), "value")))
    most = reduce(lambda e, kv: F.when(F.col("facet") == kv[0], F.lit(kv[1])).otherwise(e), tops.items(), F.lit(None).cast("int"))
    return ranked.where(most.isNull() | (F.col("rank") <= most))
