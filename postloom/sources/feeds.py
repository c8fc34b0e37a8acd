"""All feeds together."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_feeds(*feeds: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def only_sites(feed: DataFrame, sites=None) -> DataFrame:
    return feed.where(F.col("source").isin(*sites)) if sites else feed
