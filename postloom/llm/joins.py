"""Joins whose small side is counted first."""

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_ITEMS = 2_000_000


def counted(small: DataFrame, weight: Column | None = None) -> DataFrame:
    """`small` (a written or checkpointed table) marked for broadcast if it holds few items, else for a merge join.

    Items are rows, or the sum of `weight`. Both ways give the same rows.
    """
    items = small.agg(F.sum(weight if weight is not None else F.lit(1))).head()[0] or 0
    return F.broadcast(small) if items <= BROADCAST_ITEMS else small.hint("merge")
