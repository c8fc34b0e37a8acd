"""Connected components of a link table."""

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b); root is the smallest node of its component.

    Each round takes the smallest root among the neighbours and then the root's root; the sums of a
    hub are combined before the shuffle. Rounds are cut by checkpoint(), so that a lost executor
    costs one round at most. An empty table gives an empty table.
    """
    both = materialize(
        links.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        .distinct()
    )
    roots = materialize(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        seen = (
            both.join(roots.select(F.col("node").alias("other"), F.col("root").alias("r")), "other")
            .groupBy("node")
            .agg(F.min("r").alias("r"))
        )
        near = roots.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        nxt = materialize(near.join(above, "root", "left").select("node", "old", F.least("root", "up").alias("root")))
        moved = nxt.where("old <> root").isEmpty()
        roots = nxt.select("node", "root")
        if moved:
            return roots
