"""Contiguous shards of near-equal byte size.

Rows are range-sorted by id, each partition's bytes and rows are totalled, the totals of the
partitions before it (a few numbers per partition) turn running sums within a partition into global
ones, and the global byte line is cut at equal targets. A row belongs to the shard that holds the
middle of its bytes. Nothing but one row per partition is ever summed in one place.
"""

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize

BYTES = "bytes"


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length plus 1; a null text has none, and counts as an empty one for the
    checksum. Null ids come first; equal ids follow each other by checksum and order of reading, so a
    hot id is split like any other run of rows. `slot` counts a shard's rows from 0 in that order.
    """
    text = F.coalesce("text", F.lit(""))
    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("seq"),
    )
    order = ["doc_id", "text_crc32", "seq"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written down: the partition number is part of the result
    ranged = materialize(light.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base_bytes"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base_rows"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )  # one row for each partition
    inside = Window.partitionBy("part").orderBy(*order)
    run = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranged.withColumn("run_bytes", F.coalesce(F.sum("size").over(run), F.lit(0)))
        .withColumn("run_rows", F.row_number().over(inside) - 1)
        .join(F.broadcast(base), "part")
        .select(
            "doc_id", "size", "text_crc32",
            (F.col("base_rows") + F.col("run_rows")).alias("place"),
            F.expr(f"cast(((2 * (base_bytes + run_bytes) + size) * {shards}) div (2 * all_bytes) as int)").alias("shard"),
        )
    )
    placed = materialize(placed)
    heads = placed.groupBy("shard").agg(F.min("place").alias("head"))  # one row per shard
    return placed.join(F.broadcast(heads), "shard").select(
        "doc_id", "size", "text_crc32", F.lit(BYTES).alias("law"), "shard",
        (F.col("place") - F.col("head")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_sizes(placed: DataFrame) -> DataFrame:
    """Bytes and rows of each shard."""
    return placed.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
