"""Keyed merge: new uids are inserted; a known uid only ever gets a later deadline."""

from pyspark.sql import Column, DataFrame, functions as F

ACTIONS = ("insert", "update", "skip")


def one_row_per_uid(batch: DataFrame, seq: str | None = None) -> DataFrame:
    """Rows without uid go; repeats within a batch keep the first row and the greatest deadline.

    Plain aggregates, so repeats are folded before the shuffle however many there are.
    """
    batch = batch.where("uid <> ''")
    payload = F.struct(*[c for c in batch.columns if c not in ("uid", "deadline")])
    first = F.min_by(payload, seq) if seq else F.first(payload)
    return (
        batch.groupBy("uid")
        .agg(first.alias("_row"), F.max("deadline").alias("deadline"))
        .select("uid", "_row.*", "deadline")
        .select(*batch.columns)
    )


def deadline_moves(old, new) -> Column:
    """Deadlines compare as text. A blank old one always moves, even to another blank."""
    return old.isNull() | (old == "") | (old < new)


def classify(known: DataFrame, batch: DataFrame) -> DataFrame:
    """Batch rows with the action each one causes. `known` needs uid and deadline only."""
    seen = known.select("uid", F.col("deadline").alias("_old"), F.lit(True).alias("_seen"))
    action = (
        F.when(F.col("_seen").isNull(), "insert")
        .when(deadline_moves(F.col("_old"), F.col("deadline")), "update")
        .otherwise("skip")
    )
    return batch.join(seen, "uid", "left").withColumn("action", action).drop("_old", "_seen")


def merge(table: DataFrame, batch: DataFrame) -> DataFrame:
    """The table after the batch, as one full outer join on uid. Blank uids go, repeats fold."""
    t, b = table.alias("t"), one_row_per_uid(batch).alias("b")
    known, given = F.col("t.uid").isNotNull(), F.col("b.uid").isNotNull()
    moves = known & given & deadline_moves(F.col("t.deadline"), F.col("b.deadline"))

    def pick(c):
        if c in ("deadline", "updated_at"):
            return F.when(known & ~moves, F.col(f"t.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
        return F.when(known, F.col(f"t.{c}")).otherwise(F.col(f"b.{c}")).alias(c)

    return t.join(b, F.col("t.uid") == F.col("b.uid"), "full_outer").select(
        *[pick(c) for c in table.columns]
    )


def counts(known: DataFrame, batch: DataFrame) -> DataFrame:
    hits = classify(known, one_row_per_uid(batch))
    return hits.agg(
        *[F.count_if(F.col("action") == a).alias(n) for a, n in zip(ACTIONS, ("inserted", "updated", "skipped"))]
    )
