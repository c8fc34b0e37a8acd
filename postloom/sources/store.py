"""The postings table: one row per uid, merged batch by batch.

Plain Parquet that is only appended to. A batch leaves the rows it changed: full rows of uids that are new, and uid,
deadline and updated_at of known uids whose deadline moved. Each carries the writer, the batch id and the batch's
place in the order (`version`), and the table is one grouping of them by uid.

Known uids are looked up in two columns, so that a batch writes only what it changed. A batch handed over again is
classed against what stood before it, by uid and deadline alone, and adds the rows that are not there yet: none, or those
that a broken run could not write. Writers take turns; the table has no lock. To fold a long history, put `read()` into a new table.
"""

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..operators.upsert import ACTIONS, classify, one_row_per_uid
from ..operators.stats import newest
from ..functions.filters import table_filter
from ..schema import POSTING

ORDER = {"action": T.StringType(), "writer": T.StringType(), "batch_id": T.LongType(), "version": T.LongType()}
STORED = T.StructType([T.StructField(f.name, f.dataType) for f in POSTING.fields] + [T.StructField(*c) for c in ORDER.items()])
MOVED = ("deadline", "updated_at")


def latest_move() -> Column:
    """Deadline and its date: the greatest deadline from where it first stood; blank ones move to each other."""
    text = F.coalesce("deadline", F.lit(""))
    return F.max_by(F.struct(*MOVED), F.struct(text, F.when(text == "", F.col("version")).otherwise(-F.col("version"))))


class PostingStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.createDataFrame([], STORED).write.mode("ignore").parquet(self.path)

    def changes(self) -> DataFrame:
        """Everything that was ever appended."""
        return self.spark.read.schema(STORED).parquet(self.path)

    def _known(self, before: int) -> DataFrame:
        return self.changes().where(F.col("version") < before).groupBy("uid").agg(latest_move()["deadline"].alias("deadline"))

    def read(self) -> DataFrame:
        kept = [c for c in POSTING.names if c != "uid" and c not in MOVED]
        rows = self.changes().groupBy("uid").agg(F.min_by(F.struct(*kept), "version").alias("_row"), latest_move().alias("_moved"))
        return rows.select("uid", "_row.*", "_moved.*").select(*POSTING.names)

    def query(self, limit: int | None = None, **filters) -> DataFrame:
        """Newest rows that meet the filters of `table_filter`; no limit unless asked for."""
        return newest(self.read().where(table_filter(**filters)), limit)

    def _again(self, batch: DataFrame, own: Column, version: int):
        """Counts of a batch handed over again, and of the rows that it should have left and has not."""
        hits = classify(self._known(version), one_row_per_uid(batch.select("uid", "deadline")))
        done = self.changes().where(own).select("uid").distinct().withColumn("_done", F.lit(True))
        missing = F.count_if((F.col("action") != "skip") & F.col("_done").isNull()).alias("missing")
        return hits.join(done, "uid", "left").agg(*[F.count_if(F.col("action") == a).alias(a) for a in ACTIONS], missing).head()

    def upsert(self, batch: DataFrame, batch_id: int, writer: str = "batch") -> tuple[int, int, int]:
        """(inserted, updated, skipped). Running a writer's batch again changes nothing."""
        own = (F.col("writer") == writer) & (F.col("batch_id") == batch_id)
        mine, last = self.changes().agg(F.max(F.when(own, F.col("version"))), F.max("version")).head()
        version = mine or (last or 0) + 1
        if mine:
            # uids and deadlines tell whether a row is missing; rows are made whole only if one is
            *tallied, missing = self._again(batch, own, version)
            if not missing:
                return tuple(tallied)
        tally = Observation()
        merged = classify(self._known(version), one_row_per_uid(batch.select(*POSTING.names))).observe(
            tally, *[F.count_if(F.col("action") == a).alias(a) for a in ACTIONS]
        )
        rows = merged.where("action <> 'skip'")
        if mine:
            rows = rows.join(self.changes().where(own).select("uid"), "uid", "left_anti")
        new = F.col("action") == "insert"
        slim = [c if c in ("uid", "action", *MOVED) else F.when(new, F.col(c)).alias(c) for c in (*POSTING.names, "action")]
        place = [F.lit(v).cast(ORDER[c]).alias(c) for c, v in (("writer", writer), ("batch_id", batch_id), ("version", version))]
        rows.select(*slim, *place).write.mode("append").parquet(self.path)
        return tuple(tally.get[a] for a in ACTIONS)
