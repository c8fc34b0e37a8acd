"""Incremental form: landed postings as a file stream."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import dedup_rules, with_uid
from ..operators.refine import refine, to_records
from ..schema import RAW_SEQ
from ..sources.store import PostingStore


def landed_stream(spark: SparkSession, path: str, schema=RAW_SEQ, fmt="parquet", glob: str | None = None, max_files=None):
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def ingest(stream: DataFrame, store: PostingStore, checkpoint: str, threshold: int = 90, rules: bool = True, now=None, **trigger) -> StreamingQuery:
    """Refine each micro-batch and merge it into the store.

    The engine may hand over a batch again after a failure; the store applies it once. A batch is known by
    the id of the stream, which lives in its checkpoint, and its own number: other streams, and this one
    from a new checkpoint, are other writers.
    Duplicates meet within a batch only; across batches rows meet by uid.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = dedup_rules(batch) if rules else batch
        stream_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        store.upsert(to_records(refine(rows, threshold), now), batch_id, writer=f"stream {stream_id}")

    return (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def dedup_stream(stream: DataFrame, event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """First row of each uid over the life of the stream, or within a delay of event time.

    Without a delay the state keeps every uid; with one it is bounded.
    """
    rows = stream if "uid" in stream.columns else with_uid(stream)
    if event_time and delay:
        return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["uid"])
    return rows.dropDuplicates(["uid"])


def first_per_window(stream: DataFrame, keys, event_time: str, order: str, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(window_start, keys, first): the smallest `order` of each key in each window of event time.

    State holds the windows that the watermark has not passed, whatever the age of the stream. A row whose window ended
    more than `delay` before the latest event time of the batches before is late and dropped.
    """
    return (
        stream.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, size), *keys)
        .agg(F.min(order).alias("first"))
        .select(F.col("window.start").alias("window_start"), *keys, "first")
    )


def write_updates(updates: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each batch's new values as a folder of its own, which a repeated batch replaces."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        updates.writeStream.outputMode("update").foreachBatch(put)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
