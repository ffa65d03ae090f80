"""Screens that arrive as a stream."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from veilscan.plans.scan import audit
from veilscan.sources.screens import retention_filter


def stream_scan(
    screens: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str,
    folder: str | None = None,
) -> DataStreamWriter:
    """Audit every arriving screen once; ``sink(entities, verdicts, batch_id)`` stores a batch.

    The audit of a screen needs only that screen, so a micro-batch is audited like a
    table.  ``sink`` must be idempotent per ``batch_id``: a batch is repeated after a failure.
    With a shared ``folder`` the text of a batch is scanned once for both outputs.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        # Both outputs read the scanned table of the batch, which goes once they are stored.
        result = audit(batch, folder=folder)
        sink(result.entities, result.verdicts, batch_id)
        result.drop()

    return screens.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def with_capture_hash(screens: DataFrame) -> DataFrame:
    return screens.withColumn("capture_hash", F.md5(F.col("full_text").cast("binary")))


def stream_dedup(screens: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeated captures (same content) of a user that arrive within the delay.

    State is dropped as the watermark passes; on a table all repeats are dropped.
    """
    hashed = with_capture_hash(screens)
    if not screens.isStreaming:
        return first_captures(hashed).drop("capture_hash")
    return (
        hashed.withWatermark("uploaded_at", delay)
        .dropDuplicatesWithinWatermark(["user_id", "capture_hash"])
        .drop("capture_hash")
    )


def first_captures(hashed: DataFrame) -> DataFrame:
    """Earliest capture per user and content; reduced before the shuffle."""
    first = hashed.groupBy("user_id", "capture_hash").agg(
        F.min(F.struct("uploaded_at", "screen_id")).alias("_first")
    )
    kept = first.select(F.col("_first.screen_id").alias("screen_id"))
    return hashed.join(kept, "screen_id", "left_semi")


def append_to_store(screens: DataFrame, store: str) -> None:
    """Adds screens to a standing store, which is partitioned by the hour of upload (UTC)."""
    hour = F.floor(F.unix_timestamp("uploaded_at") / 3600).cast("long")
    screens.withColumn("upload_hour", hour).write.mode("append").partitionBy("upload_hour").parquet(store)


def sweep_store(spark: SparkSession, store: str, now: Column, minutes: int = 15) -> None:
    """Deletes from the store what is older than the limit at ``now``.

    Whole hours go as folders; only the hour that the limit falls into is rewritten, from a copy
    in a folder that readers pass over.  A sweep that was cut short is finished by the next one.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(store)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return
    limit = spark.range(1).select(F.unix_timestamp(now - F.expr(f"interval {minutes} minutes"))).first()[0]
    edge = limit // 3600
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("_sweep-"):
            # The hour's own folder goes only once its copy is whole.
            hour = path(f"{store}/upload_hour={name.removeprefix('_sweep-')}")
            if files.exists(hour):
                files.delete(status.getPath(), True)
            else:
                files.rename(status.getPath(), hour)
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("upload_hour=") and int(name.removeprefix("upload_hour=")) < edge:
            files.delete(status.getPath(), True)
    at_edge = path(f"{store}/upload_hour={edge}")
    if not files.exists(at_edge):
        return
    fresh = path(f"{store}/_sweep-{edge}")
    kept, _ = retention_filter(spark.read.parquet(at_edge.toString()), F.timestamp_seconds(F.lit(limit + 60 * minutes)), minutes)
    kept.write.mode("overwrite").parquet(fresh.toString())
    files.delete(at_edge, True)
    files.rename(fresh, at_edge)


def stream_retention(
    screens: DataFrame, store: str, checkpoint: str, minutes: int = 15, every: str = "300 seconds",
    now: Callable[[], Column] = F.current_timestamp,
) -> DataStreamWriter:
    """Appends arriving screens to the store and sweeps it on every trigger that brings some.

    ``sweep_store`` may also be called on a timer of its own, for hours without arrivals.
    """

    def sweep(batch: DataFrame, batch_id: int) -> None:
        append_to_store(batch, store)
        sweep_store(batch.sparkSession, store, now(), minutes)

    return (
        screens.writeStream.foreachBatch(sweep)
        .trigger(processingTime=every)
        .option("checkpointLocation", checkpoint)
    )
