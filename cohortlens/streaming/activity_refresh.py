"""Keep click activity totals fresh as new click files arrive.

Replaces the source's periodic full reload: a Structured Streaming query
reads new click files, enriches them with the site dimension (stream-static
broadcast join) and keeps one state row per enrollment-day (update mode) in
the RocksDB state store, off the executors' heap.  Each micro-batch writes its
changed rows to ``updates/epoch=<id>``; writing the same epoch again overwrites
the same folder, so a replayed batch after a failure is harmless.  Current
totals are the latest row per enrollment-day rolled up exactly as the batch
feature job does, so the final state equals the batch result.

A query that starts with a new checkpoint counts its epochs from 0 again and
its totals from nothing: epochs are therefore written under the checkpoint's
generation, and only the newest generation is read.  ``compact`` folds the
epochs so far into one snapshot, so reading does not slow down with the query's
age; readers see every row at any moment of it.

Count-distinct is not allowed on a stream; the enrollment-day grouping
itself gives the distinct days.  State and checkpoints live under the
session's shared checkpoint folder, so the query survives executor loss and
restarts where it stopped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cohortlens.operators.features import KEYS, activity_from_daily, daily_clicks, typed_clicks
from cohortlens.session import shared_checkpoint_dir
from cohortlens.sources import snapshots
from cohortlens.sources.schemas import SCHEMAS
from cohortlens.streaming.epochs import EpochTable, numbers

DAY_KEYS = [*KEYS, "date"]
DAY_VALUES = ["clicks", "forum", "quiz", "resource"]


# Files per micro-batch: bounds the work of one batch when a backlog arrives.
MAX_FILES_PER_TRIGGER = 1000


def click_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = MAX_FILES_PER_TRIGGER) -> DataFrame:
    """New click files (Parquet) as a stream with the declared click schema."""
    return (
        spark.readStream.schema(SCHEMAS["student_vle"])
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(source_dir)
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def generation(spark: SparkSession, folder: str, checkpoint: str) -> int:
    """The checkpoint's own number under ``folder``; a checkpoint without one gets the next and notes it."""
    noted = numbers(spark, os.path.join(checkpoint, "generation"), "g")
    if noted:
        return noted[-1]
    number = max([-1, *numbers(spark, folder, "generation=")]) + 1
    snapshots.created(spark, os.path.join(checkpoint, "generation", f"g{number}"))
    return number


def newest(spark: SparkSession, folder: str) -> str:
    """The folder of the newest generation."""
    return os.path.join(folder, f"generation={numbers(spark, folder, 'generation=')[-1]}")


def day_table(spark: SparkSession, folder: str, bucketed: bool = False) -> EpochTable:
    """Enrollment-day totals by epoch; a bucketed one has a ``bucket`` that readers prune by."""
    fields = [SCHEMAS["student_vle"][c] for c in DAY_KEYS] + [T.StructField(c, T.LongType()) for c in DAY_VALUES]
    if not bucketed:
        return EpochTable(spark, folder, T.StructType(fields))
    return EpochTable(spark, folder, T.StructType([*fields, T.StructField("bucket", T.IntegerType())]), ("bucket",))


def with_rocksdb(spark: SparkSession, start):
    """Starts a query whose state is kept in RocksDB, unless the session names a store; the setting is put back."""
    own = spark.conf.get(PROVIDER, None)
    default = own is None or own.endswith("HDFSBackedStateStoreProvider")
    if default:
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return start()
    finally:
        if default:
            spark.conf.unset(PROVIDER) if own is None else spark.conf.set(PROVIDER, own)


def start_activity_refresh(
    spark: SparkSession,
    source_dir: str,
    vle: DataFrame,
    out_dir: str,
    checkpoint: str | None = None,
    max_files_per_trigger: int = MAX_FILES_PER_TRIGGER,
    available_now: bool = True,
    processing_time: str = "60 seconds",
) -> StreamingQuery:
    """Start the refresh query (``availableNow`` drains what is there and stops)."""
    checkpoint = checkpoint or os.path.join(shared_checkpoint_dir(spark), "streams", "activity_refresh")
    updates = os.path.join(out_dir, "updates")
    days = day_table(spark, os.path.join(updates, f"generation={generation(spark, updates, checkpoint)}"))
    daily = daily_clicks(typed_clicks(click_stream(spark, source_dir, max_files_per_trigger), vle))
    writer = (
        daily.writeStream.outputMode("update")
        .foreachBatch(lambda batch, epoch: days.write(batch, epoch))
        .option("checkpointLocation", checkpoint)
        .queryName("activity_refresh")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return with_rocksdb(spark, writer.start)


def latest_days(updates: DataFrame) -> DataFrame:
    """The latest row of each enrollment-day."""
    # An epoch holds one row per enrollment-day, so taking each total from
    # the latest epoch separately gives the latest row; fixed-width values
    # keep this a hash aggregate.
    keys = [*DAY_KEYS, *(c for c in updates.columns if c == "bucket")]
    return updates.groupBy(*keys).agg(*[F.max_by(c, "epoch").alias(c) for c in DAY_VALUES])


def current_daily(spark: SparkSession, out_dir: str) -> DataFrame:
    """Latest state row per enrollment-day across the newest generation's epochs."""
    return latest_days(day_table(spark, newest(spark, os.path.join(out_dir, "updates"))).rows())


def compact(spark: SparkSession, out_dir: str, keep: int = 1, wait_seconds: float = 0.0) -> None:
    """Fold all epochs but the last ``keep`` into one snapshot.

    Folders that it replaces stay for ``wait_seconds``, for readers that still use them.
    """
    day_table(spark, newest(spark, os.path.join(out_dir, "updates"))).fold(latest_days, keep, wait_seconds)


def current_activity(spark: SparkSession, out_dir: str, courses: DataFrame) -> DataFrame:
    """Current enrollment click features (same columns as the batch job)."""
    return activity_from_daily(current_daily(spark, out_dir), courses)

