"""Keep the scored table and its tier summary fresh as click files arrive.

Incremental view maintenance over the activity stream.  A micro-batch brings
new clicks, which are combined to one row for each enrollment-day; a day's
totals are the sums of its rows over the epochs, so the stream keeps no state
of its own beside the table.  For the enrollments of the batch alone the
click features, the feature row and the tier are computed again and written as
the epoch's rows of the scored table; every other row stays where it is.  The
tier summary is not counted again: the worst tiers of the students concerned,
before and after, give the difference to the summary before.

All tables are bucketed by a hash of the student, and a micro-batch reads only
the buckets that it touches: the days of the changed enrollments, their static
features (assessments, registration, demographics, written once per checkpoint)
and the other enrollments of the changed students.

An epoch counts once its summary is written, which is the last step: readers
take the newest summary's epoch as the table's version and see neither rows of
an unfinished batch nor half of one.  A replayed batch reads only what earlier
epochs left, so it writes the same rows again.  ``fold`` keeps reading cheap
as the query ages.  Shuffle files go with the step that made them.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cohortlens.operators import cohort
from cohortlens.operators.features import (
    KEYS,
    activity_from_daily,
    assembled,
    daily_clicks,
    static_features,
    typed_clicks,
)
from cohortlens.operators.scoring import scored
from cohortlens.session import shared_checkpoint_dir, shuffles_released
from cohortlens.sources import snapshots
from cohortlens.streaming.activity_refresh import (
    DAY_KEYS,
    DAY_VALUES,
    MAX_FILES_PER_TRIGGER,
    click_stream,
    day_table,
    generation,
    newest,
)
from cohortlens.streaming.epochs import EpochTable

#: Buckets of the tables: a micro-batch's numbers of them reach the driver, never more than this.
BUCKETS = 64
SUMMARY = ["unique_students", "safe", "watch", "high_risk", "critical"]
_SUMMARY_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in SUMMARY])


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id_student"), F.lit(buckets)).cast("int").alias("bucket")


def day_totals(updates: DataFrame) -> DataFrame:
    """Each enrollment-day's totals over its epochs."""
    return updates.groupBy(*DAY_KEYS, "bucket").agg(*(F.sum(c).alias(c) for c in DAY_VALUES))


def latest_rows(rows: DataFrame) -> DataFrame:
    """The rows that each enrollment had in its latest epoch."""
    last = F.max("epoch").over(Window.partitionBy(*KEYS))
    return rows.withColumn("_last", last).filter(F.col("epoch") == F.col("_last")).drop("_last")


class ScoredRefresh:
    """The tables of one checkpoint's generation, and the step that a micro-batch takes."""

    def __init__(self, spark: SparkSession, folder: str, courses: DataFrame, schema: T.StructType | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.courses, self.buckets = spark, folder, courses, buckets
        self.days = day_table(spark, f"{folder}/days", bucketed=True)
        self.summaries = EpochTable(spark, f"{folder}/summary", _SUMMARY_SCHEMA)
        if schema is None:
            schema = spark.read.parquet(snapshots.current(spark, f"{folder}/scored/folded").path).schema
        fields = [f for f in schema.fields if f.name != "bucket"]
        self.scored = EpochTable(spark, f"{folder}/scored", T.StructType([*fields, T.StructField("bucket", T.IntegerType())]), ("bucket",))

    @classmethod
    def begin(cls, spark: SparkSession, folder: str, tables: dict[str, DataFrame], buckets: int = BUCKETS) -> ScoredRefresh:
        """Writes the static features and the scored rows without any click, unless they are there."""
        with shuffles_released(spark):
            if snapshots.current(spark, f"{folder}/static") is None:
                static = static_features(tables).withColumn("bucket", _bucket(buckets))
                snapshots.publish(static.repartition("bucket"), f"{folder}/static", partition_by=["bucket"])
            static = snapshots.read(spark, f"{folder}/static")
            first = scored(assembled(static, None)).withColumn("bucket", _bucket(buckets))
            refresh = cls(spark, folder, tables["courses"], first.schema, buckets)
            refresh.scored.start(first)
            refresh.summaries.start(cohort.tier_summary(first))
        return refresh

    def version(self) -> int:
        """The last epoch that is whole; -1 before the first."""
        return self.summaries.last()

    def _summary(self, upto: int) -> DataFrame:
        rows = self.summaries.rows(upto)
        return rows.groupBy().agg(*(F.max_by(c, "epoch").alias(c) for c in SUMMARY))

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """One micro-batch: what it adds to its enrollment-days."""
        with shuffles_released(self.spark), shuffles_released(batch.sparkSession):
            self._apply(batch, epoch)

    def _apply(self, batch: DataFrame, epoch: int) -> None:
        self.days.write(batch.withColumn("bucket", _bucket(self.buckets)), epoch)
        changed = self.days.epoch(epoch).select(*KEYS, "bucket").distinct()
        touched = [r.bucket for r in changed.select("bucket").distinct().collect()]  # at most BUCKETS numbers

        def mine(rows: DataFrame) -> DataFrame:
            return rows.filter(F.col("bucket").isin(touched)) if touched else rows.limit(0)

        days = day_totals(mine(self.days.rows(epoch)).join(changed, [*KEYS, "bucket"], "left_semi"))
        static = mine(snapshots.read(self.spark, f"{self.folder}/static")).join(changed, [*KEYS, "bucket"], "left_semi")
        features = assembled(static, activity_from_daily(days, self.courses))
        self.scored.write(scored(features).withColumn("bucket", _bucket(self.buckets)), epoch)

        new = self.scored.epoch(epoch)
        students = new.select("id", "bucket").distinct()
        before = latest_rows(mine(self.scored.rows(epoch - 1)).join(students, ["id", "bucket"], "left_semi"))
        after = before.join(new.select(*KEYS), KEYS, "left_anti").unionByName(new)
        old, now = (cohort.worst_tier_per_student(rows) for rows in (before, after))
        moves = now.select("id", F.col("risk").alias("now")).join(old.select("id", F.col("risk").alias("old")), "id", "full_outer")

        def change(name: str, tier: int | None) -> Column:
            is_now = F.col("now").isNotNull() if tier is None else F.coalesce(F.col("now") == tier, F.lit(False))
            was = F.col("old").isNotNull() if tier is None else F.coalesce(F.col("old") == tier, F.lit(False))
            return F.coalesce(F.sum(is_now.cast("long") - was.cast("long")), F.lit(0)).alias(f"d_{name}")

        difference = moves.agg(*map(change, SUMMARY, [None, 0, 1, 2, 3]))
        # one row beside one row
        summary = self._summary(epoch - 1).join(F.broadcast(difference), F.lit(True))
        self.summaries.write(summary.select(*((F.coalesce(c, F.lit(0)) + F.col(f"d_{c}")).alias(c) for c in SUMMARY)).coalesce(1), epoch)

    def current_scored(self, version: int | None = None) -> DataFrame:
        """The scored table as of an epoch (the newest whole one by default)."""
        version = self.version() if version is None else version
        return latest_rows(self.scored.rows(version)).drop("bucket", "epoch")

    def current_summary(self, version: int | None = None) -> DataFrame:
        """The tier summary as of an epoch, one row."""
        return self._summary(self.version() if version is None else version)

    def fold(self, keep: int = 1, wait_seconds: float = 0.0) -> None:
        """Folds the older epochs of all tables; for the time between two runs of the query."""
        self.days.fold(day_totals, keep, wait_seconds)
        self.scored.fold(latest_rows, keep, wait_seconds)
        self.summaries.fold(lambda rows: rows.groupBy().agg(*(F.max_by(c, "epoch").alias(c) for c in SUMMARY)), keep, wait_seconds)


def start_scored_refresh(
    spark: SparkSession,
    source_dir: str,
    tables: dict[str, DataFrame],
    out_dir: str,
    checkpoint: str | None = None,
    max_files_per_trigger: int = MAX_FILES_PER_TRIGGER,
    available_now: bool = True,
    processing_time: str = "60 seconds",
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Start the query; ``tables`` are the source tables, whose clicks come from ``source_dir`` instead."""
    checkpoint = checkpoint or os.path.join(shared_checkpoint_dir(spark), "streams", "scored_refresh")
    folder = os.path.join(out_dir, f"generation={generation(spark, out_dir, checkpoint)}")
    refresh = ScoredRefresh.begin(spark, folder, tables, buckets)
    typed = typed_clicks(click_stream(spark, source_dir, max_files_per_trigger), tables["vle"])
    writer = (
        typed.writeStream.foreachBatch(lambda batch, epoch: refresh.apply(daily_clicks(batch), int(epoch)))
        .option("checkpointLocation", checkpoint)
        .queryName("scored_refresh")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()


def refreshed(spark: SparkSession, out_dir: str, courses: DataFrame) -> ScoredRefresh:
    """The newest generation's tables, for readers."""
    return ScoredRefresh(spark, newest(spark, out_dir), courses)

