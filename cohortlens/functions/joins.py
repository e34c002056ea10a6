"""Join helpers: broadcast only behind a checked size bound, and what to do beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import scratch_path

#: Dimension tables (sites, courses, assessments) hold thousands of rows in
#: practice.  A side the optimizer sizes above this many bytes is not hinted.
MAX_BROADCAST_BYTES = 16 * 1024 * 1024


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's size of the frame: file bytes of a scan, scaled by what the plan keeps.  Runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bounded_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hint ``df`` for broadcast only if it is planned with at most ``max_bytes``.

    Beyond the bound the frame is returned unhinted: the join is a shuffle
    join, which AQE turns into a broadcast if the real size allows it.
    """
    return F.broadcast(df) if planned_bytes(df) <= max_bytes else df


def heavy_keys(fact: DataFrame, key: str, partitions: int) -> DataFrame:
    """Keys that hold more rows than half a partition's share: fewer than twice the partitions.  Counted map-side first."""
    counts = fact.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    limit = fact.count() / (2 * max(1, partitions))
    return counts.filter(F.col("n") > limit).select(key)


def dimension_join(fact: DataFrame, dim: DataFrame, key: str, how: str = "left", max_bytes: int | None = None) -> DataFrame:
    """``fact`` joined to its dimension on one key, without a task that holds a hot key's rows.

    A dimension within the bound is broadcast.  Beyond it, the fact rows of the
    heavy keys stay where they are and meet the broadcast dimension rows of these few
    keys (so do rows without a key, which match nothing); all other rows are
    shuffled.  Which keys are heavy is counted first, over the key column alone.  A
    stream cannot be counted first and is joined by shuffle.
    """
    max_bytes = MAX_BROADCAST_BYTES if max_bytes is None else max_bytes
    if planned_bytes(dim) <= max_bytes:
        return fact.join(F.broadcast(dim), key, how)
    if fact.isStreaming:
        return fact.join(dim, key, how)
    spark = fact.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "heavy-keys")
    heavy_keys(fact.select(key), key, partitions).write.parquet(path)
    heavy = spark.read.schema(fact.select(key).schema).parquet(path)
    # at most 2 x partitions keys; their dimension rows are written to know the size of rows that share a key, too
    path = scratch_path(spark, "heavy-rows")
    dim.join(F.broadcast(heavy), key, "left_semi").write.parquet(path)
    rows = spark.read.schema(dim.schema).parquet(path)
    if planned_bytes(rows) > MAX_BROADCAST_BYTES:
        return fact.join(dim, key, how)
    marked = fact.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), key, "left")
    stays = F.col("_heavy").isNotNull() | F.col(key).isNull()
    hot = marked.filter(stays).drop("_heavy").join(F.broadcast(rows), key, how)
    rest = marked.filter(~stays).drop("_heavy").join(dim, key, how)
    return hot.unionByName(rest)
