"""Exact positions in a sort order without merging the rows in one task.

A top-k (``orderBy(...).offset(s).limit(k)``) keeps ``s + k`` rows per
partition and merges them in a single task.  That is the cheapest plan while
``s + k`` is small, and unbounded when it grows with the data (the last page
of a large table).  ``with_positions`` numbers every row instead:

1. a range-partitioned sort spreads the rows over many tasks in key order;
2. inside each sorted partition the row order gives the position within the
   partition (``monotonically_increasing_id`` minus the partition's base);
3. per-partition counts, one row per partition, give each partition's first
   position through a running sum over that small frame.

The sorted frame is checkpointed into the shared checkpoint folder: range
bounds come from sampling, so one placement must be fixed for the positions
and the counts to agree, and the lineage cut survives executor loss.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import scratch_path, shared_checkpoint_dir, shuffles_released

# A slice ending at or below this position is cut by a per-partition top-k;
# deeper slices number all rows with the distributed sort below.
TOPK_ROWS = 100_000

# monotonically_increasing_id puts the partition index above bit 33.
_PARTITION_SHIFT = 33


def with_positions(df: DataFrame, keys: Sequence[Column], n_partitions: int | None = None) -> DataFrame:
    """``df`` plus ``position`` (1-based, long) in the order of ``keys``.

    ``keys`` should make the order total (end with a unique key); rows tied
    on every key get distinct, arbitrary but consistent positions.
    """
    spark = df.sparkSession
    shared_checkpoint_dir(spark)
    n = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.spark_partition_id()
    in_part = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), _PARTITION_SHIFT)
    tagged = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .select("*", part.alias("_part"), in_part.alias("_in_part"))
        .checkpoint(eager=True)
    )
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a running sum over this frame is bounded by the
    # partition count, not by the data.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return tagged.join(F.broadcast(starts), "_part").select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("_start") + F.col("_in_part") + 1).alias("position"),
    )


def ordered_slice(
    df: DataFrame, keys: Sequence[Column], start: int, count: int, topk_rows: int = TOPK_ROWS
) -> DataFrame:
    """Rows at 0-based positions ``[start, start + count)`` with ``position`` (1-based int).

    Shallow slices use the per-partition top-k; the position column is then
    numbered inside the at most ``count`` rows of the slice.  Deeper slices
    number all rows with ``with_positions`` and keep the requested range.
    """
    start, count = max(0, int(start)), max(0, int(count))
    if start + count <= topk_rows:
        top = df.orderBy(*keys).offset(start).limit(count)
        numbered = top.withColumn("position", F.lit(start) + F.row_number().over(Window.orderBy(*keys)))
    else:
        numbered = with_positions(df, keys).filter(
            (F.col("position") > start) & (F.col("position") <= start + count)
        )
    return numbered.withColumn("position", F.col("position").cast("int"))


def running_totals(
    df: DataFrame, order_col: str, value_cols: Sequence[str], n_partitions: int | None = None
) -> DataFrame:
    """``df`` plus ``<c>_before``: the sum of ``c`` over rows with a smaller ``order_col``.

    ``order_col`` must be unique (aggregate per value first).  The same
    layout as ``with_positions``: range partitions, whose numbers are stored
    with the rows (as Parquet: far smaller than a checkpoint's rows), an exclusive
    running sum inside each range partition (one window task per partition)
    and partition offsets from one total row per partition.
    """
    spark = df.sparkSession
    n = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "running-totals")
    tagged = df.repartitionByRange(n, order_col).withColumn("_part", F.spark_partition_id())
    with shuffles_released(spark):
        tagged.write.parquet(path)
    tagged = spark.read.schema(tagged.schema).parquet(path)
    inside = Window.partitionBy("_part").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    in_part = tagged.select(
        "*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{c}") for c in value_cols]
    )
    totals = tagged.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in value_cols]
    )
    return in_part.join(F.broadcast(offsets), "_part").select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"_off_{c}") + F.col(f"_in_{c}")).alias(f"{c}_before") for c in value_cols],
    )
