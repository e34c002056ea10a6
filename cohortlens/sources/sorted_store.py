"""A table stored in sort order: pages by position and lookups by key read one or two of its parts.

The rows are range-partitioned and sorted once and written as ``part=<k>``
folders of about ``ROWS_PER_PART`` rows, as one snapshot
(``sources/snapshots``).  Beside them lies the list of borders, one row for
each part: its number of rows, the position of its first row and the first and
last key.  A page finds its parts by position and a lookup by key; inside a
part, Parquet's row-group statistics and a bloom filter skip what does not hold
the key.  What a page or lookup reads does not grow with the table, except for
the list of borders, which Spark filters as a table of its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.sources import snapshots

ROWS_PER_PART = 250_000
#: Bytes of a Parquet row group: a few in each part.
ROW_GROUP_BYTES = 4 * 1024 * 1024
_PARTITION_SHIFT = 33


def write_sorted(
    df: DataFrame, keys: Sequence[Column], root: str, key_columns: Sequence[str] = (), rows_per_part: int = ROWS_PER_PART
) -> None:
    """Stores ``df`` in the order of ``keys`` (which should be total).

    ``key_columns`` are the leading plain columns of an ascending order, for
    lookups by key; the first of them gets a bloom filter.
    """
    spark = df.sparkSession
    n_parts = max(1, math.ceil(df.count() / rows_per_part))
    ordered = df.repartitionByRange(n_parts, *keys).withColumn("part", F.spark_partition_id())
    # ``part`` leads the order inside a partition, so that the writer keeps it as it is
    ordered = ordered.sortWithinPartitions("part", *keys)
    in_part = F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), _PARTITION_SHIFT)
    options = {"parquet.block.size": str(ROW_GROUP_BYTES)}
    if key_columns:
        options[f"parquet.bloom.filter.enabled#{key_columns[0]}"] = "true"
    ordered = ordered.withColumn("in_part", in_part)
    snapshot = snapshots.publish(ordered, f"{root}/rows", partition_by=["part"], options=options)

    written = spark.read.schema(ordered.schema).parquet(snapshot.path)
    key = F.struct(*(F.col(f"`{c}`") for c in key_columns)) if key_columns else F.lit(None).cast("string")
    borders = written.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(key, "in_part").alias("first"), F.max_by(key, "in_part").alias("last")
    )
    # one row for each part: this window is bounded by the number of parts
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    borders = borders.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # the rows' schema is kept as the type of an empty column, for a table without parts
    borders = borders.withColumn("like", F.lit(None).cast(ordered.schema))
    snapshots.publish(borders.coalesce(1), f"{root}/borders", note=str(snapshot.number))


class SortedStore:
    """Reads what ``write_sorted`` wrote; the version is resolved once."""

    def __init__(self, spark: SparkSession, root: str):
        borders = snapshots.current(spark, f"{root}/borders")
        if borders is None:
            raise FileNotFoundError(f"nothing is stored under {root}")
        self.spark = spark
        self.path = f"{root}/rows/versions/{borders.note}"
        found = spark.read.parquet(borders.path)
        self.schema, self.borders = found.schema["like"].dataType, found.drop("like")

    def total(self) -> int:
        return self.borders.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _parts(self, parts: list[int], start: DataFrame) -> DataFrame:
        if not parts:
            rows = self.spark.createDataFrame([], self.schema)
        else:
            rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*(f"{self.path}/part={p}" for p in parts))
        columns = [c for c in self.schema.names if c not in ("part", "in_part")]
        return rows.join(F.broadcast(start.select("part", "start")), "part").select(
            *(F.col(f"`{c}`") for c in columns), (F.col("start") + F.col("in_part") + 1).alias("position")
        )

    def slice(self, start: int, count: int) -> DataFrame:
        """Rows at the 0-based positions ``[start, start + count)`` with ``position`` (1-based)."""
        start, count = max(0, start), max(0, count)
        hit = self.borders.filter((F.col("start") < start + count) & (F.col("start") + F.col("n") > start))
        parts = [r.part for r in hit.select("part").collect()]  # as many as the slice spans
        rows = self._parts(parts, self.borders.filter(F.col("part").isin(parts)))
        return rows.filter((F.col("position") > start) & (F.col("position") <= start + count))

    def lookup(self, first_only: bool = True, **key) -> DataFrame:
        """Rows whose leading key columns have the given values, in order; of those, the parts' first one alone by default.

        With ``first_only`` the result is the rows of the first part that can hold
        the key, which has the smallest of its rows.
        """
        columns = list(key)
        border = lambda side: F.struct(*(F.col(f"{side}.`{c}`") for c in columns))
        wanted = F.struct(*(F.lit(v).alias(c) for c, v in key.items()))
        hit = self.borders.filter((border("first") <= wanted) & (wanted <= border("last")))
        if first_only:
            hit = hit.orderBy("part").limit(1)
        parts = [r.part for r in hit.select("part").collect()]  # one, or those that a key with more rows than a part spans
        rows = self._parts(parts, self.borders.filter(F.col("part").isin(parts)))
        for c, v in key.items():
            rows = rows.filter(F.col(f"`{c}`") == F.lit(v))
        return rows.drop("position")
