"""Tables of epoch-keyed updates: one folder for each micro-batch, folded now and then.

A micro-batch writes its rows to ``epoch=<id>``; writing the same epoch again
replaces that folder, so a replayed batch changes nothing.  ``fold`` publishes
the rows of the older epochs as one snapshot (``sources/snapshots``): readers
take the current snapshot and the epochs behind it, so they see every row once
at any moment, also if folding breaks off.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.sources import snapshots


def numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the entries ``prefix<number>`` of a folder, in order."""
    return sorted(int(n.removeprefix(prefix)) for n, _ in snapshots.listed(spark, folder) if n.startswith(prefix))


class EpochTable:
    """Rows of ``schema`` under ``folder``; ``partition_by`` names columns that readers prune by."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, partition_by: tuple[str, ...] = ()):
        self.spark, self.folder, self.schema, self.partition_by = spark, folder, schema, list(partition_by)

    def _laid_out(self, rows: DataFrame) -> DataFrame:
        rows = rows.select(*self.schema.names)
        return rows.repartition(*self.partition_by) if self.partition_by else rows

    def write(self, rows: DataFrame, epoch: int) -> None:
        """Replaces the epoch's rows."""
        self._laid_out(rows).write.mode("overwrite").partitionBy(*self.partition_by).parquet(f"{self.folder}/epoch={epoch}")

    def epochs(self) -> list[int]:
        return numbers(self.spark, self.folder, "epoch=")

    def _of(self, epochs: list[int]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("epoch", T.IntegerType())])
        if not epochs:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", self.folder).parquet(*(f"{self.folder}/epoch={e}" for e in epochs))
        return rows.select(*schema.names)

    def epoch(self, epoch: int) -> DataFrame:
        return self._of([epoch])

    def _base(self) -> tuple[snapshots.Snapshot | None, int]:
        base = snapshots.current(self.spark, f"{self.folder}/folded")
        return base, int(base.note) if base and base.note else -1

    def rows(self, upto: int | None = None) -> DataFrame:
        """All rows with their ``epoch``, those of later epochs than ``upto`` left out; rows from the start have epoch -1."""
        base, through = self._base()
        later = self._of([e for e in self.epochs() if e > through and (upto is None or e <= upto)])
        if base is None:
            return later
        folded = self.spark.read.schema(self.schema).parquet(base.path)
        return folded.select(*self.schema.names, F.lit(through).alias("epoch")).union(later)

    def last(self) -> int:
        """The newest epoch, folded ones included; -1 before the first."""
        return max([self._base()[1], *self.epochs()])

    def _publish(self, rows: DataFrame, through: int) -> None:
        note = str(through) if through >= 0 else ""
        snapshots.publish(self._laid_out(rows), f"{self.folder}/folded", note, self.partition_by)

    def start(self, rows: DataFrame) -> None:
        """The rows that there are before the first epoch; a table that has been started stays as it is."""
        if self._base()[0] is None:
            self._publish(rows, -1)

    def fold(self, latest: Callable[[DataFrame], DataFrame], keep: int = 1, wait_seconds: float = 0.0) -> None:
        """Publishes ``latest(rows)`` of all epochs but the last ``keep`` as one snapshot; replaced folders go after ``wait_seconds``.

        ``keep`` is at least 1: the last epoch may be written again.
        """
        base, through = self._base()
        old = [e for e in self.epochs() if e > through]
        old = old[: len(old) - max(1, keep)]
        if len(old) >= 2 or (old and base is not None):
            self._publish(latest(self.rows(upto=old[-1])), old[-1])
            base, through = self._base()
        if base is not None and time.time() - base.published >= wait_seconds:
            for e in self.epochs():
                if e <= through:
                    snapshots.delete(self.spark, f"{self.folder}/epoch={e}")
        snapshots.expire(self.spark, f"{self.folder}/folded", wait_seconds)
