"""Versioned snapshots of a table: a reader sees the old rows or the new ones, never neither.

A snapshot is written whole under ``versions/<n>`` and becomes current when
the file ``pointers/<n>`` (with an optional ``-note``) is created, one atomic
step on any Hadoop file system.  Readers resolve the newest pointer once and
then read that version's files, which no later publish touches.  ``expire``
removes versions that have been out of date for a given time, so a reader has
that long to finish.  Numbers are claimed by exclusive creation: two writers
never share a version, and the higher number wins.  A writer that ends half
way leaves a version without a pointer, which no reader sees.
"""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Snapshot(NamedTuple):
    number: int
    path: str
    note: str
    published: float


def _path(spark: SparkSession, name: str):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(context._jsc.hadoopConfiguration())


def listed(spark: SparkSession, folder: str) -> list[tuple[str, float]]:
    """Names in a folder with the seconds at which they changed; empty where there is no folder."""
    path, store = _path(spark, folder)
    if not store.exists(path):
        return []
    return [(x.getPath().getName(), x.getModificationTime() / 1000) for x in store.listStatus(path)]


def created(spark: SparkSession, name: str) -> bool:
    """Creates an empty file; false if it was there."""
    path, store = _path(spark, name)
    store.mkdirs(path.getParent())
    return store.createNewFile(path)


def delete(spark: SparkSession, name: str) -> None:
    path, store = _path(spark, name)
    store.delete(path, True)


def _pointers(spark: SparkSession, root: str) -> list[Snapshot]:
    found = []
    for name, changed in listed(spark, f"{root}/pointers"):
        number, _, note = name.partition("-")
        if number.isdigit():
            found.append(Snapshot(int(number), f"{root}/versions/{number}", note, changed))
    return sorted(found)


def publish(df: DataFrame, root: str, note: str = "", partition_by: list[str] | None = None, options: dict[str, str] | None = None) -> Snapshot:
    """Writes ``df`` as the next version (with the writer's ``options``) and makes it current."""
    spark = df.sparkSession
    number = max([0, *(int(n) for n, _ in listed(spark, f"{root}/claims") if n.isdigit())]) + 1
    while not created(spark, f"{root}/claims/{number}"):
        number += 1
    path = f"{root}/versions/{number}"
    df.write.mode("overwrite").options(**(options or {})).partitionBy(*(partition_by or [])).parquet(path)
    created(spark, f"{root}/pointers/{number}" + (f"-{note}" if note else ""))
    return Snapshot(number, path, note, time.time())


def current(spark: SparkSession, root: str) -> Snapshot | None:
    """The newest published version."""
    found = _pointers(spark, root)
    return found[-1] if found else None


def read(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the version that is current now; later publishes do not change the frame."""
    snapshot = current(spark, root)
    if snapshot is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    return spark.read.parquet(snapshot.path)


def expire(spark: SparkSession, root: str, seconds: float) -> list[int]:
    """Removes versions that a newer one replaced ``seconds`` ago or more, and claims that old without a pointer."""
    found, now = _pointers(spark, root), time.time()
    gone = [old for old, new in zip(found, found[1:], strict=False) if now - new.published >= seconds]
    for old in gone:
        delete(spark, f"{root}/pointers/{old.number}" + (f"-{old.note}" if old.note else ""))
    kept = {s.number for s in found} - {s.number for s in gone}
    for name, claimed in listed(spark, f"{root}/claims"):
        # the highest number stays claimed, so that numbers never go down
        if name.isdigit() and int(name) not in kept and int(name) < max(kept, default=0) and now - claimed >= seconds:
            delete(spark, f"{root}/versions/{name}")
            delete(spark, f"{root}/claims/{name}")
    return [s.number for s in gone]
