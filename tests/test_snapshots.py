"""Versioned snapshots and epoch tables: what a reader sees while a writer works or breaks off."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.sources import io, snapshots
from cohortlens.streaming import epochs
from cohortlens.streaming.epochs import EpochTable
from tests.helpers import scored_frame

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType())])


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def latest(rows):
    return rows.groupBy("k").agg(F.max_by("v", "epoch").alias("v"))


def test_reader_between_write_and_switch_sees_the_old_rows(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, root)
    io.publish_predictions(scored_frame(spark, [{"score": 10.0}, {"score": 20.0}]), root)
    before = io.published_predictions(spark, root)
    assert before.count() == 2

    seen = []
    make = snapshots.created

    def between(session, name):
        if "/pointers/" in name:  # the new version is written, its pointer is not
            seen.append(io.published_predictions(spark, root).count())
        return make(session, name)

    monkeypatch.setattr(snapshots, "created", between)
    io.publish_predictions(scored_frame(spark, [{"score": 30.0}]), root)
    assert seen == [2] and before.count() == 2 and io.published_predictions(spark, root).count() == 1

    # a writer that ends before the switch changes nothing for readers, and its number is not used again
    monkeypatch.setattr(snapshots, "created", lambda session, name: 1 / 0 if "/pointers/" in name else make(session, name))
    with pytest.raises(ZeroDivisionError):
        io.publish_predictions(scored_frame(spark, []), root)
    monkeypatch.setattr(snapshots, "created", make)
    assert io.published_predictions(spark, root).count() == 1
    io.publish_predictions(scored_frame(spark, [{}, {}, {}]), root)
    assert snapshots.current(spark, root).number == 4

    assert snapshots.expire(spark, root, seconds=3600) == [] and before.count() == 2
    assert snapshots.expire(spark, root, seconds=0) == [1, 2]
    assert sorted(p.name for p in (tmp_path / "store" / "versions").iterdir()) == ["4"]
    assert io.published_predictions(spark, root).count() == 3


def test_two_writers_never_share_a_version(spark, tmp_path):
    root = str(tmp_path / "store")
    snapshots.created(spark, f"{root}/claims/1")  # another writer is at work
    assert snapshots.publish(spark.range(1), root).number == 2


def test_epoch_table_replays_folds_and_survives_a_failed_fold(spark, tmp_path, monkeypatch):
    table = EpochTable(spark, str(tmp_path / "t"), SCHEMA, ())
    assert table.rows().count() == 0 and table.last() == -1
    for e in range(4):
        table.write(spark.createDataFrame([(1, e), (10 + e, e)], SCHEMA), e)
    table.write(spark.createDataFrame([(1, 3), (13, 3)], SCHEMA), 3)  # replayed
    want = [(1, 3), (10, 0), (11, 1), (12, 2), (13, 3)]
    assert _rows(latest(table.rows())) == want
    assert _rows(latest(table.rows(upto=1))) == [(1, 1), (10, 0), (11, 1)]

    make = snapshots.created
    monkeypatch.setattr(snapshots, "created", lambda session, name: 1 / 0 if "/pointers/" in name else make(session, name))
    with pytest.raises(ZeroDivisionError):
        table.fold(latest)
    monkeypatch.setattr(snapshots, "created", make)
    assert _rows(latest(table.rows())) == want and len(table.epochs()) == 4

    monkeypatch.setattr(epochs.snapshots, "delete", lambda *a: None)  # ends before old folders are removed
    table.fold(latest)
    assert len(table.epochs()) == 4 and _rows(latest(table.rows())) == want
    monkeypatch.undo()
    table.fold(latest)
    assert table.epochs() == [3] and _rows(latest(table.rows())) == want and table.last() == 3
    table.write(spark.createDataFrame([(1, 4)], SCHEMA), 4)
    table.fold(latest)
    assert table.epochs() == [4] and _rows(latest(table.rows())) == [(1, 4), *want[1:]]


def test_old_folders_stay_for_readers(spark, tmp_path):
    table = EpochTable(spark, str(tmp_path / "t"), SCHEMA, ())
    for e in range(3):
        table.write(spark.createDataFrame([(e, e)], SCHEMA), e)
    reader = table.rows()
    table.fold(latest, wait_seconds=3600)
    assert table.epochs() == [0, 1, 2] and _rows(reader.select("k", "v")) == _rows(latest(table.rows()))
