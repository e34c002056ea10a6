"""The scored refresh: every batch against the batch job, replay, folding, restart."""

import re

import pytest

from cohortlens.operators import cohort, cube, ranking
from cohortlens.operators.features import feature_table
from cohortlens.operators.scoring import scored
from cohortlens.plans.core_queries import cube_frame, scored_frame, tables
from cohortlens.session import RELEASE
from cohortlens.sources.schemas import SCHEMAS
from cohortlens.streaming import scored_refresh
from cohortlens.streaming.epochs import EpochTable
from tests import helpers
from tests.conftest import SF_SMALL


def _rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_each_batch_equals_the_batch_job(spark, tmp_path):
    t = tables(spark, SF_SMALL)
    t = {name: t[name].filter("id_student % 5 < 2") if "id_student" in t[name].columns else t[name] for name in t}
    columns = [f.name for f in SCHEMAS["student_vle"].fields]
    clicks = t["student_vle"].select(*columns).cache()
    source, out, checkpoint = (str(tmp_path / x) for x in ("clicks", "out", "checkpoint"))
    parts = [clicks.filter("id_student % 10 < 6"), clicks.filter("id_student % 10 >= 6"), clicks.filter("id_site % 3 = 0")]
    arrived = clicks.limit(0)
    for i, part in enumerate(parts):
        arrived = arrived.union(part)
        part.coalesce(1).write.mode("append").parquet(source)
        scored_refresh.start_scored_refresh(spark, source, t, out, checkpoint, buckets=4).awaitTermination()
        tables_ = scored_refresh.refreshed(spark, out, t["courses"])
        want = scored(feature_table({**t, "student_vle": arrived}))
        assert _rows(tables_.current_scored()) == _rows(want)
        assert _rows(tables_.current_summary()) == _rows(cohort.tier_summary(want))
        assert tables_.version() == i
    refresh = scored_refresh.ScoredRefresh(spark, f"{out}/generation=0", t["courses"], buckets=4)
    only = refresh.scored.epoch(1).select("id_student").distinct()
    assert only.filter("id_student % 10 < 6").count() == 0  # a batch writes its own enrollments alone

    before = refresh.current_scored(1)
    again = refresh.days.epoch(2).drop("bucket", "epoch")
    again = spark.createDataFrame(again.collect(), again.schema)
    refresh.apply(again, 2)  # replayed
    assert _rows(refresh.current_scored()) == _rows(want) and _rows(refresh.current_summary()) == _rows(cohort.tier_summary(want))
    old = scored(feature_table({**t, "student_vle": parts[0].union(parts[1])}))
    assert _rows(before) == _rows(old) and _rows(refresh.current_summary(1)) == _rows(cohort.tier_summary(old))

    refresh.fold()
    assert refresh.scored.epochs() == [2] and refresh.version() == 2
    assert _rows(refresh.current_scored()) == _rows(want) and _rows(refresh.current_summary()) == _rows(cohort.tier_summary(want))
    refresh.apply(again, 2)
    assert _rows(refresh.current_scored()) == _rows(want) and _rows(refresh.current_summary()) == _rows(cohort.tier_summary(want))

    # an epoch whose summary is missing has not happened yet
    refresh.scored.write(refresh.scored.epoch(2), 7)
    assert refresh.version() == 2 and _rows(refresh.current_scored()) == _rows(want)


def test_a_batch_without_changes(spark, tmp_path):
    t = tables(spark, SF_SMALL)
    refresh = scored_refresh.ScoredRefresh.begin(spark, str(tmp_path / "g"), t, buckets=2)
    first = _rows(refresh.current_summary())
    empty = refresh.days.rows().drop("bucket", "epoch")
    refresh.apply(empty, 0)
    assert refresh.version() == 0 and _rows(refresh.current_summary()) == first
    want = scored(feature_table({**t, "student_vle": t["student_vle"].limit(0)}))
    assert _rows(refresh.current_scored()) == _rows(want)


def test_the_stream_leaves_no_state_and_no_shuffle_files(spark, tmp_path, monkeypatch):
    t = tables(spark, SF_SMALL)
    source, out, checkpoint = (str(tmp_path / x) for x in ("clicks", "out", "checkpoint"))
    clicks = t["student_vle"].select(*(f.name for f in SCHEMAS["student_vle"].fields)).filter("id_student % 10 = 1").coalesce(1)
    clicks.write.parquet(source)
    asked, write = [], EpochTable.write
    monkeypatch.setattr(EpochTable, "write", lambda self, rows, epoch: asked.append(rows.sparkSession.conf.get(RELEASE)) or write(self, rows, epoch))
    scored_refresh.start_scored_refresh(spark, source, t, out, checkpoint, buckets=2).awaitTermination()
    assert asked == ["true"] * 3 and spark.conf.get(RELEASE) == "false"
    assert not (tmp_path / "checkpoint" / "state").exists()


# ---------------------------------------------------------------- the cube


@pytest.mark.parametrize("modules", [["M1"], ["M2", "M5"], [], ["none"]])
def test_cube_equals_the_rows(spark, modules):
    rows = ranking.visible_rows(scored_frame(spark, SF_SMALL), modules)
    cells = cube_frame(spark, SF_SMALL)
    got = cube.payload_summary(cells, modules).first()
    want = cohort.tier_summary(rows).first()
    assert {k: got[k] for k in want.asDict()} == want.asDict() and got.enrollments == rows.count()
    for tiers, withdrew, presentation in (([2, 3], 0, None), ([1], None, "1995J"), (None, 1, None)):
        some = ranking.student_filter(rows, presentation=presentation, tiers=tiers, withdrew=withdrew)
        got = cube.payload_summary(cells, modules, presentation, tiers, withdrew).first()
        want = cohort.filtered_summary(some).first()
        assert (got.enrollments, got.unique_students, got.safe, got.watch, got.high_risk, got.critical) == (
            want.enrollments, want.unique_students, want.safe, want.watch, want.high, want.critical,
        )


def test_cube_reads_no_scored_row(spark):
    summary = cube.payload_summary(cube_frame(spark, SF_SMALL), ["M1"])
    files = summary.inputFiles()
    assert files and all("/cube-" in f for f in files)
    assert re.search(r"PartitionFilters: \[[^\]]*code_module", summary._jdf.queryExecution().executedPlan().toString())


def test_cube_edge_cases(spark):
    rows = [{"id": "a", "risk": 3, "code_module": None}, {"id": "a", "risk": 0}, {"id": "", "risk": 2}, {"id": None, "risk": 9}, {"id": "b", "risk": None}, {"id": "c", "risk": -4, "withdrew_early": None}]
    frame = helpers.scored_frame(spark, rows)
    got = cube.payload_summary(cube.summary_cube(frame)).first()
    assert tuple(got) == (6, 3, 2, 0, 0, 1)
    assert tuple(cube.payload_summary(cube.summary_cube(frame), [""]).first()) == (1, 1, 0, 0, 0, 1)
    assert tuple(cube.payload_summary(cube.summary_cube(frame.limit(0))).first()) == (0,) * 6
    numbers = cube.student_numbers(frame).collect()
    assert sorted(r.number for r in numbers) == [1, 2, 3]
