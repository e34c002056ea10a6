"""Shuffles and stored forms behind the click features, the scored frame and the running totals."""

import pytest

from cohortlens.operators.features import activity_from_daily, vle_features
from tests.conftest import SF_SMALL
from tests.helpers import raw

DAYS = "id_student long, code_module string, code_presentation string, date int, clicks long, forum long, quiz long, resource long"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_day_rows_are_shuffled_once(spark):
    from cohortlens.sources.testdata import load_source_tables

    t = load_source_tables(spark, SF_SMALL)
    keyed = [line for line in _plan(vle_features(t["student_vle"], t["vle"], t["courses"])).splitlines() if "Exchange hashpartitioning(id_student" in line]
    assert len(keyed) == 2 and sum("date" in line for line in keyed) == 1


def test_weeks_of_any_span_are_counted_once(spark):
    # weeks -74, -1 (twice), 0, 63 (twice), 64, 128, 9142; a day that is not known counts as neither day nor week
    dates = [-515, -7, -1, 0, 441, 447, 448, 896, 64000, None]
    daily = spark.createDataFrame([(1, "A", "P", d, 2, 1, 1, None) for d in dates] + [(2, "A", "P", None, 5, 0, 0, 0), (None, "A", "P", 3, 1, 0, 0, 0)], DAYS)
    courses = raw(spark, "courses", [{"code_module": "A", "code_presentation": "P", "module_presentation_length": 10}])
    got = {r.id_student: r for r in activity_from_daily(daily, courses).collect()}
    assert (got[1].active_days, got[1].active_weeks, got[1].total_clicks, got[1].forum_clicks, got[1].resource_clicks) == (9, 7, 20, 10, None)
    assert (got[2].active_days, got[2].active_weeks, got[2].total_clicks) == (0, 0, 5)
    assert (got[None].active_days, got[None].active_weeks) == (1, 1)


def test_line_items_are_dealt_by_size(spark, monkeypatch):
    from cohortlens.sources import testdata

    plain = testdata.load_source_tables(spark, SF_SMALL)["student_vle"]
    monkeypatch.setattr(testdata, "LINE_BYTES", 1000)
    dealt = testdata.load_source_tables(spark, SF_SMALL)["student_vle"]
    lines = [line for line in _plan(dealt).splitlines() if "Exchange hashpartitioning(l_orderkey" in line]
    assert len(lines) == 1 and int(lines[0].split("), ")[0].rsplit(", ", 1)[1]) > 8
    assert plain.exceptAll(dealt).isEmpty() and dealt.count() == plain.count()


def test_scored_frame_and_running_totals_are_stored_as_files(spark):
    from cohortlens.functions.positions import running_totals
    from cohortlens.plans import core_queries

    core_queries.refresh(spark, SF_SMALL)
    for frame in (core_queries.scored_frame(spark, SF_SMALL), running_totals(spark.range(1000).selectExpr("id", "1 AS one"), "id", ["one"])):
        plan = _plan(frame)
        assert "ExistingRDD" not in plan and "parquet" in plan
    rows = running_totals(spark.range(1000).selectExpr("id", "1 AS one"), "id", ["one"]).collect()
    assert sorted((r.id, r.one_before) for r in rows) == [(i, i) for i in range(1000)]


@pytest.mark.parametrize(("rows", "shared", "whole"), [(0, 1, 1), (20_000, 1, 1), (104_000, 1, 5), (624_000, 3, 12), (6_000_000, 24, 24)])
def test_a_single_fit_gets_more_partitions(rows, shared, whole):
    from cohortlens.operators import ml

    assert (ml.fit_partitions(rows), ml.fit_partitions(rows, least=ml.FIT_PARTITIONS)) == (shared, whole)
