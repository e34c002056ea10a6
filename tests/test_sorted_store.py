"""Rows stored in sort order: pages and lookups against the whole-table operators, and what they read."""

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.positions import with_positions
from cohortlens.operators import ranking
from cohortlens.plans.core_queries import scored_frame
from cohortlens.sources.sorted_store import SortedStore, write_sorted
from tests import helpers
from tests.conftest import SF_SMALL


def _rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def _metrics(df, name):
    """Sums of one metric of the Parquet scans of a collected frame."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(plan.plan())
            continue
        if kind == "FileSourceScanExec" and "/rows/versions/" in plan.relation().location().rootPaths().mkString(","):
            total += plan.metrics().get(name).get().value()
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


@pytest.mark.parametrize(("sort_by", "order"), [("risk", "desc"), ("risk", "asc"), ("score", "desc"), ("id", "asc")])
def test_stored_pages_equal_positions(spark, tmp_path, sort_by, order):
    rows = scored_frame(spark, SF_SMALL)
    keys = ranking.sort_keys(sort_by, order)
    write_sorted(rows, keys, str(tmp_path / "s"), rows_per_part=300)
    store = SortedStore(spark, str(tmp_path / "s"))
    numbered = with_positions(rows, keys)
    assert store.total() == rows.count()
    for page in (1, 7, 20, 10**6):
        got = ranking.stored_page(store, page, 50)
        at = got.first().page
        want = numbered.filter((F.col("position") > (at - 1) * 50) & (F.col("position") <= at * 50))
        assert _rows(got.select("row_key", "position")) == _rows(want.select("row_key", F.col("position").cast("int")))
        assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()
        assert 1 <= _metrics(ranking.stored_page(store, page, 50), "numFiles") <= 2


def test_lookup_reads_as_much_of_a_table_ten_times_as_large(spark, tmp_path):
    read = []
    for n in (2000, 20000):
        rows = [{"id": str(i // 3), "code_module": f"M{i % 3}", "code_presentation": f"P{i % 2}"} for i in range(n)]
        frame = helpers.scored_frame(spark, rows[:1]).select("*").drop("id", "code_module", "code_presentation", "row_key")
        ids = spark.range(n).select((F.col("id") / 3).cast("long").cast("string").alias("id"), F.concat(F.lit("M"), F.col("id") % 3).alias("code_module"), F.concat(F.lit("P"), F.col("id") % 2).alias("code_presentation"))
        path = str(tmp_path / str(n))
        write_sorted(ids.crossJoin(F.broadcast(frame)), [F.col(c) for c in ranking.TIE_KEYS], path, ranking.TIE_KEYS, rows_per_part=500)
        store = SortedStore(spark, path)
        found = ranking.stored_lookup(store, "77", "M1")
        assert [(r.id, r.code_module) for r in found.collect()] == [("77", "M1")]
        read.append((_metrics(ranking.stored_lookup(store, "77", "M1"), "numFiles"), store.borders.count()))
        assert _metrics(ranking.stored_lookup(store, "77", "M1"), "numOutputRows") <= 1000
    assert read[0][0] == read[1][0] == 1 and read[1][1] >= 8 * read[0][1]


def test_lookup_edge_cases(spark, tmp_path):
    rows = [{"id": i, "code_module": m, "code_presentation": p} for i in ("5", "", None, "7", "70") for m in ("M1", "M2", None) for p in ("a", "b")]
    rows += [{"id": "7", "code_module": "M3", "code_presentation": f"p{i:02}"} for i in range(40)]  # one student spans parts
    frame = helpers.scored_frame(spark, rows)
    write_sorted(frame, [F.col(c) for c in ranking.TIE_KEYS], str(tmp_path / "s"), ranking.TIE_KEYS, rows_per_part=7)
    store = SortedStore(spark, str(tmp_path / "s"))
    for args in (("5",), ("7",), ("7", "M3"), ("7", "M3", "p33"), ("7", None, "p21"), ("7", None, "b"), ("70", "M2"), ("6",), ("7", "M9"), ("",), ("zz",)):
        assert _rows(ranking.stored_lookup(store, *args)) == _rows(ranking.student_lookup(frame, *args)), args
    write_sorted(frame.limit(0), [F.col("id")], str(tmp_path / "e"), ["id"])
    empty = SortedStore(spark, str(tmp_path / "e"))
    assert empty.total() == 0 and ranking.stored_page(empty, 3).count() == 0 and ranking.stored_lookup(empty, "5").count() == 0
    with pytest.raises(FileNotFoundError):
        SortedStore(spark, str(tmp_path / "none"))


def test_a_reader_keeps_its_version(spark, tmp_path):
    root = str(tmp_path / "s")
    write_sorted(spark.range(10).toDF("k"), [F.col("k")], root, ["k"])
    store = SortedStore(spark, root)
    write_sorted(spark.range(3).toDF("k"), [F.col("k")], root, ["k"])
    assert store.total() == 10 and store.slice(8, 5).count() == 2 and SortedStore(spark, root).total() == 3
