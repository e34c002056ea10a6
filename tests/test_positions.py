"""Distributed positions and deep pages against the top-k path."""

from pyspark.sql import functions as F

from cohortlens.functions.positions import with_positions
from cohortlens.operators import ranking
from tests.helpers import scored_frame


def _scored(spark):
    rows = []
    for i in range(240):
        rows.append(
            {
                "id": str(i % 70),
                "id_student": i % 70,
                "code_module": f"M{i % 3}",
                "code_presentation": f"{2000 + i % 4}J",
                "clicks": float((i * 37) % 53),
                "score": None if i % 11 == 0 else float((i * 13) % 97),
                "risk": i % 4,
            }
        )
    return scored_frame(spark, rows).repartition(7)


def test_positions_are_dense_and_follow_the_order(spark):
    df = _scored(spark)
    keys = ranking.sort_keys("clicks", "desc")
    got = [r.row_key for r in with_positions(df, keys, n_partitions=5).orderBy("position").collect()]
    want = [r.row_key for r in df.orderBy(*keys).collect()]
    assert got == want
    positions = sorted(r.position for r in with_positions(df, keys, n_partitions=5).select("position").collect())
    assert positions == list(range(1, df.count() + 1))


def test_deep_pages_equal_top_k_pages(spark):
    df = _scored(spark)
    for sort_by, order in (("risk", "desc"), ("score", "asc"), ("clicks", "desc")):
        for page in (1, 2, 5, 10, 99):
            shallow = ranking.student_page(df, page=page, page_size=25, sort_by=sort_by, order=order)
            deep = ranking.student_page(df, page=page, page_size=25, sort_by=sort_by, order=order, topk_rows=0)
            cols = ["row_key", "position", "page", "total_pages", "total_records"]
            a = [tuple(r) for r in shallow.select(*cols).orderBy("position").collect()]
            b = [tuple(r) for r in deep.select(*cols).orderBy("position").collect()]
            assert a == b, (sort_by, order, page)
            assert a, "a clamped page is never empty"


def test_deep_page_plan_has_no_single_task_merge(spark):
    df = _scored(spark)
    page = ranking.student_page(df, page=3, page_size=25, topk_rows=0)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "GlobalLimit" not in plan
    assert page.filter(F.col("position") <= 50).count() == 0


def test_positions_stay_dense_with_fully_tied_rows(spark):
    # Duplicated enrollment keys (fan-out of duplicate source rows) tie on every sort key.
    df = spark.range(0, 600, numPartitions=6).select(
        (F.col("id") % 7).cast("string").alias("id"),
        F.lit("M1").alias("code_module"),
        F.lit("2000J").alias("code_presentation"),
        (F.col("id") % 3).cast("double").alias("clicks"),
    )
    keys = ranking.sort_keys("clicks", "desc")
    rows = with_positions(df, keys, n_partitions=4).collect()
    assert sorted(r.position for r in rows) == list(range(1, 601))
    ordered = [(r.clicks, r.id) for r in sorted(rows, key=lambda r: r.position)]
    assert ordered == sorted(ordered, key=lambda t: (-t[0], t[1]))
