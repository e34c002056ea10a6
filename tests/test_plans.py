"""Plan shape of the registered queries (no execution needed beyond planning)."""

import pytest

from cohortlens.plans import REGISTRY
from tests.conftest import SF_SMALL

# Queries that train models or write files are checked elsewhere.
PLANNED = [n for n, q in REGISTRY.items() if q.oracle is not None and n not in ("stream_activity_refresh",)]
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_join_udf_or_sort_aggregate(spark, name):
    plan = _plan(REGISTRY[name].build(spark, SF_SMALL))
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plans {op}"
    # A sort-based aggregate is only acceptable as the minimum or maximum of a
    # text or of a struct holding texts, or the union of bitmaps (Spark cannot hash-aggregate such a
    # buffer), and then only with its map-side partial step, so a hot group is combined before
    # the shuffle instead of arriving in one task as raw rows.
    if "SortAggregate" in plan:
        assert any(f"partial_{x}" in plan for x in ("min(", "max(", "bitmap_")), f"{name} sort-aggregates without a partial step"


def test_stored_groups_are_assembled_without_an_exchange(spark):
    from cohortlens.sources import feature_groups

    from cohortlens.plans import core_queries

    REGISTRY["feature_table_stored"].build(spark, SF_SMALL)
    prefix = next(p for (_, folder), p in core_queries._GROUPS.items() if folder == SF_SMALL)
    plan = _plan(feature_groups.assemble_stored(spark, prefix))
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 3 and "Bucketed: true" in plan


def test_one_group_is_written_again(spark, tmp_path):
    from cohortlens.operators.features import feature_table
    from cohortlens.plans.core_queries import tables
    from cohortlens.sources import feature_groups

    t = tables(spark, SF_SMALL)
    feature_groups.store_groups(t, "again", str(tmp_path), buckets=4)
    fewer = {**t, "student_vle": t["student_vle"].filter("id_site % 2 = 0")}
    feature_groups.store_group(feature_groups.GROUPS["clicks"](fewer), "again_clicks", str(tmp_path / "clicks"), 4)
    got, want = feature_groups.assemble_stored(spark, "again"), feature_table(fewer)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    feature_groups.drop_groups(spark, "again")


def test_site_filter_reaches_the_scan(spark):
    from cohortlens.sources.testdata import load_source_tables

    plan = _plan(load_source_tables(spark, SF_SMALL)["vle"])
    assert "PushedFilters: [IsNotNull(p_size), LessThanOrEqual(p_size,45)" in plan


def test_click_features_broadcast_the_site_dimension(spark):
    from cohortlens.sources.testdata import load_source_tables
    from cohortlens.operators.features import vle_features

    t = load_source_tables(spark, SF_SMALL)
    plan = _plan(vle_features(t["student_vle"], t["vle"], t["courses"]))
    assert "BroadcastHashJoin" in plan and "BroadcastExchange" in plan


def test_correlation_multiplies_no_row(spark):
    # One block of Gram sums leaves each partition: nothing is generated below the first Python step.
    plan = _plan(REGISTRY["feature_correlation"].build(spark, SF_SMALL))
    lines = [line for line in plan.splitlines() if any(k in line for k in ("Generate", "Exchange", "MapInArrow"))]
    step = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    assert not any("Generate" in line or "Exchange" in line for line in lines[step + 1 :])


def test_a_hot_site_beyond_the_broadcast_bound_is_in_no_task_alone(spark):
    """Half of all clicks on one site, some without a site, some sites twice in the dimension: no partition over twice the median."""
    from pyspark.sql import functions as F

    from cohortlens.functions import joins

    n = 200_000
    site = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 20 == 1, None).otherwise(F.col("id") % 5000)
    fact = spark.range(n).repartition(8).select(site.cast("long").alias("id_site"), (F.col("id") % 9).alias("sum_click"))
    dim = spark.range(4000).union(spark.range(7, 9)).select(F.col("id").alias("id_site"), F.concat(F.lit("t"), F.col("id") % 3).alias("activity_type"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = joins.dimension_join(fact, dim, "id_site", max_bytes=0)
        plain = fact.join(dim, "id_site", "left")
        sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
        worst = sorted(r["count"] for r in plain.groupBy(F.spark_partition_id()).count().collect())
        same = got.groupBy("id_site", "activity_type", "sum_click").count().exceptAll(plain.groupBy("id_site", "activity_type", "sum_click").count())
        assert same.isEmpty() and got.count() == plain.count()
        inner = joins.dimension_join(fact, dim, "id_site", "inner", max_bytes=0)
        assert inner.count() == fact.join(dim, "id_site").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    median = sizes[len(sizes) // 2]
    assert sizes[-1] <= 2 * median < worst[-1]


def test_clicks_are_combined_per_enrollment_day_before_the_shuffle(spark):
    from cohortlens.operators.features import vle_features
    from cohortlens.sources.testdata import load_source_tables

    t = load_source_tables(spark, SF_SMALL)
    lines = _plan(vle_features(t["student_vle"], t["vle"], t["courses"])).splitlines()
    day_exchange = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line and "date" in line)
    assert "HashAggregate" in lines[day_exchange + 1] and "partial_sum(sum_click" in lines[day_exchange + 1]


def test_submissions_are_combined_per_enrollment_before_the_shuffle(spark):
    from cohortlens.operators.features import assessment_features
    from cohortlens.sources.testdata import load_source_tables

    t = load_source_tables(spark, SF_SMALL)
    lines = _plan(assessment_features(t["student_assessment"], t["assessments"])).splitlines()
    key_exchanges = [
        i for i, line in enumerate(lines)
        if "Exchange hashpartitioning(id_student" in line and "code_presentation" in line
    ]
    assert key_exchanges
    for i in key_exchanges:
        assert "HashAggregate" in lines[i + 1] and "partial_avg(score" in lines[i + 1]


def test_no_fact_is_shuffled_on_a_dimension_key(spark):
    """Without Spark's own broadcast threshold the checked hints alone keep facts in place."""
    from cohortlens.operators.features import assessment_features, score_by_type, vle_features
    from cohortlens.plans.core_queries import tables

    t = tables(spark, SF_SMALL)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plans = {
            "assessments": _plan(assessment_features(t["student_assessment"], t["assessments"])),
            "by type": _plan(score_by_type(t["student_assessment"], t["assessments"])),
            "clicks": _plan(vle_features(t["student_vle"], t["vle"], t["courses"])),
        }
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for name, plan in plans.items():
        for line in plan.splitlines():
            assert not ("Exchange hashpartitioning(id_assessment" in line or "Exchange hashpartitioning(id_site" in line), (name, line)
            assert not ("SortMergeJoin" in line and "code_module" in line and "id_student" not in line), (name, line)


def test_top_students_filter_below_the_aggregate(spark):
    plan = _plan(REGISTRY["top50_at_risk"].build(spark, SF_SMALL))
    lines = [line for line in plan.splitlines() if "Filter" in line or "partial_min(struct" in line]
    aggregate = next(i for i, line in enumerate(lines) if "partial_min(struct" in line)
    assert ">= 2" in lines[aggregate + 1]
    assert "gender" not in next(line for line in lines if "partial_min(struct" in line)


def test_refresh_reads_changed_files(spark, tmp_path):
    import os
    import shutil

    from cohortlens.plans import core_queries

    folder = str(tmp_path / "data")
    shutil.copytree(SF_SMALL, folder, copy_function=shutil.copyfile)
    os.chmod(folder, 0o755)
    before = core_queries.scored_frame(spark, folder).count()
    os.remove(f"{folder}/orders.parquet")
    spark.read.parquet(f"{SF_SMALL}/orders.parquet").filter("o_orderkey % 2 = 0").write.parquet(f"{folder}/orders.parquet")
    assert core_queries.scored_frame(spark, folder).count() == before
    core_queries.refresh(spark, folder)
    assert core_queries.scored_frame(spark, folder).count() < before
    core_queries.refresh(spark, folder)
