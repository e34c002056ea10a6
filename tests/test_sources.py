"""Size-checked broadcast, input spreading, shared folders, number text and its read-back."""

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.expressions import fixed, float_text
from cohortlens.functions.joins import bounded_broadcast, planned_bytes
from cohortlens.session import scratch_path, shared_checkpoint_dir
from cohortlens.sources import io
from cohortlens.sources.io import spread_input


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_broadcast_only_within_the_bytes(spark, tmp_path):
    facts = spark.range(0, 5000, numPartitions=4).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    spark.range(0, 50, numPartitions=3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")).write.parquet(str(tmp_path / "dim"))
    dim = spark.read.parquet(str(tmp_path / "dim"))
    bound = planned_bytes(dim)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "BroadcastHashJoin" in _plan(facts.join(bounded_broadcast(dim, bound), "k"))
        assert bounded_broadcast(dim, bound - 1) is dim
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_size_check_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("size-check", "")
    bounded_broadcast(spark.range(0, 100_000, numPartitions=6).filter(F.col("id") % 7 != 0))
    assert not tracker.getJobIdsForGroup("size-check")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_unset_checkpoint_folder_is_an_error_on_a_cluster(spark):
    class Conf:
        def get(self, key, default):
            return default

    class Cluster:
        conf, sparkContext = Conf(), type("C", (), {"master": "yarn"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_checkpoint_dir(Cluster())


def test_scratch_paths_are_new_and_under_the_shared_folder(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(shared_checkpoint_dir(spark) + "/cohortlens-")


def test_float_text_is_pythons(spark):
    values = [0.0, -0.0, 1.0, 12345678.0, 1e7, 123456789.125, 9999999999999998.0, 1e16, 1.5e17, 0.001, 0.0005, 0.0001, 0.00009, 1.5e-5, -2.5e-7, 1e100, 3e-101, float("nan"), float("inf"), -float("inf"), 0.1, 100.25]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", float_text(F.col("v")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: str(v) for i, v in enumerate(values)}
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS v").select(float_text(F.col("v")).alias("t")).first().t is None


def test_fixed_is_pythons_half_even(spark):
    values = [0.5, 1.5, 2.5, 0.125, 0.375, -0.5, 1234567.891, 0.0, 2.675]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2):
        got = {r.v: r.t for r in df.select("v", fixed(F.col("v"), digits).alias("t")).collect()}
        assert {v: t.lstrip("-") for v, t in got.items()} == {v: f"{abs(v):.{digits}f}" for v in values}


def test_read_back_of_bad_numbers(spark):
    """NaN, overflow and text take the default; a row with an infinite whole number is skipped."""
    bad = ["nan", "1e30", "3000000000", "x", "", None, "-7.9", "2"]
    columns = [f"info_{c}" for c in io.INFO_TEXT + io.INFO_FLOAT + io.INFO_INT]
    rows = [(f"{i}|m|p", *["1"] * len(io.INFO_TEXT + io.INFO_FLOAT), *[v] * len(io.INFO_INT), "2") for i, v in enumerate(bad)]
    rows += [("90|m|p", *["1"] * len(io.INFO_TEXT), *["inf"] * len(io.INFO_FLOAT), *["1"] * len(io.INFO_INT), "nan")]
    rows += [("91|m|p", *["1"] * (len(columns) - 1), "inf", "1"), ("92|m|p", *["1"] * len(columns), "-Infinity")]
    store = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ["row_key", *columns, "prediction_risk_tier"]))
    got = {r.id: r for r in io.predictions_readback(store).collect()}
    assert sorted(got) == ["0", "1", "2", "3", "4", "5", "6", "7", "90"]
    assert [got[str(i)].active_days for i in range(8)] == [0, 0, 0, 0, 0, 0, -7, 2]
    assert got["0"].imd_band_encoded == -1 and got["90"].risk == 0 and got["90"].clicks == float("inf")


def test_spread_input_only_for_under_split_scans(spark):
    wide = spark.range(0, 1000, numPartitions=16)
    assert spread_input(wide, "id", min_partitions=8) is wide
    narrow = spark.range(0, 1000, numPartitions=1)
    spread = spread_input(narrow, "id", min_partitions=8)
    assert spread.rdd.getNumPartitions() == 8
    assert sorted(r.id for r in spread.collect()) == list(range(1000))


def test_scale_conf_sizes_partitions_to_the_input():
    from cohortlens.session import MAX_SHUFFLE_PARTITIONS, scale_conf

    tb = 1024**4
    big = scale_conf(100 * tb, total_cores=8000)
    assert int(big["spark.sql.shuffle.partitions"]) == MAX_SHUFFLE_PARTITIONS  # 102,400 GiB, capped
    mid = scale_conf(10 * tb, total_cores=2000)
    assert int(mid["spark.sql.shuffle.partitions"]) == 10 * 1024
    small = scale_conf(1024**3, total_cores=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16  # two waves over the cores
    assert big["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == big["spark.sql.shuffle.partitions"]
    assert int(scale_conf(100 * tb, 8000, max_shuffle_partitions=200_000)["spark.sql.shuffle.partitions"]) == 102_400
