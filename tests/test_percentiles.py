"""Exact distributed percentiles against numpy's linear interpolation."""

import numpy as np
import pytest

from cohortlens.functions.quantiles import exact_percentiles

PROBS = [0.01, 0.25, 0.5, 0.75, 0.99]


@pytest.mark.parametrize(("k", "margin"), [(8000, 0.0009), (100, 0.02), (8, 0.3)])
def test_matches_numpy_with_a_hot_group(spark, k, margin):
    rng = np.random.default_rng(7)
    # Group "hot" holds most rows and many ties; "cold" is small; "one" has one value.
    hot = rng.integers(0, 50, 3000).astype(float)
    cold = rng.normal(10, 3, 40)
    rows = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold] + [("one", 5.0)]
    rows += [("hot", None)]  # nulls are ignored
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.p): r.value for r in exact_percentiles(df, ["g"], "v", PROBS, k, margin).collect()}
    for g, vals in (("hot", hot), ("cold", cold), ("one", np.array([5.0]))):
        for p in PROBS:
            assert got[(g, p)] == pytest.approx(np.quantile(vals, p, method="linear"), rel=1e-12, abs=1e-12)


def test_matches_spark_percentile(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 1001).select((F.col("id") % 97).cast("double").alias("v"), (F.col("id") % 3).alias("g"))
    ours = {(r.g, r.p): r.value for r in exact_percentiles(df, ["g"], "v", [0.1, 0.9]).collect()}
    ref = df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.9))).alias("q")).collect()
    for r in ref:
        assert ours[(r.g, 0.1)] == pytest.approx(r.q[0]) and ours[(r.g, 0.9)] == pytest.approx(r.q[1])


@pytest.mark.parametrize(("k", "margin"), [(8, 0.3), (50, 0.05), (400, 0.001)])
def test_brackets_hold_ties_gaps_and_infinities(spark, k, margin):
    rng = np.random.default_rng(k)
    groups = {
        "ties": rng.choice([0.0, 0.0, 0.0, 1.0, 5.0], 3000),
        "constant": np.full(1000, 7.0),
        "wide": np.exp(rng.normal(0, 8, 3000)),
        "negative": -rng.integers(0, 3, 500).astype(float),
        "few": rng.normal(size=5),
        "steps": np.repeat(np.arange(40.0), 50),
        "infinite": np.concatenate([np.full(300, -np.inf), rng.normal(size=400), np.full(300, np.inf)]),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {(r.g, r.p): (r.value, r.n) for r in exact_percentiles(df, ["g"], "v", [0.0, *PROBS, 1.0], k, margin).collect()}
    for g, vs in groups.items():
        for p in [0.0, *PROBS, 1.0]:
            with np.errstate(invalid="ignore"):
                want = np.quantile(vs, p, method="linear")
            assert np.isnan(want) or got[(g, p)][0] == pytest.approx(want, rel=1e-12, abs=1e-12), (g, p)
            assert got[(g, p)][1] == len(vs)


def test_a_bracket_that_misses_its_rank_is_opened(spark, monkeypatch):
    from pyspark.sql import functions as F

    from cohortlens.functions import quantiles

    real = F.kll_sketch_get_quantile_double
    monkeypatch.setattr(quantiles.F, "kll_sketch_get_quantile_double", lambda sketch, edges: real(sketch, F.array(F.lit(0.3), F.lit(0.4))))
    rows = [("g", float(i)) for i in range(1, 1002)] + [("h", 5.0)] * 700 + [("nan", float("nan"))] * 600 + [("some", float("nan"))] * 300 + [("some", 1.0)] * 301
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.value for r in exact_percentiles(df, ["g"], "v", [0.9], sketch_k=100, margin=0.01).collect()}
    assert got["g"] == 901.0 and got["h"] == 5.0 and np.isnan(got["nan"]) and np.isnan(got["some"])


def test_slices_are_thin(spark, monkeypatch):
    from pyspark.sql import functions as F

    from cohortlens.functions import quantiles

    n = 400_000
    df = spark.range(n).select(F.rand(3).alias("v"), F.lit("g").alias("g")).repartition(4)
    seen = []
    real = quantiles._counted

    def watched(values, groups, brackets, ps):
        counts = real(values, groups, brackets, ps)
        seen.append(counts.filter("sv IS NOT NULL").agg(F.sum("c")).first()[0])
        return counts

    monkeypatch.setattr(quantiles, "_counted", watched)
    exact_percentiles(df, ["g"], "v", PROBS).collect()
    assert len(seen) == 1 and 0 < seen[0] < 0.01 * n


def test_empty_input(spark):
    assert exact_percentiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", PROBS).count() == 0
