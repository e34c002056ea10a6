"""Hand-computed edge cases for the operators (small literal frames)."""

import math

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.expressions import imd_band_code, outcome_label, risk_tier, week_index
from cohortlens.operators import cohort, features, ranking, stats
from tests.helpers import raw, scored_frame


def test_imd_band_codes(spark):
    df = spark.createDataFrame([("",), (None,), ("10-20",), ("90-100%",)], "imd_band string")
    got = [r[0] for r in df.select(imd_band_code(F.col("imd_band"))).collect()]
    assert got == [None, None, 1, 9]  # the feature table zero-fills the nulls


def test_missing_result_counts_as_dropout(spark):
    df = spark.createDataFrame([(None,), ("Pass",), ("Distinction",), ("Fail",)], "r string")
    assert [r[0] for r in df.select(outcome_label(F.col("r"))).collect()] == [1, 0, 0, 1]


def _assessment_tables(spark, scores, weights):
    assessments = raw(spark, "assessments", [
        {"code_module": "M", "code_presentation": "P", "id_assessment": i, "assessment_type": "TMA", "date": 10,
         "weight": w}
        for i, w in enumerate(weights)
    ])
    subs = raw(spark, "student_assessment", [
        {"id_assessment": i, "id_student": 1, "date_submitted": 5, "is_banked": 0, "score": s}
        for i, s in enumerate(scores)
    ])
    return features.assessment_features(subs, assessments).collect()[0]


def test_weighted_score_counts_null_score_weight(spark):
    row = _assessment_tables(spark, [None, 50.0], [10.0, 10.0])
    assert row.weighted_avg_score == pytest.approx(25.0)
    assert row.avg_score == pytest.approx(50.0)


def test_weighted_score_null_without_positive_weight(spark):
    row = _assessment_tables(spark, [40.0, 50.0], [0.0, 0.0])
    assert row.weighted_avg_score is None


def test_submission_rate_not_clamped(spark):
    assessments = raw(spark, "assessments", [
        {"code_module": "M", "code_presentation": "P", "id_assessment": i, "assessment_type": "CMA", "weight": 1.0}
        for i in range(7)
    ])
    subs = raw(spark, "student_assessment", [
        {"id_assessment": i % 7, "id_student": 1, "is_banked": 0, "score": 60.0} for i in range(9)
    ])
    row = features.assessment_features(subs, assessments).collect()[0]
    assert row.submission_rate == pytest.approx(9 / 7)


def _vle(spark, dates, length):
    clicks = raw(spark, "student_vle", [
        {"code_module": "M", "code_presentation": "P", "id_student": 1, "id_site": 1, "date": d, "sum_click": 1}
        for d in dates
    ])
    sites = raw(spark, "vle", [{"id_site": 1, "activity_type": "forumng"}])
    courses = raw(spark, "courses", [{"code_module": "M", "code_presentation": "P", "module_presentation_length": length}])
    return features.vle_features(clicks, sites, courses).collect()[0]


def test_weeks_floor_toward_minus_infinity(spark):
    row = _vle(spark, [-1, -7, -8, 0, 6, 7], 100)
    assert row.active_days == 6 and row.active_weeks == 4
    got = [r[0] for r in spark.createDataFrame([(d,) for d in [-1, -7, -8, 0, 6, 7]], "d int")
           .select(week_index(F.col("d"))).collect()]
    assert got == [-1, -1, -2, 0, 0, 1]


@pytest.mark.parametrize("length,expected", [(0, 0.0), (None, 0.0), (2, 1.0)])
def test_engagement_guard_and_clamp(spark, length, expected):
    row = _vle(spark, [1, 2, 3, 4, 5], length)
    assert row.engagement_ratio == pytest.approx(expected)
    assert row.forum_clicks == 5


def test_student_counted_once_with_worst_tier(spark):
    df = scored_frame(spark, [{"id": "7", "risk": 0, "code_module": "A"}, {"id": "7", "risk": 3, "code_module": "B"},
                              {"id": "7", "risk": 1, "code_module": "C"}])
    row = cohort.tier_summary(df).collect()[0]
    assert (row.unique_students, row.critical, row.safe, row.watch) == (1, 1, 0, 0)


def test_two_averages(spark):
    df = scored_frame(spark, [{"id": "1", "score": 10.0}, {"id": "2", "score": 20.0, "code_module": "A"},
                              {"id": "2", "score": 40.0, "code_module": "B"}])
    assert cohort.per_student_means(df).collect()[0].avg_score == pytest.approx(20.0)
    assert cohort.cohort_health(df).collect()[0].avg_score == pytest.approx(70 / 3)


def test_constant_field_correlation_is_zero(spark):
    df = scored_frame(spark, [{"clicks": 5.0, "score": float(i)} for i in range(5)])
    corr = {(r.feature_x, r.feature_y): r.r for r in stats.feature_correlation(df, ["clicks", "score", "active_days"]).collect()}
    assert corr[("clicks", "score")] == 0.0


def test_correlation_matches_numpy_on_pairwise_rows(spark):
    import numpy as np

    xs = [1.0, 2.0, 3.0, 4.0, 5.0]
    ys = [2.0, 1.0, 4.0, 3.0, 7.0]
    rows = [{"clicks": x, "score": y} for x, y in zip(xs, ys)] + [{"clicks": 9.0, "score": -1.0}]
    corr = stats.feature_correlation(scored_frame(spark, rows), ["clicks", "score"]).collect()[0].r
    assert corr == pytest.approx(np.corrcoef(xs, ys)[0, 1])


def test_histogram_all_equal_values_in_first_bucket(spark):
    df = scored_frame(spark, [{"clicks": 3.0} for _ in range(4)])
    rows = stats.feature_histogram(df, ["clicks"]).collect()
    counts = [r.safe for r in rows]
    assert counts[0] == 4 and sum(counts) == 4
    assert rows[0].bucket_lo == 3.0 and rows[-1].bucket_hi == pytest.approx(4.0)


def test_score_100_in_last_bucket(spark):
    df = scored_frame(spark, [{"score": 100.0, "risk": 3}])
    rows = {r.bucket: r for r in cohort.score_distribution(df).collect()}
    assert len(rows) == 10 and rows[9].crit == 1 and rows[9].label == "90–100"


@pytest.mark.parametrize(
    "withdrew,label,score,rate,clicks,early,expected",
    [
        (1, 0, 90.0, 1.0, 100, 0.0, 3),
        (0, 1, 39.9, 1.0, 100, 0.0, 3),
        (0, 1, 90.0, 0.24, 100, 0.0, 3),
        (0, 1, 90.0, 1.0, 9, 0.0, 3),
        (0, 1, 90.0, 1.0, 100, 0.0, 2),
        (0, 0, 59.0, 1.0, 100, 0.0, 1),
        (0, 0, 90.0, 0.59, 100, 0.0, 1),
        (0, 0, 90.0, 1.0, 100, -7.1, 1),
        (0, 0, 90.0, 1.0, 100, -7.0, 0),
    ],
)
def test_tier_rules(spark, withdrew, label, score, rate, clicks, early, expected):
    df = spark.createDataFrame(
        [(withdrew, label, score, rate, clicks, early)], "w int, l int, s double, r double, c long, e double"
    )
    tier = df.select(risk_tier(F.col("s"), F.col("c"), F.col("r"), F.col("e"), F.col("w"), F.col("l"))).collect()[0][0]
    assert tier == expected


def test_empty_cohort_gives_zeros(spark):
    df = scored_frame(spark, [{}]).limit(0)
    row = cohort.cohort_health(df).collect()[0]
    assert row.enrollments == 0 and row.withdrawal_rate == 0.0 and row.avg_score == 0.0


@pytest.mark.parametrize("page,expected", [(0, 1), (1, 1), (3, 3), (99, 3)])
def test_page_is_clamped(page, expected):
    assert ranking.page_bounds(120, page, 50) == (expected, 3)
    assert ranking.page_bounds(0, page, 50) == (1, 1)


def test_search_is_literal(spark):
    df = scored_frame(spark, [{"id": "a%b"}, {"id": "axb"}, {"id": "a_b"}])
    assert {r.id for r in ranking.student_search(df, "%").collect()} == {"a%b"}
    assert {r.id for r in ranking.student_search(df, "_").collect()} == {"a_b"}


def test_representative_row_worst_then_lowest_score(spark):
    df = scored_frame(spark, [
        {"id": "5", "risk": 2, "score": 10.0, "code_module": "A"},
        {"id": "5", "risk": 3, "score": 50.0, "code_module": "B"},
        {"id": "5", "risk": 3, "score": 40.0, "code_module": "C"},
    ])
    row = ranking.representative_row(df).collect()[0]
    assert (row.risk, row.code_module, row.score) == (3, "C", 40.0)


def test_sort_by_risk_tie_rules(spark):
    df = scored_frame(spark, [{"id": "1", "risk": 3, "score": 50.0}, {"id": "2", "risk": 3, "score": 10.0},
                              {"id": "3", "risk": 1, "score": 5.0}])
    desc = [r.id for r in ranking.student_sort(df, "risk", "desc").collect()]
    asc = [r.id for r in ranking.student_sort(df, "risk", "asc").collect()]
    assert desc == ["2", "1", "3"] and asc == ["3", "1", "2"]


def test_percent_format_matches_python(spark):
    from cohortlens.functions.expressions import fixed

    values = [7.125, 2.675, 0.125, 12.5, -0.04, 1234.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(fixed(F.col("v"), 2)).collect()]
    assert got == [f"{v:.2f}" for v in values]
    assert not math.isnan(values[0])


def test_tier_clamp_of_text_and_numbers(spark):
    from cohortlens.functions.expressions import clamp_tier

    cases = [("2.7", 2), ("abc", 0), ("-1", 0), ("7", 3), ("1e20", 3), (None, 0), ("NaN", 0), ("3", 3), ("0.4", 0)]
    df = spark.createDataFrame([(v,) for v, _ in cases], "risk string")
    got = [r.t for r in df.select(clamp_tier(F.col("risk")).alias("t")).collect()]
    assert got == [want for _, want in cases]
    ints = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 5, -2, None)], "risk int")
    assert [r.t for r in ints.select(clamp_tier(F.col("risk")).alias("t")).collect()] == [0, 1, 2, 3, 3, 0, 0]
