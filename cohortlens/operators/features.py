"""Per-enrollment feature table from the seven raw tables.

Every function is ``DataFrame(s) -> DataFrame`` and builds a lazy plan; the
caller decides when to run or persist it.  Grain of the result is one row per
enrollment ``(id_student, code_module, code_presentation)``.

Scale notes
-----------
* The click stream is the big table.  It is pre-aggregated to one row per
  enrollment-day (map-side partial aggregation before the first shuffle, so a
  hot enrollment collapses to one row per map task and day).  The day rows
  are then shuffled once more, on the enrollment, where the active weeks are
  bits of one long for each 64 weeks.  Neither days nor weeks need an
  ``Expand`` of the raw rows.
* Site, course and assessment dimensions and the per-module totals get a
  size-checked broadcast, so no submission or activity row is shuffled on one
  of their few hundred keys before it is aggregated.  Site and assessment
  dimensions beyond the bound are joined with their heavy keys apart
  (``dimension_join``).
* All feature groups end hash-partitioned on the enrollment keys, so the
  final left joins line up without re-shuffling the aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.expressions import (
    disability_code,
    imd_band_code,
    outcome_label,
    safe_ratio,
    week_index,
)
from cohortlens.functions.joins import bounded_broadcast, dimension_join
from cohortlens.sources.schemas import ENROLLMENT_KEYS

KEYS = ENROLLMENT_KEYS

# Activity types counted as forum, quiz and resource clicks.
FORUM_TYPES = ["forumng", "oucollaborate"]
QUIZ_TYPES = ["quiz", "questionnaire", "externalquiz"]
RESOURCE_TYPES = ["resource", "url", "page", "oucontent", "pdf", "html_activity"]

# The 20 model features, in model input order (fixed values).
FEATURE_COLUMNS = [
    "total_clicks", "active_days", "clicks_per_day",
    "forum_clicks", "quiz_clicks", "resource_clicks",
    "active_weeks", "engagement_ratio",
    "avg_score", "weighted_avg_score", "submission_rate", "avg_days_early",
    "exam_score", "tma_score", "cma_score",
    "withdrew_early", "days_before_start",
    "num_prev_attempts", "imd_band_encoded", "disability_encoded",
]

# Types of the click features.
CLICK_TYPES = {
    "total_clicks": "long", "active_days": "long", "active_weeks": "long",
    "forum_clicks": "long", "quiz_clicks": "long", "resource_clicks": "long",
    "clicks_per_day": "double", "engagement_ratio": "double",
}

DEMOGRAPHIC_COLUMNS = [
    "gender", "region", "highest_education", "imd_band",
    "age_band", "studied_credits", "disability", "final_result",
]


def _clicks_of(types: list[str]):
    return F.when(F.col("activity_type").isin(types), F.col("sum_click")).otherwise(F.lit(0))


def typed_clicks(student_vle: DataFrame, vle: DataFrame) -> DataFrame:
    """Click rows with their site's activity type."""
    clicks = student_vle.select(*KEYS, "id_site", "date", "sum_click")
    return dimension_join(clicks, vle.select("id_site", "activity_type"), "id_site")


def daily_clicks(typed: DataFrame) -> DataFrame:
    """One row per enrollment-day: total and per-category clicks."""
    return typed.groupBy(*KEYS, "date").agg(
        F.sum("sum_click").alias("clicks"),
        F.sum(_clicks_of(FORUM_TYPES)).alias("forum"),
        F.sum(_clicks_of(QUIZ_TYPES)).alias("quiz"),
        F.sum(_clicks_of(RESOURCE_TYPES)).alias("resource"),
    )


def activity_from_daily(daily: DataFrame, courses: DataFrame) -> DataFrame:
    """Enrollment click features from enrollment-day rows."""
    week = week_index(F.col("date"))
    # A day row reaches its enrollment's task once; there a group holds 64 weeks, not one.
    rows = daily.repartition(*KEYS).withColumns({"span": F.floor(week / 64), "bit": F.pmod(week, F.lit(64)).cast("int")})
    spans = rows.groupBy(*KEYS, "span").agg(
        F.sum("clicks").alias("clicks"),
        F.sum("forum").alias("forum"),
        F.sum("quiz").alias("quiz"),
        F.sum("resource").alias("resource"),
        F.count("date").alias("days"),
        F.expr("bit_count(bit_or(shiftleft(1L, bit)))").alias("weeks"),
    )
    per_enrollment = spans.groupBy(*KEYS).agg(
        F.sum("clicks").alias("total_clicks"),
        F.sum("days").alias("active_days"),
        F.coalesce(F.sum("weeks"), F.lit(0)).cast("long").alias("active_weeks"),
        F.sum("forum").alias("forum_clicks"),
        F.sum("quiz").alias("quiz_clicks"),
        F.sum("resource").alias("resource_clicks"),
    )
    length = bounded_broadcast(courses.select("code_module", "code_presentation", "module_presentation_length"))
    with_length = per_enrollment.join(length, ["code_module", "code_presentation"], "left")
    days = F.col("active_days")
    course_len = F.col("module_presentation_length")
    return with_length.select(
        *KEYS,
        "total_clicks",
        "active_days",
        "active_weeks",
        "forum_clicks",
        "quiz_clicks",
        "resource_clicks",
        F.when(days > 0, safe_ratio(F.col("total_clicks"), days)).otherwise(F.lit(0.0)).alias("clicks_per_day"),
        F.when(course_len.isNotNull() & (course_len > 0), F.least(safe_ratio(days, course_len), F.lit(1.0)))
        .otherwise(F.lit(0.0))
        .alias("engagement_ratio"),
    )


def vle_features(student_vle: DataFrame, vle: DataFrame, courses: DataFrame) -> DataFrame:
    """Click totals, activity days/weeks, per-category clicks and engagement."""
    return activity_from_daily(daily_clicks(typed_clicks(student_vle, vle)), courses)


def assessments_per_module(assessments: DataFrame) -> DataFrame:
    """Number of assessments defined per module presentation."""
    return assessments.groupBy("code_module", "code_presentation").agg(
        F.count("id_assessment").alias("total_assessments")
    )


def assessment_features(student_assessment: DataFrame, assessments: DataFrame) -> DataFrame:
    """Score averages, weighted score, timing, per-type scores, submission rate.

    Banked submissions are dropped first.  Module keys come from the
    assessment side, so submissions of unknown assessments group under null
    keys and disappear in the final join (as in the source pipeline).
    """
    submissions = student_assessment.filter(F.col("is_banked") == 0).select(
        "id_assessment", "id_student", "date_submitted", "score"
    )
    assessment = assessments.select("id_assessment", "code_module", "code_presentation", "weight", "date", "assessment_type")
    joined = dimension_join(submissions, assessment, "id_assessment")
    score, weight = F.col("score"), F.col("weight")
    scores = joined.groupBy(*KEYS).agg(
        F.avg(score).alias("avg_score"),
        # A null score adds nothing to the numerator but its weight still
        # counts in the denominator; no positive weight gives null.
        F.when(F.sum(weight) > 0, safe_ratio(F.sum(score * weight), F.sum(weight))).alias("weighted_avg_score"),
        F.count("id_assessment").alias("num_submitted"),
        F.avg(F.when(F.col("date_submitted").isNotNull(), F.col("date") - F.col("date_submitted"))).alias(
            "avg_days_early"
        ),
        F.avg(F.when(F.col("assessment_type") == "Exam", score)).alias("exam_score"),
        F.avg(F.when(F.col("assessment_type") == "TMA", score)).alias("tma_score"),
        F.avg(F.when(F.col("assessment_type") == "CMA", score)).alias("cma_score"),
    )
    totals = bounded_broadcast(assessments_per_module(assessments))
    total = F.col("total_assessments")
    return scores.join(totals, ["code_module", "code_presentation"], "left").select(
        *KEYS,
        "avg_score",
        "weighted_avg_score",
        "avg_days_early",
        "exam_score",
        "tma_score",
        "cma_score",
        # Not clamped: repeated submissions can push the rate above 1.
        F.when(total > 0, safe_ratio(F.col("num_submitted"), total)).otherwise(F.lit(0.0)).alias("submission_rate"),
    )


def score_by_type(student_assessment: DataFrame, assessments: DataFrame) -> DataFrame:
    """Average score per enrollment and assessment type (long form)."""
    submissions = student_assessment.filter(F.col("is_banked") == 0).select("id_assessment", "id_student", "score")
    assessment = assessments.select("id_assessment", "code_module", "code_presentation", "assessment_type")
    joined = dimension_join(submissions, assessment, "id_assessment", "inner")
    return joined.groupBy(*KEYS, "assessment_type").agg(
        F.avg("score").alias("avg_score"), F.count(F.lit(1)).alias("n_submissions")
    )


def registration_features(student_registration: DataFrame) -> DataFrame:
    """Withdrawal flag (any unregistration date) and days registered early."""
    return student_registration.select(
        *KEYS,
        F.col("date_unregistration").isNotNull().cast("int").alias("withdrew_early"),
        F.coalesce(-F.col("date_registration"), F.lit(0)).cast("int").alias("days_before_start"),
    )


def demographic_features(student_info: DataFrame) -> DataFrame:
    """Label, encoded demographics and the raw demographic columns."""
    return student_info.select(
        *KEYS,
        outcome_label(F.col("final_result")).alias("label"),
        F.col("num_of_prev_attempts").alias("num_prev_attempts"),
        imd_band_code(F.col("imd_band")).alias("imd_band_encoded"),
        disability_code(F.col("disability")).alias("disability_encoded"),
        *DEMOGRAPHIC_COLUMNS,
    )


def static_features(tables: dict[str, DataFrame]) -> DataFrame:
    """The feature groups that no click changes: demographics, assessments and registration of every enrollment."""
    base = demographic_features(tables["student_info"])
    assess = assessment_features(tables["student_assessment"], tables["assessments"])
    reg = registration_features(tables["student_registration"])
    return base.join(assess, KEYS, "left").join(reg, KEYS, "left")


def assembled(static: DataFrame, clicks: DataFrame | None) -> DataFrame:
    """Feature rows of the enrollments in ``static`` with their click features (none: all 0); the 20 features are zero-filled."""
    if clicks is None:
        joined = static.select("*", *(F.lit(0).cast(t).alias(c) for c, t in CLICK_TYPES.items()))
    else:
        joined = static.join(clicks, KEYS, "left")
    return joined.select(*KEYS, "label", *FEATURE_COLUMNS, *DEMOGRAPHIC_COLUMNS).fillna(0, subset=FEATURE_COLUMNS)


def feature_table(tables: dict[str, DataFrame]) -> DataFrame:
    """Assemble the enrollment feature table (left joins on the three keys).

    Label and demographics come from one scan of ``student_info``; the click,
    assessment and registration groups are left-joined on the enrollment key
    and the 20 features are zero-filled.
    """
    base = demographic_features(tables["student_info"])
    vle = vle_features(tables["student_vle"], tables["vle"], tables["courses"])
    assess = assessment_features(tables["student_assessment"], tables["assessments"])
    reg = registration_features(tables["student_registration"])
    joined = base.join(vle, KEYS, "left").join(assess, KEYS, "left").join(reg, KEYS, "left")
    return joined.select(*KEYS, "label", *FEATURE_COLUMNS, *DEMOGRAPHIC_COLUMNS).fillna(0, subset=FEATURE_COLUMNS)
