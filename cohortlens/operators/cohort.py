"""Cohort summaries over the scored enrollment frame.

Two notions of "count" exist side by side: per enrollment (the cohort page)
and per student, where a student takes the worst tier over their enrollments
(dashboard, table summary, cohort report).  Likewise two averages: over
enrollments, and the mean of per-student means.

All operators are one or two aggregations: a per-student ``groupBy`` (partial
aggregation first, so a student with very many enrollments is combined on the
map side) and a global or per-group aggregate.  Fixed dimension lists (tiers,
buckets, outcomes) are small literal frames joined to the aggregate, never
to the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.expressions import RISK_LABELS, clamp_tier, safe_ratio

# Tier display order (worst first) and cross-tab column names.
TIER_ORDER = [3, 2, 1, 0]
TIER_COLUMNS = {0: "safe", 1: "watch", 2: "high", 3: "crit"}
# Outcome order of the outcome chart.
OUTCOMES = ["Pass", "Distinction", "Fail", "Withdrawn"]
# Age bands in display order.
AGE_ORDER = ["0-35", "35-55", "55<=", "Unknown"]


def _count_if(cond) -> F.Column:
    return F.count(F.when(cond, F.lit(1)))


def _tier_counts(tier_col: str = "risk") -> list[F.Column]:
    return [_count_if(F.col(tier_col) == t).alias(TIER_COLUMNS[t]) for t in (0, 1, 2, 3)]


def _with_student(scored: DataFrame) -> DataFrame:
    """Rows that have a student id (empty ids are skipped)."""
    return scored.filter(F.col("id").isNotNull() & (F.col("id") != ""))


def worst_tier_per_student(scored: DataFrame) -> DataFrame:
    """``(id, risk)``: the worst clamped tier of each student."""
    return _with_student(scored).groupBy("id").agg(F.max(clamp_tier(F.col("risk"))).alias("risk"))


def tier_summary(scored: DataFrame) -> DataFrame:
    """Unique students and their count per worst tier (one row)."""
    worst = worst_tier_per_student(scored)
    return worst.agg(
        F.count(F.lit(1)).alias("unique_students"),
        _count_if(F.col("risk") == 0).alias("safe"),
        _count_if(F.col("risk") == 1).alias("watch"),
        _count_if(F.col("risk") == 2).alias("high_risk"),
        _count_if(F.col("risk") == 3).alias("critical"),
    )


def per_student_means(scored: DataFrame) -> DataFrame:
    """Mean over students of each student's mean score, engagement and clicks."""
    per_student = _with_student(scored).groupBy("id").agg(
        F.avg(F.coalesce("score", F.lit(0.0))).alias("s"),
        F.avg(F.coalesce("engagement_ratio", F.lit(0.0))).alias("e"),
        F.avg(F.coalesce("clicks", F.lit(0.0))).alias("c"),
    )
    return per_student.agg(
        F.coalesce(F.avg("s"), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.avg("e"), F.lit(0.0)).alias("avg_engagement"),
        F.coalesce(F.avg("c"), F.lit(0.0)).alias("avg_clicks"),
    )


def cohort_health(scored: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Enrollments, students, tier counts, rates and averages per group.

    With no group columns the result is one row, zeros for an empty cohort.
    """
    n = F.count(F.lit(1))
    aggs = [
        n.alias("enrollments"),
        F.count_distinct("id").alias("unique_students"),
        _count_if(F.col("risk") == 3).alias("critical"),
        _count_if(F.col("risk") == 2).alias("high_risk"),
        _count_if(F.col("risk") == 1).alias("watch"),
        _count_if(F.col("risk") == 0).alias("safe"),
        F.coalesce(safe_ratio(_count_if(F.col("withdrew_early") == 1), n), F.lit(0.0)).alias("withdrawal_rate"),
        F.coalesce(safe_ratio(_count_if(F.coalesce("num_prev_attempts", F.lit(0)) > 0), n), F.lit(0.0)).alias(
            "reattempt_rate"
        ),
        F.coalesce(F.avg(F.coalesce("score", F.lit(0.0))), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.avg(F.coalesce("engagement_ratio", F.lit(0.0))), F.lit(0.0)).alias("avg_engagement"),
    ]
    if group_cols:
        return scored.groupBy(*group_cols).agg(*aggs)
    return scored.agg(*aggs)


def score_distribution(scored: DataFrame) -> DataFrame:
    """Ten score buckets (the last closed) x tier; empty buckets shown as 0."""
    bucket = F.least(F.floor(F.coalesce("score", F.lit(0.0)) / 10), F.lit(9)).cast("int")
    counts = scored.groupBy(bucket.alias("bucket")).agg(*_tier_counts())
    spark = scored.sparkSession
    buckets = spark.range(10).select(F.col("id").cast("int").alias("bucket"))
    # counts has at most one row per bucket: it is the broadcast (build) side,
    # so the left outer join from the fixed bucket list needs no shuffle.
    return (
        buckets.join(F.broadcast(counts), "bucket", "left")
        .select(
            "bucket",
            F.concat((F.col("bucket") * 10).cast("string"), F.lit("–"), (F.col("bucket") * 10 + 10).cast("string")).alias(
                "label"
            ),
            *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("crit", "high", "watch", "safe")],
        )
    )


def risk_drivers(scored: DataFrame) -> DataFrame:
    """Count and four means per tier, worst tier first; empty tiers omitted."""
    label = None
    for tier, text in RISK_LABELS.items():
        label = (F.when if label is None else label.when)(F.col("tier") == tier, F.lit(text))
    return (
        scored.groupBy(F.col("risk").alias("tier"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg(F.coalesce("score", F.lit(0.0))).alias("avg_score"),
            F.avg(F.coalesce("submission_rate", F.lit(0.0))).alias("avg_submission"),
            F.avg(F.coalesce("engagement_ratio", F.lit(0.0))).alias("avg_engagement"),
            F.avg(F.coalesce("active_days", F.lit(0))).alias("avg_active_days"),
        )
        .withColumn("label", label)
        .orderBy(F.desc("tier"))
    )


def _order_of(value: F.Column, order: Sequence[str]) -> F.Column:
    expr = None
    for i, v in enumerate(order):
        expr = (F.when if expr is None else expr.when)(value == v, F.lit(i))
    return expr.otherwise(F.lit(len(order)))


def age_band_risk(scored: DataFrame) -> DataFrame:
    """Tier counts per age band: fixed band order first, then other bands."""
    band = F.when(F.coalesce("age_band", F.lit("")) == "", F.lit("Unknown")).otherwise(F.col("age_band"))
    return (
        scored.groupBy(band.alias("band"))
        .agg(*_tier_counts())
        .withColumn("band_order", _order_of(F.col("band"), AGE_ORDER))
        .orderBy("band_order", "band")
    )


def education_risk(scored: DataFrame) -> DataFrame:
    """Tier counts per highest education level, sorted by level."""
    level = F.when(F.coalesce("highest_education", F.lit("")) == "", F.lit("Unknown")).otherwise(
        F.col("highest_education")
    )
    return scored.groupBy(level.alias("level")).agg(*_tier_counts()).orderBy("level")


def outcome_counts(scored: DataFrame) -> DataFrame:
    """Enrollments per final result for the four fixed outcomes (zeros shown)."""
    spark = scored.sparkSession
    outcomes = spark.createDataFrame([(i, o) for i, o in enumerate(OUTCOMES)], "outcome_order int, final_result string")
    counts = scored.filter(F.col("final_result").isin(OUTCOMES)).groupBy("final_result").agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        outcomes.join(F.broadcast(counts), "final_result", "left")  # counts: at most 4 rows
        .select("final_result", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "outcome_order")
        .orderBy("outcome_order")
    )


def module_risk(scored: DataFrame, top: int | None = 12) -> DataFrame:
    """Critical / high counts per module presentation; the ``top`` largest."""
    key = F.trim(
        F.concat(
            F.when(F.coalesce("code_module", F.lit("")) == "", F.lit("?")).otherwise(F.col("code_module")),
            F.lit(" "),
            F.coalesce("code_presentation", F.lit("")),
        )
    )
    per_key = (
        scored.groupBy(key.alias("module_key"))
        .agg(_count_if(F.col("risk") == 3).alias("crit"), _count_if(F.col("risk") == 2).alias("high"))
        .withColumn("total", F.col("crit") + F.col("high"))
        .filter(F.col("total") > 0)
        .orderBy(F.desc("total"), "module_key")
    )
    return per_key.limit(top) if top else per_key


def filter_options(scored: DataFrame, modules: Sequence[str] | None = None) -> DataFrame:
    """Distinct non-blank modules and presentations, sorted (one shuffle)."""
    rows = scored if not modules else scored.filter(F.col("code_module").isin(list(modules)))
    pairs = rows.select(
        F.explode(
            F.array(
                F.struct(F.lit("module").alias("kind"), F.col("code_module").alias("value")),
                F.struct(F.lit("presentation").alias("kind"), F.col("code_presentation").alias("value")),
            )
        ).alias("kv")
    ).select("kv.kind", "kv.value")
    return pairs.filter(F.col("value").isNotNull() & (F.col("value") != "")).distinct().orderBy("kind", "value")


def _per_student_rollup(rows: DataFrame) -> DataFrame:
    """One row per student id (null/blank ids form their own group).

    Carries the enrollment count, at-risk enrollment count, worst tier and
    mean engagement, so enrollment- and student-level totals come out of one
    global aggregate without joining two one-row frames.
    """
    valid = F.col("id").isNotNull() & (F.col("id") != "")
    return rows.groupBy(F.when(valid, F.col("id")).alias("id")).agg(
        F.count(F.lit(1)).alias("n_enrollments"),
        _count_if(F.col("risk") >= 2).alias("n_at_risk"),
        F.max(clamp_tier(F.col("risk"))).alias("worst"),
        F.avg(F.coalesce("engagement_ratio", F.lit(0.0))).alias("eng"),
    )


def at_risk_share(scored: DataFrame) -> DataFrame:
    """Critical + high, counted per student (worst tier) and per enrollment."""
    student = F.col("id").isNotNull()
    totals = _per_student_rollup(scored).agg(
        F.count(F.when(student, F.lit(1))).alias("unique_students"),
        F.count(F.when(student & (F.col("worst") >= 2), F.lit(1))).alias("at_risk_students"),
        F.coalesce(F.sum("n_enrollments"), F.lit(0)).alias("enrollments"),
        F.coalesce(F.sum("n_at_risk"), F.lit(0)).alias("at_risk_enrollments"),
    )
    return totals.select(
        "unique_students",
        "at_risk_students",
        F.coalesce(safe_ratio(F.col("at_risk_students") * 100, F.col("unique_students")), F.lit(0.0)).alias(
            "at_risk_student_pct"
        ),
        "enrollments",
        "at_risk_enrollments",
        F.coalesce(safe_ratio(F.col("at_risk_enrollments") * 100, F.col("enrollments")), F.lit(0.0)).alias(
            "at_risk_enrollment_pct"
        ),
    )


def filtered_summary(rows: DataFrame) -> DataFrame:
    """Table summary of an already filtered set (one row).

    Enrollments, unique students, per-student worst-tier counts and the
    per-student mean engagement in percent.
    """
    student = F.col("id").isNotNull()
    return _per_student_rollup(rows).agg(
        F.coalesce(F.sum("n_enrollments"), F.lit(0)).alias("enrollments"),
        F.count(F.when(student, F.lit(1))).alias("unique_students"),
        F.count(F.when(student & (F.col("worst") == 3), F.lit(1))).alias("critical"),
        F.count(F.when(student & (F.col("worst") == 2), F.lit(1))).alias("high"),
        F.count(F.when(student & (F.col("worst") == 1), F.lit(1))).alias("watch"),
        F.count(F.when(student & (F.col("worst") == 0), F.lit(1))).alias("safe"),
        F.coalesce(F.avg(F.when(student, F.col("eng"))) * 100, F.lit(0.0)).alias("avg_engagement_pct"),
    )


def scatter_points(scored: DataFrame) -> DataFrame:
    """Exam score vs submission percent per enrollment, with its tier."""
    return scored.select(
        "id",
        "code_module",
        "code_presentation",
        F.coalesce("risk", F.lit(0)).alias("risk"),
        F.coalesce("exam_score", F.lit(0.0)).alias("exam_score"),
        F.round(F.coalesce("submission_rate", F.lit(0.0)) * 100).cast("long").alias("submission_pct"),
    )
