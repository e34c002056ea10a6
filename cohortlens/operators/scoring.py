"""Risk tiers and the scored enrollment frame.

``scored`` is the frame every dashboard, report and statistics operator reads:
one row per enrollment with short field names, typed values (the source kept
them as text in a key-value store) and the tier.  It replaces the source's
driver-side publish loop and in-memory cache: callers ``persist`` it once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.expressions import risk_label, risk_tier
from cohortlens.sources.schemas import ENROLLMENT_KEYS

# Statistic fields of the scored frame, in display order (fixed values).
SCORED_FEATURES = [
    "clicks", "active_days", "active_weeks", "engagement_ratio",
    "forum_clicks", "quiz_clicks", "resource_clicks",
    "score", "weighted_score", "submission_rate", "avg_days_early",
    "exam_score", "tma_score", "cma_score",
    "withdrew_early", "days_before_start",
    "num_prev_attempts", "imd_band_encoded", "disability_encoded",
]

# Model feature name -> scored field name (fixed values).
MODEL_TO_SCORED = {
    "total_clicks": "clicks",
    "active_days": "active_days",
    "active_weeks": "active_weeks",
    "engagement_ratio": "engagement_ratio",
    "forum_clicks": "forum_clicks",
    "quiz_clicks": "quiz_clicks",
    "resource_clicks": "resource_clicks",
    "avg_score": "score",
    "weighted_avg_score": "weighted_score",
    "submission_rate": "submission_rate",
    "avg_days_early": "avg_days_early",
    "exam_score": "exam_score",
    "tma_score": "tma_score",
    "cma_score": "cma_score",
    "withdrew_early": "withdrew_early",
    "days_before_start": "days_before_start",
    "num_prev_attempts": "num_prev_attempts",
    "imd_band_encoded": "imd_band_encoded",
    "disability_encoded": "disability_encoded",
}


def with_risk_tier(features: DataFrame) -> DataFrame:
    """Add ``risk`` (0..3) and ``risk_label`` to the feature table."""
    tier = risk_tier(
        score=F.col("avg_score"),
        clicks=F.col("total_clicks"),
        submission_rate=F.col("submission_rate"),
        avg_days_early=F.col("avg_days_early"),
        withdrew_early=F.col("withdrew_early"),
        label=F.col("label"),
    )
    return features.withColumn("risk", tier).withColumn("risk_label", risk_label(F.col("risk")))


def row_key(*cols) -> F.Column:
    """Composite key ``id|module|presentation``."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def scored(features: DataFrame) -> DataFrame:
    """The scored enrollment frame with display field names and types."""
    tiered = with_risk_tier(features)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return tiered.select(
        F.col("id_student").cast("string").alias("id"),
        "id_student",
        "code_module",
        "code_presentation",
        row_key(*ENROLLMENT_KEYS).alias("row_key"),
        F.col("total_clicks").cast("double").alias("clicks"),
        F.col("active_days").cast("long").alias("active_days"),
        F.col("active_weeks").cast("long").alias("active_weeks"),
        F.col("engagement_ratio").cast("double").alias("engagement_ratio"),
        F.col("forum_clicks").cast("double").alias("forum_clicks"),
        F.col("quiz_clicks").cast("double").alias("quiz_clicks"),
        F.col("resource_clicks").cast("double").alias("resource_clicks"),
        F.col("avg_score").cast("double").alias("score"),
        F.col("weighted_avg_score").cast("double").alias("weighted_score"),
        F.col("submission_rate").cast("double").alias("submission_rate"),
        F.col("avg_days_early").cast("double").alias("avg_days_early"),
        F.col("exam_score").cast("double").alias("exam_score"),
        F.col("tma_score").cast("double").alias("tma_score"),
        F.col("cma_score").cast("double").alias("cma_score"),
        F.col("withdrew_early").cast("int").alias("withdrew_early"),
        F.col("num_prev_attempts").cast("int").alias("num_prev_attempts"),
        F.col("imd_band_encoded").cast("int").alias("imd_band_encoded"),
        F.col("disability_encoded").cast("int").alias("disability_encoded"),
        F.col("days_before_start").cast("double").alias("days_before_start"),
        text("gender"),
        text("region"),
        text("highest_education"),
        text("imd_band"),
        text("age_band"),
        F.coalesce(F.col("studied_credits"), F.lit(0)).cast("int").alias("studied_credits"),
        text("disability"),
        text("final_result"),
        F.col("label").cast("int").alias("label"),
        F.col("risk").cast("int").alias("risk"),
        "risk_label",
    )
