"""Small literal frames shaped like the package's tables."""

from pyspark.sql import types as T

from cohortlens.sources.schemas import SCHEMAS

SCORED_TYPES = {
    "id": T.StringType(), "id_student": T.LongType(), "code_module": T.StringType(),
    "code_presentation": T.StringType(), "row_key": T.StringType(), "clicks": T.DoubleType(),
    "active_days": T.LongType(), "active_weeks": T.LongType(), "engagement_ratio": T.DoubleType(),
    "forum_clicks": T.DoubleType(), "quiz_clicks": T.DoubleType(), "resource_clicks": T.DoubleType(),
    "score": T.DoubleType(), "weighted_score": T.DoubleType(), "submission_rate": T.DoubleType(),
    "avg_days_early": T.DoubleType(), "exam_score": T.DoubleType(), "tma_score": T.DoubleType(),
    "cma_score": T.DoubleType(), "withdrew_early": T.IntegerType(), "num_prev_attempts": T.IntegerType(),
    "imd_band_encoded": T.IntegerType(), "disability_encoded": T.IntegerType(),
    "days_before_start": T.DoubleType(), "gender": T.StringType(), "region": T.StringType(),
    "highest_education": T.StringType(), "imd_band": T.StringType(), "age_band": T.StringType(),
    "studied_credits": T.IntegerType(), "disability": T.StringType(), "final_result": T.StringType(),
    "label": T.IntegerType(), "risk": T.IntegerType(), "risk_label": T.StringType(),
}
DEFAULTS = {
    "code_module": "M1", "code_presentation": "2000J", "clicks": 100.0, "active_days": 10, "active_weeks": 3,
    "engagement_ratio": 0.5, "forum_clicks": 10.0, "quiz_clicks": 10.0, "resource_clicks": 10.0, "score": 70.0,
    "weighted_score": 70.0, "submission_rate": 0.8, "avg_days_early": 1.0, "exam_score": 70.0, "tma_score": 70.0,
    "cma_score": 70.0, "withdrew_early": 0, "num_prev_attempts": 0, "imd_band_encoded": 3,
    "disability_encoded": 0, "days_before_start": 10.0, "gender": "M", "region": "R", "highest_education": "E",
    "imd_band": "30-40%", "age_band": "0-35", "studied_credits": 60, "disability": "N",
    "final_result": "Pass", "label": 0, "risk": 0, "risk_label": "Safe",
}


def scored_frame(spark, rows):
    """Scored-shaped frame; each row is a dict overriding the defaults."""
    schema = T.StructType([T.StructField(c, t, True) for c, t in SCORED_TYPES.items()])
    data = []
    for i, r in enumerate(rows):
        d = dict(DEFAULTS)
        d["id_student"] = i + 1
        d.update(r)
        d.setdefault("id", str(d["id_student"]))
        d["row_key"] = f"{d['id']}|{d['code_module']}|{d['code_presentation']}"
        data.append(tuple(d.get(c) for c in SCORED_TYPES))
    return spark.createDataFrame(data, schema)


def raw(spark, table, rows):
    """Raw table with its declared schema; rows are dicts (missing = null)."""
    schema = SCHEMAS[table]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)
