"""Registered queries: features, tiers, cohort summaries, ranking, statistics.

Every query reads the test tables through the adapter and runs over all of
them; parameters (module lists, tiers, search text, page numbers) are the
operator's inputs, not row caps.
"""

from __future__ import annotations

import os
from itertools import combinations

from pyspark import StorageLevel

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.positions import with_positions
from cohortlens.operators import cohort, cube, features, ranking, stats
from cohortlens.operators.scoring import SCORED_FEATURES, scored, with_risk_tier
from cohortlens.plans.registry import register
from cohortlens.session import scratch_path, shuffles_released
from cohortlens.sources import feature_groups
from cohortlens.sources.sorted_store import SortedStore
from cohortlens.sources.testdata import load_source_tables

KEYS_SQL = "id_student, code_module, code_presentation"
VALID_ID = "id IS NOT NULL AND id <> ''"
CLAMP = "greatest(0, least(3, coalesce(risk, 0)))"


# The seven source tables, built once per application and input folder.  The
# facts stay lazy plans that scan the files when a query runs; the dimensions
# (one row per course, site or assessment, derived here from the fact tables)
# are written to the scratch folder, so every plan knows their real size.
_DIMENSIONS = ("vle", "courses", "assessments")
_TABLES: dict[tuple[str, str], dict[str, DataFrame]] = {}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    if key not in _TABLES:
        found = load_source_tables(spark, sf_dir)
        for name in _DIMENSIONS:
            path = scratch_path(spark, name)
            found[name].write.parquet(path)
            found[name] = spark.read.schema(found[name].schema).parquet(path)
        _TABLES[key] = found
    return _TABLES[key]


def refresh(spark: SparkSession, sf_dir: str) -> None:
    """Drop what is kept for the folder, so the next query reads its files again."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    _TABLES.pop(key, None)
    _CUBES.pop(key, None)
    if key in _GROUPS:
        feature_groups.drop_groups(spark, _GROUPS.pop(key))
    for stored in [k for k in _SORTED if k[:2] == key]:
        _SORTED.pop(stored)
    frame = _SCORED.pop(key, None)
    if frame is not None:
        frame.unpersist()


def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_table(tables(spark, sf_dir))


# One scored frame per application and input folder: the dashboard queries
# all read it, as the source served them from one in-memory cache.  It is
# written to the shared folder (a lineage cut: a lost executor's blocks are
# re-read from those files instead of re-running the feature pipeline and its
# shuffles), as Parquet, which takes a small part of a checkpoint's rows, and
# then kept in memory, as far as it fits: the rest is read from the files again,
# not stored on disk a second time.
_SCORED: dict[tuple[str, str], DataFrame] = {}


def scored_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    frame = _SCORED.get(key)
    if frame is None:
        path = scratch_path(spark, "scored")
        rows = scored(feature_frame(spark, sf_dir))
        with shuffles_released(spark):
            rows.write.parquet(path)
        frame = spark.read.schema(rows.schema).parquet(path).persist(StorageLevel.MEMORY_ONLY)
        _SCORED[key] = frame
    return frame


def _tiers_sql(col: str = "risk") -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE {col} = {t}) AS {name}" for t, name in ((0, "safe"), (1, "watch"), (2, "high"), (3, "crit"))
    )


# ── features (A, B, C, D1-D4) ──────────────────────────────────────────────


@register(
    "vle_features",
    oracle=f"""SELECT {KEYS_SQL}, total_clicks, active_days, active_weeks, forum_clicks, quiz_clicks,
       resource_clicks, clicks_per_day, engagement_ratio FROM vle_feat""",
    doubles=["clicks_per_day", "engagement_ratio"],
    survey_ids="C1 C2 D1 B9 B10 B11 B12",
)
def q_vle_features(spark, sf_dir):
    t = tables(spark, sf_dir)
    return features.vle_features(t["student_vle"], t["vle"], t["courses"])


@register(
    "assessments_per_module",
    oracle="SELECT code_module, code_presentation, total_assessments FROM assess_totals",
    survey_ids="D2",
)
def q_assessments_per_module(spark, sf_dir):
    return features.assessments_per_module(tables(spark, sf_dir)["assessments"])


@register(
    "assessment_features",
    oracle=f"""SELECT {KEYS_SQL}, avg_score, weighted_avg_score, avg_days_early, exam_score, tma_score,
       cma_score, submission_rate FROM assess_feat""",
    doubles=["avg_score", "weighted_avg_score", "avg_days_early", "exam_score", "tma_score", "cma_score", "submission_rate"],
    survey_ids="B7 B13 C3 C4 D3",
)
def q_assessment_features(spark, sf_dir):
    t = tables(spark, sf_dir)
    return features.assessment_features(t["student_assessment"], t["assessments"])


@register(
    "score_by_type",
    oracle=f"""SELECT {KEYS_SQL}, assessment_type, avg(score) AS avg_score, count(*) AS n_submissions
       FROM raw_student_assessment sa JOIN raw_assessments a USING (id_assessment)
       WHERE sa.is_banked = 0 GROUP BY {KEYS_SQL}, assessment_type""",
    doubles=["avg_score"],
    survey_ids="D4",
)
def q_score_by_type(spark, sf_dir):
    t = tables(spark, sf_dir)
    return features.score_by_type(t["student_assessment"], t["assessments"])


@register(
    "registration_features",
    oracle=f"SELECT {KEYS_SQL}, withdrew_early, days_before_start FROM reg_feat",
    survey_ids="B4 B5",
)
def q_registration_features(spark, sf_dir):
    return features.registration_features(tables(spark, sf_dir)["student_registration"])


@register(
    "demographic_features",
    oracle=f"""SELECT {KEYS_SQL}, label, num_prev_attempts, imd_band_encoded, disability_encoded, gender, region,
       highest_education, imd_band, age_band, studied_credits, disability, final_result FROM demo_feat""",
    survey_ids="B3 B6",
)
def q_demographic_features(spark, sf_dir):
    return features.demographic_features(tables(spark, sf_dir)["student_info"])


@register(
    "label",
    oracle=f"SELECT {KEYS_SQL}, final_result, label FROM demo_feat",
    survey_ids="B1",
)
def q_label(spark, sf_dir):
    return features.demographic_features(tables(spark, sf_dir)["student_info"]).select(
        *features.KEYS, "final_result", "label"
    )


@register(
    "imd_encode",
    oracle=f"SELECT {KEYS_SQL}, imd_band, imd_band_encoded FROM demo_feat",
    survey_ids="B2",
)
def q_imd_encode(spark, sf_dir):
    return features.demographic_features(tables(spark, sf_dir)["student_info"]).select(
        *features.KEYS, "imd_band", "imd_band_encoded"
    )


@register(
    "feature_table",
    oracle="SELECT * FROM features",
    doubles=[
        "clicks_per_day", "engagement_ratio", "avg_score", "weighted_avg_score", "submission_rate",
        "avg_days_early", "exam_score", "tma_score", "cma_score",
    ],
    survey_ids="B8 C5",
)
def q_feature_table(spark, sf_dir):
    return feature_frame(spark, sf_dir)


# Stored feature groups per application and input folder: the prefix of their tables.
_GROUPS: dict[tuple[str, str], str] = {}


@register(
    "feature_table_stored",
    oracle="SELECT * FROM features",
    doubles=[
        "clicks_per_day", "engagement_ratio", "avg_score", "weighted_avg_score", "submission_rate",
        "avg_days_early", "exam_score", "tma_score", "cma_score",
    ],
    survey_ids="C5",
)
def q_feature_table_stored(spark, sf_dir):
    """The feature table assembled from its stored groups, bucket by bucket."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    if key not in _GROUPS:
        path = scratch_path(spark, "feature-groups")
        prefix = os.path.basename(path).replace("-", "_")
        feature_groups.store_groups(tables(spark, sf_dir), prefix, path)
        _GROUPS[key] = prefix
    return feature_groups.assemble_stored(spark, _GROUPS[key])


@register(
    "risk_tier",
    oracle=f"SELECT {KEYS_SQL}, label, risk, risk_label FROM scored",
    survey_ids="B14 B15",
)
def q_risk_tier(spark, sf_dir):
    return with_risk_tier(feature_frame(spark, sf_dir)).select(*features.KEYS, "label", "risk", "risk_label")


# ── cohort summaries (D6-D11, D15-D20) ─────────────────────────────────────


@register(
    "tier_summary",
    ctes=f""", worst AS (SELECT id, max({CLAMP}) AS risk FROM scored WHERE {VALID_ID} GROUP BY id)""",
    oracle="""SELECT count(*) AS unique_students, count(*) FILTER (WHERE risk = 0) AS safe,
       count(*) FILTER (WHERE risk = 1) AS watch, count(*) FILTER (WHERE risk = 2) AS high_risk,
       count(*) FILTER (WHERE risk = 3) AS critical FROM worst""",
    survey_ids="D6 I4",
)
def q_tier_summary(spark, sf_dir):
    return cohort.tier_summary(scored_frame(spark, sf_dir))


# Module lists of the payload query; an empty one means all modules.
PAYLOAD_MODULES = [["M1", "M3"], ["M2"], []]


def _payload_sql(modules: list[str]) -> str:
    rows = f"SELECT * FROM scored WHERE coalesce(code_module, '') IN ({', '.join(map(repr, modules))})" if modules else "SELECT * FROM scored"
    return f"""SELECT '{",".join(modules)}' AS modules, CAST(coalesce(sum(n), 0) AS BIGINT) AS enrollments,
       count(*) FILTER (WHERE sid IS NOT NULL) AS unique_students,
       count(*) FILTER (WHERE sid IS NOT NULL AND worst = 0) AS safe, count(*) FILTER (WHERE sid IS NOT NULL AND worst = 1) AS watch,
       count(*) FILTER (WHERE sid IS NOT NULL AND worst = 2) AS high_risk, count(*) FILTER (WHERE sid IS NOT NULL AND worst = 3) AS critical
       FROM (SELECT CASE WHEN {VALID_ID} THEN id END AS sid, count(*) AS n, max({CLAMP}) AS worst FROM ({rows}) GROUP BY 1)"""


# One cube per application and input folder, stored in the scratch folder by module.
_CUBES: dict[tuple[str, str], str] = {}


def cube_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    if key not in _CUBES:
        path = scratch_path(spark, "cube")
        cube.summary_cube(scored_frame(spark, sf_dir)).write.partitionBy("code_module").parquet(path)
        _CUBES[key] = path
    return spark.read.parquet(_CUBES[key])


@register("payload_summary", oracle=" UNION ALL ".join(map(_payload_sql, PAYLOAD_MODULES)), survey_ids="I4 D6 D19")
def q_payload_summary(spark, sf_dir):
    """Summary over the rows that a user may see, for three lists of modules, from the stored cube alone."""
    cells = cube_frame(spark, sf_dir)
    parts = [cube.payload_summary(cells, m).select(F.lit(",".join(m)).alias("modules"), "*") for m in PAYLOAD_MODULES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register(
    "per_student_means",
    ctes=f""", ps AS (SELECT id, avg(coalesce(score, 0)) AS s, avg(coalesce(engagement_ratio, 0)) AS e,
       avg(coalesce(clicks, 0)) AS c FROM scored WHERE {VALID_ID} GROUP BY id)""",
    oracle="""SELECT coalesce(avg(s), 0) AS avg_score, coalesce(avg(e), 0) AS avg_engagement,
       coalesce(avg(c), 0) AS avg_clicks FROM ps""",
    doubles=["avg_score", "avg_engagement", "avg_clicks"],
    survey_ids="D7",
)
def q_per_student_means(spark, sf_dir):
    return cohort.per_student_means(scored_frame(spark, sf_dir))


_HEALTH_SQL = """count(*) AS enrollments, count(DISTINCT id) AS unique_students,
       count(*) FILTER (WHERE risk = 3) AS critical, count(*) FILTER (WHERE risk = 2) AS high_risk,
       count(*) FILTER (WHERE risk = 1) AS watch, count(*) FILTER (WHERE risk = 0) AS safe,
       coalesce(CAST(count(*) FILTER (WHERE withdrew_early = 1) AS DOUBLE) / nullif(count(*), 0), 0) AS withdrawal_rate,
       coalesce(CAST(count(*) FILTER (WHERE coalesce(num_prev_attempts, 0) > 0) AS DOUBLE) / nullif(count(*), 0), 0)
         AS reattempt_rate,
       coalesce(avg(coalesce(score, 0)), 0) AS avg_score,
       coalesce(avg(coalesce(engagement_ratio, 0)), 0) AS avg_engagement"""
_HEALTH_DOUBLES = ["withdrawal_rate", "reattempt_rate", "avg_score", "avg_engagement"]


@register("cohort_health", oracle=f"SELECT {_HEALTH_SQL} FROM scored", doubles=_HEALTH_DOUBLES, survey_ids="D8")
def q_cohort_health(spark, sf_dir):
    return cohort.cohort_health(scored_frame(spark, sf_dir))


@register(
    "cohort_health_by_module",
    oracle=f"SELECT code_module, {_HEALTH_SQL} FROM scored GROUP BY code_module",
    doubles=_HEALTH_DOUBLES,
    survey_ids="D8",
)
def q_cohort_health_by_module(spark, sf_dir):
    return cohort.cohort_health(scored_frame(spark, sf_dir), ["code_module"])


@register(
    "score_distribution",
    ctes=f""", sd AS (SELECT CAST(least(floor(coalesce(score, 0) / 10), 9) AS INTEGER) AS bucket, {_tiers_sql()}
       FROM scored GROUP BY 1)""",
    oracle="""SELECT g.bucket, CAST(g.bucket * 10 AS VARCHAR) || '–' || CAST(g.bucket * 10 + 10 AS VARCHAR) AS label,
       coalesce(sd.crit, 0) AS crit, coalesce(sd.high, 0) AS high, coalesce(sd.watch, 0) AS watch,
       coalesce(sd.safe, 0) AS safe
       FROM (SELECT CAST(range AS INTEGER) AS bucket FROM range(10)) g LEFT JOIN sd USING (bucket)""",
    survey_ids="D9",
)
def q_score_distribution(spark, sf_dir):
    return cohort.score_distribution(scored_frame(spark, sf_dir))


@register(
    "risk_drivers",
    oracle="""SELECT risk AS tier, count(*) AS "count", avg(coalesce(score, 0)) AS avg_score,
       avg(coalesce(submission_rate, 0)) AS avg_submission, avg(coalesce(engagement_ratio, 0)) AS avg_engagement,
       avg(coalesce(active_days, 0)) AS avg_active_days,
       CASE risk WHEN 0 THEN 'Safe' WHEN 1 THEN 'Watch' WHEN 2 THEN 'High Risk' WHEN 3 THEN 'Critical' END AS label
       FROM scored GROUP BY risk""",
    doubles=["avg_score", "avg_submission", "avg_engagement", "avg_active_days"],
    survey_ids="D10",
)
def q_risk_drivers(spark, sf_dir):
    return cohort.risk_drivers(scored_frame(spark, sf_dir))


@register(
    "age_band_risk",
    oracle=f"""SELECT band, {_tiers_sql()},
       CASE band WHEN '0-35' THEN 0 WHEN '35-55' THEN 1 WHEN '55<=' THEN 2 WHEN 'Unknown' THEN 3 ELSE 4 END
         AS band_order
       FROM (SELECT CASE WHEN coalesce(age_band, '') = '' THEN 'Unknown' ELSE age_band END AS band, risk FROM scored)
       GROUP BY band""",
    survey_ids="D11",
)
def q_age_band_risk(spark, sf_dir):
    return cohort.age_band_risk(scored_frame(spark, sf_dir))


@register(
    "education_risk",
    oracle=f"""SELECT level, {_tiers_sql()}
       FROM (SELECT CASE WHEN coalesce(highest_education, '') = '' THEN 'Unknown' ELSE highest_education END AS level,
             risk FROM scored)
       GROUP BY level""",
    survey_ids="D11",
)
def q_education_risk(spark, sf_dir):
    return cohort.education_risk(scored_frame(spark, sf_dir))


@register(
    "outcome_counts",
    oracle="""SELECT o.final_result, coalesce(c.n, 0) AS n, o.outcome_order
       FROM (VALUES (0, 'Pass'), (1, 'Distinction'), (2, 'Fail'), (3, 'Withdrawn')) o(outcome_order, final_result)
       LEFT JOIN (SELECT final_result, count(*) AS n FROM scored GROUP BY final_result) c USING (final_result)""",
    survey_ids="D15",
)
def q_outcome_counts(spark, sf_dir):
    return cohort.outcome_counts(scored_frame(spark, sf_dir))


@register(
    "module_risk_top12",
    oracle="""SELECT module_key, crit, high, crit + high AS total FROM (
         SELECT trim(CASE WHEN coalesce(code_module, '') = '' THEN '?' ELSE code_module END || ' '
                     || coalesce(code_presentation, '')) AS module_key,
                count(*) FILTER (WHERE risk = 3) AS crit, count(*) FILTER (WHERE risk = 2) AS high
         FROM scored GROUP BY 1)
       WHERE crit + high > 0 ORDER BY total DESC, module_key LIMIT 12""",
    survey_ids="D16 F5",
)
def q_module_risk_top12(spark, sf_dir):
    return cohort.module_risk(scored_frame(spark, sf_dir), top=12)


@register(
    "filter_options",
    oracle="""SELECT DISTINCT kind, value FROM (
         SELECT 'module' AS kind, code_module AS value FROM scored
         UNION ALL SELECT 'presentation' AS kind, code_presentation AS value FROM scored)
       WHERE value IS NOT NULL AND value <> ''""",
    survey_ids="D17",
)
def q_filter_options(spark, sf_dir):
    return cohort.filter_options(scored_frame(spark, sf_dir))


_ROLLUP_SQL = f"""SELECT CASE WHEN {VALID_ID} THEN id END AS sid, count(*) AS n_enr,
       count(*) FILTER (WHERE risk >= 2) AS n_at_risk, max({CLAMP}) AS worst,
       avg(coalesce(engagement_ratio, 0)) AS eng"""


@register(
    "at_risk_share",
    ctes=f", ps AS ({_ROLLUP_SQL} FROM scored GROUP BY 1)",
    oracle="""SELECT count(*) FILTER (WHERE sid IS NOT NULL) AS unique_students,
       count(*) FILTER (WHERE sid IS NOT NULL AND worst >= 2) AS at_risk_students,
       coalesce(CAST(count(*) FILTER (WHERE sid IS NOT NULL AND worst >= 2) * 100 AS DOUBLE)
                / nullif(count(*) FILTER (WHERE sid IS NOT NULL), 0), 0) AS at_risk_student_pct,
       CAST(coalesce(sum(n_enr), 0) AS BIGINT) AS enrollments,
       CAST(coalesce(sum(n_at_risk), 0) AS BIGINT) AS at_risk_enrollments,
       coalesce(CAST(sum(n_at_risk) * 100 AS DOUBLE) / nullif(sum(n_enr), 0), 0) AS at_risk_enrollment_pct
       FROM ps""",
    doubles=["at_risk_student_pct", "at_risk_enrollment_pct"],
    survey_ids="D18",
)
def q_at_risk_share(spark, sf_dir):
    return cohort.at_risk_share(scored_frame(spark, sf_dir))


FILTER_TIERS, FILTER_WITHDREW, FILTER_SEARCH = [2, 3], 0, "3"


@register(
    "filtered_summary",
    ctes=f""", fs_rows AS (SELECT * FROM scored WHERE risk IN (2, 3) AND withdrew_early = 0
                 AND contains(lower(coalesce(id, '')), '{FILTER_SEARCH}')),
       ps AS ({_ROLLUP_SQL} FROM fs_rows GROUP BY 1)""",
    oracle="""SELECT CAST(coalesce(sum(n_enr), 0) AS BIGINT) AS enrollments,
       count(*) FILTER (WHERE sid IS NOT NULL) AS unique_students,
       count(*) FILTER (WHERE sid IS NOT NULL AND worst = 3) AS critical,
       count(*) FILTER (WHERE sid IS NOT NULL AND worst = 2) AS high,
       count(*) FILTER (WHERE sid IS NOT NULL AND worst = 1) AS watch,
       count(*) FILTER (WHERE sid IS NOT NULL AND worst = 0) AS safe,
       coalesce(avg(CASE WHEN sid IS NOT NULL THEN eng END) * 100, 0) AS avg_engagement_pct
       FROM ps""",
    doubles=["avg_engagement_pct"],
    survey_ids="D19 B17 B18",
)
def q_filtered_summary(spark, sf_dir):
    rows = ranking.student_filter(scored_frame(spark, sf_dir), tiers=FILTER_TIERS, withdrew=FILTER_WITHDREW)
    return cohort.filtered_summary(ranking.student_search(rows, FILTER_SEARCH))


@register(
    "scatter_points",
    oracle="""SELECT id, code_module, code_presentation, coalesce(risk, 0) AS risk,
       coalesce(exam_score, 0) AS exam_score,
       CAST(round(coalesce(submission_rate, 0) * 100) AS BIGINT) AS submission_pct FROM scored""",
    doubles=["exam_score"],
    survey_ids="D20",
)
def q_scatter_points(spark, sf_dir):
    return cohort.scatter_points(scored_frame(spark, sf_dir))


# ── ranking, selection (B16-B18, C6, E1, F1-F4) ────────────────────────────

_SCORED_DOUBLES = [
    "clicks", "engagement_ratio", "forum_clicks", "quiz_clicks", "resource_clicks", "score", "weighted_score",
    "submission_rate", "avg_days_early", "exam_score", "tma_score", "cma_score", "days_before_start",
]

_REPS_CTE = f""", reps AS (
  SELECT * EXCLUDE (rn, risk), worst AS risk FROM (
    SELECT *, {CLAMP} AS worst,
           row_number() OVER (PARTITION BY id ORDER BY {CLAMP} DESC, coalesce(score, 100),
                              coalesce(code_module, ''), coalesce(code_presentation, ''), row_key) AS rn
    FROM scored WHERE {VALID_ID})
  WHERE rn = 1)"""


@register(
    "representative_row",
    ctes=_REPS_CTE,
    oracle="SELECT * EXCLUDE (worst) FROM reps",
    doubles=_SCORED_DOUBLES,
    survey_ids="E1",
)
def q_representative_row(spark, sf_dir):
    return ranking.representative_row(scored_frame(spark, sf_dir))


@register(
    "top50_at_risk",
    ctes=_REPS_CTE,
    oracle="SELECT * EXCLUDE (worst) FROM reps WHERE risk >= 2 ORDER BY risk DESC, coalesce(score, 100), id LIMIT 50",
    doubles=_SCORED_DOUBLES,
    survey_ids="F4",
)
def q_top50_at_risk(spark, sf_dir):
    return ranking.top_at_risk_students(scored_frame(spark, sf_dir), 50)


@register(
    "attention_top10",
    oracle="""SELECT * FROM scored WHERE risk >= 2
       ORDER BY withdrew_early DESC, risk DESC, coalesce(score, 0), id, code_module, code_presentation LIMIT 10""",
    doubles=_SCORED_DOUBLES,
    survey_ids="F3",
)
def q_attention_top10(spark, sf_dir):
    return ranking.attention_list(scored_frame(spark, sf_dir), 10)




@register(
    "student_sort",
    oracle="""SELECT *, CAST(row_number() OVER (ORDER BY coalesce(clicks, 0) DESC, id, code_module, code_presentation)
                    AS INTEGER) AS position
         FROM scored""",
    doubles=_SCORED_DOUBLES,
    survey_ids="F1",
)
def q_student_sort(spark, sf_dir):
    """Every enrollment with its exact position in the sort order (distributed
    range sort; no task merges the whole table)."""
    keys = ranking.sort_keys("clicks", "desc")
    return with_positions(scored_frame(spark, sf_dir), keys).withColumn("position", F.col("position").cast("int"))


# Sorted copies of the scored rows, each written once per application and input folder when it is first asked for.
_SORTED: dict[tuple[str, str, str, str], str] = {}


def sorted_rows(spark: SparkSession, sf_dir: str, sort_by: str = "student", order: str = "asc") -> SortedStore:
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), sort_by, order)
    if key not in _SORTED:
        path = scratch_path(spark, f"sorted-{sort_by}-{order}")
        if sort_by == "student":
            ranking.store_by_student(scored_frame(spark, sf_dir), path)
        else:
            ranking.store_sorted(scored_frame(spark, sf_dir), path, sort_by, order)
        _SORTED[key] = path
    return SortedStore(spark, _SORTED[key])


PAGE, PAGE_SIZE = 3, 50


@register(
    "student_page",
    oracle=f"""SELECT * EXCLUDE (rn), CAST(rn AS INTEGER) AS position, {PAGE} AS page,
         CAST(ceil((SELECT count(*) FROM scored) / {PAGE_SIZE}.0) AS INTEGER) AS total_pages,
         (SELECT count(*) FROM scored) AS total_records
       FROM (SELECT *, row_number() OVER (ORDER BY risk DESC, coalesce(score, 0), id, code_module, code_presentation)
                    AS rn FROM scored)
       WHERE rn > {(PAGE - 1) * PAGE_SIZE} AND rn <= {PAGE * PAGE_SIZE}""",
    doubles=_SCORED_DOUBLES,
    survey_ids="F2",
)
def q_student_page(spark, sf_dir):
    return ranking.student_page(scored_frame(spark, sf_dir), page=PAGE, page_size=PAGE_SIZE)


@register(
    "student_page_last",
    oracle=f"""WITH n AS (SELECT count(*) AS total FROM scored),
       p AS (SELECT total, CAST(greatest(1, ceil(total / {PAGE_SIZE}.0)) AS INTEGER) AS last FROM n)
       SELECT s.* EXCLUDE (rn), CAST(rn AS INTEGER) AS position, p.last AS page, p.last AS total_pages,
              p.total AS total_records
       FROM (SELECT *, row_number() OVER (ORDER BY coalesce(clicks, 0), id, code_module, code_presentation)
                    AS rn FROM scored) s, p
       WHERE rn > (p.last - 1) * {PAGE_SIZE} AND rn <= p.last * {PAGE_SIZE}""",
    doubles=_SCORED_DOUBLES,
    survey_ids="F2",
)
def q_student_page_last(spark, sf_dir):
    """The last page (a page number past the end is clamped), read from the rows stored in this order."""
    return ranking.stored_page(sorted_rows(spark, sf_dir, "clicks", "asc"), page=10**9, page_size=PAGE_SIZE)


LOOKUP_ID = "7"


@register(
    "student_lookup",
    oracle=f"SELECT * FROM scored WHERE id = '{LOOKUP_ID}' ORDER BY code_module, code_presentation LIMIT 1",
    doubles=_SCORED_DOUBLES,
    survey_ids="C6",
)
def q_student_lookup(spark, sf_dir):
    """From the rows stored by student: one part of them is read."""
    return ranking.stored_lookup(sorted_rows(spark, sf_dir), LOOKUP_ID)


@register(
    "visible_rows",
    oracle="SELECT * FROM scored WHERE coalesce(code_module, '') IN ('M1', 'M3')",
    doubles=_SCORED_DOUBLES,
    survey_ids="B16",
)
def q_visible_rows(spark, sf_dir):
    return ranking.visible_rows(scored_frame(spark, sf_dir), ["M1", "M3"])


@register(
    "student_filter",
    oracle="SELECT * FROM scored WHERE code_module = 'M2' AND risk IN (2, 3) AND withdrew_early = 0",
    doubles=_SCORED_DOUBLES,
    survey_ids="B17",
)
def q_student_filter(spark, sf_dir):
    return ranking.student_filter(scored_frame(spark, sf_dir), module="M2", tiers=[2, 3], withdrew=0)


@register(
    "student_search",
    oracle="SELECT * FROM scored WHERE contains(lower(coalesce(id, '')), '12')",
    doubles=_SCORED_DOUBLES,
    survey_ids="B18",
)
def q_student_search(spark, sf_dir):
    return ranking.student_search(scored_frame(spark, sf_dir), "12")


@register(
    "student_search_wide",
    oracle="""SELECT * FROM scored WHERE contains(lower(coalesce(id, '')), 'm1')
       OR contains(lower(coalesce(code_module, '')), 'm1') OR contains(lower(coalesce(code_presentation, '')), 'm1')""",
    doubles=_SCORED_DOUBLES,
    survey_ids="B18",
)
def q_student_search_wide(spark, sf_dir):
    return ranking.student_search(scored_frame(spark, sf_dir), "M1", ("id", "code_module", "code_presentation"))


# ── statistics (D12-D14) ───────────────────────────────────────────────────

_UNPIVOT_SELECT = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in SCORED_FEATURES)
_VALS_CTE = f""", vals AS (
  SELECT risk, field, v FROM (
    UNPIVOT (SELECT CAST(risk AS INTEGER) AS risk, {_UNPIVOT_SELECT} FROM scored)
    ON {", ".join(SCORED_FEATURES)} INTO NAME field VALUE v)
  WHERE v IS NOT NULL AND NOT isnan(v) AND v >= 0 AND risk IN (0, 1, 2, 3))"""


@register(
    "feature_histogram",
    ctes=_VALS_CTE
    + """,
  pct AS (SELECT field, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi0 FROM vals GROUP BY field),
  bnd AS (SELECT field, lo, CASE WHEN lo = hi0 THEN lo + 1 ELSE hi0 END AS hi FROM pct),
  bnd2 AS (SELECT field, lo, hi, (hi - lo) / 20 AS width FROM bnd),
  grid AS (SELECT field, lo, width, CAST(unnest(generate_series(0, 19)) AS INTEGER) AS bucket FROM bnd2),
  hits AS (
    SELECT g.field, g.bucket, v.risk FROM vals v JOIN grid g
      ON v.field = g.field AND g.lo + g.bucket * g.width <= v.v AND v.v < g.lo + (g.bucket + 1) * g.width
    UNION ALL
    SELECT v.field, 19 AS bucket, v.risk FROM vals v JOIN bnd2 b ON v.field = b.field WHERE v.v >= b.hi),
  hcounts AS (SELECT field, bucket, """
    + _tiers_sql()
    + """ FROM hits GROUP BY field, bucket)""",
    oracle="""SELECT g.field, g.bucket, g.lo + g.bucket * g.width AS bucket_lo, g.lo + (g.bucket + 1) * g.width AS bucket_hi,
       printf('%.2f', g.lo + g.bucket * g.width) || '–' || printf('%.2f', g.lo + (g.bucket + 1) * g.width) AS label,
       coalesce(c.safe, 0) AS safe, coalesce(c.watch, 0) AS watch, coalesce(c.high, 0) AS high,
       coalesce(c.crit, 0) AS crit
       FROM grid g LEFT JOIN hcounts c USING (field, bucket)""",
    doubles=["bucket_lo", "bucket_hi"],
    survey_ids="D12 B19",
)
def q_feature_histogram(spark, sf_dir):
    return stats.feature_histogram(scored_frame(spark, sf_dir))


@register(
    "feature_boxplot",
    ctes=_VALS_CTE,
    oracle=f"""SELECT field, risk AS tier, quantile_cont(v, 0.01) AS "min", quantile_cont(v, 0.25) AS q1,
       quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.99) AS "max"
       FROM vals WHERE field IN ({", ".join(repr(f) for f in stats.DEFAULT_BOX_FIELDS)})
       GROUP BY field, risk""",
    doubles=["min", "q1", "median", "q3", "max"],
    survey_ids="D13",
)
def q_feature_boxplot(spark, sf_dir):
    return stats.feature_boxplot(scored_frame(spark, sf_dir))


def _correlation_sql() -> tuple[str, str]:
    pairs = list(combinations(SCORED_FEATURES, 2))
    valid = lambda c: f"({c} IS NOT NULL AND NOT isnan({c}) AND {c} >= 0)"
    cols = []
    for i, (a, b) in enumerate(pairs):
        both = f"{valid(a)} AND {valid(b)}"
        x, y = f"CASE WHEN {both} THEN {a} END", f"CASE WHEN {both} THEN {b} END"
        cols.append(
            f"coalesce(CASE WHEN stddev_pop({x}) * stddev_pop({y}) <> 0 "
            f"THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END, 0) AS r{i}"
        )
    names = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(pairs))
    on = ", ".join(f"r{i}" for i in range(len(pairs)))
    dbl = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in SCORED_FEATURES)
    ctes = f""", sdbl AS (SELECT {dbl} FROM scored),
  wide AS (SELECT {", ".join(cols)} FROM sdbl),
  longr AS (SELECT CAST(substr(k, 2) AS INTEGER) AS i, r FROM (UNPIVOT wide ON {on} INTO NAME k VALUE r)),
  pairs(i, feature_x, feature_y) AS (VALUES {names})"""
    return ctes, "SELECT p.feature_x, p.feature_y, l.r FROM longr l JOIN pairs p USING (i)"


_CORR_CTES, _CORR_SQL = _correlation_sql()


@register("feature_correlation", ctes=_CORR_CTES, oracle=_CORR_SQL, doubles=["r"], survey_ids="D14")
def q_feature_correlation(spark, sf_dir):
    return stats.feature_correlation(scored_frame(spark, sf_dir))
