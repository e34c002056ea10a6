"""Registered queries: recommendations, report datasets, export, prediction
store, sources/sinks and key quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cohortlens.operators import quality, ranking, reports
from cohortlens.plans.core_queries import KEYS_SQL, VALID_ID, CLAMP, scored_frame, tables
from cohortlens.plans.registry import register
from cohortlens.session import scratch_path
from cohortlens.sources import io
from cohortlens.sources.testdata import read_table


def fx(expr: str, digits: int) -> str:
    return f"printf('%.{digits}f', {expr})"


def pct0(expr: str) -> str:
    return f"printf('%.0f', ({expr}) * 100) || '%'"


#: A double as text, plain digits between 0.0001 and 1e16 (the test values are all in between).
FLOAT_TEXT = "CAST(CAST({c} AS DOUBLE) AS VARCHAR)"


def grp(expr: str) -> str:
    return f"format('{{:,}}', CAST({expr} AS BIGINT))"


# ── recommendations (G1) ───────────────────────────────────────────────────

_S, _R, _D, _E = "coalesce(score, 0)", "coalesce(submission_rate, 0)", "coalesce(active_days, 0)", "coalesce(avg_days_early, 0)"
_P, _C, _FO = "coalesce(num_prev_attempts, 0)", "coalesce(clicks, 0)", "coalesce(forum_clicks, 0)"
_W, _T = "coalesce(withdrew_early, 0)", "coalesce(risk, 0)"
_T0 = f"NOT ({_T} IN (1, 2, 3))"
_WATCH = f"({_S} < 60 OR {_R} < 0.6 OR {_D} < 10 OR {_E} < -7)"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rules_sql() -> list[tuple[str, str, str, str]]:
    """Same rules as ``reports.recommendation_rules`` written as SQL."""
    s1 = fx(_S, 1)
    return [
        ("crit_unregistered", "crit", f"{_T} = 3 AND {_W} <> 0",
         _lit("Formally unregistered: contact the student in person to learn why and discuss a return.")),
        ("crit_escalate", "crit", f"{_T} = 3 AND {_W} = 0",
         _lit("Several severe risk signals: arrange personal contact within 48 hours.")),
        ("crit_low_score", "crit", f"{_T} = 3 AND {_S} < 40",
         f"'Average score ' || {s1} || ' is far below the pass mark: offer counselling and catch-up sessions.'"),
        ("crit_low_submission", "high", f"{_T} = 3 AND {_R} < 0.25",
         f"'Only ' || {pct0(_R)} || ' of assessments handed in: check access and personal circumstances.'"),
        ("crit_repeat_attempt", "high", f"{_T} = 3 AND {_P} >= 2",
         f"'Attempt number ' || CAST({_P} + 1 AS VARCHAR) || ' at this module: review earlier support and adapt it.'"),
        ("high_lead", "high", f"{_T} = 2",
         _lit("High risk of not completing: start active academic support before the next deadline.")),
        ("high_low_score", "high", f"{_T} = 2 AND {_S} < 60",
         f"'Score ' || {s1} || ' shows steady underperformance: suggest study sessions or peer tutoring.'"),
        ("high_low_submission", "high", f"{_T} = 2 AND {_R} < 0.6",
         f"'Submission rate ' || {pct0(_R)} || ': encourage handing in even partial work.'"),
        ("high_late", "watch", f"{_T} = 2 AND {_E} < -3",
         f"'Work arrives ' || {fx(f'abs({_E})', 1)} || ' days late on average: plan deadlines together.'"),
        ("high_effort_gap", "watch", f"{_T} = 2 AND {_C} > 200 AND {_S} < 50",
         _lit("Much online activity but low scores: a one-to-one tutorial may turn effort into results.")),
        ("high_low_forum", "watch", f"{_T} = 2 AND {_FO} < 5",
         _lit("Hardly any forum use: invite the student to a study group.")),
        ("watch_lead", "watch", f"{_T} = 1",
         _lit("Passing so far with early warning signs: a light check-in within two weeks is advised.")),
        ("watch_low_score", "watch", f"{_T} = 1 AND {_S} < 60",
         f"'Score ' || {s1} || ' is close to the pass mark: focus on the coming assessments.'"),
        ("watch_low_submission", "watch", f"{_T} = 1 AND {_R} < 0.6",
         f"'Submission rate ' || {pct0(_R)} || ': remind the student of upcoming deadlines.'"),
        ("watch_few_days", "watch", f"{_T} = 1 AND {_D} < 10",
         f"'Only ' || CAST({_D} AS VARCHAR) || ' active day(s) online: encourage regular study.'"),
        ("watch_late", "watch", f"{_T} = 1 AND {_E} < -7",
         _lit("Repeated late submissions: a short talk about workload may help.")),
        ("watch_no_action", "safe", f"{_T} = 1 AND NOT {_WATCH}",
         _lit("No action needed now: keep following engagement in the coming weeks.")),
        ("safe_outstanding", "safe", f"{_T0} AND {_S} >= 90",
         _lit("Outstanding results: consider peer-tutoring or extra challenge tasks.")),
        ("safe_on_track", "safe", f"{_T0} AND {_S} < 90 AND {_D} > 0", _lit("On track: no intervention needed.")),
        ("safe_no_activity", "watch", f"{_T0} AND {_S} < 90 AND {_D} <= 0",
         _lit("No online activity recorded yet: check that the student can reach the course.")),
    ]


_REC_LIST = ",\n      ".join(
    f"CASE WHEN {cond} THEN {{'rule_id': '{rid}', 'level': '{lvl}', 'text': {text}}} END"
    for rid, lvl, cond, text in _rules_sql()
)


@register(
    "recommendations",
    ctes=f""", rec_lists AS (
  SELECT {KEYS_SQL}, list_filter([
      {_REC_LIST}], lambda x: x IS NOT NULL) AS recs
  FROM scored),
  rec_rows AS (SELECT {KEYS_SQL}, unnest(recs) AS rec, unnest(generate_series(1, len(recs))) AS pos FROM rec_lists)""",
    oracle=f"""SELECT {KEYS_SQL}, CAST(pos - 1 AS INTEGER) AS position, rec.rule_id AS rule_id, rec.level AS level,
       rec.text AS text FROM rec_rows""",
    survey_ids="G1",
)
def q_recommendations(spark, sf_dir):
    return reports.recommendations(scored_frame(spark, sf_dir))


# ── bands, profile, cohort report, export (B21, B23, I1, I2, A9) ───────────


@register(
    "metric_bands",
    oracle=f"""SELECT {KEYS_SQL},
       CASE WHEN {_S} < 40 THEN 'crit' WHEN {_S} < 60 THEN 'watch' WHEN {_S} < 75 THEN 'high' ELSE 'safe' END
         AS score_band,
       CAST(round({_R} * 100) AS BIGINT) AS submission_pct,
       CASE WHEN round({_R} * 100) < 40 THEN 'crit' WHEN round({_R} * 100) < 70 THEN 'watch' ELSE 'safe' END
         AS submission_band,
       CAST(round(coalesce(engagement_ratio, 0) * 100) AS BIGINT) AS engagement_pct,
       CASE WHEN round(coalesce(engagement_ratio, 0) * 100) < 20 THEN 'crit'
            WHEN round(coalesce(engagement_ratio, 0) * 100) < 50 THEN 'watch' ELSE 'safe' END AS engagement_band
       FROM scored""",
    survey_ids="B21",
)
def q_metric_bands(spark, sf_dir):
    return reports.metric_bands(scored_frame(spark, sf_dir))


def _dash(c: str) -> str:
    return f"CASE WHEN coalesce({c}, '') = '' THEN '—' ELSE {c} END"


def _profile_sql() -> str:
    e = _E
    timing = (
        f"CASE WHEN {e} > 0 THEN {fx(f'abs({e})', 1)} || ' days early' "
        f"WHEN {e} < 0 THEN {fx(f'abs({e})', 1)} || ' days late' ELSE 'on deadline' END"
    )
    o100 = lambda c: f"{fx(f'coalesce({c}, 0)', 2)} || ' / 100'"
    whole = lambda c: grp(f"coalesce({c}, 0)")
    gender = "CASE WHEN coalesce(gender, '') = 'M' THEN 'Male' WHEN coalesce(gender, '') = 'F' THEN 'Female' " \
             "WHEN coalesce(gender, '') = '' THEN '—' ELSE gender END"
    dis = "CASE WHEN disability = 'Y' OR (disability NOT IN ('Y', 'N') AND disability_encoded = 1) THEN 'Yes' " \
          "WHEN disability = 'N' OR disability_encoded = 0 THEN 'No' ELSE '—' END"
    imd = "CASE WHEN imd_band <> '' THEN imd_band WHEN imd_band_encoded BETWEEN 0 AND 9 THEN (imd_band_encoded * 10) || '–' || " \
          "(imd_band_encoded * 10 + 10) || '%' WHEN imd_band_encoded > 9 THEN 'Unknown' ELSE '—' END"
    a, v, b = "Academic Performance", "VLE Engagement", "Student Background"
    items = [
        (a, "Average Score", o100("score")), (a, "Weighted Score", o100("weighted_score")),
        (a, "Exam Score", o100("exam_score")), (a, "TMA Score", o100("tma_score")), (a, "CMA Score", o100("cma_score")),
        (a, "Submission Rate", pct0(_R)), (a, "Avg Submission Timing", timing),
        (v, "Engagement Ratio", f"{fx('coalesce(engagement_ratio, 0) * 100', 1)} || '%'"),
        (v, "Active Days", f"CAST({_D} AS VARCHAR)"),
        (v, "Active Weeks", "CAST(coalesce(active_weeks, 0) AS VARCHAR)"),
        (v, "Total Clicks", whole("clicks")),
        (v, "Clicks / Active Day", f"CASE WHEN {_D} <> 0 THEN {fx(f'{_C} / {_D}', 1)} ELSE '—' END"),
        (v, "Forum Clicks", whole("forum_clicks")), (v, "Quiz Clicks", whole("quiz_clicks")),
        (v, "Resource Clicks", whole("resource_clicks")),
        (b, "Gender", gender), (b, "Age Band", _dash("age_band")), (b, "Region", _dash("region")),
        (b, "Highest Education", _dash("highest_education")), (b, "IMD Band", imd),
        (b, "Disability", dis), (b, "Studied Credits", "coalesce(CAST(studied_credits AS VARCHAR), '—')"),
        (b, "Prev Attempts", f"CAST({_P} AS VARCHAR)"),
        (b, "Days Before Start", "CAST(CAST(trunc(coalesce(days_before_start, 0)) AS BIGINT) AS VARCHAR) || ' days'"),
        (b, "Formally Withdrew", f"CASE WHEN {_W} <> 0 THEN 'Yes' ELSE 'No' END"),
    ]
    return ",\n      ".join(
        f"{{'position': {i}, 'section': '{s}', 'label': '{lab}', 'value': {val}}}" for i, (s, lab, val) in enumerate(items)
    )


@register(
    "student_profile",
    ctes=f""", prof AS (SELECT {KEYS_SQL}, risk_label, unnest([
      {_profile_sql()}]) AS item FROM scored)""",
    oracle=f"""SELECT {KEYS_SQL}, risk_label, CAST(item.position AS INTEGER) AS position, item.section AS section,
       item.label AS label, item.value AS value FROM prof""",
    survey_ids="B23 I1",
)
def q_student_profile(spark, sf_dir):
    return reports.student_profile(scored_frame(spark, sf_dir))


def _share(c: str) -> str:
    return (f"CASE WHEN unique_students > 0 THEN {grp(c)} || '  (' || {fx(f'{c} / unique_students * 100', 1)} "
            f"|| '%)' ELSE '0' END")


@register(
    "cohort_report",
    ctes=f""", cr_ps AS (SELECT id, max({CLAMP}) AS worst, avg(coalesce(score, 0)) AS s,
         avg(coalesce(engagement_ratio, 0)) AS e, avg(coalesce(clicks, 0)) AS c FROM scored WHERE {VALID_ID} GROUP BY id),
  cr AS (SELECT count(*) AS unique_students, count(*) FILTER (WHERE worst = 3) AS critical,
         count(*) FILTER (WHERE worst = 2) AS high_risk, count(*) FILTER (WHERE worst = 1) AS watch,
         count(*) FILTER (WHERE worst = 0) AS safe, coalesce(avg(s), 0) AS avg_score,
         coalesce(avg(e), 0) AS avg_engagement, coalesce(avg(c), 0) AS avg_clicks FROM cr_ps),
  cr_items AS (SELECT unnest([
      {{'position': 0, 'label': 'Total Students', 'value': {grp('unique_students')}}},
      {{'position': 1, 'label': 'Critical', 'value': {_share('critical')}}},
      {{'position': 2, 'label': 'High Risk', 'value': {_share('high_risk')}}},
      {{'position': 3, 'label': 'Watch', 'value': {_share('watch')}}},
      {{'position': 4, 'label': 'Safe', 'value': {_share('safe')}}},
      {{'position': 5, 'label': 'High + Critical', 'value': {grp('critical + high_risk')} || '  (' ||
          {fx('CASE WHEN unique_students > 0 THEN (critical + high_risk) / unique_students * 100 ELSE 0 END', 1)} || '%)'}},
      {{'position': 6, 'label': 'Avg Score', 'value': {fx('avg_score', 1)} || ' / 100'}},
      {{'position': 7, 'label': 'Avg Engagement', 'value': {fx('avg_engagement * 100', 1)} || '%'}},
      {{'position': 8, 'label': 'Avg Total Clicks', 'value': format('{{:,.0f}}', avg_clicks)}}
  ]) AS item FROM cr)""",
    oracle="SELECT CAST(item.position AS INTEGER) AS position, item.label AS label, item.value AS value FROM cr_items",
    survey_ids="I2",
)
def q_cohort_report(spark, sf_dir):
    return reports.cohort_overview(scored_frame(spark, sf_dir))


#: SQL of each kind of export column.
_EXPORT_SQL = {
    "text": "CAST({c} AS VARCHAR)",
    "float": FLOAT_TEXT,
    "gender": "CASE WHEN gender = 'M' THEN 'Male' WHEN gender = 'F' THEN 'Female' ELSE gender END",
    "disability": "CASE WHEN disability = 'Y' THEN 'Yes' WHEN disability = 'N' THEN 'No' END",
    "yes_no": "CASE WHEN {c} = 1 THEN 'Yes' ELSE 'No' END",
    "fixed0": "printf('%.0f', {c})",
    "fixed1": "printf('%.1f', {c})",
    "fixed2": "printf('%.2f', {c})",
    "percent0": "printf('%.0f', {c} * 100) || '%'",
    "percent1": "printf('%.1f', {c} * 100) || '%'",
}


def _export_sql(names: dict[str, str] | None = None) -> str:
    """The export columns, under their fields or the names given for them."""
    return ",\n       ".join(
        f"coalesce({_EXPORT_SQL[kind].format(c=f)}, '') AS \"{(names or {}).get(f, f)}\"" for f, _, kind in reports.EXPORT_FORMATS
    )


@register(
    "student_export",
    oracle=f"SELECT {_export_sql()} FROM scored WHERE risk IN (2, 3)",
    survey_ids="A9",
)
def q_student_export(spark, sf_dir):
    rows = ranking.student_sort(ranking.student_filter(scored_frame(spark, sf_dir), tiers=[2, 3]))
    return reports.export_frame(rows)


# ── prediction store (A5, A7, A8) ──────────────────────────────────────────

_INFO_ALL = io.INFO_TEXT + io.INFO_FLOAT + io.INFO_INT


@register(
    "export_file",
    oracle=f"SELECT {_export_sql(dict(reports.EXPORT_COLUMNS))} FROM scored WHERE risk IN (2, 3)",
    survey_ids="A9",
)
def q_export_file(spark, sf_dir):
    """The export written as CSV under its labels and read back as text."""
    path = scratch_path(spark, "export")
    rows = ranking.student_filter(scored_frame(spark, sf_dir), tiers=[2, 3])
    reports.write_export_csv(reports.export_frame(rows), path)
    back = spark.read.option("header", True).option("emptyValue", "").option("nullValue", "\\N").csv(path)
    return back.fillna("")


@register(
    "prediction_rows",
    oracle="SELECT row_key, "
    + ", ".join(f"CAST({c} AS VARCHAR) AS info_{c}" for c in io.INFO_TEXT + io.INFO_INT)
    + ", "
    + ", ".join(f"{FLOAT_TEXT.format(c=f'round({c}, 6)')} AS info_{c}" for c in io.INFO_FLOAT)
    + ", CAST(risk AS VARCHAR) AS prediction_risk_tier FROM scored",
    survey_ids="A5",
)
def q_prediction_rows(spark, sf_dir):
    """The stored text, compared as text; averages are rounded first, as the engines add in different orders."""
    rounded = {c: F.round(c, 6) for c in io.INFO_FLOAT}
    return io.prediction_rows(scored_frame(spark, sf_dir).withColumns(rounded))


@register(
    "predictions_readback",
    oracle="SELECT id, " + ", ".join(io.INFO_TEXT + io.INFO_FLOAT) + ", "
    + ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in io.INFO_INT)
    + ", risk, risk_label FROM scored",
    doubles=list(io.INFO_FLOAT),
    survey_ids="A7",
)
def q_predictions_readback(spark, sf_dir):
    path = scratch_path(spark, "prediction-store")
    io.publish_predictions(scored_frame(spark, sf_dir), path)
    return io.predictions_readback(io.published_predictions(spark, path))


@register(
    "key_split",
    oracle="""SELECT row_key, split_part(row_key, '|', 1) AS id, split_part(row_key, '|', 2) AS module_part,
       split_part(row_key, '|', -1) AS last_part FROM scored""",
    survey_ids="A8",
)
def q_key_split(spark, sf_dir):
    return io.split_row_key(scored_frame(spark, sf_dir).select("row_key"))


# ── sources, sinks, audit (A1-A4, A12) and key quality (Q1) ────────────────

_RAW = ["student_info", "student_vle", "vle", "student_assessment", "assessments", "student_registration", "courses"]


@register(
    "source_row_counts",
    oracle=" UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS rows FROM raw_{t.replace('student_registration', 'registration')}"
        for t in _RAW
    ),
    survey_ids="A2",
)
def q_source_row_counts(spark, sf_dir):
    return io.source_row_counts({t: tables(spark, sf_dir)[t] for t in _RAW})


@register(
    "parquet_roundtrip",
    oracle="SELECT * FROM features",
    doubles=[
        "clicks_per_day", "engagement_ratio", "avg_score", "weighted_avg_score", "submission_rate",
        "avg_days_early", "exam_score", "tma_score", "cma_score",
    ],
    survey_ids="A3 A4",
)
def q_parquet_roundtrip(spark, sf_dir):
    from cohortlens.plans.core_queries import feature_frame

    path = scratch_path(spark, "features")
    io.write_table(feature_frame(spark, sf_dir), path, partition_by=["code_module"])
    return io.read_table(spark, path)


#: Raw columns whose values the scan query returns, one sum per table besides the row count.
_CSV_SUMS = {
    "student_info": "studied_credits",
    "student_vle": "sum_click",
    "vle": "id_site",
    "student_assessment": "score",
    "assessments": "weight",
    "student_registration": "date_registration",
    "courses": "module_presentation_length",
}


@register(
    "csv_scan",
    oracle=" UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS rows, count({c}) AS values, CAST(sum({c}) AS DOUBLE) AS total "
        f"FROM raw_{t.replace('student_registration', 'registration')}"
        for t, c in _CSV_SUMS.items()
    ),
    doubles=["total"],
    survey_ids="A1",
)
def q_csv_scan(spark, sf_dir):
    """Raw tables written as header CSV and read back with declared schemas: rows, values and total of a column each."""
    path = scratch_path(spark, "raw-csv")
    io.write_raw_csv(tables(spark, sf_dir), path)
    raw = io.read_raw_csv(spark, path)
    parts = [
        raw[t].agg(F.count(F.lit(1)).alias("rows"), F.count(c).alias("values"), F.sum(c).cast("double").alias("total"))
        .select(F.lit(t).alias("table"), "rows", "values", "total")
        for t, c in _CSV_SUMS.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("csv_rows", oracle="SELECT * REPLACE (nullif(imd_band, '') AS imd_band) FROM raw_student_info", survey_ids="A1")
def q_csv_rows(spark, sf_dir):
    """Every value of the enrollment table after a CSV round trip; CSV does not tell empty text from a missing value."""
    path = scratch_path(spark, "raw-info")
    io.write_raw_csv({"student_info": tables(spark, sf_dir)["student_info"]}, path)
    return io.read_raw_csv(spark, path, {"student_info": io.RAW_FILE_NAMES["student_info"]})["student_info"]


_INVENTORY = ["orders", "lineitem", "customer", "nation", "part"]


@register(
    "data_inventory",
    oracle=" UNION ALL ".join(f"SELECT '{t}' AS dataset, CAST(1 AS BIGINT) AS files, count(*) AS rows FROM {t}"
                              for t in _INVENTORY),
    survey_ids="A12",
)
def q_data_inventory(spark, sf_dir):
    return io.data_inventory(spark, {t: f"{sf_dir.rstrip('/')}/{t}.parquet" for t in _INVENTORY})


_Q_SQL = f"""
  SELECT 'student_info' AS "table", 'duplicate_keys' AS "check", count(*) AS groups,
         CAST(coalesce(sum(n), 0) AS BIGINT) AS rows
    FROM (SELECT count(*) AS n FROM raw_student_info GROUP BY {KEYS_SQL} HAVING count(*) > 1)
  UNION ALL SELECT 'student_registration', 'duplicate_keys', count(*), CAST(coalesce(sum(n), 0) AS BIGINT)
    FROM (SELECT count(*) AS n FROM raw_registration GROUP BY {KEYS_SQL} HAVING count(*) > 1)
  UNION ALL SELECT 'vle', 'duplicate_keys', count(*), CAST(coalesce(sum(n), 0) AS BIGINT)
    FROM (SELECT count(*) AS n FROM raw_vle GROUP BY id_site HAVING count(*) > 1)
  UNION ALL SELECT 'assessments', 'duplicate_keys', count(*), CAST(coalesce(sum(n), 0) AS BIGINT)
    FROM (SELECT count(*) AS n FROM raw_assessments GROUP BY id_assessment HAVING count(*) > 1)
  UNION ALL SELECT 'courses', 'duplicate_keys', count(*), CAST(coalesce(sum(n), 0) AS BIGINT)
    FROM (SELECT count(*) AS n FROM raw_courses GROUP BY code_module, code_presentation HAVING count(*) > 1)
  UNION ALL SELECT 'student_assessment', 'unknown_assessment', NULL, count(*)
    FROM raw_student_assessment s WHERE NOT EXISTS (SELECT 1 FROM raw_assessments a WHERE a.id_assessment = s.id_assessment)
  UNION ALL SELECT 'student_vle', 'unknown_site', NULL, count(*)
    FROM raw_student_vle s WHERE NOT EXISTS (SELECT 1 FROM raw_vle v WHERE v.id_site = s.id_site)
  UNION ALL SELECT 'student_registration', 'unknown_enrollment', NULL, count(*)
    FROM raw_registration r WHERE NOT EXISTS (SELECT 1 FROM raw_student_info i WHERE i.id_student = r.id_student
      AND i.code_module = r.code_module AND i.code_presentation = r.code_presentation)"""


@register("key_quality", oracle=_Q_SQL, survey_ids="Q1 T9")
def q_key_quality(spark, sf_dir):
    return quality.key_quality(tables(spark, sf_dir))
