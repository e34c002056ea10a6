"""Shared SQL (DuckDB dialect) for the correctness oracle.

``BASE_CTES`` derives the seven raw tables from the registered test views
(``orders``, ``lineitem``, ``customer``, ``nation``, ``part``), the feature
table and the scored frame, written independently of the DataFrame code.
Each query's oracle is ``WITH <BASE_CTES>, <its own CTEs> SELECT ...``.
Doubles are rounded to 6 places on both sides (summation order differs).
"""

from __future__ import annotations

FORUM = "'forumng', 'oucollaborate'"
QUIZ = "'quiz', 'questionnaire', 'externalquiz'"
RESOURCE = "'resource', 'url', 'page', 'oucontent', 'pdf', 'html_activity'"

BASE_CTES = f"""
ord AS (
  SELECT o_orderkey,
         o_custkey AS id_student,
         'M' || substr(o_orderpriority, 1, 1) AS code_module,
         CAST(year(o_orderdate) AS VARCHAR) || 'J' AS code_presentation,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS m,
         CAST(year(o_orderdate) AS INTEGER) AS y,
         o_orderstatus, o_totalprice
  FROM orders
),
enr AS (
  SELECT id_student, code_module, code_presentation,
         max(m) AS m, max(y) AS y, max(o_orderstatus) AS st,
         count(*) AS n, max(o_totalprice) AS mx
  FROM ord GROUP BY id_student, code_module, code_presentation
),
cust AS (
  SELECT c_custkey, c_nationkey, c_mktsegment,
         CAST(floor((c_acctbal + 1000) / 1100) AS INTEGER) AS k
  FROM customer
),
raw_student_info AS (
  SELECT e.code_module, e.code_presentation, e.id_student,
         CASE WHEN e.id_student % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
         na.n_name AS region,
         c.c_mktsegment AS highest_education,
         CASE WHEN c.c_nationkey = 7 THEN ''
              WHEN c.c_nationkey = 8 THEN NULL
              WHEN c.k = 1 THEN '10-20'
              ELSE CAST(c.k * 10 AS VARCHAR) || '-' || CAST(c.k * 10 + 10 AS VARCHAR) || '%' END AS imd_band,
         CASE c.c_nationkey % 4 WHEN 0 THEN '0-35' WHEN 1 THEN '35-55' WHEN 2 THEN '55<=' END AS age_band,
         CAST(e.n - 1 AS INTEGER) AS num_of_prev_attempts,
         CAST(e.n * 30 AS INTEGER) AS studied_credits,
         CASE WHEN e.id_student % 10 = 0 THEN 'Y' ELSE 'N' END AS disability,
         CASE WHEN e.st = 'F' THEN 'Fail'
              WHEN e.st = 'O' THEN 'Withdrawn'
              WHEN e.st = 'P' AND e.mx > 400000 THEN 'Distinction'
              WHEN e.st = 'P' THEN 'Pass' END AS final_result
  FROM enr e
  JOIN cust c ON e.id_student = c.c_custkey
  JOIN nation na ON c.c_nationkey = na.n_nationkey
),
raw_registration AS (
  SELECT code_module, code_presentation, id_student,
         CASE WHEN id_student % 17 = 0 THEN NULL ELSE CAST(5 - id_student % 60 AS INTEGER) END AS date_registration,
         CASE WHEN st = 'O' AND id_student % 3 = 0 THEN CAST(id_student % 100 AS INTEGER) END AS date_unregistration
  FROM enr
),
course_keys AS (
  SELECT code_module, code_presentation, max(m) AS m, max(y) AS y
  FROM enr GROUP BY code_module, code_presentation
),
raw_courses AS (
  SELECT code_module, code_presentation,
         CAST(CASE WHEN m = 5 AND y = 2001 THEN 0 ELSE m * 2 END AS INTEGER) AS module_presentation_length
  FROM course_keys
),
assess_lines AS (
  SELECT code_module, code_presentation, m, y, unnest(generate_series(1, 7)) AS ln FROM course_keys
),
raw_assessments AS (
  SELECT code_module, code_presentation,
         CAST(m * 1000000 + y * 10 + ln AS BIGINT) AS id_assessment,
         CASE WHEN ln <= 3 THEN 'TMA' WHEN ln <= 6 THEN 'CMA' ELSE 'Exam' END AS assessment_type,
         CAST(CASE WHEN ln = 7 THEN NULL ELSE ln * 40 END AS INTEGER) AS "date",
         CASE WHEN ln <= 3 THEN CAST(20 AS DOUBLE) WHEN ln = 4 THEN CAST(0 AS DOUBLE)
              WHEN ln <= 6 THEN CAST(10 AS DOUBLE) ELSE CAST(100 AS DOUBLE) END AS weight
  FROM assess_lines
),
order_lines AS (
  SELECT l.l_partkey, l.l_linenumber, l.l_quantity, l.l_returnflag, l.l_linestatus, l.l_shipdate,
         o.id_student, o.code_module, o.code_presentation, o.m, o.y
  FROM lineitem l JOIN ord o ON l.l_orderkey = o.o_orderkey
),
raw_student_assessment AS (
  SELECT CAST(m * 1000000 + y * 10 + l_linenumber AS BIGINT) AS id_assessment,
         id_student,
         CAST(dayofyear(l_shipdate) AS INTEGER) AS date_submitted,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END AS is_banked,
         CASE WHEN l_quantity = 13 THEN NULL ELSE l_quantity * 2 END AS score
  FROM order_lines
),
raw_student_vle AS (
  SELECT code_module, code_presentation, id_student,
         l_partkey AS id_site,
         CAST(dayofyear(l_shipdate) - 30 AS INTEGER) AS "date",
         CAST(l_quantity AS INTEGER) AS sum_click
  FROM order_lines
),
raw_vle AS (
  SELECT p_partkey AS id_site,
         CASE p_type WHEN 'ECONOMY' THEN 'forumng' WHEN 'LARGE' THEN 'quiz' WHEN 'MEDIUM' THEN 'resource'
                     WHEN 'PROMO' THEN 'oucontent' WHEN 'SMALL' THEN 'homepage' WHEN 'STANDARD' THEN 'ouwiki' END
           AS activity_type
  FROM part WHERE p_size <= 45
),
vle_agg AS (
  SELECT v.id_student, v.code_module, v.code_presentation,
         CAST(sum(v.sum_click) AS BIGINT) AS total_clicks,
         count(DISTINCT v."date") AS active_days,
         count(DISTINCT floor(v."date" / 7)) AS active_weeks,
         CAST(sum(CASE WHEN s.activity_type IN ({FORUM}) THEN v.sum_click ELSE 0 END) AS BIGINT) AS forum_clicks,
         CAST(sum(CASE WHEN s.activity_type IN ({QUIZ}) THEN v.sum_click ELSE 0 END) AS BIGINT) AS quiz_clicks,
         CAST(sum(CASE WHEN s.activity_type IN ({RESOURCE}) THEN v.sum_click ELSE 0 END) AS BIGINT) AS resource_clicks
  FROM raw_student_vle v LEFT JOIN raw_vle s ON v.id_site = s.id_site
  GROUP BY v.id_student, v.code_module, v.code_presentation
),
vle_feat AS (
  SELECT a.*,
         CASE WHEN a.active_days > 0 THEN CAST(a.total_clicks AS DOUBLE) / a.active_days ELSE CAST(0 AS DOUBLE) END
           AS clicks_per_day,
         CASE WHEN c.module_presentation_length IS NOT NULL AND c.module_presentation_length > 0
              THEN least(CAST(a.active_days AS DOUBLE) / c.module_presentation_length, CAST(1 AS DOUBLE))
              ELSE CAST(0 AS DOUBLE) END AS engagement_ratio
  FROM vle_agg a
  LEFT JOIN raw_courses c ON a.code_module = c.code_module AND a.code_presentation = c.code_presentation
),
assess_joined AS (
  SELECT sa.id_assessment, sa.id_student, sa.date_submitted, sa.score,
         a.code_module, a.code_presentation, a.weight, a."date", a.assessment_type
  FROM raw_student_assessment sa
  LEFT JOIN raw_assessments a ON sa.id_assessment = a.id_assessment
  WHERE sa.is_banked = 0
),
assess_scores AS (
  SELECT id_student, code_module, code_presentation,
         avg(score) AS avg_score,
         CASE WHEN sum(weight) > 0 THEN sum(score * weight) / sum(weight) END AS weighted_avg_score,
         count(id_assessment) AS num_submitted,
         avg(CASE WHEN date_submitted IS NOT NULL THEN "date" - date_submitted END) AS avg_days_early,
         avg(CASE WHEN assessment_type = 'Exam' THEN score END) AS exam_score,
         avg(CASE WHEN assessment_type = 'TMA' THEN score END) AS tma_score,
         avg(CASE WHEN assessment_type = 'CMA' THEN score END) AS cma_score
  FROM assess_joined
  GROUP BY id_student, code_module, code_presentation
),
assess_totals AS (
  SELECT code_module, code_presentation, count(id_assessment) AS total_assessments
  FROM raw_assessments GROUP BY code_module, code_presentation
),
assess_feat AS (
  SELECT s.id_student, s.code_module, s.code_presentation,
         s.avg_score, s.weighted_avg_score, s.avg_days_early, s.exam_score, s.tma_score, s.cma_score,
         CASE WHEN t.total_assessments > 0 THEN CAST(s.num_submitted AS DOUBLE) / t.total_assessments
              ELSE CAST(0 AS DOUBLE) END AS submission_rate
  FROM assess_scores s
  LEFT JOIN assess_totals t ON s.code_module = t.code_module AND s.code_presentation = t.code_presentation
),
reg_feat AS (
  SELECT id_student, code_module, code_presentation,
         CASE WHEN date_unregistration IS NOT NULL THEN 1 ELSE 0 END AS withdrew_early,
         CASE WHEN date_registration IS NOT NULL THEN CAST(-date_registration AS INTEGER) ELSE 0 END
           AS days_before_start
  FROM raw_registration
),
demo_feat AS (
  SELECT id_student, code_module, code_presentation,
         CASE WHEN final_result IN ('Pass', 'Distinction') THEN 0 ELSE 1 END AS label,
         num_of_prev_attempts AS num_prev_attempts,
         CAST(trunc(TRY_CAST(regexp_extract(imd_band, '(\\d+)', 1) AS INTEGER) / 10) AS INTEGER) AS imd_band_encoded,
         CASE WHEN disability = 'Y' THEN 1 ELSE 0 END AS disability_encoded,
         gender, region, highest_education, imd_band, age_band, studied_credits, disability, final_result
  FROM raw_student_info
),
features AS (
  SELECT d.id_student, d.code_module, d.code_presentation, d.label,
         coalesce(v.total_clicks, 0) AS total_clicks,
         coalesce(v.active_days, 0) AS active_days,
         coalesce(v.clicks_per_day, 0) AS clicks_per_day,
         coalesce(v.forum_clicks, 0) AS forum_clicks,
         coalesce(v.quiz_clicks, 0) AS quiz_clicks,
         coalesce(v.resource_clicks, 0) AS resource_clicks,
         coalesce(v.active_weeks, 0) AS active_weeks,
         coalesce(v.engagement_ratio, 0) AS engagement_ratio,
         coalesce(a.avg_score, 0) AS avg_score,
         coalesce(a.weighted_avg_score, 0) AS weighted_avg_score,
         coalesce(a.submission_rate, 0) AS submission_rate,
         coalesce(a.avg_days_early, 0) AS avg_days_early,
         coalesce(a.exam_score, 0) AS exam_score,
         coalesce(a.tma_score, 0) AS tma_score,
         coalesce(a.cma_score, 0) AS cma_score,
         coalesce(r.withdrew_early, 0) AS withdrew_early,
         coalesce(r.days_before_start, 0) AS days_before_start,
         coalesce(d.num_prev_attempts, 0) AS num_prev_attempts,
         coalesce(d.imd_band_encoded, 0) AS imd_band_encoded,
         coalesce(d.disability_encoded, 0) AS disability_encoded,
         d.gender, d.region, d.highest_education, d.imd_band, d.age_band, d.studied_credits, d.disability,
         d.final_result
  FROM demo_feat d
  LEFT JOIN vle_feat v USING (id_student, code_module, code_presentation)
  LEFT JOIN assess_feat a USING (id_student, code_module, code_presentation)
  LEFT JOIN reg_feat r USING (id_student, code_module, code_presentation)
),
tiered AS (
  SELECT f.*,
         CASE WHEN withdrew_early = 1 THEN 3
              WHEN label = 1 AND (avg_score < 40 OR submission_rate < 0.25 OR total_clicks < 10) THEN 3
              WHEN label = 1 THEN 2
              WHEN avg_score < 60 OR submission_rate < 0.6 OR avg_days_early < -7 THEN 1
              ELSE 0 END AS risk
  FROM features f
),
scored AS (
  SELECT CAST(id_student AS VARCHAR) AS id, id_student, code_module, code_presentation,
         CAST(id_student AS VARCHAR) || '|' || code_module || '|' || code_presentation AS row_key,
         CAST(total_clicks AS DOUBLE) AS clicks,
         CAST(active_days AS BIGINT) AS active_days,
         CAST(active_weeks AS BIGINT) AS active_weeks,
         CAST(engagement_ratio AS DOUBLE) AS engagement_ratio,
         CAST(forum_clicks AS DOUBLE) AS forum_clicks,
         CAST(quiz_clicks AS DOUBLE) AS quiz_clicks,
         CAST(resource_clicks AS DOUBLE) AS resource_clicks,
         CAST(avg_score AS DOUBLE) AS score,
         CAST(weighted_avg_score AS DOUBLE) AS weighted_score,
         CAST(submission_rate AS DOUBLE) AS submission_rate,
         CAST(avg_days_early AS DOUBLE) AS avg_days_early,
         CAST(exam_score AS DOUBLE) AS exam_score,
         CAST(tma_score AS DOUBLE) AS tma_score,
         CAST(cma_score AS DOUBLE) AS cma_score,
         CAST(withdrew_early AS INTEGER) AS withdrew_early,
         CAST(num_prev_attempts AS INTEGER) AS num_prev_attempts,
         CAST(imd_band_encoded AS INTEGER) AS imd_band_encoded,
         CAST(disability_encoded AS INTEGER) AS disability_encoded,
         CAST(days_before_start AS DOUBLE) AS days_before_start,
         coalesce(gender, '') AS gender,
         coalesce(region, '') AS region,
         coalesce(highest_education, '') AS highest_education,
         coalesce(imd_band, '') AS imd_band,
         coalesce(age_band, '') AS age_band,
         CAST(coalesce(studied_credits, 0) AS INTEGER) AS studied_credits,
         coalesce(disability, '') AS disability,
         coalesce(final_result, '') AS final_result,
         CAST(label AS INTEGER) AS label,
         CAST(risk AS INTEGER) AS risk,
         CASE risk WHEN 0 THEN 'Safe' WHEN 1 THEN 'Watch' WHEN 2 THEN 'High Risk' WHEN 3 THEN 'Critical'
                   ELSE 'Unknown' END AS risk_label
  FROM tiered
)
"""

