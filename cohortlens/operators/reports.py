"""Report datasets: recommendations, metric bands, student profile, cohort
overview, and the formatted export frame.

Only contents are built here; drawing pages is out of scope.  Text is built
with native string expressions (``format_number``-based fixed-point text, so
rounding matches Python's ``f"{v:.2f}"``), never a Python UDF, and reports
over many students are long frames, one row per value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.expressions import clamp_tier, fixed, float_text, grouped
from cohortlens.sources.schemas import ENROLLMENT_KEYS

EM_DASH = "—"


def _num(c: str, default=0.0) -> Column:
    return F.coalesce(F.col(c), F.lit(default))


def _pct0(rate: Column) -> Column:
    """``f"{rate:.0%}"``."""
    return F.concat(fixed(rate * 100, 0), F.lit("%"))


# ── recommendations (G1) ───────────────────────────────────────────────────


def recommendation_rules() -> list[tuple[str, str, Column, Column]]:
    """``(rule_id, level, condition, text)`` in firing order, 20 rules.

    Conditions and levels follow the source rules; the wording is our own.
    Tiers 3, 2 and 1 each have a lead rule; tier 1 adds a closing rule when
    only its lead fired; any other tier takes the first matching safe rule.
    """
    risk = _num("risk", 0)
    score = _num("score")
    rate = _num("submission_rate")
    days = _num("active_days", 0)
    early = _num("avg_days_early")
    prev = _num("num_prev_attempts", 0)
    clicks = _num("clicks")
    forum = _num("forum_clicks")
    withdrew = _num("withdrew_early", 0)
    t3, t2, t1 = risk == 3, risk == 2, risk == 1
    t0 = ~(t3 | t2 | t1)
    watch_signals = (score < 60) | (rate < 0.6) | (days < 10) | (early < -7)
    s1 = fixed(score, 1)
    return [
        ("crit_unregistered", "crit", t3 & (withdrew != 0),
         F.lit("Formally unregistered: contact the student in person to learn why and discuss a return.")),
        ("crit_escalate", "crit", t3 & (withdrew == 0),
         F.lit("Several severe risk signals: arrange personal contact within 48 hours.")),
        ("crit_low_score", "crit", t3 & (score < 40),
         F.concat(F.lit("Average score "), s1, F.lit(" is far below the pass mark: offer counselling and catch-up sessions."))),
        ("crit_low_submission", "high", t3 & (rate < 0.25),
         F.concat(F.lit("Only "), _pct0(rate), F.lit(" of assessments handed in: check access and personal circumstances."))),
        ("crit_repeat_attempt", "high", t3 & (prev >= 2),
         F.concat(F.lit("Attempt number "), (prev + 1).cast("string"), F.lit(" at this module: review earlier support and adapt it."))),
        ("high_lead", "high", t2,
         F.lit("High risk of not completing: start active academic support before the next deadline.")),
        ("high_low_score", "high", t2 & (score < 60),
         F.concat(F.lit("Score "), s1, F.lit(" shows steady underperformance: suggest study sessions or peer tutoring."))),
        ("high_low_submission", "high", t2 & (rate < 0.6),
         F.concat(F.lit("Submission rate "), _pct0(rate), F.lit(": encourage handing in even partial work."))),
        ("high_late", "watch", t2 & (early < -3),
         F.concat(F.lit("Work arrives "), fixed(F.abs(early), 1), F.lit(" days late on average: plan deadlines together."))),
        ("high_effort_gap", "watch", t2 & (clicks > 200) & (score < 50),
         F.lit("Much online activity but low scores: a one-to-one tutorial may turn effort into results.")),
        ("high_low_forum", "watch", t2 & (forum < 5),
         F.lit("Hardly any forum use: invite the student to a study group.")),
        ("watch_lead", "watch", t1,
         F.lit("Passing so far with early warning signs: a light check-in within two weeks is advised.")),
        ("watch_low_score", "watch", t1 & (score < 60),
         F.concat(F.lit("Score "), s1, F.lit(" is close to the pass mark: focus on the coming assessments."))),
        ("watch_low_submission", "watch", t1 & (rate < 0.6),
         F.concat(F.lit("Submission rate "), _pct0(rate), F.lit(": remind the student of upcoming deadlines."))),
        ("watch_few_days", "watch", t1 & (days < 10),
         F.concat(F.lit("Only "), days.cast("string"), F.lit(" active day(s) online: encourage regular study."))),
        ("watch_late", "watch", t1 & (early < -7),
         F.lit("Repeated late submissions: a short talk about workload may help.")),
        ("watch_no_action", "safe", t1 & ~watch_signals,
         F.lit("No action needed now: keep following engagement in the coming weeks.")),
        ("safe_outstanding", "safe", t0 & (score >= 90),
         F.lit("Outstanding results: consider peer-tutoring or extra challenge tasks.")),
        ("safe_on_track", "safe", t0 & (score < 90) & (days > 0),
         F.lit("On track: no intervention needed.")),
        ("safe_no_activity", "watch", t0 & (score < 90) & (days <= 0),
         F.lit("No online activity recorded yet: check that the student can reach the course.")),
    ]


def recommendations(scored: DataFrame) -> DataFrame:
    """Ordered recommendations per enrollment: ``(keys, position, rule_id, level, text)``."""
    rules = F.array(
        *[
            F.when(cond, F.struct(F.lit(rule_id).alias("rule_id"), F.lit(level).alias("level"), text.alias("text")))
            for rule_id, level, cond, text in recommendation_rules()
        ]
    )
    fired = F.filter(rules, lambda r: r.isNotNull())
    return scored.select(*ENROLLMENT_KEYS, F.posexplode(fired).alias("position", "rec")).select(
        *ENROLLMENT_KEYS, "position", "rec.rule_id", "rec.level", "rec.text"
    )


# ── metric bands (B21) ─────────────────────────────────────────────────────


def metric_bands(scored: DataFrame) -> DataFrame:
    """Score, submission and engagement bands used to colour the table."""
    score = _num("score")
    sub = F.round(_num("submission_rate") * 100).cast("long")
    eng = F.round(_num("engagement_ratio") * 100).cast("long")
    return scored.select(
        *ENROLLMENT_KEYS,
        F.when(score < 40, "crit").when(score < 60, "watch").when(score < 75, "high").otherwise("safe").alias(
            "score_band"
        ),
        sub.alias("submission_pct"),
        F.when(sub < 40, "crit").when(sub < 70, "watch").otherwise("safe").alias("submission_band"),
        eng.alias("engagement_pct"),
        F.when(eng < 20, "crit").when(eng < 50, "watch").otherwise("safe").alias("engagement_band"),
    )


# ── student profile (B23, I1) ──────────────────────────────────────────────


def _gender_text(empty: str) -> Column:
    g = F.coalesce(F.col("gender"), F.lit(""))
    return F.when(g == "M", "Male").when(g == "F", "Female").when(g == "", F.lit(empty)).otherwise(g)


def _disability_text(empty: str) -> Column:
    d = F.col("disability")
    return F.when(d == "Y", "Yes").when(d == "N", "No").otherwise(F.lit(empty))


def _disability_shown() -> Column:
    """The flag, else what the code says."""
    code = F.col("disability_encoded")
    return F.coalesce(
        F.when(F.col("disability") == "Y", "Yes").when(F.col("disability") == "N", "No").when(code == 1, "Yes").when(code == 0, "No"), F.lit(EM_DASH)
    )


def _imd_shown() -> Column:
    """The band, else the band of a code from 0 to 9; other codes are unknown, a negative or missing one is none."""
    code = F.col("imd_band_encoded")
    span = F.concat((code * 10).cast("string"), F.lit("–"), (code * 10 + 10).cast("string"), F.lit("%"))
    named = F.when(code.between(0, 9), span).when(code > 9, "Unknown").otherwise(F.lit(EM_DASH))
    return F.coalesce(F.when(F.col("imd_band") != "", F.col("imd_band")), named)


def _or_dash(c: str) -> Column:
    v = F.coalesce(F.col(c), F.lit(""))
    return F.when(v == "", F.lit(EM_DASH)).otherwise(v)


def profile_values() -> list[tuple[str, str, Column]]:
    """``(section, label, value)`` of the student report, 25 values."""
    early = _num("avg_days_early")
    clicks = _num("clicks")
    active = _num("active_days", 0)
    timing = (
        F.when(early > 0, F.concat(fixed(F.abs(early), 1), F.lit(" days early")))
        .when(early < 0, F.concat(fixed(F.abs(early), 1), F.lit(" days late")))
        .otherwise(F.lit("on deadline"))
    )
    out_of_100 = lambda c: F.concat(fixed(_num(c), 2), F.lit(" / 100"))
    whole = lambda c: grouped(_num(c).cast("long"), 0)
    academic, vle, background = "Academic Performance", "VLE Engagement", "Student Background"
    # Report labels.
    return [
        (academic, "Average Score", out_of_100("score")),
        (academic, "Weighted Score", out_of_100("weighted_score")),
        (academic, "Exam Score", out_of_100("exam_score")),
        (academic, "TMA Score", out_of_100("tma_score")),
        (academic, "CMA Score", out_of_100("cma_score")),
        (academic, "Submission Rate", _pct0(_num("submission_rate"))),
        (academic, "Avg Submission Timing", timing),
        (vle, "Engagement Ratio", F.concat(fixed(_num("engagement_ratio") * 100, 1), F.lit("%"))),
        (vle, "Active Days", active.cast("string")),
        (vle, "Active Weeks", _num("active_weeks", 0).cast("string")),
        (vle, "Total Clicks", whole("clicks")),
        (vle, "Clicks / Active Day", F.when(active != 0, fixed(clicks / active, 1)).otherwise(F.lit(EM_DASH))),
        (vle, "Forum Clicks", whole("forum_clicks")),
        (vle, "Quiz Clicks", whole("quiz_clicks")),
        (vle, "Resource Clicks", whole("resource_clicks")),
        (background, "Gender", _gender_text(EM_DASH)),
        (background, "Age Band", _or_dash("age_band")),
        (background, "Region", _or_dash("region")),
        (background, "Highest Education", _or_dash("highest_education")),
        (background, "IMD Band", _imd_shown()),
        (background, "Disability", _disability_shown()),
        (background, "Studied Credits", F.coalesce(F.col("studied_credits").cast("string"), F.lit(EM_DASH))),
        (background, "Prev Attempts", _num("num_prev_attempts", 0).cast("string")),
        (background, "Days Before Start", F.concat(_num("days_before_start").cast("long").cast("string"), F.lit(" days"))),
        (background, "Formally Withdrew", F.when(_num("withdrew_early", 0) != 0, "Yes").otherwise("No")),
    ]


def student_profile(scored: DataFrame) -> DataFrame:
    """Long report frame: ``(keys, position, section, label, value)`` per enrollment."""
    values = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(s).alias("section"), F.lit(lab).alias("label"), v.alias("value"))
            for i, (s, lab, v) in enumerate(profile_values())
        ]
    )
    return scored.select(*ENROLLMENT_KEYS, "risk_label", F.inline(values))


# ── cohort report overview (I2) ────────────────────────────────────────────


def cohort_overview(scored: DataFrame) -> DataFrame:
    """Nine labelled overview values (per student, worst tier; per-student means)."""
    per_student = (
        scored.filter(F.col("id").isNotNull() & (F.col("id") != ""))
        .groupBy("id")
        .agg(
            F.max(clamp_tier(F.col("risk"))).alias("worst"),
            F.avg(_num("score")).alias("s"),
            F.avg(_num("engagement_ratio")).alias("e"),
            F.avg(_num("clicks")).alias("c"),
        )
    )
    one = per_student.agg(
        F.count(F.lit(1)).alias("unique_students"),
        *[F.count(F.when(F.col("worst") == t, F.lit(1))).alias(n) for t, n in
          ((3, "critical"), (2, "high_risk"), (1, "watch"), (0, "safe"))],
        F.coalesce(F.avg("s"), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.avg("e"), F.lit(0.0)).alias("avg_engagement"),
        F.coalesce(F.avg("c"), F.lit(0.0)).alias("avg_clicks"),
    )
    total = F.col("unique_students")

    def share(c: Column) -> Column:
        return F.when(
            total > 0, F.concat(grouped(c, 0), F.lit("  ("), fixed(c / total * 100, 1), F.lit("%)"))
        ).otherwise(F.lit("0"))

    at_risk = F.col("critical") + F.col("high_risk")
    pct = F.when(total > 0, at_risk / total * 100).otherwise(F.lit(0.0))
    # Overview labels.
    items = [
        ("Total Students", grouped(total, 0)),
        ("Critical", share(F.col("critical"))),
        ("High Risk", share(F.col("high_risk"))),
        ("Watch", share(F.col("watch"))),
        ("Safe", share(F.col("safe"))),
        ("High + Critical", F.concat(grouped(at_risk, 0), F.lit("  ("), fixed(pct, 1), F.lit("%)"))),
        ("Avg Score", F.concat(fixed(F.col("avg_score"), 1), F.lit(" / 100"))),
        ("Avg Engagement", F.concat(fixed(F.col("avg_engagement") * 100, 1), F.lit("%"))),
        ("Avg Total Clicks", grouped(F.col("avg_clicks"), 0)),
    ]
    arr = F.array(
        *[F.struct(F.lit(i).alias("position"), F.lit(lab).alias("label"), v.alias("value")) for i, (lab, v) in enumerate(items)]
    )
    return one.select(F.inline(arr))


# ── formatted export frame (A9) ────────────────────────────────────────────

# Export columns, their CSV header labels, and how each is written, in order.
EXPORT_FORMATS = [
    ("id", "Student ID", "text"), ("code_module", "Module", "text"), ("code_presentation", "Presentation", "text"),
    ("risk_label", "Risk Tier", "text"), ("final_result", "Final Result", "text"), ("gender", "Gender", "gender"),
    ("age_band", "Age Band", "text"), ("region", "Region", "text"), ("highest_education", "Highest Education", "text"),
    ("imd_band", "IMD Band", "text"), ("disability", "Disability", "disability"), ("studied_credits", "Studied Credits", "text"),
    ("num_prev_attempts", "Prev Attempts", "text"), ("days_before_start", "Days Before Start", "fixed0"),
    ("score", "Avg Score", "fixed2"), ("weighted_score", "Weighted Score", "fixed2"), ("exam_score", "Exam Score", "fixed2"),
    ("tma_score", "TMA Score", "fixed2"), ("cma_score", "CMA Score", "fixed2"), ("submission_rate", "Submission Rate", "percent0"),
    ("avg_days_early", "Avg Days Early", "fixed1"), ("engagement_ratio", "Engagement Ratio", "percent1"),
    ("active_days", "Active Days", "text"), ("active_weeks", "Active Weeks", "text"), ("clicks", "Total Clicks", "float"),
    ("forum_clicks", "Forum Clicks", "float"), ("quiz_clicks", "Quiz Clicks", "float"), ("resource_clicks", "Resource Clicks", "float"),
    ("withdrew_early", "Withdrew Early", "yes_no"),
]
EXPORT_COLUMNS = [(field, label) for field, label, _ in EXPORT_FORMATS]

#: One writer per kind; a missing value is empty text.
_WRITERS = {
    "text": lambda c: c.cast("string"),
    "float": float_text,
    "gender": lambda c: _gender_text(""),
    "disability": lambda c: _disability_text(""),
    "yes_no": lambda c: F.when(c == 1, "Yes").otherwise("No"),
    **{f"fixed{d}": lambda c, d=d: fixed(c, d) for d in range(3)},
    **{f"percent{d}": lambda c, d=d: F.concat(fixed(c * 100, d), F.lit("%")) for d in range(2)},
}


def export_frame(rows: DataFrame) -> DataFrame:
    """The 29 export columns as display text (field names as column names)."""
    return rows.select(*[F.coalesce(_WRITERS[kind](F.col(f)), F.lit("")).alias(f) for f, _, kind in EXPORT_FORMATS])


def write_export_csv(frame: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the export frame as CSV with the display header labels."""
    labelled = frame.select(*[F.col(f).alias(label) for f, label in EXPORT_COLUMNS])
    labelled.write.mode(mode).option("header", True).option("emptyValue", "").csv(path)
