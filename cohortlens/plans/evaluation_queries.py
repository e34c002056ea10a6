"""Registered queries over an evaluations table that both engines derive from the test tables.

Four fixed linear scores over the feature table stand for models, module
presentations for training runs.  Their confusion counts and areas under ROC
are computed from the predictions, stored as text rows and read back; the
views of the evaluations table run on what was read.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators import evaluation, ml, stats
from cohortlens.operators.scoring import MODEL_TO_SCORED, SCORED_FEATURES
from cohortlens.plans.core_queries import feature_frame, scored_frame
from cohortlens.plans.registry import register
from cohortlens.session import scratch_path, shuffles_released
from cohortlens.sources import io


@dataclass(frozen=True)
class Rule:
    """A linear score; above ``cut`` it predicts dropout.  The terms are SQL for either engine."""

    name: str
    terms: tuple[tuple[str, float], ...]
    cut: float
    cross_validated: bool = True
    tuned: bool = False

    @property
    def sql(self) -> str:
        return "round(" + " + ".join(f"({w} * round(CAST({c} AS DOUBLE), 4))" for c, w in self.terms) + ", 9)"

    @property
    def importance(self) -> list[tuple[str, float]]:
        total = sum(abs(w) for _, w in self.terms)
        return sorted(((c, round(abs(w) / total, 4)) for c, w in self.terms), key=lambda x: -x[1])


RULES = [
    Rule("Score Rule", (("avg_score", -1.0), ("submission_rate", -20.0), ("num_prev_attempts", 5.0)), -60.0, tuned=True),
    Rule("Activity Rule", (("active_days", -1.0), ("clicks_per_day", -0.125), ("forum_clicks", -0.0625)), -6.0),
    Rule("Deadline Rule", (("withdrew_early", 50.0), ("avg_days_early", -0.5)), 10.0),
    Rule("Attempts Rule", (("num_prev_attempts", 1.0),), 0.0, cross_validated=False),
]
FOLDS = 3
#: The presentation whose rows are stored without a run id.
NO_RUN = "1998J"
TUNING = {
    "combos": [{"params": {"maxDepth": "3"}, "cv_auc": 0.71, "is_best": False}, {"params": {"maxDepth": "5"}, "cv_auc": 0.75, "is_best": True}],
    "best_params": {"maxDepth": "5"},
    "best_auc": 0.75,
    "num_folds": 2,
}
_STORED: dict[tuple[str, str], str] = {}


def rule_predictions(features: DataFrame) -> DataFrame:
    """``name``, ``position``, ``run_id``, ``fold``, ``label``, ``score``, ``prediction`` of every rule and enrollment."""
    rules = [
        F.struct(
            F.lit(r.name).alias("name"), F.lit(i).alias("position"), F.expr(r.sql).alias("score"),
            (F.expr(r.sql) > r.cut).cast("int").alias("prediction"), F.lit(r.cross_validated).alias("cross_validated"),
        )
        for i, r in enumerate(RULES)
    ]
    fold = (ml.split_bucket() % FOLDS).alias("fold")
    return features.select(F.col("code_presentation").alias("run_id"), fold, "label", F.inline(F.array(*rules)))


def evaluations(features: DataFrame) -> DataFrame:
    """Typed evaluation rows of all rules and runs, metrics not yet rounded."""
    spark = features.sparkSession
    # written once: three branches and their range sorts read the predictions, not the feature pipeline
    path = scratch_path(spark, "rule-predictions")
    with shuffles_released(spark):
        rule_predictions(features).write.parquet(path)
    preds = spark.read.parquet(path)
    keys = ["name", "position", "run_id"]
    folds = evaluation.rank_sum_auc(preds.filter("cross_validated"), [*keys, "fold"])
    cross = folds.groupBy(*keys).agg((F.sum(F.coalesce("auc", F.lit(0.0))) / FOLDS).alias("cv_auc"))
    out = evaluation.classification_metrics(preds, keys).join(evaluation.rank_sum_auc(preds, keys), keys).join(cross, keys, "left")
    out = out.withColumns({"auc": F.coalesce("auc", F.lit(0.0)), "cv_auc": F.coalesce("cv_auc", F.lit(0.0))})
    out = out.withColumn("composite_score", F.round(evaluation.composite_column(), 4))
    out = evaluation.flag_best(out)
    documents = [(r.name, r.importance, TUNING if r.tuned else None) for r in RULES]
    documents = spark.createDataFrame(documents, T.StructType().add("name", "string").add("importance", io.IMPORTANCE_TYPE).add("tuning", io.TUNING_TYPE))
    rows = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return out.join(F.broadcast(documents), "name").withColumns(
        {"training_time": rows / 1000, "timestamp": F.concat(F.substring("run_id", 1, 4), F.lit("-01-01 00:00:00"))}
    )


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluations table: one folder per run, written once per application and input folder."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    if key not in _STORED:
        path = scratch_path(spark, "evaluations")
        found = evaluations(feature_frame(spark, sf_dir)).withColumn("run_id", F.when(F.col("run_id") != NO_RUN, F.col("run_id")))
        with shuffles_released(spark):
            evaluation.publish_evaluations(found, path, "all")
        _STORED[key] = path
    return evaluation.stored_evaluations(spark, _STORED[key])


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.model_rows_readback(stored(spark, sf_dir))


# ── the same in SQL ────────────────────────────────────────────────────────

_METRICS = ["auc", "accuracy", "precision", "recall", "f1", "recall_dropout", "cv_auc", "composite_score", "training_time"]


def _auc_sql(groups: str, where: str = "true") -> str:
    return f"""SELECT {groups}, sum(pos * (before + neg * 0.5)) / nullif(CAST(sum(pos) * sum(neg) AS DOUBLE), 0) AS auc FROM (
    SELECT *, coalesce(sum(neg) OVER (PARTITION BY {groups} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT {groups}, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
          FROM ev_preds WHERE {where} GROUP BY {groups}, score)) GROUP BY {groups}"""


def _document_sql(rule: Rule) -> str:
    importance = ",".join(f'{{"feature":"{c}","score":{w}}}' for c, w in rule.importance)
    tuning = "{}"
    if rule.tuned:
        combos = ",".join(
            f'{{"params":{{"maxDepth":"{c["params"]["maxDepth"]}"}},"cv_auc":{c["cv_auc"]},"is_best":{str(c["is_best"]).lower()}}}' for c in TUNING["combos"]
        )
        tuning = f'{{"combos":[{combos}],"best_params":{{"maxDepth":"5"}},"best_auc":0.75,"num_folds":2}}'
    return f"('{rule.name}', '[{importance}]', '{tuning}')"


_FOLD = f"""CAST(CAST(('0x' || substr(md5(CAST(id_student AS VARCHAR) || '|' || code_module || '|' || code_presentation),
  1, 8)) AS BIGINT) % 10 AS BIGINT) % {FOLDS}"""
_PREDS = " UNION ALL ".join(
    f"SELECT '{r.name}' AS name, {i} AS position, code_presentation AS run_id, {_FOLD} AS fold, label, {r.sql} AS score, "
    f"CAST({r.sql} > {r.cut} AS INTEGER) AS prediction, {str(r.cross_validated).lower()} AS cross_validated FROM features"
    for i, r in enumerate(RULES)
)
_DIV = "coalesce(({}) / nullif(CAST({} AS DOUBLE), 0), 0)"
_PREC1, _PREC0 = _DIV.format("tp", "tp + fp"), _DIV.format("tn", "tn + fn")
_REC1, _REC0 = _DIV.format("tp", "tp + fn"), _DIV.format("tn", "tn + fp")
_F1, _F0 = _DIV.format("2 * tp", "2 * tp + fp + fn"), _DIV.format("2 * tn", "2 * tn + fp + fn")
_W1, _W0 = "CAST(tp + fn AS DOUBLE) / (tp + fp + tn + fn)", "CAST(tn + fp AS DOUBLE) / (tp + fp + tn + fn)"
_TEXT = "CAST(CAST({} AS DOUBLE) AS VARCHAR)"
CTES = f""", ev_preds AS ({_PREDS}),
ev_conf AS (SELECT name, position, run_id, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 1 AND prediction = 0) AS fn
  FROM ev_preds GROUP BY ALL),
ev_auc AS ({_auc_sql('name, position, run_id')}),
ev_cv AS (SELECT name, position, run_id, sum(coalesce(auc, 0)) / {FOLDS} AS cv_auc
  FROM ({_auc_sql('name, position, run_id, fold', 'cross_validated')}) GROUP BY ALL),
ev_metrics AS (SELECT *, CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) AS accuracy,
    {_W1} * {_PREC1} + {_W0} * {_PREC0} AS "precision", {_W1} * {_REC1} + {_W0} * {_REC0} AS recall,
    {_W1} * {_F1} + {_W0} * {_F0} AS f1, {_REC1} AS recall_dropout
  FROM ev_conf),
ev_all AS (SELECT m.*, coalesce(a.auc, 0) AS auc, coalesce(c.cv_auc, 0) AS cv_auc, (tp + fp + tn + fn) / 1000.0 AS training_time,
    round(0.4 * coalesce(a.auc, 0) + 0.3 * f1 + 0.2 * recall + 0.1 * coalesce(c.cv_auc, 0), 4) AS composite_score
  FROM ev_metrics m JOIN ev_auc a USING (name, position, run_id) LEFT JOIN ev_cv c USING (name, position, run_id)),
ev_docs AS (SELECT * FROM (VALUES {", ".join(map(_document_sql, RULES))}) AS d(name, importance_json, tuning_json)),
ev_rows AS (SELECT name, CASE WHEN run_id <> '{NO_RUN}' THEN run_id ELSE '{io.DEFAULT_RUN_ID}' END AS run_id, position,
    {", ".join(f'round("{m}", 4) AS "{m}"' for m in _METRICS)},
    row_number() OVER (PARTITION BY run_id ORDER BY composite_score DESC, position) = 1 AS is_best,
    substr(run_id, 1, 4) || '-01-01 00:00:00' AS "timestamp", importance_json, tuning_json
  FROM ev_all JOIN ev_docs USING (name)),
ev_latest AS (SELECT * FROM ev_rows QUALIFY row_number() OVER (PARTITION BY name ORDER BY run_id DESC) = 1),
ev_best AS (SELECT * FROM ev_latest ORDER BY is_best DESC, composite_score DESC, name LIMIT 1)"""
_NUMBERS = ", ".join(f'"{m}"' for m in _METRICS)


def _importance_sql(rows: str) -> str:
    ranked = ", ".join(f"('{r.name}', {i + 1}, '{c}', {w})" for r in RULES for i, (c, w) in enumerate(r.importance))
    return f"""SELECT name, run_id, CAST(rank AS INTEGER) AS rank, feature, CAST(score AS DOUBLE) AS score
       FROM {rows} JOIN (VALUES {ranked}) AS i(name, rank, feature, score) USING (name)"""


@register(
    "eval_metrics",
    ctes=CTES,
    oracle="""SELECT name, run_id, tp, fp, tn, fn, accuracy, "precision", recall, f1, recall_dropout, auc
       FROM ev_metrics JOIN ev_auc USING (name, position, run_id)""",
    doubles=["accuracy", "\"precision\"", "recall", "f1", "recall_dropout", "auc"],
    survey_ids="H10 T16 T20",
)
def q_eval_metrics(spark, sf_dir):
    preds = rule_predictions(feature_frame(spark, sf_dir))
    keys = ["name", "run_id"]
    return evaluation.classification_metrics(preds, keys).join(evaluation.rank_sum_auc(preds, keys), keys)


@register(
    "model_results_rows",
    ctes=CTES,
    oracle=f"""SELECT CASE WHEN run_id = '{io.DEFAULT_RUN_ID}' THEN replace(name, ' ', '_') ELSE replace(name, ' ', '_') || '|' || run_id END AS row_key,
       {", ".join(_TEXT.format(f'"{m}"') + f' AS "{m}"' for m in _METRICS)}, CAST(is_best AS VARCHAR) AS is_best, "timestamp",
       importance_json, tuning_json FROM ev_rows""",
    survey_ids="A6 A8",
)
def q_model_results_rows(spark, sf_dir):
    """The stored text rows, compared as text."""
    return stored(spark, sf_dir)


@register(
    "model_rows_readback",
    ctes=CTES,
    oracle=f'SELECT name, run_id, {_NUMBERS}, is_best, "timestamp" FROM ev_rows',
    survey_ids="A7 A8",
)
def q_model_rows_readback(spark, sf_dir):
    return results(spark, sf_dir).drop("importance", "tuning")


@register(
    "composite_score",
    ctes=CTES,
    oracle="""SELECT name, run_id, composite_score, 0.4 * auc + 0.3 * f1 + 0.2 * recall + 0.1 * cv_auc AS recomputed FROM ev_rows""",
    doubles=["composite_score", "recomputed"],
    survey_ids="H13",
)
def q_composite_score(spark, sf_dir):
    """The stored score, and the score of the stored (rounded) metrics."""
    return results(spark, sf_dir).select("name", "run_id", "composite_score", evaluation.composite_column().alias("recomputed"))


@register("best_model", ctes=CTES, oracle="SELECT name, run_id, composite_score, is_best FROM ev_best", survey_ids="E4 H14")
def q_best_model(spark, sf_dir):
    return evaluation.best_model(evaluation.latest_runs(results(spark, sf_dir))).select("name", "run_id", "composite_score", "is_best")


@register(
    "best_model_unflagged",
    ctes=CTES,
    oracle="SELECT name, run_id, composite_score FROM ev_latest WHERE NOT is_best ORDER BY composite_score DESC, name LIMIT 1",
    survey_ids="E4",
)
def q_best_model_unflagged(spark, sf_dir):
    """Without a flagged model the first by composite score is taken."""
    rest = evaluation.latest_runs(results(spark, sf_dir)).filter("NOT is_best")
    return evaluation.best_model(rest).select("name", "run_id", "composite_score")


@register(
    "latest_model_runs",
    ctes=CTES,
    oracle=f'SELECT name, run_id, {_NUMBERS}, is_best, "timestamp" FROM ev_latest',
    survey_ids="E2",
)
def q_latest_model_runs(spark, sf_dir):
    return evaluation.latest_runs(results(spark, sf_dir)).drop("importance", "tuning")


@register(
    "model_history",
    ctes=CTES,
    oracle="""SELECT name, run_id, auc, composite_score, CAST(row_number() OVER (PARTITION BY name ORDER BY run_id) AS INTEGER) AS run_ordinal
       FROM ev_rows""",
    survey_ids="E3",
)
def q_model_history(spark, sf_dir):
    return evaluation.run_history(results(spark, sf_dir))


@register("feature_importance", ctes=CTES, oracle=_importance_sql("ev_rows"), survey_ids="H15 F6")
def q_feature_importance(spark, sf_dir):
    return evaluation.importance_table(results(spark, sf_dir))


_MAPPED = ", ".join(f"('{k}', '{v}')" for k, v in MODEL_TO_SCORED.items())
_DEFAULTS = ", ".join(f"({i + 1}, '{f}')" for i, f in enumerate(SCORED_FEATURES[:6]))
_TOP = f"""ev_top AS (SELECT CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS rank, field
  FROM ({_importance_sql('ev_best')}) JOIN (VALUES {_MAPPED}) AS m(feature, field) USING (feature)),
ev_fields AS (SELECT rank, field FROM ev_top WHERE rank <= 6
  UNION ALL SELECT CAST(rank AS INTEGER), field FROM (VALUES {_DEFAULTS}) AS d(rank, field) WHERE NOT EXISTS (SELECT 1 FROM ev_top))"""


@register("top_features", ctes=f"{CTES}, {_TOP}", oracle="SELECT rank, field FROM ev_fields", survey_ids="E5")
def q_top_features(spark, sf_dir):
    """The best model's most important fields, for the box plot."""
    return evaluation.top_fields(evaluation.latest_runs(results(spark, sf_dir)), MODEL_TO_SCORED, SCORED_FEATURES)


_FIELD_VALUES = " UNION ALL ".join(f"SELECT '{f}' AS field, risk, CAST({f} AS DOUBLE) AS v FROM scored" for f in SCORED_FEATURES)


@register(
    "boxplot_of_best_model",
    ctes=f"{CTES}, {_TOP}",
    oracle=f"""SELECT field, risk AS tier, quantile_cont(v, 0.01) AS "min", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
       quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.99) AS "max"
       FROM ({_FIELD_VALUES}) WHERE field IN (SELECT field FROM ev_fields) AND v >= 0 GROUP BY field, risk""",
    doubles=['"min"', "q1", "median", "q3", '"max"'],
    survey_ids="D13 E5",
)
def q_boxplot_of_best_model(spark, sf_dir):
    """The box plot over the six fields that matter most to the best model (a handful of names picks the columns)."""
    fields = [r.field for r in q_top_features(spark, sf_dir).orderBy("rank").collect()]
    return stats.feature_boxplot(scored_frame(spark, sf_dir), fields)


@register(
    "model_comparison",
    ctes=CTES,
    oracle="""SELECT name, run_id, auc, nullif(cv_auc, 0) AS cv_auc, accuracy, "precision", recall, f1, composite_score, training_time,
       CASE WHEN auc >= 0.85 THEN 'meets target' WHEN auc >= 0.75 THEN 'watch' ELSE 'critical' END AS auc_band FROM ev_latest""",
    survey_ids="H17 B22",
)
def q_model_comparison(spark, sf_dir):
    return evaluation.comparison_table(evaluation.latest_runs(results(spark, sf_dir)))


def _report_sql() -> str:
    best = ["name", "run_id", '"timestamp"', *(f"printf('%.4f', \"{c}\")" for c, _ in evaluation.BEST), "printf('%.2f', training_time) || 's'",
            "CASE WHEN auc >= 0.85 THEN 'yes' ELSE 'no' END"]
    labels = ["Model", "Run ID", "Trained at", *(label for _, label in evaluation.BEST), "Training Time", "Meets AUC target"]
    parts = [f"SELECT 'best' AS section, name, {i} AS position, '{label}' AS label, {v} AS value FROM ev_best" for i, (label, v) in enumerate(zip(labels, best, strict=True))]
    for i, (c, label, places) in enumerate(evaluation.COMPARISON):
        v = f"printf('%.{places}f', \"{c}\")"
        v = f"CASE WHEN cv_auc = 0 THEN '—' ELSE {v} END" if c == "cv_auc" else f"{v} || 's'" if c == "training_time" else v
        parts.append(f"SELECT 'comparison', name, {i}, '{label}', {v} FROM ev_latest")
    parts.append(f"SELECT 'importance', name, rank - 1, feature, printf('%.4f', score) FROM ({_importance_sql('ev_best')})")
    return " UNION ALL ".join(parts)


@register("model_report", ctes=CTES, oracle=_report_sql(), survey_ids="I3 B22 F6")
def q_model_report(spark, sf_dir):
    return evaluation.model_report(evaluation.latest_runs(results(spark, sf_dir)))


@register(
    "importance_json",
    ctes=CTES,
    oracle="""SELECT name, run_id, CAST(len(CAST(importance_json AS JSON[])) AS INTEGER) AS n_features,
       json_extract_string(importance_json, '$[0].feature') AS first_feature,
       CAST(json_extract_string(importance_json, '$[0].score') AS DOUBLE) AS first_score,
       CAST(json_extract_string(tuning_json, '$.best_auc') AS DOUBLE) AS best_auc,
       json_extract_string(tuning_json, '$.best_params.maxDepth') AS best_depth,
       CAST(json_extract_string(tuning_json, '$.combos[1].cv_auc') AS DOUBLE) AS second_cv_auc FROM ev_rows""",
    survey_ids="A11",
)
def q_importance_json(spark, sf_dir):
    """Fields of the decoded documents."""
    return results(spark, sf_dir).select(
        "name",
        "run_id",
        F.size("importance").alias("n_features"),
        F.col("importance")[0]["feature"].alias("first_feature"),
        F.col("importance")[0]["score"].alias("first_score"),
        F.col("tuning.best_auc").alias("best_auc"),
        F.col("tuning.best_params")["maxDepth"].alias("best_depth"),
        F.try_element_at("tuning.combos", F.lit(2))["cv_auc"].alias("second_cv_auc"),
    )
