"""Metrics of predictions, and the views of the evaluations table.

Metrics come from two aggregates per set of predictions, for any number of
models and runs at once: confusion counts, and the exact area under ROC from
distributed running totals.  Everything stays a DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.expressions import fixed, float_text
from cohortlens.functions.positions import running_totals
from cohortlens.sources.io import MODEL_NUMBERS

# Composite selection weights and the AUC target bands.
SELECTION_WEIGHTS = {"auc": 0.40, "f1": 0.30, "recall": 0.20, "cv_auc": 0.10}
AUC_TARGET, AUC_WATCH = 0.85, 0.75


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion_counts(predictions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """``tp``, ``fp``, ``tn``, ``fn`` per group (one row without groups); class 1 is the positive one."""
    y, guess = F.col("label").cast("int"), F.col("prediction").cast("int")
    cells = {"tp": (1, 1), "fp": (0, 1), "tn": (0, 0), "fn": (1, 0)}
    return predictions.groupBy(*groups).agg(*(F.count_if((y == a) & (guess == b)).alias(n) for n, (a, b) in cells.items()))


def classification_metrics(predictions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Confusion counts with accuracy, class-weighted precision, recall and F, and the recall of class 1.

    A class that is never predicted has precision 0; weights are the classes' shares.
    """
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    classes = [(tp, tp + fp, tp + fn), (tn, tn + fn, tn + fp)]  # right, predicted, there

    def weighted(metric) -> Column:
        return sum((_share(there, total) * metric(right, predicted, there) for right, predicted, there in classes), F.lit(0.0))

    def f_measure(right: Column, predicted: Column, there: Column) -> Column:
        return _share(2 * right, predicted + there)

    return confusion_counts(predictions, groups).select(
        *groups,
        "tp", "fp", "tn", "fn",
        _share(tp + tn, total).alias("accuracy"),
        weighted(lambda right, predicted, there: _share(right, predicted)).alias("precision"),
        weighted(lambda right, predicted, there: _share(right, there)).alias("recall"),
        weighted(f_measure).alias("f1"),
        _share(tp, tp + fn).alias("recall_dropout"),
    )


def rank_sum_auc(predictions: DataFrame, groups: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Exact area under ROC per group, as ``auc`` (null where a class is missing).

    Predictions are counted per distinct score first, so tied scores share half
    credit.  Each score's positives count the negatives below it, taken from
    running totals over all groups' sorted scores less the total at the
    group's first score: no window over a group, no group in one task.
    """
    y = F.col("label").cast("int")
    per_score = predictions.groupBy(F.struct(*groups, score).alias("at")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    ranked = running_totals(per_score, "at", ["neg"])
    credit = F.col("pos") * (F.col("neg_before") + F.col("neg") * F.lit(0.5))
    sums = ranked.groupBy(*(F.col(f"at.{g}").alias(g) for g in groups)).agg(
        F.sum(credit).alias("credit"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min("neg_before").alias("start")
    )
    won = F.col("credit") - F.col("start") * F.col("pos")
    return sums.select(*groups, F.try_divide(won, (F.col("pos") * F.col("neg")).cast("double")).alias("auc"))


def composite_column(weights: Mapping[str, float] = SELECTION_WEIGHTS) -> Column:
    return sum((F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in weights.items()), F.lit(0.0))


def flag_best(results: DataFrame, runs: Sequence[str] = ("run_id",)) -> DataFrame:
    """``is_best`` for the run's strictly greatest composite score; ties go to the earlier position."""
    # a run has one row per model
    first = Window.partitionBy(*runs).orderBy(F.desc("composite_score"), "position")
    return results.withColumn("is_best", F.row_number().over(first) == 1)


# ── stored form (A6, A8) ───────────────────────────────────────────────────


def evaluation_rows(results: DataFrame) -> DataFrame:
    """Stored rows: ``model|run`` keys (the model alone without a run), metrics rounded to 4 places, all as text.

    Blanks in model names become underscores; an untuned model has the document ``{}``.
    """
    name = F.regexp_replace("name", " ", "_")
    return results.select(
        F.when(F.col("run_id").isNull(), name).otherwise(F.concat_ws("|", name, "run_id")).alias("row_key"),
        *[float_text(F.round(m, 4)).alias(m) for m in MODEL_NUMBERS],
        F.col("is_best").cast("string").alias("is_best"),
        "timestamp",
        F.coalesce(F.to_json("importance"), F.lit("[]")).alias("importance_json"),
        F.coalesce(F.to_json("tuning"), F.lit("{}")).alias("tuning_json"),
    )


def publish_evaluations(results: DataFrame, path: str, run_id: str) -> None:
    """One folder per run, overwritten: publishing a run again leaves its rows as they are.

    The stored rows have no place for an ``error``: rows with one are refused.
    """
    if "error" in results.columns:
        failed = results.filter("error IS NOT NULL").first()
        if failed is not None:
            raise ValueError(f"{failed.name} is not published: {failed.error}")
    evaluation_rows(results).write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run_id}")


def stored_evaluations(spark, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/run=*").drop("run")


# ── views (E2-E5, H14, H17, F6, B22, I3) ───────────────────────────────────


def latest_runs(results: DataFrame) -> DataFrame:
    """Latest run per model (largest run id), sorted by composite score."""
    newest = results.groupBy("name").agg(F.max("run_id").alias("run_id"))
    return results.join(newest, ["name", "run_id"], "left_semi").orderBy(F.desc(F.coalesce("composite_score", "auc")), "name")


def run_history(results: DataFrame) -> DataFrame:
    """Every run per model in run-id order with its ordinal."""
    w = Window.partitionBy("name").orderBy("run_id")
    return results.select("name", "run_id", "auc", "composite_score", F.row_number().over(w).alias("run_ordinal"))


def best_model(results: DataFrame) -> DataFrame:
    """The flagged model, else the first by composite score, then name."""
    return results.orderBy(F.desc("is_best"), F.desc("composite_score"), "name").limit(1)


def importance_table(results: DataFrame, top: int | None = None) -> DataFrame:
    """``(name, run_id, rank, feature, score)`` by score; equal scores keep their stored order."""
    entries = F.transform("importance", lambda x, i: F.struct((-x["score"]).alias("low"), i.alias("i"), x["feature"].alias("feature")))
    out = results.select("name", "run_id", F.posexplode(F.array_sort(entries)).alias("at", "e"))
    out = out.select("name", "run_id", (F.col("at") + 1).alias("rank"), F.col("e.feature").alias("feature"), (-F.col("e.low")).alias("score"))
    return out.filter(F.col("rank") <= top) if top else out


def top_fields(results: DataFrame, mapping: Mapping[str, str], defaults: Sequence[str], k: int = 6) -> DataFrame:
    """``rank``, ``field``: the best model's ``k`` most important fields, or the defaults where it has none."""
    best = best_model(results)
    pairs = [x for f, v in mapping.items() for x in (F.lit(f), F.lit(v))]
    known = F.transform(
        "importance", lambda x, i: F.struct((-x["score"]).alias("low"), i.alias("i"), F.try_element_at(F.create_map(*pairs), x["feature"]).alias("field"))
    )
    fields = F.transform(F.filter(F.array_sort(known), lambda x: x["field"].isNotNull()), lambda x: x["field"])
    fields = F.slice(F.array_distinct(fields), 1, k)
    chosen = F.when(F.size(fields) > 0, fields).otherwise(F.array(*map(F.lit, defaults[:k])))
    return best.select(F.posexplode(chosen).alias("at", "field")).select((F.col("at") + 1).alias("rank"), "field")


def auc_band(auc: Column) -> Column:
    return F.when(auc >= AUC_TARGET, "meets target").when(auc >= AUC_WATCH, "watch").otherwise("critical")


def comparison_table(results: DataFrame) -> DataFrame:
    """Model comparison sorted by composite score; CV AUC 0 shown as missing."""
    columns = ["accuracy", "precision", "recall", "f1", "composite_score", "training_time"]
    out = results.select("name", "run_id", "auc", F.nullif(F.col("cv_auc"), F.lit(0.0)).alias("cv_auc"), *columns, auc_band(F.col("auc")).alias("auc_band"))
    return out.orderBy(F.desc("composite_score"), "name")


#: Columns of the report's comparison section and how many places they show (fixed values).
COMPARISON = [("auc", "AUC", 4), ("cv_auc", "CV-AUC", 4), ("accuracy", "Accuracy", 4), ("precision", "Precision", 4), ("recall", "Recall", 4),
              ("f1", "F1", 4), ("composite_score", "Score", 4), ("training_time", "Time", 1)]
BEST = [("auc", "AUC"), ("cv_auc", "CV AUC"), ("accuracy", "Accuracy"), ("precision", "Precision"), ("recall", "Recall"), ("f1", "F1"),
        ("composite_score", "Composite Score")]


def model_report(results: DataFrame, top: int = 15) -> DataFrame:
    """The model report as ``section, name, position, label, value`` text rows.

    Sections: twelve values of the best model, eight of every model, and the
    best model's most important features.
    """
    best = best_model(results)
    values = [("Model", F.col("name")), ("Run ID", F.col("run_id")), ("Trained at", F.col("timestamp"))]
    values += [(label, fixed(F.col(c), 4)) for c, label in BEST]
    values += [("Training Time", F.concat(fixed(F.col("training_time"), 2), F.lit("s")))]
    values += [("Meets AUC target", F.when(F.col("auc") >= AUC_TARGET, "yes").otherwise("no"))]

    def listed(section: str, rows: DataFrame, pairs: list[tuple[str, Column]]) -> DataFrame:
        entries = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), v.alias("value")) for i, (label, v) in enumerate(pairs)))
        return rows.select(F.lit(section).alias("section"), "name", F.inline(entries))

    def shown(c: str, places: int) -> Column:
        text = fixed(F.col(c), places)
        if c == "cv_auc":
            return F.when(F.col(c) == 0, "—").otherwise(text)
        return F.concat(text, F.lit("s")) if c == "training_time" else text

    compared = listed("comparison", results, [(label, shown(c, places)) for c, label, places in COMPARISON])
    features = importance_table(best, top).select(
        F.lit("importance").alias("section"), "name", (F.col("rank") - 1).alias("position"), F.col("feature").alias("label"), fixed(F.col("score"), 4).alias("value")
    )
    return listed("best", best, values).unionByName(compared).unionByName(features)
