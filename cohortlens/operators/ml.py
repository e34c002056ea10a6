"""Dropout classifiers with Spark ML: weights, split, training, tuning,
evaluation, selection, importance and the model registry.

Everything runs as Spark ML estimators on DataFrames; the driver only sees
scalar metrics and model parameters (never rows).  Class weights come from
one count per class and split, which is also all that a run's sizes need.
The train/test split hashes the enrollment key, so it does not depend on
partitioning (``randomSplit`` does).
"""

from __future__ import annotations

import math
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import Executor, Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators.evaluation import classification_metrics, composite_column, flag_best
from cohortlens.operators.features import FEATURE_COLUMNS
from cohortlens.sources.io import IMPORTANCE_TYPE, TUNING_TYPE
from cohortlens.sources.schemas import ENROLLMENT_KEYS

SEED = 42
ROWS_PER_PARTITION = 250_000
#: A single fit of fewer partitions than this is split further, down to a tenth of the rows in each.
FIT_PARTITIONS = 12
TEST_SHARE = 2  # tenths of the key-hash space held out (20 %)
# Hyper-parameter grids of the tuned models.
RF_GRID = {"numTrees": [20, 50, 100], "maxDepth": [5, 10]}
GBT_GRID = {"maxIter": [20, 50], "maxDepth": [3, 5]}
GRIDS = {"Random Forest": RF_GRID, "Gradient Boosted Trees": GBT_GRID}


# ── weights, split, vectors (D5, H1) ───────────────────────────────────────


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """``(label, cnt, weight)`` with inverse-frequency weight ``n / (2 * cnt)``."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("cnt"))
    # The window spans one row per class, so a single partition is fine here.
    total = F.sum("cnt").over(Window.partitionBy(F.lit(0)))
    return counts.select(label_col, "cnt", (total / (F.lit(2.0) * F.col("cnt"))).alias("weight"))


def with_class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Add ``weight`` per row (1.0 for a label without a count)."""
    weights = class_counts(df, label_col).select(label_col, "weight")
    return df.join(F.broadcast(weights), label_col, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def split_bucket(keys: Sequence[str] = ENROLLMENT_KEYS) -> F.Column:
    """0..9 from the first 32 bits of the md5 of ``id|module|presentation``."""
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(10))


def train_test_split(df: DataFrame, test_share: int = TEST_SHARE) -> tuple[DataFrame, DataFrame]:
    bucket = split_bucket()
    return df.filter(bucket >= test_share), df.filter(bucket < test_share)


def assemble(df: DataFrame, feature_cols: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    vec = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="keep")
    return vec.transform(df.withColumn("label", F.col("label").cast("double")))


def fit_partitions(rows: int, rows_per_partition: int = ROWS_PER_PARTITION, least: int = 1) -> int:
    """Partitions for ``rows``; up to ``least`` while these hold a tenth of ``rows_per_partition`` each."""
    return max(1, math.ceil(rows / rows_per_partition), min(least, math.ceil(10 * rows / rows_per_partition)))


def sized_partitions(df: DataFrame, rows: int, rows_per_partition: int = ROWS_PER_PARTITION, least: int = 1) -> DataFrame:
    """Repartition by size before the many iterative passes of a fit.

    Every optimizer iteration is a job over all partitions, so their number
    follows the row count alone: a partition never holds more than about
    ``rows_per_partition`` rows.  Hashing the unique enrollment key spreads
    rows evenly and is deterministic on retry.
    """
    return df.repartition(fit_partitions(rows, rows_per_partition, least), *ENROLLMENT_KEYS)


# ── estimators (H2-H5) ─────────────────────────────────────────────────────


def classifiers(weight_svc: bool = False) -> dict[str, Estimator]:
    svc = LinearSVC(labelCol="label", featuresCol="features", maxIter=100)
    if weight_svc:
        svc.setWeightCol("weight")
    common = {"labelCol": "label", "featuresCol": "features", "weightCol": "weight"}
    return {
        "Logistic Regression": LogisticRegression(maxIter=100, **common),
        # A row's node in each tree is kept between levels instead of being found again from the root: the same trees, sooner.
        "Random Forest": RandomForestClassifier(numTrees=20, seed=SEED, cacheNodeIds=True, **common),
        "Gradient Boosted Trees": GBTClassifier(maxIter=20, maxDepth=5, seed=SEED, **common),
        "Linear SVC": svc,
    }


# ── cross-validated AUC and grid search (H7, H8, H11) ──────────────────────


def fold_parts(train: DataFrame, folds: int) -> list[tuple[DataFrame, DataFrame]]:
    """(rows to fit, rows to judge) of each fold, the folds that ``CrossValidator`` draws with ``SEED``."""
    if folds < 2:
        raise ValueError(f"cross-validation needs two folds or more, not {folds}")
    place, width = "_fold_place", 1.0 / folds
    placed = train.select("*", F.rand(SEED).alias(place))
    judged = [(F.col(place) >= i * width) & (F.col(place) < (i + 1) * width) for i in range(folds)]
    return [(placed.filter(~held), placed.filter(held)) for held in judged]


def fit_cost(params: Mapping) -> float:
    """Grows with the time that a fit takes: trees or iterations times depth, as far as they are given."""
    return math.prod(v for v in params.values() if isinstance(v, (int, float)))


def fold_auc(estimator: Estimator, train: DataFrame, grid: list, folds: int, pool: Executor) -> list[float]:
    """Mean AUC over the folds of each parameter map.

    The fits of all folds and maps wait in the pool at once, the longest ones
    first: a long fit that starts last would keep a few cores busy alone.
    """
    judge = BinaryClassificationEvaluator(labelCol="label")

    def auc(params: dict, fitted: DataFrame, judged: DataFrame) -> float:
        return float(judge.evaluate(estimator.fit(fitted, params).transform(judged, params)))

    parts, target = fold_parts(train, folds), inheritable_thread_target(train.sparkSession)
    order = sorted(range(len(grid)), key=lambda i: fit_cost(grid[i]), reverse=True)
    waiting: dict[int, list[Future]] = {i: [pool.submit(target(auc), grid[i], *part) for part in parts] for i in order}
    try:
        return [sum(f.result() for f in waiting[i]) / folds for i in range(len(grid))]
    finally:  # after a failure
        for f in (f for fits in waiting.values() for f in fits):
            f.cancel()


def grid_search(
    estimator: Estimator, grid: Mapping[str, list], train: DataFrame, folds: int, pool: Executor
) -> list[tuple[dict, float]]:
    """Each parameter map of the grid with its cross-validated AUC."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder.addGrid(estimator.getParam(name), values)
    maps = builder.build()
    return list(zip(maps, fold_auc(estimator, train, maps, folds, pool), strict=True))


def tuning_document(tried: Column, folds: int) -> Column:
    """The tuning document (``TUNING_TYPE``) of an array of (params, auc): AUC to 4 places, the first greatest one is the best."""
    aucs = F.transform(tried, lambda t: t["auc"])
    best = F.array_position(aucs, F.array_max(aucs))
    combos = F.transform(
        tried, lambda t, i: F.struct(t["params"].alias("params"), F.round(t["auc"], 4).alias("cv_auc"), (i + 1 == best).alias("is_best"))
    )
    document = F.struct(
        combos.alias("combos"),
        F.get(tried, (best - 1).cast("int"))["params"].alias("best_params"),
        F.round(F.array_max(aucs), 4).alias("best_auc"),
        F.lit(folds).alias("num_folds"),
    )
    return F.when(tried.isNotNull(), document).cast(TUNING_TYPE)


# ── evaluation (H9-H12) ────────────────────────────────────────────────────


def evaluate(predictions: DataFrame) -> dict[str, float]:
    """AUC (the evaluator's default bins) and the metrics of one confusion aggregate."""
    counted = classification_metrics(predictions).first().asDict()
    auc = BinaryClassificationEvaluator(labelCol="label").evaluate(predictions)
    return {"auc": auc, **{m: counted[m] for m in ("accuracy", "precision", "recall", "f1", "recall_dropout")}}


def exact_auc(predictions: DataFrame) -> float:
    """Area under ROC without down-sampling the curve (``numBins=0``)."""
    return BinaryClassificationEvaluator(labelCol="label", numBins=0).evaluate(predictions)


def raw_score(predictions: DataFrame, raw_col: str = "rawPrediction") -> DataFrame:
    """``label``, ``prediction`` and ``score``: the class-1 raw score by which the evaluator ranks."""
    return predictions.select("label", "prediction", vector_to_array(F.col(raw_col))[1].alias("score"))


# ── importance (H15, H16) ──────────────────────────────────────────────────


def importance_values(model: Model) -> list[float] | None:
    if hasattr(model, "featureImportances"):
        return [float(v) for v in model.featureImportances.toArray()]
    if hasattr(model, "coefficients"):
        return [float(v) for v in model.coefficients.toArray()]
    return None


def ranked_importance(model: Model, feature_cols: Sequence[str] = FEATURE_COLUMNS) -> list[tuple[str, float]]:
    """``|value| / sum |values|`` per feature, highest first (all 0 if sum is 0)."""
    raw = importance_values(model)
    if raw is None:
        return []
    total = sum(abs(v) for v in raw)
    norm = [abs(v) / total if total else 0.0 for v in raw]
    return sorted(zip(feature_cols, norm), key=lambda x: x[1], reverse=True)


def model_summary(model: Model) -> dict[str, float | None]:
    if not getattr(model, "hasSummary", False):
        return {"areaUnderROC": None, "accuracy": None}
    s = model.summary
    return {"areaUnderROC": getattr(s, "areaUnderROC", None), "accuracy": getattr(s, "accuracy", None)}


# ── one training run (H9, H13, H14) ────────────────────────────────────────

METRICS = ["auc", "accuracy", "precision", "recall", "f1", "recall_dropout", "cv_auc"]
# Tried parameter maps with their AUC, as a run collects them; ``tuning_document`` gives the stored form.
TRIED_TYPE = T.ArrayType(
    T.StructType([T.StructField("params", T.MapType(T.StringType(), T.StringType())), T.StructField("auc", T.DoubleType())])
)
RUN_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("position", T.IntegerType()),
        *[T.StructField(m, T.DoubleType()) for m in METRICS],
        T.StructField("training_time", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("importance", IMPORTANCE_TYPE),
        T.StructField("tuning", TRIED_TYPE),
        T.StructField("error", T.StringType()),
    ]
)


@dataclass
class TrainingRun:
    run_id: str
    results: DataFrame
    models: dict[str, Model] = field(default_factory=dict)
    best_name: str = ""
    test: DataFrame | None = None

    def release(self) -> None:
        """Drop the kept test frame."""
        if self.test is not None:
            self.test.unpersist()


def run_training(
    features: DataFrame,
    run_id: str | None = None,
    do_tune: bool = True,
    tune_folds: int = 2,
    cv_folds: int = 3,
    estimators: dict[str, Estimator] | None = None,
    parallelism: int = 8,
    weights_from: str = "all",
    strict: bool = False,
) -> TrainingRun:
    """Weights, split, optional tuning, fit, evaluation and cross-validation of each model, selection.

    The features are materialised once: that pass gives the counts per class
    and split, from which weights and partition counts follow.  All fits share one pool,
    ``parallelism`` at a time, as most wait for the driver between many small jobs: those of the
    searches and cross-validations over few partitions, each whole model, once its search is
    done, over more.  ``training_time`` is thus the time that a model took beside others.  A tuning or cross-validation
    that fails stops a ``strict`` run; else it leaves the default settings or an AUC of 0
    and its message in ``error``, and the run's rows cannot be published as evaluations.
    A model that cannot be fitted or evaluated stops any run.
    """
    spark: SparkSession = features.sparkSession
    now = datetime.now(timezone.utc)
    run_id = run_id or now.strftime("%Y%m%d_%H%M%S_%f")
    columns = ["label", *FEATURE_COLUMNS, *ENROLLMENT_KEYS]
    held = features.select(*columns, (split_bucket() < TEST_SHARE).alias("is_test")).persist(StorageLevel.MEMORY_AND_DISK)
    counts = {(r.label, r.is_test): r["count"] for r in held.groupBy("label", "is_test").count().collect()}

    counted = {k: n for k, n in counts.items() if weights_from == "all" or not k[1]}
    per_class: dict = {}
    for (label, _), n in counted.items():
        per_class[label] = per_class.get(label, 0) + n
    weight = F.lit(1.0)
    for label, n in per_class.items():
        weight = F.when(F.col("label").eqNullSafe(F.lit(label)), sum(per_class.values()) / (2.0 * n)).otherwise(weight)
    vectors = assemble(held.withColumn("weight", weight)).select("label", "weight", "features", *ENROLLMENT_KEYS, "is_test")

    def part(is_test: bool) -> tuple[DataFrame, int]:
        rows = sum(n for (_, test), n in counts.items() if test == is_test)
        return sized_partitions(vectors.filter(F.col("is_test") == is_test).drop("is_test"), rows).persist(StorageLevel.MEMORY_AND_DISK), rows

    (train, rows_train), (test, _) = part(False), part(True)
    train.count(), test.count()
    held.unpersist()
    whole = train
    if fit_partitions(rows_train, least=FIT_PARTITIONS) > fit_partitions(rows_train):
        whole = sized_partitions(train, rows_train, least=FIT_PARTITIONS).persist(StorageLevel.MEMORY_AND_DISK)
        whole.count()

    def fitted(estimator: Estimator) -> tuple[Model, float, dict[str, float]]:
        began = time.perf_counter()
        model = estimator.fit(whole)
        took = round(time.perf_counter() - began, 2)
        return model, took, evaluate(model.transform(test))

    def trained(name: str, estimator: Estimator, pool: Executor) -> tuple[tuple, list | None, float, list[str]]:
        """The whole model with its time and metrics, what was tried, the cross-validated AUC, and what failed."""
        errors, tried, cv_auc = [], None, 0.0
        if do_tune and name in GRIDS:
            try:
                found = grid_search(estimator, GRIDS[name], train, tune_folds, pool)
                estimator = estimator.copy(max(found, key=lambda t: t[1])[0])
                tried = [({param.name: str(value) for param, value in params.items()}, auc) for params, auc in found]
            except Exception as e:  # noqa: BLE001 - the default settings stay
                if strict:
                    raise
                errors.append(f"tuning: {e}")
        model = pool.submit(inheritable_thread_target(spark)(fitted), estimator)
        try:
            cv_auc = fold_auc(estimator, train, ParamGridBuilder().build(), cv_folds, pool)[0]
        except Exception as e:  # noqa: BLE001 - an AUC of 0 stands for none
            if strict:
                raise
            errors.append(f"cross-validation: {e}")
        return model.result(), tried, cv_auc, errors

    estimators = estimators or classifiers()
    # one thread a model waits for its fits; boosting comes first in the pool, as its searches and folds are long chains of
    # small jobs, then the other tuned models
    with ThreadPoolExecutor(parallelism) as pool, ThreadPoolExecutor(max(1, len(estimators))) as waits:
        order = sorted(estimators, key=lambda name: (not (do_tune and name in GRIDS), not isinstance(estimators[name], GBTClassifier)))
        found = {name: waits.submit(inheritable_thread_target(spark)(trained), name, estimators[name], pool) for name in order}
        try:
            found = {name: found[name].result() for name in estimators}
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)  # fits that have not begun
            for kept in (train, test, whole):
                kept.unpersist()
            raise

    rows, models = [], {}
    for position, (name, ((model, took, metrics), tried, cv_auc, errors)) in enumerate(found.items()):
        models[name] = model
        metrics = {**metrics, "cv_auc": cv_auc}
        importance = [(f, round(float(v), 4)) for f, v in ranked_importance(model)]
        rows.append(
            (name, run_id, position, *(float(metrics[m]) for m in METRICS), took, now.strftime("%Y-%m-%d %H:%M:%S"),
             importance, tried, "; ".join(errors)[:500] or None)
        )
    train.unpersist()
    whole.unpersist()
    # one row per model; selection uses the unrounded metrics
    results = flag_best(spark.createDataFrame(rows, RUN_SCHEMA).withColumn("composite_score", composite_column()))
    results = results.withColumns({m: F.round(m, 4) for m in [*METRICS, "composite_score"]})
    results = results.withColumn("tuning", tuning_document(F.col("tuning"), tune_folds))
    best = results.filter("is_best").first()
    return TrainingRun(run_id, results, models, best.name if best else "", test)


# ── model registry (A10) ───────────────────────────────────────────────────


def model_path(base: str, name: str, run_id: str) -> str:
    return f"{base.rstrip('/')}/{name.replace(' ', '_').lower()}_{run_id}"


def save_model(model: Model, base: str, name: str, run_id: str) -> str | None:
    """Save with the model's own writer; ``None`` if it cannot be written."""
    if model is None or not hasattr(model, "write"):
        return None
    path = model_path(base, name, run_id)
    model.write().overwrite().save(path)
    return path


def load_model(model_class, base: str, name: str, run_id: str):
    return model_class.load(model_path(base, name, run_id))


def list_saved_models(spark: SparkSession, base: str) -> DataFrame:
    """Saved models under ``base`` from their metadata files: ``(model_dir, class, uid)``."""
    meta = spark.read.json(f"{base.rstrip('/')}/*/metadata")
    return meta.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/metadata/[^/]+$", 1).alias("model_dir"),
        F.col("class"),
        F.col("uid"),
    ).orderBy("model_dir")
