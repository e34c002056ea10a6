"""ML checks on the smallest tables with a reduced run (no grid search)."""

import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators import evaluation, ml
from cohortlens.plans.core_queries import feature_frame
from cohortlens.sources import io
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def run(spark):
    ests = {k: v for k, v in ml.classifiers().items() if k in ("Logistic Regression", "Random Forest")}
    run = ml.run_training(feature_frame(spark, SF_SMALL), do_tune=False, cv_folds=2, estimators=ests)
    yield run
    run.release()


def test_models_beat_chance(run):
    rows = run.results.collect()
    assert len(rows) == 2 and all(r.auc > 0.5 for r in rows)
    assert sum(r.is_best for r in rows) == 1


def test_weighted_recall_equals_accuracy(run):
    for r in run.results.collect():
        assert r.recall == pytest.approx(r.accuracy, abs=1e-4)


def test_importance_sums_to_one(run):
    for r in run.results.collect():
        assert sum(i.score for i in r.importance) == pytest.approx(1.0, abs=1e-3)


def test_confusion_metrics_equal_the_evaluators(run):
    preds = run.models["Logistic Regression"].transform(run.test)
    got = evaluation.classification_metrics(preds).first()
    names = {"accuracy": "accuracy", "precision": "weightedPrecision", "recall": "weightedRecall", "f1": "weightedFMeasure"}
    for mine, theirs in names.items():
        judge = MulticlassClassificationEvaluator(labelCol="label", metricName=theirs)
        assert got[mine] == pytest.approx(judge.evaluate(preds)), mine
    assert got.recall_dropout == pytest.approx(
        MulticlassClassificationEvaluator(labelCol="label", metricName="recallByLabel", metricLabel=1.0).evaluate(preds)
    )
    assert 0.5 < ml.exact_auc(preds) <= 1.0


def test_metrics_of_a_class_that_is_never_predicted(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 0, 0), ("b", 1, 1)], "g string, label int, prediction int")
    got = {r.g: r for r in evaluation.classification_metrics(rows, ["g"]).collect()}
    assert (got["a"].accuracy, got["a"].precision, got["a"].recall_dropout) == (0.5, 0.25, 0.0)
    assert (got["b"].accuracy, got["b"].f1) == (1.0, 1.0)


def test_failing_searches_are_recorded(spark):
    features = feature_frame(spark, SF_SMALL).limit(200)
    ests = {"Linear SVC": ml.classifiers()["Linear SVC"]}
    run = ml.run_training(features, do_tune=False, cv_folds=1, estimators=ests)  # one fold is not allowed
    row = run.results.first()
    assert row.cv_auc == 0.0 and row.error.startswith("cross-validation")
    run.release()


def test_tuning_document(spark):
    tried = [({"regParam": "0.0"}, 0.5), ({"regParam": "0.1"}, 0.71239), ({"regParam": "0.2"}, 0.71239)]
    rows = spark.createDataFrame([(1, tried), (2, None)], T.StructType().add("k", "integer").add("tried", ml.TRIED_TYPE))
    docs = {r.k: r.doc for r in rows.select("k", ml.tuning_document(F.col("tried"), 2).alias("doc")).collect()}
    assert docs[2] is None
    assert [c.cv_auc for c in docs[1].combos] == [0.5, 0.7124, 0.7124] and [c.is_best for c in docs[1].combos] == [False, True, False]
    assert docs[1].best_params == {"regParam": "0.1"} and docs[1].best_auc == 0.7124 and docs[1].num_folds == 2


def test_training_partitions_follow_the_rows_alone(spark):
    df = spark.range(10).selectExpr("id AS id_student", "'m' AS code_module", "'p' AS code_presentation")
    assert ml.sized_partitions(df, 10_000, 10).rdd.getNumPartitions() == 1000


def test_split_is_about_a_fifth(spark):
    f = feature_frame(spark, SF_SMALL)
    share = f.select((ml.split_bucket() < 2).cast("int").alias("t")).agg(F.avg("t")).collect()[0][0]
    assert 0.1 < share < 0.3


def test_registry_round_trip(spark, run, tmp_path):
    base = str(tmp_path / "models")
    path = ml.save_model(run.models["Logistic Regression"], base, "Logistic Regression", run.run_id)
    assert path.endswith(f"logistic_regression_{run.run_id}")
    loaded = ml.load_model(LogisticRegressionModel, base, "Logistic Regression", run.run_id)
    a = run.models["Logistic Regression"].transform(run.test).select("prediction").collect()
    b = loaded.transform(run.test).select("prediction").collect()
    assert a == b
    assert [r.model_dir for r in ml.list_saved_models(spark, base).collect()] == [f"logistic_regression_{run.run_id}"]


def test_views_of_the_evaluations_table(spark):
    rows = [
        ("Random Forest", "20240101_000000", 0, 0.8, 0.5, True),
        ("Random Forest", "20240102_000000", 0, 0.7, 0.6, False),
        ("Linear SVC", "20240102_000000", 1, 0.9, 0.0, False),
    ]
    res = spark.createDataFrame(rows, "name string, run_id string, position int, composite_score double, cv_auc double, is_best boolean").withColumn("auc", F.col("composite_score"))
    latest = {r.name: r.run_id for r in evaluation.latest_runs(res).collect()}
    assert latest == {"Random Forest": "20240102_000000", "Linear SVC": "20240102_000000"}
    hist = {(r.name, r.run_id): r.run_ordinal for r in evaluation.run_history(res).collect()}
    assert hist[("Random Forest", "20240102_000000")] == 2
    assert evaluation.best_model(res).collect()[0].name == "Random Forest"
    flagged = evaluation.flag_best(res.drop("is_best"), ["run_id"]).filter("is_best").collect()
    assert {(r.run_id, r.name) for r in flagged} == {("20240101_000000", "Random Forest"), ("20240102_000000", "Linear SVC")}


def test_publishing_a_run_twice_keeps_one_copy(spark, run, tmp_path):
    path = str(tmp_path / "evaluations")
    evaluation.publish_evaluations(run.results, path, run.run_id)
    evaluation.publish_evaluations(run.results, path, run.run_id)
    evaluation.publish_evaluations(run.results.withColumn("run_id", F.lit("other")), path, "other")
    stored = evaluation.stored_evaluations(spark, path)
    assert stored.count() == 2 * run.results.count()
    typed = io.model_rows_readback(stored)
    best = typed.filter(F.col("is_best") & (F.col("run_id") == run.run_id)).first()
    assert best.name == run.best_name and best.auc == round(best.auc, 4)
    assert abs(sum(x.score for x in best.importance) - 1.0) < 1e-3
    untuned = stored.select("tuning_json").distinct().collect()
    assert [r.tuning_json for r in untuned] == ["{}"]


def test_model_queries_built_twice_give_the_same_rows(spark):
    from cohortlens.plans import REGISTRY

    for name in ("model_results_rows", "model_comparison"):
        first, again = (sorted(map(tuple, REGISTRY[name].build(spark, SF_SMALL).collect())) for _ in range(2))
        assert first == again and first


def test_model_rows_with_bad_values(spark):
    numbers = {c: "0.5" for c in io.MODEL_NUMBERS}
    rows = [
        ("Random_Forest|20240101", {**numbers, "auc": "nan", "f1": "x"}, "true", None, "[]", "not json"),
        ("Linear_SVC", numbers, "TRUE?", "t", None, None),
    ]
    schema = "row_key string, " + ", ".join(f"`{c}` string" for c in io.MODEL_NUMBERS) + ", is_best string, timestamp string, importance_json string, tuning_json string"
    stored = spark.createDataFrame([(k, *n.values(), *rest) for k, n, *rest in rows], schema)
    got = {r.name: r for r in io.model_rows_readback(stored).collect()}
    assert got["Random Forest"].run_id == "20240101" and got["Random Forest"].f1 == 0.0 and got["Random Forest"].is_best
    assert got["Linear SVC"].run_id == io.DEFAULT_RUN_ID and not got["Linear SVC"].is_best
    assert got["Linear SVC"].importance == [] and got["Random Forest"].timestamp == ""


def test_json_documents_are_decoded_in_the_plan(spark):
    from cohortlens.plans import REGISTRY

    plan = REGISTRY["importance_json"].build(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" in plan


def test_rank_sum_auc_equals_exact_evaluator(run):
    for name, model in run.models.items():
        preds = model.transform(run.test)
        got = evaluation.rank_sum_auc(ml.raw_score(preds)).first()["auc"]
        assert got == pytest.approx(ml.exact_auc(preds), abs=1e-9), name


def test_grouped_auc_counts_pairs(spark):
    import random

    rng = random.Random(1)
    rows = [(g, rng.randint(0, 1), float(rng.randint(0, 6))) for g in "abc" for _ in range(40)] + [("d", 1, 0.5)]
    got = {r.g: r.auc for r in evaluation.rank_sum_auc(spark.createDataFrame(rows, "g string, label int, score double"), ["g"]).collect()}
    for g in "abc":
        pos, neg = ([s for h, y, s in rows if h == g and y == v] for v in (1, 0))
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert got[g] == pytest.approx(want)
    assert got["d"] is None


def test_running_totals_match_a_cumulative_sum(spark):
    from cohortlens.functions.positions import running_totals

    df = spark.range(0, 500, numPartitions=5).select((F.col("id") * 7 % 500).alias("k"), (F.col("id") % 3).alias("v"))
    got = {r.k: r.v_before for r in running_totals(df, "k", ["v"], n_partitions=4).collect()}
    rows = sorted((r.k, r.v) for r in df.collect())
    acc = 0
    for k, v in rows:
        assert got[k] == acc
        acc += v


class MeetingRegression(LogisticRegression):
    """Waits in each fit until ``meeting`` fits are there; records the settings in the order in which fits begin."""

    meeting = None
    begun: list = []

    def _fit(self, dataset):
        type(self).begun.append(self.getMaxIter() * self.getRegParam())
        if self.meeting is not None:
            self.meeting.wait()
        return super()._fit(dataset)


class FailingForest(RandomForestClassifier):
    def _fit(self, dataset):
        if self.getMaxDepth() > 5:
            raise ValueError("deep")
        return super()._fit(dataset)


@pytest.fixture(scope="module")
def weighted(spark):
    rows = ml.assemble(ml.with_class_weights(feature_frame(spark, SF_SMALL))).select("label", "weight", "features", *ml.ENROLLMENT_KEYS)
    rows = ml.sized_partitions(rows, rows.count()).persist()
    yield rows
    rows.unpersist()


def test_folds_are_fitted_side_by_side(weighted, monkeypatch):
    monkeypatch.setattr(MeetingRegression, "meeting", threading.Barrier(3, timeout=60))
    with ThreadPoolExecutor(3) as pool:
        assert ml.fold_auc(MeetingRegression(maxIter=2), weighted, [{}], 3, pool)[0] > 0.5


def test_longest_fits_begin_first(weighted, monkeypatch):
    monkeypatch.setattr(MeetingRegression, "begun", [])
    with ThreadPoolExecutor(1) as pool:
        ml.grid_search(MeetingRegression(), {"maxIter": [1, 3], "regParam": [0.5, 1.0]}, weighted, 2, pool)
    assert MeetingRegression.begun == [3.0, 3.0, 1.5, 1.5, 1.0, 1.0, 0.5, 0.5]


def test_fold_auc_equals_the_cross_validator(weighted):
    estimator = ml.classifiers()["Random Forest"]
    grid = ParamGridBuilder().addGrid(estimator.maxDepth, [2, 4]).addGrid(estimator.numTrees, [2, 3]).build()
    judge = BinaryClassificationEvaluator(labelCol="label")
    search = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=judge, numFolds=3, seed=ml.SEED)
    with ThreadPoolExecutor(4) as pool:
        assert ml.fold_auc(estimator, weighted, grid, 3, pool) == pytest.approx(search.fit(weighted).avgMetrics, abs=1e-12)


def test_a_model_whose_search_fails_leaves_the_others_alone(spark):
    ests = {k: v for k, v in ml.classifiers().items() if k in ("Linear SVC", "Random Forest")}
    ests["Random Forest"] = FailingForest(numTrees=3, maxDepth=2, weightCol="weight", seed=ml.SEED)
    run = ml.run_training(feature_frame(spark, SF_SMALL), cv_folds=2, estimators=ests)
    rows = {r.name: r for r in run.results.collect()}
    assert rows["Random Forest"].error.startswith("tuning: deep") and rows["Random Forest"].tuning is None
    assert rows["Linear SVC"].error is None and rows["Linear SVC"].cv_auc > 0.5 and rows["Random Forest"].cv_auc > 0.5
    assert run.models["Random Forest"].getNumTrees == 3  # the settings that it came with
    run.release()


def test_boosted_trees_are_cross_validated_with_all_their_iterations(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(ml, "fold_auc", lambda estimator, train, grid, folds, pool: asked.append((estimator.getMaxIter(), folds)) or [0.75])
    ests = {"Gradient Boosted Trees": GBTClassifier(maxIter=7, maxDepth=2, weightCol="weight", seed=ml.SEED)}
    run = ml.run_training(feature_frame(spark, SF_SMALL), do_tune=False, estimators=ests)
    assert asked == [(7, 3)] and run.results.first().cv_auc == 0.75
    run.release()


def test_a_failed_search_is_no_result(spark, monkeypatch, tmp_path):
    from cohortlens.plans import ml_queries

    def fails(*_):
        raise ValueError("no folds")

    monkeypatch.setattr(ml, "fold_auc", fails)
    monkeypatch.setattr(ml_queries, "feature_frame", lambda spark, folder: features)
    features = feature_frame(spark, SF_SMALL).limit(200).cache()
    with pytest.raises(ValueError, match="no folds"):
        ml_queries.training_run(spark, str(tmp_path))
    row = spark.createDataFrame([("Linear SVC", "cross-validation: no folds")], "name string, error string")
    with pytest.raises(ValueError, match="Linear SVC is not published: cross-validation"):
        evaluation.publish_evaluations(row, str(tmp_path / "evaluations"), "r")


def test_kept_node_ids_leave_the_forest_as_it_is(weighted):
    forest = ml.classifiers()["Random Forest"]
    assert forest.getCacheNodeIds()
    kept, plain = (forest.copy({forest.cacheNodeIds: keep, forest.maxDepth: 7}).fit(weighted).toDebugString for keep in (True, False))
    assert kept.split("\n", 1)[1] == plain.split("\n", 1)[1]


def test_a_whole_model_is_fitted_beside_its_folds(spark, monkeypatch):
    monkeypatch.setattr(MeetingRegression, "meeting", threading.Barrier(4, timeout=60))
    run = ml.run_training(feature_frame(spark, SF_SMALL), estimators={"Logistic Regression": MeetingRegression(maxIter=2, weightCol="weight")})
    row = run.results.first()
    assert row.error is None and row.cv_auc > 0.5 and row.auc > 0.5
    run.release()
