from datetime import datetime

import numpy as np
import pytest
from helpers import near, table
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskframe.learning import models, training, workflow
from riskframe.learning.stages import SoftVote
from riskframe.learning.trees import Cut
from riskframe.operators.features import engineer_features
from riskframe.plans.views import feature_importance
from riskframe.sources import stores
from riskframe.sources.schemas import MODEL_METRICS, PREDICTIONS

RUN = datetime(2024, 2, 1)
SPECS = (
    models.Spec("logistic_regression", models.logistic, {"C": (0.1, 10)}),
    models.Spec("decision_tree", models.tree, {"max_depth": (2, 3), "min_samples_leaf": (1,)}),
    models.Spec(
        "random_forest", models.forest,
        {"n_estimators": (5,), "max_depth": (3,), "min_samples_leaf": (1,)},
    ),
    models.Spec("svm", models.svm, {"C": (1,)}, loss="hinge", features=models.KERNEL_FEATURES),
)


def grid(spec):
    return len(spec.candidates())


def test_grid_sizes():
    assert [grid(s) for s in models.SPECS] == [3, 12, 24, 3]
    assert models.cut_of(models.TREE.candidates()[-1]) == Cut(5, 5)


@pytest.fixture(scope="module")
def people(spark):
    """Patients whose label follows cholesterol, with some noise."""
    draw = np.random.default_rng(3)
    rows = []
    for i in range(240):
        ranges = ((30, 80), (90, 180), (150, 300), (60, 120))
        age, bp, chol, hr = (int(draw.integers(*r)) for r in ranges)
        target = int(chol + draw.normal(scale=15) < 235)
        rows.append((i, age, i % 2, bp, chol, hr, target))
    names = "id long, age int, sex int, trestbps int, chol int, thalach int, target int"
    return engineer_features(spark.createDataFrame(rows, names))


@pytest.fixture(scope="module")
def trained(people):
    return workflow.train_models(people, SPECS)


@pytest.fixture(scope="module")
def scored(trained):
    return workflow.score_all(trained, RUN).persist()


def test_rows_are_dealt_to_all_cores(spark, people):
    """Patients from a single file, of which every fold is read by as many tasks as there are."""
    train = workflow.prepare(people.coalesce(1)).train
    for rows in (train.rows, train.inside(0), train.outside(0)):
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        shares = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert max(shares) < sum(shares) / 2


def test_stored_scores_are_not_made_again(trained, monkeypatch):
    made = training.unseen_scores
    bases = [training.grid_search(trained.train, SPECS[0])]
    unseen = made(trained.train, bases)
    own = training.fit_stacking(trained.train, bases).stages[-1]
    monkeypatch.setattr(training, "unseen_scores", None)
    handed = training.fit_stacking(trained.train, bases, unseen).stages[-1]
    assert handed.intercept == pytest.approx(own.intercept)
    assert handed.coefficients.toArray() == pytest.approx(own.coefficients.toArray())


def test_training_input(people, trained):
    assert trained.train.columns == [c for c in people.columns if c not in ("id", "target")]
    assert len(trained.train.columns) == 27
    labels = dict(table(people.groupBy("target").count()))
    tested = dict(table(trained.test.groupBy("target").count()))
    assert tested == {k: int(n * 0.2 + 0.5) for k, n in labels.items()}
    weights = dict(table(trained.train.rows.select("target", "weight").distinct()))
    counts = dict(table(trained.train.rows.groupBy("target").count()))
    total = sum(counts.values())
    assert weights == pytest.approx({k: total / (2 * n) for k, n in counts.items()})
    assert trained.train.size == total


def test_all_models_are_trained(trained):
    assert list(trained.models) == [
        "logistic_regression", "decision_tree", "random_forest", "svm",
        "voting_classifier", "stacking_classifier",
    ]
    assert trained.params["random_forest"] == {
        "n_estimators": 5, "max_depth": 3, "min_samples_leaf": 1,
    }


def test_models_learn(scored):
    from riskframe.operators.metrics import classification_metrics

    got = {r.model_name: r.accuracy for r in classification_metrics(scored).collect()}
    for name in ("logistic_regression", "decision_tree", "random_forest", "voting_classifier",
                 "stacking_classifier"):
        assert got[name] > 0.75, got


def test_predictions_table(trained, scored):
    out = workflow.predictions_of(workflow.numbered(scored))
    assert out.schema.simpleString() == PREDICTIONS.simpleString()
    rows = out.collect()
    assert len({r.id for r in rows}) == len(rows) == 6 * trained.test.count()
    assert all(0 <= r.probability <= 1 and r.created_at == RUN for r in rows)
    # The margin decides for the support vector machine, a half for the others.
    for r in rows:
        if r.model_name != "svm":
            assert r.prediction == int(r.probability > 0.5)


def test_voting_is_the_mean_of_its_members(scored):
    p = {}
    for r in scored.collect():
        p.setdefault(r.model_name, {})[r.patient_id] = r.probability
    members = [p[m] for m in workflow.ENSEMBLE]
    for patient, vote in p["voting_classifier"].items():
        assert vote == pytest.approx(sum(m[patient] for m in members) / 3)


def test_a_tied_vote_is_negative(spark):
    rows = [([0.2, 0.8], [0.8, 0.2]), ([0.2, 0.8], [0.7, 0.3])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    vectors = df.select(array_to_vector("a").alias("a"), array_to_vector("b").alias("b"))
    out = SoftVote(inputCols=["a", "b"]).transform(vectors)
    got = out.select("prediction", vector_to_array("probability")[1]).collect()
    assert [tuple(round(x, 9) for x in r) for r in got] == [(0.0, 0.5), (1.0, 0.55)]


def test_out_of_fold_rows_are_scored_once_by_models_without_them(trained):
    class Seen:
        """Stands for a model: marks rows with the fold it was kept from."""

        def __init__(self, fold):
            self.fold = fold

        def transform(self, df):
            return df.withColumn("kept_from", F.lit(self.fold))

    out = training.out_of_fold(trained.train, lambda fold: [Seen(fold)])
    assert out.count() == out.select("id").distinct().count() == trained.train.size
    assert out.where(F.col("kept_from") != F.col("fold")).count() == 0
    inside = trained.train.inside(2).select("id")
    assert inside.join(trained.train.outside(2).select("id"), "id").count() == 0


def test_fold_models_are_fitted_without_the_fold(trained):
    spec = SPECS[1]
    found = training.grid_search(trained.train, spec)
    assert len(found.fold_models) == training.FOLDS
    again = spec.build(found.params, trained.train.fold_size).fit(trained.train.outside(1))
    assert found.fold_models[1].toDebugString.split("\n")[1:] == again.toDebugString.split("\n")[1:]


def test_precisions_match_a_separate_pass(trained):
    spec = SPECS[0]
    fitted = [spec.build(p, trained.train.size).fit(trained.train.rows) for p in spec.candidates()]
    got = training.precisions(fitted, trained.train.rows)
    for model, precision in zip(fitted, got):
        rows = model.transform(trained.train.rows).where("prediction = 1")
        assert precision == rows.where("target = 1").count() / rows.count()


def test_training_is_deterministic(people, trained, scored):
    spec = SPECS[1]
    again = workflow.prepare(people)
    found = training.grid_search(again.train, spec)
    model = training.scorer(again.train, found.model)
    got = workflow.score(model, again.test, spec.name, RUN).drop("id")
    expected = scored.where(F.col("model_name") == spec.name).select(got.columns)
    assert near(table(got)) == near(table(expected))


def test_saved_models_predict_the_same(trained, scored, tmp_path):
    for name, model in trained.models.items():
        stores.save_model(model, str(tmp_path), name)
        loaded = stores.load_model(str(tmp_path), name)
        got = workflow.score(loaded, trained.test, name, RUN)
        expected = scored.where(F.col("model_name") == name).select(got.columns)
        assert table(got) == table(expected), name


def test_metrics_feed_the_importance_view(trained, scored):
    rows = workflow.metrics_rows(trained, scored, RUN)
    assert rows.schema.simpleString() == MODEL_METRICS.simpleString()
    by_name = {r.model_name: r for r in rows.collect()}
    assert len(by_name) == 6
    assert by_name["svm"].best_params == {"C": "1"}
    assert by_name["voting_classifier"].cv_precision_mean is None
    (tn, fp), (fn, tp) = by_name["decision_tree"].confusion_matrix
    assert by_name["decision_tree"].accuracy == (tp + tn) / (tp + tn + fp + fn)
    listed = feature_importance(rows).where("model_name = 'random_forest'").collect()
    assert len(listed) == 27
    assert sum(r.importance for r in listed) == pytest.approx(1)


def test_importance_table(spark, trained):
    forest = workflow.classifier_of(trained.models["random_forest"])
    df = workflow.importances(spark, forest, trained.train.columns)
    rows = df.collect()
    assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)
    assert {r.feature for r in rows} == set(trained.train.columns)
