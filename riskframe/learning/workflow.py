"""From a patients table to stored models, metrics and predictions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.learning.forests import tasks_for
from riskframe.learning.models import FOREST, LABEL, LOGISTIC, SPECS, SVM, TREE, Params, Spec
from riskframe.learning.training import (
    SearchResult,
    TrainingSet,
    feature_columns,
    fit_stacking,
    fit_svm,
    grid_search,
    numeric,
    scorer,
    soft_vote,
    training_set,
)
from riskframe.operators.encoding import encode_categoricals
from riskframe.operators.ids import assign_ids
from riskframe.operators.metrics import classification_metrics, confusion_matrix
from riskframe.operators.sampling import stratified_parts
from riskframe.session import materialize
from riskframe.sources.files import run_time
from riskframe.sources.schemas import MODEL_METRICS, PREDICTIONS, conform

TEST_SHARE = 0.2
ENSEMBLE = (FOREST.name, LOGISTIC.name, TREE.name)


@dataclass
class Trained:
    """Models by name, with what is known about each."""

    codes: DataFrame
    train: TrainingSet
    test: DataFrame
    models: dict[str, PipelineModel] = field(default_factory=dict)
    params: dict[str, Params] = field(default_factory=dict)
    cv_precision: dict[str, float] = field(default_factory=dict)

    def add(self, model: PipelineModel, found: SearchResult) -> None:
        self.models[found.name] = model
        self.params[found.name] = found.params
        self.cv_precision[found.name] = found.cv_precision


def prepare(patients: DataFrame, seed: int = 42) -> Trained:
    """Encode categories and split off a stratified fifth for testing."""
    encoded, codes = encode_categoricals(patients)
    cols = feature_columns(encoded)
    # Rows are dealt anew: files that are read by few tasks would leave all later steps to as few.
    tasks = tasks_for(patients.sparkSession, patients.count())
    dealt = numeric(encoded, cols).repartition(tasks, "id").sortWithinPartitions("id")
    stored = materialize(dealt, "encoded")
    parts = stratified_parts(stored, LABEL, "id", [TEST_SHARE], seed, "part")
    split = materialize(parts, "split", partition_by=["part"])
    train, test = (split.where(F.col("part") == i).drop("part") for i in (1, 0))
    return Trained(codes, training_set(train, cols), test)


def train_models(
    patients: DataFrame, specs: Sequence[Spec] = SPECS, seed: int = 42, parallelism: int = 8
) -> Trained:
    """Search every base model, then build the voting and stacking ensembles."""
    trained = prepare(patients, seed)
    bases: dict[str, SearchResult] = {}
    for spec in specs:
        if spec.name == SVM.name:
            found, model = fit_svm(trained.train, spec, parallelism=parallelism)
        else:
            found = grid_search(trained.train, spec, parallelism)
            model = scorer(trained.train, found.model)
            bases[spec.name] = found
        trained.add(model, found)
    members = [bases[name] for name in ENSEMBLE if name in bases]
    if len(members) == len(ENSEMBLE):
        trained.models["voting_classifier"] = soft_vote(trained.train, members)
        trained.models["stacking_classifier"] = fit_stacking(trained.train, members)
    return trained


def score(
    model: PipelineModel,
    df: DataFrame,
    model_name: str,
    run_ts: datetime | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Predictions in the canonical columns but their own id; ``df.id`` is the patient.

    Patient, model and run are the key. ``numbered`` adds contiguous ids.
    """
    return model.transform(df).select(
        F.col("id").alias("patient_id"),
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("probability"),
        F.lit(model_name).alias("model_name"),
        run_time(run_ts).alias("created_at"),
        *keep,
    )


def score_all(trained: Trained, run_ts: datetime | None = None) -> DataFrame:
    """Test-set predictions of all models, with the label."""
    parts = [
        score(model, trained.test, name, run_ts, [LABEL]) for name, model in trained.models.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def numbered(scored: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Predictions with ids that follow those of the ``stored`` ones."""
    last = 0 if stored is None else stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return assign_ids(scored, start=last + 1)


def predictions_of(scored: DataFrame) -> DataFrame:
    return conform(scored, PREDICTIONS)


def feature_importance_table(model: Model, cols: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, importance), largest first; as long as the feature list."""
    pairs = zip(cols, (float(x) for x in model.featureImportances.toArray()))
    return sorted(pairs, key=lambda pair: -pair[1])


def importances(spark: SparkSession, model: Model, cols: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(
        feature_importance_table(model, cols), "feature string, importance double"
    )


def classifier_of(model: PipelineModel) -> Model:
    return model.stages[-1]


def metrics_rows(trained: Trained, scored: DataFrame, run_ts: datetime | None = None) -> DataFrame:
    """One row per model: test metrics, search result, importances as JSON."""
    spark = scored.sparkSession
    known = []
    for name, model in trained.models.items():
        last = classifier_of(model)
        listed = (
            feature_importance_table(last, trained.train.columns)
            if hasattr(last, "featureImportances")
            else []
        )
        known.append(
            (
                name,
                trained.cv_precision.get(name),
                {k: str(v) for k, v in trained.params.get(name, {}).items()},
                [{"name": f, "importance": x} for f, x in listed],
            )
        )
    # One row per model.
    details = F.broadcast(
        spark.createDataFrame(
            known,
            "model_name string, cv_precision_mean double, best_params map<string,string>, "
            "listed array<struct<name:string,importance:double>>",
        )
    )
    measured = classification_metrics(scored).join(confusion_matrix(scored), "model_name")
    rows = measured.join(details, "model_name").withColumns(
        {"metrics": F.to_json("listed"), "created_at": run_time(run_ts)}
    )
    return conform(rows, MODEL_METRICS)
