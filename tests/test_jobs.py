from datetime import datetime

import numpy as np
import pytest
from helpers import table

from riskframe import __main__ as command
from riskframe import jobs
from riskframe.learning import models
from riskframe.sources import files, stores

RUN = datetime(2024, 2, 1)
SPECS = (
    models.Spec("logistic_regression", models.logistic, {"C": (1,)}),
    models.Spec("decision_tree", models.tree, {"max_depth": (2,), "min_samples_leaf": (1,)}),
    models.Spec(
        "random_forest",
        models.forest,
        {"n_estimators": (3,), "max_depth": (2,), "min_samples_leaf": (1,)},
    ),
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("job")
    draw = np.random.default_rng(11)
    lines = ["Age,Gender,BloodPressure,Cholesterol,HeartRate,QuantumPatternFeature,HeartDisease"]
    for i in range(150):
        chol = int(draw.integers(150, 300))
        lines.append(
            f"{draw.integers(30, 80)},{i % 2},{draw.integers(90, 180)},{chol},"
            f"{draw.integers(60, 120) if i % 10 else ''},{draw.uniform(6, 11):.4f},{int(chol < 235)}"
        )
    lines.append(lines[1])
    (base / "raw.csv").write_text("\r\n".join(lines) + "\r\n")
    jobs.prepare_patients(spark, str(base / "raw.csv"), str(base), RUN)
    jobs.train_and_store(spark, str(base), SPECS, RUN)
    return str(base)


def test_patients_table(spark, folder):
    rows = files.read_patients(spark, f"{folder}/patients").collect()
    assert sorted(r.id for r in rows) == list(range(1, 151))
    assert all(r.thalach is not None and r.risk_level and r.created_at == RUN for r in rows)


def test_stored_results(spark, folder):
    names = [s.name for s in SPECS] + ["voting_classifier", "stacking_classifier"]
    predictions = files.read_predictions(spark, f"{folder}/predictions")
    counts = dict(table(predictions.groupBy("model_name").count()))
    assert sorted(counts) == sorted(names) and set(counts.values()) == {30}
    metrics = stores.read_metrics(spark, f"{folder}/metrics").collect()
    assert sorted(r.model_name for r in metrics) == sorted(names)
    for name in names:
        assert stores.load_model(f"{folder}/models", name).stages
    features = {r.feature for r in stores.read_codes(spark, f"{folder}/models/codes").collect()}
    assert features == {"age_group", "sex_age_group", "risk_level"}
    listed = spark.read.option("header", True).csv(f"{folder}/models/feature_importance")
    assert listed.count() == 27


def test_views_over_stored_tables(spark, folder):
    names = jobs.open_views(spark, folder)
    sizes = {name: spark.table(name).count() for name in names}
    assert sizes["tableau_risk_assessment"] == sizes["patient_risk_analysis"] == 150
    assert sizes["model_training_data"] == 150
    # Five models score each of the 30 held-out patients once.
    assert sizes["model_comparison"] == 30 * 10
    assert sizes["feature_importance"] == 2 * 27
    assert sizes["model_performance"] == 5


def test_repeated_jobs_add_nothing(spark, folder):
    before = {
        "predictions": table(files.read_predictions(spark, f"{folder}/predictions").select("id", "patient_id", "model_name")),
        "metrics": table(stores.read_metrics(spark, f"{folder}/metrics").select("model_name", "accuracy")),
    }
    jobs.train_and_store(spark, folder, SPECS, RUN)
    assert table(files.read_predictions(spark, f"{folder}/predictions").select("id", "patient_id", "model_name")) == before["predictions"]
    assert table(stores.read_metrics(spark, f"{folder}/metrics").select("model_name", "accuracy")) == before["metrics"]


def test_bad_lines_of_a_job(spark, folder, tmp_path):
    text = open(f"{folder}/raw.csv").read() + "1,2,3\r\n"
    (tmp_path / "raw.csv").write_text(text)
    command.main(["prepare", str(tmp_path / "raw.csv"), str(tmp_path), "--most-bad", "1"])
    assert files.read_patients(spark, f"{tmp_path}/patients").count() == 150
    assert files.read_bad_lines(spark, f"{tmp_path}/bad_lines").first().reason == "3 fields, not 7"
    with pytest.raises(files.TooManyBadLines):
        jobs.prepare_patients(spark, str(tmp_path / "raw.csv"), str(tmp_path), RUN, most_bad=0)
    assert files.read_patients(spark, f"{tmp_path}/patients").count() == 150


def test_command_line(spark, folder, capsys):
    command.main(["show", folder, "model_performance", "--rows", "3"])
    assert "total_predictions" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        command.main(["show", folder, "unknown"])
