"""Sums kept run by run against the views that read all predictions; pairs in blocks."""

from datetime import datetime

import pytest
from helpers import near, table
from pyspark.sql import functions as F

from riskframe.plans import dashboard, sums, views
from riskframe.sources import files, tables

VIEWS = {
    "model_performance": lambda p, q: views.model_performance(q),
    "risk_score_distribution": lambda p, q: views.risk_score_distribution(q),
    "model_trends": views.model_trends,
    "demographic_risk": views.demographic_risk,
    "prediction_confidence": views.prediction_confidence,
    "accuracy_by_model": dashboard.accuracy_by_model,
    "correctness_by_category": dashboard.correctness_by_category,
    "age_distribution": dashboard.age_distribution,
    "sex_by_category": dashboard.sex_by_category,
    "score_histogram": dashboard.score_histogram,
    "score_by_category": dashboard.score_by_category,
    "risk_factor_counts": dashboard.risk_factor_counts,
}


@pytest.fixture()
def stored(spark, patients, predictions, tmp_path):
    files.write_patients(patients, f"{tmp_path}/patients", datetime(2024, 1, 1))
    files.append_predictions(predictions.where("model_name = 'a'"), f"{tmp_path}/predictions", "one")
    return sums.SumsTable(*(f"{tmp_path}/{n}" for n in ("sums", "patients", "predictions")))


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_views_of_sums(patients, predictions, name):
    state = sums.prediction_sums(patients, predictions)
    got = getattr(sums, name)(state)
    expected = VIEWS[name](patients, predictions)
    assert got.columns == expected.columns
    assert near(table(got)) == near(table(expected))


def test_weeks_and_other_limits(patients, predictions):
    limits = sums.Limits(risk=(0.1, 0.3, 0.5), cutoff=0.3, bins=4)
    state = sums.prediction_sums(patients, predictions, limits)
    pairs = [
        (sums.model_trends(state, "week"), views.model_trends(patients, predictions, "week")),
        (sums.risk_score_distribution(state), views.risk_score_distribution(predictions, limits.risk)),
        (sums.score_histogram(state, 4), dashboard.score_histogram(patients, predictions, 0.25)),
        (sums.risk_factor_counts(state), dashboard.risk_factor_counts(patients, predictions, cutoff=0.3)),
    ]
    for got, expected in pairs:
        assert near(table(got)) == near(table(expected))


def test_an_update_reads_new_runs_alone(spark, stored, patients, predictions, monkeypatch):
    read = []
    plain = files.read_predictions

    def watched(session, path, runs=None):
        read.append(runs)
        return plain(session, path, runs)

    monkeypatch.setattr(files, "read_predictions", watched)
    assert stored.update(spark) == ["one"] and read == [["one"]]
    files.append_predictions(predictions.where("model_name <> 'a'"), stored.predictions, "two")
    with pytest.raises(LookupError, match="1 runs"):
        stored.read(spark)
    assert stored.update(spark) == ["two"] and read == [["one"], ["two"]]
    assert stored.update(spark) == [] and len(read) == 2
    whole = sums.prediction_sums(patients, predictions)
    assert near(table(stored.read(spark))) == near(table(whole.select(stored.read(spark).columns)))


def test_repeated_runs_new_patients_and_other_limits(spark, stored, patients, predictions):
    files.append_predictions(predictions.where("model_name = 'b'"), stored.predictions, "two")
    assert stored.update(spark) == ["one", "two"]
    # The same run with other rows takes the place of its sums.
    files.append_predictions(predictions.where("model_name = 'c'"), stored.predictions, "two")
    assert stored.update(spark) == ["two"]
    kept = files.read_predictions(spark, stored.predictions)
    got = table(sums.model_performance(stored.read(spark)))
    assert near(got) == near(table(views.model_performance(kept)))
    assert len(tables.runs(spark, stored.path)) == 2
    files.write_patients(patients.withColumn("sex", F.lit(1)), stored.patients, datetime(2024, 1, 1))
    assert stored.update(spark) == ["one", "two"]
    sexes = stored.read(spark).where("known").select("sex").distinct()
    assert table(sexes) == [(1,)]
    other = sums.SumsTable(stored.path, stored.patients, stored.predictions, sums.Limits(bins=5))
    assert other.update(spark) == ["one", "two"]
    assert other.read(spark).agg(F.max("bin")).first()[0] <= 4


def test_no_runs(spark, stored, tmp_path):
    empty = sums.SumsTable(f"{tmp_path}/none", stored.patients, f"{tmp_path}/nothing")
    assert empty.update(spark) == [] and empty.read(spark).count() == 0


# --- pairs -----------------------------------------------------------------


def by_hand(rows):
    out = []
    for _, p1, y1, s1, m1, _ in rows:
        for _, p2, y2, s2, m2, _ in rows:
            if p1 is not None and p1 == p2 and m1 < m2:
                label = "Agreement" if y1 is not None and y1 == y2 else "Disagreement"
                out.append((p1, m1, m2, y1, y2, s1, s2, label))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows_per_block", [1, 7, 10_000])
def test_pairs_of_all_predictions(predictions, prediction_rows, rows_per_block):
    pairs = views.model_pairs(predictions, rows_per_block)
    assert table(pairs) == by_hand(prediction_rows)


def test_pairs_shuffle_rows_once(spark, predictions):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = views.model_pairs(predictions, 7)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange" in plan


def test_pairs_agree_with_their_sums(predictions):
    pairs = views.model_pairs(predictions, 7)
    keys = ["patient_id", "model1_name", "model2_name", "model1_prediction", "model2_prediction"]
    counted = pairs.groupBy(*keys).count()
    summed = views.model_comparison(predictions).select(*keys, "pair_count")
    assert table(counted) == table(summed)
