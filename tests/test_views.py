"""Views against the plain join, done row by row in Python."""

from collections import defaultdict
from datetime import datetime

import pytest
from helpers import near, table
from pyspark.sql import functions as F

from riskframe.plans import dashboard, views
from riskframe.plans.catalog import register_views


@pytest.fixture(scope="module")
def joined(patients, prediction_rows):
    people = {p.id: p for p in patients.collect()}
    names = ("pid", "patient_id", "prediction", "probability", "model_name", "created_at")
    out = []
    for row in prediction_rows:
        scored = dict(zip(names, row))
        if scored["patient_id"] in people:
            out.append({**people[scored["patient_id"]].asDict(), **scored})
    return out


def grouped(rows, *keys):
    groups = defaultdict(list)
    for row in rows:
        groups[tuple(k(row) if callable(k) else row[k] for k in keys)].append(row)
    return groups


def mean(items):
    items = [x for x in items if x is not None]
    return sum(items) / len(items) if items else None


def hit(row):
    return row["prediction"] is not None and row["prediction"] == row["target"]


def category(row):
    p = row["probability"]
    steps = ((0.2, "Low Risk"), (0.4, "Moderate Risk"), (0.6, "High Risk"))
    return next((label for limit, label in steps if p is not None and p < limit), "Very High Risk")


def correct(row):
    return "Correct" if hit(row) else "Incorrect"


def factors(row):
    above = row["probability"] is not None and row["probability"] > 0.6
    if above and row["age_group"] in ("50-55", "55-60", "60-65", "65-70", ">70"):
        return "High Risk Age Group"
    if above and row["exang"] == "Yes":
        return "High Risk with Exercise Angina"
    return "Standard Risk"


def counts(rows, *keys):
    return near((*k, len(v)) for k, v in grouped(rows, *keys).items())


SPLITS = [{}, {"rows_per_split": 4}]


@pytest.mark.parametrize("split", SPLITS)
def test_risk_assessment(patients, predictions, joined, split):
    got = views.risk_assessment(patients, predictions, **split)
    assert "rule_risk_score" in got.columns and got.columns.count("risk_score") == 1
    means = {k: mean(r["probability"] for r in v) for k, v in grouped(joined, "age_group").items()}
    expected = [
        (
            r["id"], r["risk_score"], r["model_name"], r["prediction"], r["probability"],
            category(r), correct(r), factors(r),
            None if r["probability"] is None or not means[r["age_group"],]
            else r["probability"] / means[r["age_group"],],
        )
        for r in joined
    ]
    cols = (
        "id", "rule_risk_score", "model_name", "prediction", "risk_score", "risk_category",
        "prediction_accuracy", "risk_factors", "age_adjusted_risk",
    )
    assert near(table(got.select(*cols))) == near(expected)


def test_group_without_any_score(spark, patients, predictions):
    only_zero = predictions.where("patient_id = 1").withColumn("probability", F.lit(0.0))
    got = views.risk_assessment(patients, only_zero)
    assert {r.age_adjusted_risk for r in got.collect()} == {None}


@pytest.mark.parametrize("split", SPLITS)
def test_patient_profiles(patients, predictions, joined, split):
    got = views.patient_profiles(patients, predictions, **split)
    assert got.columns == [
        "id", "age_group", "sex", "cp_type", "trestbps_normalized", "chol_normalized", "fbs",
        "restecg_type", "thalach_normalized", "exang", "oldpeak_normalized", "slope_type",
        "ca_count", "thal_type", "actual_outcome", "model_name", "predicted_outcome",
        "risk_score", "risk_category", "prediction_accuracy",
    ]
    cols = ("id", "age_group", "exang", "actual_outcome", "model_name", "predicted_outcome",
            "risk_score", "risk_category", "prediction_accuracy")
    expected = [
        (r["id"], r["age_group"], r["exang"], r["target"], r["model_name"], r["prediction"],
         r["probability"], category(r), correct(r))
        for r in joined
    ]
    assert near(table(got.select(*cols))) == near(expected)
    analysis = views.patient_risk_analysis(patients, predictions, **split)
    assert table(analysis) == table(got.drop("risk_category", "prediction_accuracy"))


def test_model_performance(predictions, prediction_rows):
    expected = []
    plain = [dict(p=r[3], y=r[2], m=r[4]) for r in prediction_rows]
    for (model,), rows in grouped(plain, "m").items():
        scores = [r["p"] for r in rows if r["p"] is not None]
        expected.append(
            (model, len(rows), sum(r["y"] == 1 for r in rows), sum(r["y"] == 0 for r in rows),
             mean(scores), min(scores), max(scores))
        )
    assert near(table(views.model_performance(predictions))) == near(expected)


def test_distribution_partitions_the_predictions(predictions, prediction_rows):
    rows = [dict(probability=r[3], m=r[4]) for r in prediction_rows]
    got = views.risk_score_distribution(predictions)
    assert near(table(got)) == counts(rows, "m", category)


def test_demographics(patients):
    rows = [p.asDict() for p in patients.collect()]
    expected = [
        (*k, len(v), sum(r["target"] == 1 for r in v), mean(int(r["target"] == 1) for r in v))
        for k, v in grouped(rows, "age_group", "sex").items()
    ]
    assert near(table(views.patient_demographics(patients))) == near(expected)


def test_demographic_risk(patients, predictions, joined):
    expected = []
    for k, v in grouped(joined, "age_group", "sex").items():
        scores = [r["probability"] for r in v if r["probability"] is not None]
        cases = sum(r["target"] == 1 for r in v)
        expected.append(
            (*k, len(v), cases, cases / len(v), mean(scores), min(scores), max(scores))
        )
    assert near(table(views.demographic_risk(patients, predictions))) == near(expected)


def test_model_trends(patients, predictions, joined):
    def day(r):
        return r["created_at"].replace(hour=0, minute=0)

    expected = [
        (*k, len(v), mean(int(hit(r)) for r in v), mean(r["probability"] for r in v))
        for k, v in grouped(joined, day, "model_name").items()
    ]
    assert near(table(views.model_trends(patients, predictions))) == near(expected)


def test_prediction_confidence(patients, predictions, joined):
    def level(r):
        p = r["probability"]
        steps = ((0.2, "Very Low"), (0.4, "Low"), (0.6, "Medium"), (0.8, "High"))
        return next((label for limit, label in steps if p is not None and p < limit), "Very High")

    expected = [
        (*k, len(v), mean(int(hit(r)) for r in v))
        for k, v in grouped(joined, "model_name", level).items()
    ]
    assert near(table(views.prediction_confidence(patients, predictions))) == near(expected)


def all_pairs(rows):
    """Every two predictions of a patient by two models, in order of name."""
    return [
        (a, b)
        for a in rows
        for b in rows
        if a[1] is not None and a[1] == b[1] and a[4] < b[4]
    ]


def test_model_comparison_stands_for_all_pairs(predictions, prediction_rows):
    groups = defaultdict(list)
    for a, b in all_pairs(prediction_rows):
        groups[a[1], a[4], b[4], a[2], b[2]].append((a[3], b[3]))
    expected = [
        (*k, mean(p for p, _ in v), mean(q for _, q in v),
         "Agreement" if k[3] is not None and k[3] == k[4] else "Disagreement", len(v))
        for k, v in groups.items()
    ]
    assert near(table(views.model_comparison(predictions))) == near(expected)


def test_model_comparison_of_single_scorings_is_the_plain_pair(predictions, prediction_rows):
    once = predictions.where("patient_id <> 3")
    got = views.model_comparison(once)
    assert got.where("pair_count <> 1").count() == 0
    expected = [
        (a[1], a[4], b[4], a[2], b[2], a[3], b[3])
        for a, b in all_pairs([r for r in prediction_rows if r[1] != 3])
    ]
    assert near(table(got.select(*got.columns[:7]))) == near(expected)


def test_correlations(spark):
    rows = [(1.0, 5.0, 1), (2.0, 5.0, 0), (None, 5.0, 1), (4.0, 5.0, 1), (7.0, 5.0, None)]
    df = spark.createDataFrame(rows, "x double, constant double, target int")
    got = views.feature_correlations(df, ("x", "constant"), sort=True)
    # Pairs (1,1), (2,0), (4,1): covariance 5/3 - 7/3 * 2/3, variances 14/9 and 2/9.
    r = (1 / 9) / ((14 / 9) ** 0.5 * (2 / 9) ** 0.5)
    assert near(table(got)) == near([("x", "target", r, 5)])


def test_correlations_are_sorted_by_strength(spark):
    df = spark.createDataFrame([(1, 3, 1), (2, 1, 2), (3, 0, 3)], "a int, b int, target int")
    weak = df.withColumn("c", F.when(F.col("a") == 2, 9).otherwise(1))
    got = views.feature_correlations(weak, ("c", "b", "a"), sort=True).collect()
    assert [r.feature1 for r in got] == ["a", "b", "c"]


def test_feature_importance(spark):
    one = '[{"name":"x","importance":0.5},{"name":"y","importance":0.2},{"name":"z"}]'
    tied = one.replace("0.5", "0.1").replace("0.2", "0.1").replace('"z"', '"w","importance":0')
    df = spark.createDataFrame(
        [("m", one), ("m", one), ("n", tied), ("o", None)], "model_name string, metrics string"
    )
    assert table(views.feature_importance(df)) == [
        ("m", "x", 0.5, 1), ("m", "y", 0.2, 2),
        ("n", "w", 0.0, 3), ("n", "x", 0.1, 1), ("n", "y", 0.1, 1),
    ]
    shown = views.presented("feature_importance", views.feature_importance(df)).collect()
    assert [(r.model_name, r.importance) for r in shown][:2] == [("m", 0.5), ("m", 0.2)]


# --- dashboard -----------------------------------------------------------


def test_dashboard_counts(patients, predictions, joined):
    both = patients, predictions
    by_category = table(dashboard.correctness_by_category(*both))
    assert near(by_category) == counts(joined, correct, category)
    assert near(table(dashboard.sex_by_category(*both))) == counts(joined, "sex", category)
    assert near(table(dashboard.risk_factor_counts(*both))) == counts(joined, factors)


def test_accuracy_by_model(patients, predictions, joined):
    expected = [
        (*k, len(v), mean(int(hit(r)) for r in v))
        for k, v in grouped(joined, "model_name").items()
    ]
    assert near(table(dashboard.accuracy_by_model(patients, predictions))) == near(expected)


def test_age_distribution(patients, predictions, joined):
    expected = [
        (*k, len(v), sum(r["target"] for r in v), mean(r["target"] for r in v))
        for k, v in grouped(joined, "age_group").items()
    ]
    assert near(table(dashboard.age_distribution(patients, predictions))) == near(expected)


def test_score_by_category(patients, predictions, joined):
    expected = [
        (*k, len(v), mean(r["probability"] for r in v))
        for k, v in grouped(joined, category).items()
    ]
    assert near(table(dashboard.score_by_category(patients, predictions))) == near(expected)


def test_histogram_closes_at_one(spark, patients):
    scores = [0.0, 0.05, 0.949, 0.95, 1.0, None]
    rows = [(i, 1, 1, p, "m", datetime(2024, 1, 1)) for i, p in enumerate(scores)]
    df = spark.createDataFrame(
        rows, "id long, patient_id long, prediction int, probability double, "
        "model_name string, created_at timestamp_ntz",
    )
    assert table(dashboard.score_histogram(patients, df)) == [
        (0, 0.0, 1), (1, 0.05, 1), (18, 0.9, 1), (19, 0.95, 2),
    ]


def test_filters(patients, predictions, joined):
    got = dashboard.filtered_profiles(
        patients, predictions, dates=(datetime(2024, 3, 2), datetime(2024, 3, 4)),
        models=["a", "b"], risk_categories=["High Risk", "Low Risk"],
        age_groups=["55-60", "40-50"], sexes=[1],
    )
    expected = [
        (r["id"], r["model_name"], r["probability"])
        for r in joined
        if datetime(2024, 3, 2) <= r["created_at"] < datetime(2024, 3, 4)
        and r["model_name"] in "ab" and category(r) in ("High Risk", "Low Risk")
        and r["age_group"] in ("55-60", "40-50") and r["sex"] == 1
    ]
    assert expected and near(table(got.select("id", "model_name", "risk_score"))) == near(expected)
    unfiltered = dashboard.filtered_profiles(patients, predictions)
    assert unfiltered.count() == len(joined)


# --- registration and empty input ----------------------------------------


def test_registered_views(spark, patients, predictions):
    metrics = spark.createDataFrame([("m", "[]")], "model_name string, metrics string")
    names = register_views(spark, patients, predictions, metrics)
    assert len(names) == 13
    for name in names:
        assert spark.table(name).columns
    sql = spark.sql("select model_name, total_predictions from model_performance")
    assert table(sql) == table(
        views.model_performance(predictions).select("model_name", "total_predictions")
    )


def test_views_of_empty_tables(patients, predictions):
    none, nobody = predictions.limit(0), patients.limit(0)
    for view in (
        views.risk_assessment, views.patient_profiles, views.model_trends,
        views.demographic_risk, views.prediction_confidence, dashboard.accuracy_by_model,
        dashboard.score_histogram,
    ):
        assert view(nobody, none).collect() == []
        assert view(patients, none).collect() == []
        assert view(nobody, predictions).collect() == []
    assert views.feature_correlations(nobody).collect() == []
    assert views.model_comparison(none).collect() == []
