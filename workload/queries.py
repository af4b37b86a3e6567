"""Registered queries: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.functions import cut
from riskframe.jobs import prepare_patients
from riskframe.operators.cleaning import (
    clean,
    decode,
    drop_duplicate_rows,
    min_max_normalize,
)
from riskframe.operators.encoding import (
    CLINICAL_CATEGORIES,
    encode_categoricals,
    encode_clinical,
)
from riskframe.operators.features import AGE_EDGES, AGE_LABELS, engineer_features
from riskframe.operators.ids import assign_ids
from riskframe.operators.metrics import (
    class_weights,
    classification_metrics,
    confusion_matrix,
)
from riskframe.operators.quality import orphan_predictions
from riskframe.operators.quantiles import exact_quantiles, quantile_bins
from riskframe.operators.sampling import assign_folds, stratified_parts
from riskframe.plans import dashboard, views
from riskframe.plans.catalog import register_views
from riskframe.session import materialize, scratch_path
from riskframe.sources import files, stores
from riskframe.sources.schemas import IMPORTANCES, RAW_COLUMNS
from workload import tables

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Round columns whose last bits depend on the order of summing."""
    return df.withColumns({c: F.round(c, DIGITS) for c in cols})


def on_both(view: Callable[..., DataFrame], *floats: str, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        joined = view(tables.patients(spark, sf_dir), tables.predictions(spark, sf_dir), **options)
        return rounded(joined, *floats)

    return run


def on(source: Callable[..., DataFrame], view: Callable[..., DataFrame], *floats: str) -> Query:
    return lambda spark, sf_dir: rounded(view(source(spark, sf_dir)), *floats)


# --- preparation ---------------------------------------------------------


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measurements written as a raw CSV file and read back."""
    path = write_raw_csv(spark, sf_dir)
    loaded = files.load_raw(spark, path)
    return loaded.withColumns({c: F.col(c).cast("double") for c in tables.NORMALIZED})


def age_binning(df: DataFrame) -> DataFrame:
    group = cut(F.col("age"), AGE_EDGES, AGE_LABELS)
    return df.groupBy("age", group.alias("age_group")).agg(F.count(F.lit(1)).alias("n"))


def features(df: DataFrame) -> DataFrame:
    return engineer_features(clean(df))


def risk_levels(df: DataFrame) -> DataFrame:
    scored = engineer_features(drop_duplicate_rows(df))
    return scored.groupBy("risk_score", "risk_level").agg(F.count(F.lit(1)).alias("n"))


def normalized(df: DataFrame) -> DataFrame:
    return min_max_normalize(df, tables.NORMALIZED)


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = tables.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        (F.col("c_nationkey") % 4).alias("cp"),
        (F.col("c_custkey") % 3).alias("slope"),
    )
    names = {
        "cp": ("cp_type", {0: "typical", 1: "atypical", 2: "non-anginal"}),
        "slope": ("slope_type", {0: "up", 1: "flat", 2: "down"}),
    }
    return decode(codes, names)


def surrogate_ids(df: DataFrame) -> DataFrame:
    """The ids of the distinct rows, and how often each is used."""
    numbered = assign_ids(drop_duplicate_rows(df))
    return numbered.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def surrogate_rows(df: DataFrame) -> DataFrame:
    """The distinct rows, and whether each has an id of its own from 1 to their number."""
    numbered = assign_ids(drop_duplicate_rows(df), "_id")
    rows = [c for c in numbered.columns if c != "_id"]
    number = numbered.agg(F.count(F.lit(1))).scalar()
    same = Window.partitionBy("_id")
    return numbered.select(
        *rows,
        F.col("_id").between(F.lit(1), number).alias("in_range"),
        (F.count(F.lit(1)).over(same) == 1).alias("own_id"),
    )


def quantiles_with_infinities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the events' values, some of them infinite."""
    place = F.col("user_id") % 50
    values = tables.table(spark, sf_dir, "events").select(
        F.when(place == 0, float("inf")).when(place == 1, float("-inf")).otherwise(F.col("value"))
        .alias("x")
    )
    probs = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    found = exact_quantiles(materialize(values, "values"), ["x"], probs)["x"]
    rows = spark.createDataFrame(list(zip(probs, found)), "prob double, x double")
    infinite = F.abs("x") == float("inf")
    return rows.select(
        "prob",
        F.when(~infinite, F.round("x", DIGITS)).alias("value"),
        F.when(infinite, F.signum("x")).otherwise(0).cast("int").alias("infinite"),
    )


def write_raw_csv(spark: SparkSession, sf_dir: str) -> str:
    """The measurements as a raw CSV file."""
    path = scratch_path(spark, "raw-csv")
    names = {new: old for old, new in RAW_COLUMNS.items()}
    raw = tables.raw_measures(spark, sf_dir).withColumn("quantum_pattern_raw", F.col("age") / 8)
    measured = {c: F.col(c).cast("int") for c in tables.NORMALIZED}
    raw.withColumns(measured).select(*RAW_COLUMNS.values()).withColumnsRenamed(names).write.option(
        "header", True
    ).csv(path)
    return path


def prepared_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patients table as the job makes it from the CSV, with its number of correlations."""
    folder = scratch_path(spark, "cohort")
    prepare_patients(spark, write_raw_csv(spark, sf_dir), folder, datetime(2024, 1, 1))
    patients = files.read_patients(spark, f"{folder}/patients")
    correlated = views.feature_correlations(patients).agg(F.count(F.lit(1)).cast("int")).scalar()
    return rounded(
        patients.select(
            "age", "sex", "trestbps", "chol", "thalach", "target", "age_group",
            *tables.NORMALIZED.values(), correlated.alias("correlations"),
        ),
        *tables.NORMALIZED.values(),
    )


def csv_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importances written as CSV and read back."""
    path = scratch_path(spark, "importances")
    ranked = views.feature_importance(tables.model_metrics(spark, sf_dir))
    files.write_csv(ranked.select("model_name", "feature_name", "importance"), path)
    schema = "model_name string, feature_name string, importance double"
    return spark.read.schema(schema).option("header", True).csv(path)


def codes_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category codes stored and read back."""
    path = scratch_path(spark, "stored-codes")
    _, codes = encode_categoricals(
        tables.patients(spark, sf_dir), ("age_group", "cp_type", "thal_type")
    )
    stores.save_codes(codes, path)
    return stores.read_codes(spark, path)


def metrics_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics appended in two runs and read back, with the importance of one feature in each."""
    path = scratch_path(spark, "metrics")
    rows = tables.model_metrics(spark, sf_dir)
    for side in (F.col("model_name") < "m", F.col("model_name") >= "m"):
        stores.append_metrics(rows.where(side), path)
    entries = F.from_json("metrics", IMPORTANCES)
    first = F.round(entries[0]["importance"] * 100).cast("long")
    return stores.read_metrics(spark, path).groupBy("model_name").agg(
        F.sum(first).alias("most"), F.count(F.lit(1)).alias("runs")
    )


def ordered_demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's rows in display order, numbered as they come."""
    shown = views.presented(
        "patient_demographics", views.patient_demographics(tables.patients(spark, sf_dir))
    )
    return assign_ids(shown.select("age_group", "sex"), "position")


def views_with_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each risk category in the named views, with limits of the caller."""
    register_views(
        spark,
        tables.patients(spark, sf_dir),
        tables.predictions(spark, sf_dir),
        tables.model_metrics(spark, sf_dir),
        thresholds=(0.1, 0.3, 0.5),
    )
    counted = [
        f"select '{view}' as view, risk_category, {n} as n from {view} group by risk_category"
        for view, n in (
            ("tableau_risk_assessment", "count(*)"),
            ("tableau_patient_profiles", "count(*)"),
            ("risk_score_distribution", "sum(patient_count)"),
        )
    ]
    return spark.sql(" union all ".join(counted))


def stored_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients written to the canonical table and read back."""
    path = scratch_path(spark, "patients")
    files.write_patients(tables.patients(spark, sf_dir), path, datetime(2024, 1, 1))
    return files.read_patients(spark, path).select(
        "id", "age", "sex", "target", "age_group", "cp_type", "chol_normalized", "risk_level",
        "created_at",
    )


def stored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions appended in two runs and read back."""
    path = scratch_path(spark, "predictions")
    scored = tables.predictions(spark, sf_dir)
    files.append_predictions(scored.where(F.col("prediction") == 0), path)
    files.append_predictions(scored.where(F.col("prediction") == 1), path)
    return files.read_predictions(spark, path)


# --- learning inputs and metrics -----------------------------------------


def pairs_in_blocks(predictions: DataFrame) -> DataFrame:
    """Small blocks, so that most patients fill several."""
    return views.model_pairs(predictions, rows_per_block=40)


def label_encode(df: DataFrame) -> DataFrame:
    encoded, _ = encode_categoricals(df, ("age_group", "cp_type", "fbs", "thal_type", "absent"))
    return encoded.select("id", "age_group", "cp_type", "fbs", "thal_type")


def clinical_encode(df: DataFrame) -> DataFrame:
    """Codes of the clinical categories beside the columns that stay."""
    encoded, _ = encode_clinical(df)
    return encoded.select("id", *CLINICAL_CATEGORIES, "ca_count", "target")


def probability_quartiles(df: DataFrame) -> DataFrame:
    """Quartile label of every prediction's probability, a free double."""
    return quantile_bins(
        df.select("id", "probability"), "probability", "quartile", ("Q1", "Q2", "Q3", "Q4")
    )


def registered_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each named view, asked for in SQL."""
    names = register_views(
        spark,
        tables.patients(spark, sf_dir),
        tables.predictions(spark, sf_dir),
        tables.model_metrics(spark, sf_dir),
    )
    counts = [f"select '{name}' as view, count(*) as n from {name}" for name in names]
    return spark.sql(" union all ".join(counts))


def split(df: DataFrame) -> DataFrame:
    return stratified_parts(df, "target", "id", [0.2], 42).select(
        "id", "target", (F.col("part") == 0).alias("in_test")
    )


def folds(df: DataFrame) -> DataFrame:
    return assign_folds(df).select("id", "target", F.col("fold").cast("int"))


def outcomes(patients: DataFrame, predictions: DataFrame) -> DataFrame:
    sums = views.scores_per_patient(predictions, "model_name", "prediction")
    return views.with_patients(sums, patients, "target")


def metrics(patients: DataFrame, predictions: DataFrame) -> DataFrame:
    return classification_metrics(outcomes(patients, predictions), n="n")


def matrix(patients: DataFrame, predictions: DataFrame) -> DataFrame:
    nested = confusion_matrix(outcomes(patients, predictions), n="n")
    cell = F.col("confusion_matrix")
    return nested.select(
        "model_name",
        cell[0][0].alias("tn"), cell[0][1].alias("fp"),
        cell[1][0].alias("fn"), cell[1][1].alias("tp"),
    )


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions whose patient is not in the table: every tenth key is shifted beyond it."""
    patient = F.when(F.col("id") % 10 == 0, F.col("patient_id") + 100_000_000)
    shifted = tables.predictions(spark, sf_dir).withColumn(
        "patient_id", F.coalesce(patient, "patient_id")
    )
    return orphan_predictions(tables.patients(spark, sf_dir), shifted)


def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = views.feature_importance(tables.model_metrics(spark, sf_dir))
    return ranked.orderBy(F.desc("importance"), "model_name", "feature_name").limit(10)


def training_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.model_training_data(tables.patients(spark, sf_dir))


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.filtered_profiles(
        tables.patients(spark, sf_dir),
        tables.predictions(spark, sf_dir),
        dates=(datetime(2024, 1, 5), datetime(2024, 1, 20)),
        models=["click", "view"],
        risk_categories=["High Risk", "Very High Risk"],
        age_groups=["40-50", "50-55", ">70"],
        sexes=[1],
    )


def filtered_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dashboard.filtered_assessment(
        tables.patients(spark, sf_dir),
        tables.predictions(spark, sf_dir),
        models=["click", "view"],
        risk_categories=["High Risk", "Very High Risk"],
        age_groups=["40-50", "50-55", ">70"],
        sexes=[1],
    )
    return rounded(kept, "age_adjusted_risk")


def filtered_demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dashboard.filtered_demographics(
        tables.patients(spark, sf_dir),
        tables.predictions(spark, sf_dir),
        dates=(datetime(2024, 1, 5), None),
        models=["click", "view"],
        sexes=[1],
    )
    return rounded(kept, "heart_disease_rate", "avg_risk_score")


QUERIES: dict[str, Query] = {
    # one row per prediction
    "risk_assessment": on_both(views.risk_assessment, "age_adjusted_risk"),
    "patient_risk_analysis": on_both(views.patient_risk_analysis),
    "patient_profiles": on_both(views.patient_profiles),
    "dash_filtered": filtered,
    "dash_filtered_assessment": filtered_assessment,
    "dash_filtered_demographics": filtered_demographics,
    # aggregated views
    "model_performance": on(tables.predictions, views.model_performance, "avg_probability"),
    "risk_score_distribution": on(tables.predictions, views.risk_score_distribution),
    "patient_demographics": on(
        tables.patients, views.patient_demographics, "heart_disease_rate"
    ),
    "model_trends": on_both(views.model_trends, "accuracy", "avg_risk_score"),
    "model_trends_weekly": on_both(
        views.model_trends, "accuracy", "avg_risk_score", grain="week"
    ),
    "demographic_risk": on_both(views.demographic_risk, "heart_disease_rate", "avg_risk_score"),
    "prediction_confidence": on_both(views.prediction_confidence, "accuracy_rate"),
    "model_comparison": on(
        tables.predictions, views.model_comparison, "model1_probability", "model2_probability"
    ),
    "model_pairs": on(
        tables.predictions, pairs_in_blocks, "model1_probability", "model2_probability"
    ),
    "feature_correlations": on(tables.patients, views.feature_correlations, "correlation"),
    "feature_importance_json": on(tables.model_metrics, views.feature_importance),
    "model_training_data": training_data,
    "registered_views": registered_views,
    "views_with_thresholds": views_with_thresholds,
    "ordered_demographics": ordered_demographics,
    # dashboard
    "dash_accuracy_by_model": on_both(dashboard.accuracy_by_model, "accuracy"),
    "dash_correct_by_category": on_both(dashboard.correctness_by_category),
    "dash_age_distribution": on_both(dashboard.age_distribution, "heart_disease_rate"),
    "dash_sex_by_category": on_both(dashboard.sex_by_category),
    "dash_score_histogram": on_both(dashboard.score_histogram, "bin_start"),
    "dash_feature_rank": on(tables.model_metrics, dashboard.feature_ranking),
    "dash_score_by_category": on_both(dashboard.score_by_category, "avg_risk_score"),
    "dash_risk_factors": on_both(dashboard.risk_factor_counts),
    "top_features": top_features,
    # preparation
    "csv_scan": csv_scan,
    "dedup_clean": on(tables.raw_measures, drop_duplicate_rows),
    "median_impute": on(tables.raw_measures, clean),
    "engineer_features": on(
        tables.raw_measures,
        features,
        "quantum_pattern", "quantum_pattern_squared", "quantum_pattern_cubed",
    ),
    "age_binning": on(tables.raw_measures, age_binning),
    "risk_level_quartiles": on(tables.raw_measures, risk_levels),
    "probability_quartiles": on(tables.predictions, probability_quartiles),
    "minmax_normalize": on(tables.raw_measures, normalized),
    "code_decode": decoded,
    "surrogate_ids": on(tables.raw_measures, surrogate_ids),
    "surrogate_rows": on(tables.raw_measures, surrogate_rows),
    "quantiles_with_infinities": quantiles_with_infinities,
    "prepared_patients": prepared_patients,
    "csv_importances": csv_importances,
    "codes_store": codes_store,
    "metrics_store": metrics_store,
    "patients_store": stored_patients,
    "predictions_store": stored_predictions,
    "orphan_predictions": orphans,
    # learning inputs and metrics
    "label_encode": on(tables.patients, label_encode),
    "clinical_encode": on(tables.patients, clinical_encode),
    "class_weights": on(tables.patients, class_weights, "weight"),
    "stratified_split": on(tables.patients, split),
    "stratified_folds": on(tables.patients, folds),
    "classification_metrics": on_both(metrics, "accuracy", "precision", "recall", "f1"),
    "confusion_matrix": on_both(matrix),
}
