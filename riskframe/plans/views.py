"""Views over patients and predictions, one function each.

Where a view aggregates, predictions are first summed up per patient and per
the view's own prediction-side keys, and only those sums meet the patients. A
patient who owns a third of all predictions is then a handful of rows. Views
that return one row per prediction use the join that splits such a patient.

Results are unsorted; ``presented`` sorts one for display.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions import (
    agreement,
    confidence_level,
    correctness,
    period_start,
    risk_category,
    risk_factors,
)
from riskframe.functions.labels import (
    CONFIDENCE_THRESHOLDS,
    OLDER_GROUPS,
    RISK_FACTOR_CUTOFF,
    RISK_THRESHOLDS,
)
from riskframe.operators.joins import (
    ROWS_PER_SPLIT,
    hot_keys,
    join_on_unique_key,
    row_hash,
)
from riskframe.sources.schemas import CLINICAL_TYPES, IMPORTANCES

ATTRIBUTES = ("age_group", "sex", *CLINICAL_TYPES)

# Columns to sort by for display; a leading "-" means descending.
PRESENTATION_ORDER = {
    "risk_score_distribution": ("model_name", "risk_category"),
    "patient_demographics": ("age_group", "sex"),
    "model_trends": ("prediction_date", "model_name"),
    "demographic_risk": ("age_group", "sex"),
    "prediction_confidence": ("model_name", "confidence_level"),
    "feature_importance": ("model_name", "-importance"),
}


def presented(view: str, df: DataFrame) -> DataFrame:
    """The view's rows in display order."""
    return df.orderBy(
        *[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in PRESENTATION_ORDER[view]]
    )


def scores_per_patient(predictions: DataFrame, *keys: Column | str) -> DataFrame:
    """Counts and score sums by patient and ``keys``."""
    score = F.col("probability")
    return predictions.groupBy("patient_id", *keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(score).alias("n_scored"),
        F.sum(score).alias("score_sum"),
        F.min(score).alias("score_min"),
        F.max(score).alias("score_max"),
    )


def with_patients(groups: DataFrame, patients: DataFrame, *cols: str) -> DataFrame:
    """Inner join of per-patient sums with patient columns."""
    side = patients.select(F.col("id").alias("_id"), *cols)
    return groups.join(side, groups["patient_id"] == side["_id"]).drop("_id")


def total() -> Column:
    return F.sum("n").cast("long")


def mean_score() -> Column:
    return F.try_divide(F.sum("score_sum"), F.sum("n_scored"))


def share_of_rows(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(0)) / F.sum("n")


def sum_where(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("long")


# --- one table -----------------------------------------------------------


def model_training_data(patients: DataFrame) -> DataFrame:
    return patients.select(*ATTRIBUTES, "target")


def model_performance(predictions: DataFrame) -> DataFrame:
    score, outcome = F.col("probability"), F.col("prediction")
    return predictions.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(outcome == 1).alias("positive_predictions"),
        F.count_if(outcome == 0).alias("negative_predictions"),
        F.avg(score).alias("avg_probability"),
        F.min(score).alias("min_probability"),
        F.max(score).alias("max_probability"),
    )


def risk_score_distribution(
    predictions: DataFrame, thresholds: Sequence[float] = RISK_THRESHOLDS
) -> DataFrame:
    """``patient_count`` counts predictions, as the name does not say."""
    category = risk_category(F.col("probability"), thresholds).alias("risk_category")
    return predictions.groupBy("model_name", category).agg(
        F.count(F.lit(1)).alias("patient_count")
    )


def patient_demographics(patients: DataFrame) -> DataFrame:
    case = F.coalesce(F.col("target") == 1, F.lit(False))
    return patients.groupBy("age_group", "sex").agg(
        F.count(F.lit(1)).alias("total_patients"),
        F.count_if(case).alias("heart_disease_cases"),
        F.avg(case.cast("int")).alias("heart_disease_rate"),
    )


def feature_correlations(
    patients: DataFrame,
    features: Sequence[str] = ("age", "trestbps_normalized"),
    target: str = "target",
    sort: bool = False,
) -> DataFrame:
    """Pearson correlation of each feature with the target, in one pass.

    Pairs with a null are left out of the correlation but counted in
    ``sample_size``; a constant column, or one with NaN, has no correlation and no row.
    """
    y = F.col(target).cast("double")

    def pearson(name: str) -> Column:
        x = F.col(name).cast("double")
        deviations = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(
            F.when(x.isNotNull(), y)
        )
        return F.try_divide(F.covar_pop(x, y), deviations)

    wide = patients.agg(
        F.count(F.lit(1)).alias("sample_size"),
        *[pearson(name).alias(f"r{i}") for i, name in enumerate(features)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("feature1"), F.col(f"r{i}").alias("correlation"))
            for i, name in enumerate(features)
        ]
    )
    out = (
        wide.select(F.inline(rows), "sample_size")
        .where(F.col("correlation").isNotNull() & ~F.isnan("correlation"))
        .select("feature1", F.lit(target).alias("feature2"), "correlation", "sample_size")
    )
    return out.orderBy(F.abs("correlation").desc()) if sort else out


def feature_importance(model_metrics: DataFrame) -> DataFrame:
    """Importances out of the metrics' JSON, ranked within the model.

    Equal metrics texts are merged before they are parsed. The table has one
    row per training run, so a model's list of features fits one window.
    """
    entries = model_metrics.select("model_name", "metrics").distinct()
    listed = entries.select("model_name", F.inline(F.from_json("metrics", IMPORTANCES)))
    kept = listed.where(F.col("importance").isNotNull()).select(
        "model_name", F.col("name").alias("feature_name"), "importance"
    )
    by_importance = Window.partitionBy("model_name").orderBy(F.desc("importance"))
    return kept.withColumn("rank", F.rank().over(by_importance).cast("long"))


def model_comparison(predictions: DataFrame) -> DataFrame:
    """How two models judge one patient, for every two models of the patient.

    One row per patient, model pair and pair of predicted classes. Where each
    model scored the patient once, that is the plain pair of predictions and
    ``pair_count`` is 1. Repeated scorings would make all pairs of a patient
    quadratic, so they are summed up per model first: ``pair_count`` tells how
    many pairs the row stands for, and the probabilities are their means.
    """
    sums = predictions.groupBy("patient_id", "model_name", "prediction").agg(
        F.count(F.lit(1)).alias("n"), F.avg("probability").alias("probability")
    )

    def side(i: int) -> DataFrame:
        return sums.select(
            F.col("patient_id").alias(f"patient{i}"),
            F.col("model_name").alias(f"model{i}_name"),
            F.col("prediction").alias(f"model{i}_prediction"),
            F.col("probability").alias(f"model{i}_probability"),
            F.col("n").alias(f"n{i}"),
        )

    pairs = side(1).join(
        side(2),
        (F.col("patient1") == F.col("patient2")) & (F.col("model1_name") < F.col("model2_name")),
    )
    return pairs.select(
        F.col("patient1").alias("patient_id"),
        "model1_name",
        "model2_name",
        "model1_prediction",
        "model2_prediction",
        "model1_probability",
        "model2_probability",
        agreement(F.col("model1_prediction"), F.col("model2_prediction")).alias(
            "prediction_agreement"
        ),
        (F.col("n1") * F.col("n2")).alias("pair_count"),
    )


def model_pairs(predictions: DataFrame, rows_per_block: int = 10_000) -> DataFrame:
    """Every two predictions of one patient by two models, one row per pair.

    The number of rows grows with the square of a patient's predictions;
    ``model_comparison`` has their sums. A patient of many predictions is cut into
    blocks of about ``rows_per_block``, and every two blocks meet in a cell of
    their own, so that no task makes more than about the square of that. Rows
    are shuffled once: a row goes to each cell of its block, and tells which sides
    of the pairs there it is on. Both sides of the join are then the same table.
    """
    rows = predictions.select("patient_id", "model_name", "prediction", "probability", "id")
    rows = rows.where(F.col("patient_id").isNotNull() & F.col("model_name").isNotNull())
    hot = F.broadcast(hot_keys(rows, "patient_id", rows_per_block))
    parts = F.coalesce(F.col("_splits"), F.lit(1).cast("long"))
    cut = rows.join(hot, F.col("patient_id") == F.col("_hot_key"), "left").select(
        *rows.columns, parts.alias("_parts"), F.pmod(row_hash(rows), parts).alias("_own")
    )
    # Cell (i, j) holds block i as the first side and block j as the second.
    own, other = F.col("_own"), F.col("_other")
    as_first = F.struct(
        (own * F.col("_parts") + other).alias("cell"),
        F.lit(1).alias("first"),
        (own == other).cast("int").alias("second"),
    )
    as_second = F.struct(
        (other * F.col("_parts") + own).alias("cell"), F.lit(0).alias("first"), F.lit(1).alias("second")
    )
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_other")
    sides = F.when(own == other, F.array(as_first)).otherwise(F.array(as_first, as_second))
    dealt = cut.select("*", others).select(
        "patient_id", "model_name", "prediction", "probability", F.explode(sides).alias("s")
    )
    dealt = dealt.select(
        "patient_id", "model_name", "prediction", "probability",
        F.col("s.cell").alias("cell"), F.col("s.first").alias("first"), F.col("s.second").alias("second"),
    )
    one, two = dealt.alias("one"), dealt.alias("two")
    # The sides in one expression: apart, they would be filters before the shuffle,
    # and the two shuffles would differ.
    met = (
        (F.col("one.patient_id") == F.col("two.patient_id"))
        & (F.col("one.cell") == F.col("two.cell"))
        & (F.col("one.first") + F.col("two.second") == 2)
        & (F.col("one.model_name") < F.col("two.model_name"))
    )
    return one.join(two, met).select(
        F.col("one.patient_id").alias("patient_id"),
        F.col("one.model_name").alias("model1_name"),
        F.col("two.model_name").alias("model2_name"),
        F.col("one.prediction").alias("model1_prediction"),
        F.col("two.prediction").alias("model2_prediction"),
        F.col("one.probability").alias("model1_probability"),
        F.col("two.probability").alias("model2_probability"),
        agreement(F.col("one.prediction"), F.col("two.prediction")).alias("prediction_agreement"),
    )


# --- aggregates over patients and predictions ----------------------------


def model_trends(patients: DataFrame, predictions: DataFrame, grain: str = "day") -> DataFrame:
    day = period_start(F.col("created_at"), grain).alias("prediction_date")
    sums = scores_per_patient(predictions, day, "model_name", "prediction")
    return (
        with_patients(sums, patients, "target")
        .groupBy("prediction_date", "model_name")
        .agg(
            total().alias("total_predictions"),
            share_of_rows(F.col("prediction") == F.col("target")).alias("accuracy"),
            mean_score().alias("avg_risk_score"),
        )
    )


def demographic_risk(patients: DataFrame, predictions: DataFrame) -> DataFrame:
    """``total_patients`` counts predictions: a patient counts once per scoring."""
    case = F.col("target") == 1
    return (
        with_patients(scores_per_patient(predictions), patients, "age_group", "sex", "target")
        .groupBy("age_group", "sex")
        .agg(
            total().alias("total_patients"),
            sum_where(case).alias("heart_disease_cases"),
            share_of_rows(case).alias("heart_disease_rate"),
            mean_score().alias("avg_risk_score"),
            F.min("score_min").alias("min_risk_score"),
            F.max("score_max").alias("max_risk_score"),
        )
    )


def prediction_confidence(
    patients: DataFrame,
    predictions: DataFrame,
    thresholds: Sequence[float] = CONFIDENCE_THRESHOLDS,
) -> DataFrame:
    level = confidence_level(F.col("probability"), thresholds).alias("confidence_level")
    sums = scores_per_patient(predictions, "model_name", level, "prediction")
    return (
        with_patients(sums, patients, "target")
        .groupBy("model_name", "confidence_level")
        .agg(
            total().alias("prediction_count"),
            share_of_rows(F.col("prediction") == F.col("target")).alias("accuracy_rate"),
        )
    )


# --- one row per prediction ----------------------------------------------


def _score_side(predictions: DataFrame, *extra: str) -> DataFrame:
    return predictions.select(
        "patient_id",
        *extra,
        "model_name",
        F.col("prediction").alias("_prediction"),
        F.col("probability").alias("_probability"),
    )


def patient_risk_analysis(
    patients: DataFrame,
    predictions: DataFrame,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    joined = join_on_unique_key(
        _score_side(predictions, "id").withColumnRenamed("id", "_prediction_id"),
        patients.select("id", *ATTRIBUTES, "target"),
        "patient_id",
        "id",
        rows_per_split,
    )
    return joined.select(
        "id",
        *ATTRIBUTES,
        F.col("target").alias("actual_outcome"),
        "model_name",
        F.col("_prediction").alias("predicted_outcome"),
        F.col("_probability").alias("risk_score"),
    )


def patient_profiles(
    patients: DataFrame,
    predictions: DataFrame,
    thresholds: Sequence[float] = RISK_THRESHOLDS,
    **split: int,
) -> DataFrame:
    analysis = patient_risk_analysis(patients, predictions, **split)
    return analysis.select(
        "*",
        risk_category(F.col("risk_score"), thresholds).alias("risk_category"),
        correctness(F.col("predicted_outcome"), F.col("actual_outcome")).alias(
            "prediction_accuracy"
        ),
    )


def _mean_by_age_group(patients: DataFrame, sums: DataFrame) -> DataFrame:
    return (
        with_patients(sums, patients, "age_group")
        .groupBy("age_group")
        .agg(mean_score().alias("_mean_score"))
    )


def risk_assessment(
    patients: DataFrame,
    predictions: DataFrame,
    thresholds: Sequence[float] = RISK_THRESHOLDS,
    older_groups: Sequence[str] = OLDER_GROUPS,
    cutoff: float = RISK_FACTOR_CUTOFF,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Every prediction with its patient, labels, and score relative to the
    mean score of the patient's age group.

    The mean per age group is not a window: there are only a few groups, each
    far too large for one task. It is aggregated and attached to the patients,
    who are fewer than the predictions. A patient column ``risk_score`` is
    returned as ``rule_risk_score``, since the view's own is the probability.
    """
    own = patients.withColumnRenamed("risk_score", "rule_risk_score")
    sums = scores_per_patient(predictions)
    means = _mean_by_age_group(patients, sums)
    # The sums that the means need tell the hot keys too.
    hot = hot_keys(sums.where("patient_id is not null"), "patient_id", rows_per_split, F.col("n"))
    groups = means.withColumnRenamed("age_group", "_group")
    # No hint and no job: AQE sees how small the means are.
    same_group = F.col("age_group").eqNullSafe(F.col("_group"))
    rated = own.join(groups, same_group, "left").select(*own.columns, "_mean_score")
    joined = join_on_unique_key(
        _score_side(predictions, "id").withColumnRenamed("id", "_prediction_id"),
        rated,
        "patient_id",
        "id",
        rows_per_split,
        hot=hot,
    )
    score = F.col("_probability")
    return joined.select(
        *own.columns,
        "model_name",
        F.col("_prediction").alias("prediction"),
        score.alias("risk_score"),
        risk_category(score, thresholds).alias("risk_category"),
        correctness(F.col("_prediction"), F.col("target")).alias("prediction_accuracy"),
        risk_factors(F.col("age_group"), F.col("exang"), score > cutoff, older_groups).alias(
            "risk_factors"
        ),
        F.try_divide(score, F.col("_mean_score")).alias("age_adjusted_risk"),
    )
