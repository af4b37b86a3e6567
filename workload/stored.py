"""Registered queries on stored tables: sums kept run by run, repeated and failed writes, bad lines."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import cache

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.plans import sums, views
from riskframe.session import scratch_path
from riskframe.sources import files
from riskframe.sources.schemas import RAW_COLUMNS
from workload import tables
from workload.queries import Query, rounded

RUN_TIME = datetime(2024, 1, 1)


@cache
def kept_table(spark: SparkSession, sf_dir: str) -> sums.SumsTable:
    """Sums that were brought up to date while predictions came in two runs."""
    folder = scratch_path(spark, "kept")
    files.write_patients(tables.patients(spark, sf_dir), f"{folder}/patients", RUN_TIME)
    table = sums.SumsTable(f"{folder}/sums", f"{folder}/patients", f"{folder}/predictions")
    scored = tables.predictions(spark, sf_dir)
    for label in (0, 1):
        part = scored.where(F.col("prediction") == label)
        files.append_predictions(part, f"{folder}/predictions", f"run {label}")
        read = table.update(spark)
        if read != [f"run {label}"]:
            raise AssertionError(f"{read} were read")
    return table


def kept(view: Callable[..., DataFrame], *floats: str, **options) -> Query:
    """A view of the sums."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(view(kept_table(spark, sf_dir).read(spark), **options), *floats)

    return run


def repeated_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions by model after a run was repeated under its key, and a write failed midway."""
    folder = scratch_path(spark, "repeated")
    scored = tables.predictions(spark, sf_dir)
    for label in (1, 0, 1):
        files.append_predictions(scored.where(F.col("prediction") == label), folder, f"run {label}")
    failing = F.when(F.col("id") % 7 == 3, F.raise_error(F.lit("stop"))).otherwise(F.lit(0.5))
    try:
        files.append_predictions(scored.withColumn("probability", failing), folder, "run 0")
    except PySparkException:
        pass
    else:
        raise AssertionError("the write was to fail")
    return (
        files.read_predictions(spark, folder)
        .groupBy("model_name")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))
    )


def bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines a load reads, and how many it keeps apart for each reason."""
    path, folder = scratch_path(spark, "raw-csv"), scratch_path(spark, "bad-lines")
    measures = tables.raw_measures(spark, sf_dir)
    numbers = [
        F.coalesce(F.col(c).cast("int").cast("string"), F.lit(""))
        for c in ("age", "sex", "trestbps", "chol", "thalach", "target")
    ]
    numbers.insert(5, F.lit("8.25"))
    line = F.concat_ws(",", *numbers)
    place = F.col("age") % 9
    spoilt = F.when(place == 0, F.concat(line, F.lit(",more"))).when(
        place == 1, F.concat_ws(",", F.lit("old"), *numbers[1:])
    )
    # Lines of one column, whose name is the header.
    lines = measures.select(F.coalesce(spoilt, line).alias(",".join(RAW_COLUMNS)))
    lines.write.options(header=True, quote="", sep="\t").csv(path)
    loaded = files.load_raw(spark, path, folder)
    kinds = loaded.select(F.lit("read").alias("kind")).union(
        files.read_bad_lines(spark, folder).select("reason")
    )
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of one day, and of one patient, from files laid out by both."""
    folder = scratch_path(spark, "laid-out")
    files.append_predictions(
        tables.predictions(spark, sf_dir), folder, "run", by_day_and_patient=True
    )
    day = datetime(2024, 1, 5)
    of_day = files.read_predictions(spark, folder, dates=(day, day + timedelta(1)))
    of_patient = files.read_predictions(spark, folder).where("patient_id = 7")
    return of_day.withColumn("kept_by", F.lit("day")).union(
        of_patient.withColumn("kept_by", F.lit("patient"))
    ).select("kept_by", "id", "patient_id", "model_name", "prediction", "created_at")


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients stored without a time of their own, and whether theirs is that of the write."""
    path = scratch_path(spark, "stamped")
    now = F.current_timestamp().cast("timestamp_ntz")
    before = spark.range(1).select(now).first()[0]
    files.write_patients(tables.patients(spark, sf_dir), path)
    after = spark.range(1).select(now).first()[0]
    stamp = F.col("created_at")
    return files.read_patients(spark, path).select(
        "id", stamp.between(F.lit(before), F.lit(after)).alias("in_time")
    )


def sorted_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations, the strongest first, numbered as they come."""
    features = ("age", "chol", "thalach", "trestbps", "sex")
    found = views.feature_correlations(tables.patients(spark, sf_dir), features, sort=True)
    # As many rows as features.
    numbered = found.withColumn(
        "position", F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))
    )
    return rounded(numbered.select("position", "feature1", "correlation"), "correlation")


QUERIES = {
    "kept_performance": kept(sums.model_performance, "avg_probability"),
    "kept_distribution": kept(sums.risk_score_distribution),
    "kept_trends": kept(sums.model_trends, "accuracy", "avg_risk_score"),
    "kept_trends_weekly": kept(sums.model_trends, "accuracy", "avg_risk_score", grain="week"),
    "kept_demographic_risk": kept(sums.demographic_risk, "heart_disease_rate", "avg_risk_score"),
    "kept_confidence": kept(sums.prediction_confidence, "accuracy_rate"),
    "kept_accuracy_by_model": kept(sums.accuracy_by_model, "accuracy"),
    "kept_correct_by_category": kept(sums.correctness_by_category),
    "kept_age_distribution": kept(sums.age_distribution, "heart_disease_rate"),
    "kept_sex_by_category": kept(sums.sex_by_category),
    "kept_score_histogram": kept(sums.score_histogram, "bin_start"),
    "kept_score_by_category": kept(sums.score_by_category, "avg_risk_score"),
    "kept_risk_factors": kept(sums.risk_factor_counts),
    "repeated_run": repeated_run,
    "bad_lines": bad_lines,
    "laid_out": laid_out,
    "stamped": stamped,
    "sorted_correlations": sorted_correlations,
}
