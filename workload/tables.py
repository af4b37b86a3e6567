"""The given tables, seen as patients, predictions and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions import cut
from riskframe.operators.cleaning import min_max_normalize
from riskframe.operators.features import AGE_EDGES, AGE_LABELS

NORMALIZED = {
    "trestbps": "trestbps_normalized",
    "chol": "chol_normalized",
    "thalach": "thalach_normalized",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements from lineitem, with duplicate rows and missing values."""

    def measure(low: int, key: str, span: int, missing: int) -> Column:
        value = F.lit(low) + F.col(key) % span
        return F.nullif(value, F.lit(missing).cast("long")).cast("double")

    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") + 29).cast("int").alias("age"),
        (F.col("l_linenumber") % 2).cast("int").alias("sex"),
        measure(90, "l_partkey", 90, 97).alias("trestbps"),
        measure(150, "l_orderkey", 150, 155).alias("chol"),
        measure(60, "l_suppkey", 60, 63).alias("thalach"),
        (F.col("l_returnflag") == "R").cast("int").alias("target"),
    )


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients from customer."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    balance = F.floor(F.abs("c_acctbal")).cast("long")
    base = table(spark, sf_dir, "customer").select(
        key.alias("id"),
        (30 + key * 7 % 50).cast("int").alias("age"),
        (nation % 2).cast("int").alias("sex"),
        (90 + balance % 90).cast("int").alias("trestbps"),
        (150 + (key * 31 + nation) % 150).cast("int").alias("chol"),
        (60 + balance % 60).cast("int").alias("thalach"),
        ((balance + nation) % 5 < 3).cast("int").alias("target"),
        F.col("c_mktsegment").alias("cp_type"),
        F.when(key % 7 == 0, "Yes").otherwise("No").alias("fbs"),
        F.when(key % 3 == 0, "normal").when(key % 3 == 1, "abnormal").alias("restecg_type"),
        F.when(nation % 3 == 0, "Yes").otherwise("No").alias("exang"),
        (balance % 63).cast("int").alias("oldpeak"),
        F.when(nation % 2 == 0, "up").otherwise("flat").alias("slope_type"),
        (key % 4).cast("int").alias("ca_count"),
        F.when(key % 5 == 0, "fixed").when(key % 5 == 1, "reversible").alias("thal_type"),
    )
    grouped = base.withColumn("age_group", cut(F.col("age"), AGE_EDGES, AGE_LABELS))
    scaled = min_max_normalize(grouped, {**NORMALIZED, "oldpeak": "oldpeak_normalized"})
    return scaled.drop("oldpeak")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions from events: five models, thirty days."""
    probability = F.col("value") / (F.col("value") + 50.0)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("patient_id"),
        (probability >= 0.5).cast("int").alias("prediction"),
        probability.alias("probability"),
        F.col("event_type").alias("model_name"),
        F.col("ts").cast("timestamp_ntz").alias("created_at"),
    )


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as JSON text, per event type and a third of the users."""
    k = F.get_json_object("props", "$.k").cast("int")

    def two_digits(n: Column) -> Column:
        return F.lpad(n.cast("string"), 2, "0")

    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("model_name"), (F.col("user_id") % 3).alias("third"))
        .agg(F.max(k).alias("most"), F.min(k).alias("least"))
        .select(
            "model_name",
            F.concat(
                F.lit('[{"name":"k","importance":0.'),
                two_digits(F.col("most")),
                F.lit('},{"name":"user","importance":0.'),
                two_digits(F.col("least")),
                F.lit('},{"name":"missing"}]'),
            ).alias("metrics"),
        )
    )
