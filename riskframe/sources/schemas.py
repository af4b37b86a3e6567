"""Canonical tables as Spark schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Header of the raw file and the name each column gets.
RAW_COLUMNS = {
    "Age": "age",
    "Gender": "sex",
    "BloodPressure": "trestbps",
    "Cholesterol": "chol",
    "HeartRate": "thalach",
    "QuantumPatternFeature": "quantum_pattern_raw",
    "HeartDisease": "target",
}

RAW = T.StructType(
    [
        T.StructField(name, T.DoubleType() if name == "QuantumPatternFeature" else T.IntegerType())
        for name in RAW_COLUMNS
    ]
)

# Uncleaned clinical attributes under their coded names.
RAW_CLINICAL = T.StructType(
    [T.StructField("id", T.LongType())]
    + [
        T.StructField(name, T.DoubleType() if name == "oldpeak" else T.IntegerType())
        for name in (
            "age", "sex", "cp", "trestbps", "chol", "fbs", "restecg",
            "thalach", "exang", "oldpeak", "slope", "ca", "thal", "target",
        )
    ]
    + [T.StructField("created_at", T.TimestampNTZType())]
)

# Columns of the feature step in the order in which they are stored.
FEATURE_TYPES = {
    **dict.fromkeys(("age", "sex", "trestbps", "chol", "thalach", "target"), T.IntegerType()),
    "age_group": T.StringType(),
    **dict.fromkeys(
        ("bp_age_interaction", "chol_age_interaction", "hr_bp_interaction"), T.DoubleType()
    ),
    **dict.fromkeys(
        ("high_bp_risk", "high_chol_risk", "high_hr_risk", "risk_score"), T.IntegerType()
    ),
    **dict.fromkeys(
        (
            "age_squared", "bp_squared", "chol_squared", "bp_chol_ratio", "hr_bp_ratio",
            "quantum_pattern", "quantum_pattern_squared", "quantum_pattern_cubed",
        ),
        T.DoubleType(),
    ),
    **dict.fromkeys(("sex_age_group", "risk_level"), T.StringType()),
    **dict.fromkeys(("healthy_bp", "healthy_chol", "healthy_hr"), T.BooleanType()),
    "health_score": T.IntegerType(),
}

# Decoded and normalized clinical attributes.
CLINICAL_TYPES = {
    "cp_type": T.StringType(),
    "trestbps_normalized": T.DoubleType(),
    "chol_normalized": T.DoubleType(),
    "fbs": T.StringType(),
    "restecg_type": T.StringType(),
    "thalach_normalized": T.DoubleType(),
    "exang": T.StringType(),
    "oldpeak_normalized": T.DoubleType(),
    "slope_type": T.StringType(),
    "ca_count": T.IntegerType(),
    "thal_type": T.StringType(),
}

PATIENTS = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(name, kind) for name, kind in {**FEATURE_TYPES, **CLINICAL_TYPES}.items()]
    + [T.StructField("created_at", T.TimestampNTZType())]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("patient_id", T.LongType()),
        T.StructField("prediction", T.IntegerType()),
        T.StructField("probability", T.DoubleType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

IMPORTANCES = T.ArrayType(
    T.StructType(
        [T.StructField("name", T.StringType()), T.StructField("importance", T.DoubleType())]
    )
)

MODEL_METRICS = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("cv_precision_mean", T.DoubleType()),
        T.StructField("best_params", T.MapType(T.StringType(), T.StringType())),
        # JSON text: list of {"name", "importance"}
        T.StructField("metrics", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns, cast them, and add missing ones as null.

    A fractional number going into an integer column is rounded, as a
    relational INSERT would do, not cut off.
    """
    present = dict(df.dtypes)

    def column(field: T.StructField):
        kind = field.dataType
        if field.name not in present:
            return F.lit(None).cast(kind).alias(field.name)
        col = F.col(field.name)
        if isinstance(kind, T.IntegralType) and present[field.name] in ("double", "float"):
            col = F.round(col)
        return col.cast(kind).alias(field.name)

    return df.select([column(field) for field in schema])
