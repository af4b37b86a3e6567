"""Derived attributes of a patient."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions import cut, quantile_label
from riskframe.sources.schemas import FEATURE_TYPES

# Bins, thresholds, weights and ranges which results must match.
AGE_EDGES = (0, 30, 40, 50, 55, 60, 65, 70, 100)
AGE_LABELS = ("<30", "30-40", "40-50", "50-55", "55-60", "60-65", "65-70", ">70")
RISK_LEVELS = ("Low", "Medium", "High", "Very High")
HIGH_LIMITS = {"trestbps": 130, "chol": 200, "thalach": 100}
VERY_HIGH_LIMITS = {"trestbps": 140, "chol": 240, "thalach": 120}
HEALTHY_RANGES = {"trestbps": (90, 120), "chol": (120, 200), "thalach": (60, 100)}
FLAG_NAMES = {"trestbps": "bp", "chol": "chol", "thalach": "hr"}


class Rule(NamedTuple):
    condition: Column
    weight: int


def score_rules() -> list[Rule]:
    limits = [*HIGH_LIMITS.items(), *VERY_HIGH_LIMITS.items()]
    return [Rule(F.col(c) > limit, 2) for c, limit in limits] + [
        Rule(F.col("age") > 55, 3),
        Rule(F.col("sex") == 1, 2),
    ]


def flag(condition: Column) -> Column:
    """A comparison with a missing value counts as not met."""
    return F.coalesce(condition, F.lit(False))


def rule_score(rules: Sequence[Rule]) -> Column:
    total = F.lit(0)
    for rule in rules:
        total = total + F.when(rule.condition, rule.weight).otherwise(0)
    return total


def engineer_features(
    df: DataFrame,
    keep_raw_pattern: bool = False,
    on_duplicate_edges: str = "collapse",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Derive all features; an ``id`` column and those of ``keep`` are carried along.

    ``keep_raw_pattern`` also keeps the measured pattern value, which the
    stored feature list leaves out.
    """
    age, sex, bp, chol, hr = (
        F.col(c).cast("double") for c in ("age", "sex", "trestbps", "chol", "thalach")
    )
    pattern = F.sin(age * 0.1) * F.cos(bp * 0.05) * F.sin(chol * 0.02)
    healthy = {
        f"healthy_{FLAG_NAMES[c]}": flag(F.col(c).between(*limits))
        for c, limits in HEALTHY_RANGES.items()
    }
    age_group = cut(F.col("age"), AGE_EDGES, AGE_LABELS)
    score = rule_score(score_rules())
    derived = {
        "age_group": age_group,
        "bp_age_interaction": bp * age,
        "chol_age_interaction": chol * age,
        "hr_bp_interaction": hr * bp,
        **{
            f"high_{FLAG_NAMES[c]}_risk": flag(F.col(c) > limit).cast("int")
            for c, limit in HIGH_LIMITS.items()
        },
        "risk_score": score,
        "age_squared": F.pow(age, 2),
        "bp_squared": F.pow(bp, 2),
        "chol_squared": F.pow(chol, 2),
        "bp_chol_ratio": F.try_divide(bp, chol),
        "hr_bp_ratio": F.try_divide(hr, bp),
        "quantum_pattern": pattern,
        "quantum_pattern_squared": F.pow(pattern, 2),
        "quantum_pattern_cubed": F.pow(pattern, 3),
        **healthy,
        "health_score": sum((col.cast("int") for col in healthy.values()), F.lit(0)),
        "sex_age_group": F.concat_ws(
            "_",
            F.coalesce(F.col("sex").cast("string"), F.lit("nan")),
            F.coalesce(age_group, F.lit("nan")),
        ),
    }
    kept = ["id"] if "id" in df.columns else []
    if keep_raw_pattern:
        kept.append("quantum_pattern_raw")
    level = quantile_label(F.col("risk_score"), F.col("_edges"), RISK_LEVELS, on_duplicate_edges)
    return (
        df.withColumns({**derived, "_edges": score_quartiles(df)})
        .withColumn("risk_level", level)
        .select(*kept, *FEATURE_TYPES, *keep)
    )


def score_quartiles(df: DataFrame) -> Column:
    """Quartile edges of the rule score as a scalar subquery.

    The score takes at most 18 values, so ``percentile`` holds at most 18.
    """
    scored = df.select(rule_score(score_rules()).alias("risk_score"))
    edges = F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)])
    return scored.agg(F.percentile("risk_score", edges)).scalar()
