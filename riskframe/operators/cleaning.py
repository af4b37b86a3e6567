"""Duplicate removal, imputation, scaling, decoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.ids import with_places
from riskframe.operators.quantiles import exact_quantiles
from riskframe.session import materialize

IMPUTED = ("trestbps", "chol", "thalach", "quantum_pattern_raw")


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Copies of a row collapse on the map side, before the shuffle."""
    return df.dropDuplicates()


def impute_medians(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Fill nulls with the column's median. The filled columns become double.

    ``approx`` trades the exact passes for one ``percentile_approx`` pass: the
    rank it finds is off by one in 100,000 of the rows at most.
    """
    if approx:
        row = df.agg(*[F.percentile_approx(c, 0.5, 100_000).alias(c) for c in cols]).first()
        medians = {c: row[c] for c in cols}
    else:
        medians = {c: values[0] for c, values in exact_quantiles(df, cols, [0.5]).items()}
    return df.withColumns(
        {
            c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c]).cast("double"))
            for c in cols
        }
    )


def clean(
    df: DataFrame,
    impute_cols: Sequence[str] | None = None,
    approx: bool = False,
    places: bool = False,
) -> DataFrame:
    """Distinct rows with medians for missing measurements.

    The distinct rows are written out once, so that the passes over single
    columns do not repeat the shuffle. With ``places`` each row's is stored with it,
    which ``assign_ids`` makes ids of without writing the rows again.
    """
    cols = [c for c in IMPUTED if c in df.columns] if impute_cols is None else list(impute_cols)
    distinct = drop_duplicate_rows(df)
    if not cols and not places:
        return distinct
    if places:
        distinct = with_places(distinct)
    stored = materialize(distinct, "distinct")
    return impute_medians(stored, cols, approx) if cols else stored


def min_max_normalize(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """Add ``cols[name] = (x - min) / (max - min)``; null for a constant column.

    NaN takes no part in the extremes and stays NaN.
    """

    def number(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x), x)

    extremes = df.agg(
        F.struct(
            *[F.min(number(c)).alias(f"{c}_min") for c in cols],
            *[F.max(number(c)).alias(f"{c}_max") for c in cols],
        )
    ).scalar()

    def scaled(c: str) -> Column:
        low, high = F.col(f"_extremes.{c}_min"), F.col(f"_extremes.{c}_max")
        return F.try_divide(F.col(c).cast("double") - low, high - low)

    # Naming the subquery's row first keeps it from being planned once per use.
    scaled_df = df.withColumn("_extremes", extremes).withColumns(
        {out: scaled(c) for c, out in cols.items()}
    )
    return scaled_df.drop("_extremes")


def decode(df: DataFrame, mappings: Mapping[str, tuple[str, Mapping[int, str]]]) -> DataFrame:
    """Add label columns: ``{code column: (label column, {code: label})}``.

    Codes without a label become null. The mappings are the caller's constants.
    """

    def label(code: str, names: Mapping[int, str]) -> Column:
        pairs = [F.lit(x) for pair in names.items() for x in pair]
        return F.element_at(F.create_map(*pairs), F.col(code).cast("int"))

    return df.withColumns({out: label(c, names) for c, (out, names) in mappings.items()})
