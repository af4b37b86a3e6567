"""Ordinal codes of category columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.ids import assign_ids
from riskframe.operators.joins import (
    BROADCAST_BYTES,
    BROADCAST_ROWS,
    at_most,
    attach_lookup,
)
from riskframe.session import materialize

# Columns encoded for training, and in a decoded clinical table.
TRAINING_CATEGORIES = (
    "cp", "fbs", "restecg", "exang", "slope", "ca", "thal",
    "age_group", "sex_age_group", "cp_sex", "risk_level",
)
CLINICAL_CATEGORIES = (
    "age_group", "sex", "cp_type", "fbs", "restecg_type", "exang", "slope_type", "thal_type",
)
MISSING = "None"


def category_codes(
    df: DataFrame, cols: Sequence[str], max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """(feature, value, code): rank of each value in byte order, from 0.

    All columns are listed in one scan and the distinct values are written out.
    Few values are ranked in one window; many are sorted in ranges and numbered
    by file offsets.
    """
    entries = [
        F.struct(F.lit(c).alias("feature"), _text(c).alias("value")) for c in cols
    ]
    listed = df.select(F.inline(F.array(*entries))).distinct()
    values = materialize(listed, "categories")
    if at_most(values, max_rows):
        place = F.row_number().over(Window.partitionBy("feature").orderBy("value"))
        # Written out, so that the ranking is not planned again for every column.
        return materialize(values.withColumn("code", (place - 1).cast("long")), "codes")
    ranged = values.repartitionByRange("feature", "value").sortWithinPartitions("feature", "value")
    numbered = assign_ids(ranged, "_id")
    # One row per encoded column.
    firsts = F.broadcast(
        numbered.groupBy(F.col("feature").alias("_feature")).agg(F.min("_id").alias("_first"))
    )
    coded = numbered.join(firsts, F.col("feature") == F.col("_feature")).select(
        "feature", "value", (F.col("_id") - F.col("_first")).alias("code")
    )
    return materialize(coded, "codes")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(MISSING))


def apply_codes(
    df: DataFrame, codes: DataFrame, cols: Sequence[str], max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Replace each column by its code; a value without one becomes null.

    Whether a column's codes are broadcast is decided by their own number and size.
    """
    sizes = codes.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("size")
    )
    small = {
        row.feature for row in sizes.collect() if row.n <= max_rows and row.size <= BROADCAST_BYTES
    }
    out = df
    for c in cols:
        lookup = codes.where(F.col("feature") == c).select(
            F.col("value").alias("_text"), F.col("code").alias("_code")
        )
        joined = attach_lookup(out.withColumn("_text", _text(c)), lookup, "_text", c in small)
        out = joined.withColumn(c, F.col("_code")).select(*df.columns)
    return out


def encode_categoricals(
    df: DataFrame, cols: Sequence[str] = TRAINING_CATEGORIES
) -> tuple[DataFrame, DataFrame]:
    """The table with codes, and the codes. Names not in the table are skipped."""
    present = [c for c in cols if c in df.columns]
    if not present:
        raise ValueError(f"none of {cols} is in the table")
    codes = category_codes(df, present)
    return apply_codes(df, codes, present), codes


def encode_clinical(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Encode the decoded clinical table; the target stays as it is."""
    return encode_categoricals(df, CLINICAL_CATEGORIES)
