"""Exact stratified splits and folds."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.joins import BROADCAST_ROWS, at_most, attach_lookup

_BUCKET_DIGITS = 4


def shuffle_key(key: str, seed: int) -> Column:
    """A text whose order is random but the same in every run and engine."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def stratified_parts(
    df: DataFrame, label: str, key: str, shares: Sequence[float], seed: int, name: str = "part"
) -> DataFrame:
    """Cut each class, in shuffled order, into ``len(shares) + 1`` parts.

    Part ``i`` gets ``shares[i]`` of each class, rounded at the cut; the last
    part gets the rest. ``key`` must be unique.

    Two classes make a ranking window two tasks wide. So the rows of a class
    are counted per hash bucket (65,536 of them), the counts are summed up to
    find the bucket of each cut, and only that bucket is ranked. The result is
    one cut key per class and share, to which each row is compared in place.
    """
    at = F.struct(shuffle_key(key, seed).alias("hash"), F.col(key).alias("key"))
    slim = df.select(F.col(label).alias("_class"), at.alias("_at")).withColumn(
        "_bucket", F.substring("_at.hash", 1, _BUCKET_DIGITS)
    )
    counts = slim.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"))

    in_class = Window.partitionBy("_class")
    running = in_class.orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    totals = counts.withColumns(
        {"_upto": F.sum("_n").over(running), "_total": F.sum("_n").over(in_class)}
    )
    wanted = F.array(
        *[F.floor(F.col("_total") * F.lit(s) + 0.5) for s in accumulate(shares)]
    )
    # One row per class and cut.
    cuts = totals.select("*", F.explode(F.array_distinct(wanted)).alias("_rank")).where(
        (F.col("_upto") - F.col("_n") < F.col("_rank")) & (F.col("_rank") <= F.col("_upto"))
    ).select(
        F.col("_class").alias("_cut_class"),
        F.col("_bucket").alias("_cut_bucket"),
        (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_left"),
        "_rank",
        wanted.alias("_wanted"),
    )
    # Buckets are even, so this join stays balanced even without the broadcast.
    few_classes = at_most(df.select(label).distinct(), BROADCAST_ROWS)
    if few_classes:
        cuts = F.broadcast(cuts)
    in_bucket = Window.partitionBy("_class", "_bucket", "_rank").orderBy("_at")
    cut_keys = (
        slim.join(
            cuts,
            F.col("_class").eqNullSafe(F.col("_cut_class"))
            & (F.col("_bucket") == F.col("_cut_bucket")),
        )
        .withColumn("_place", F.row_number().over(in_bucket))
        .where(F.col("_place") == F.col("_left"))
        # A share of zero rows repeats no cut; a share equal to the one before does.
        .withColumn("_times", F.size(F.filter("_wanted", lambda r: r == F.col("_rank"))))
        .groupBy("_class")
        .agg(
            F.collect_list(F.struct("_at", "_times")).alias("_cuts"),
            F.first(F.size(F.filter("_wanted", lambda r: r == 0))).alias("_empty"),
        )
    )
    found = attach_lookup(
        df.withColumn("_at", at),
        cut_keys.withColumnRenamed("_class", label),
        label,
        few_classes,
    )
    passed = F.aggregate(
        F.coalesce("_cuts", F.array().cast(cut_keys.schema["_cuts"].dataType)),
        F.lit(0),
        lambda total, cut: total + F.when(F.col("_at") > cut["_at"], cut["_times"]).otherwise(0),
    )
    # Without any cut key, all cuts of the class lie before its first row.
    part = passed + F.coalesce("_empty", F.lit(len(shares)))
    return found.select(*df.columns, part.cast("int").alias(name))


def stratified_split(
    df: DataFrame, label: str = "target", fraction: float = 0.2, seed: int = 42, key: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """(train, test), with ``fraction`` of each class in test."""
    parts = stratified_parts(df, label, key, [fraction], seed, "_part")
    return (
        parts.where(F.col("_part") == 1).drop("_part"),
        parts.where(F.col("_part") == 0).drop("_part"),
    )


def assign_folds(
    df: DataFrame, label: str = "target", k: int = 5, seed: int = 42, key: str = "id"
) -> DataFrame:
    """Add ``fold``: 0 to k-1, each with an equal share of every class."""
    return stratified_parts(df, label, key, [1 / k] * (k - 1), seed, "fold")
