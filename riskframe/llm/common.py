"""What several operators share: scratch tables, whole texts, links and components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.session import materialize

#: Lower-cases A-Z in UTF-8 bytes and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of exactly this name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_text(name: str = "text") -> Column:
    """The whole text; a null counts as empty."""
    return F.coalesce(column(name).cast("string"), F.lit(""))


def crc_of_id(id_col: str = "doc_id") -> Column:
    """CRC-32 of the id written out, as the folds use it; a null id counts as empty text."""
    return F.crc32(F.coalesce(column(id_col).cast("string"), F.lit("")))


def ceil_div(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node that each node reaches: rows (node, component).

    ``edges`` holds ``a`` and ``b`` of one ordered type, in either direction;
    repeats and loops do no harm, and nulls take no part. Large and small stars
    alternate: a node's larger neighbours are tied to its smallest neighbour,
    then its smaller ones are, until nothing changes; a chain of n nodes takes
    about log n rounds. Each round is written to the shared folder, so that a
    lost executor costs one round at most. Nothing but a row count and a
    checksum reaches the driver.
    """
    tied = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    tied = materialize(tied, "edges")
    before = _state(tied)
    while before[0]:
        both = tied.union(tied.select("b", "a"))
        low = both.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("low"))
        low = low.select("hub", F.least("hub", "low").alias("low"))
        large = (
            both.join(low, both["a"] == low["hub"])
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .where("a <> b")
            .distinct()
        )
        large = materialize(large, "edges")
        low = large.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("low"))
        small = (
            large.join(low, large["a"] == low["hub"])
            .where("b <> low")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(low.select("hub", "low"))
            .distinct()
        )
        tied = materialize(small, "edges")
        after = _state(tied)
        if after == before:
            break
        before = after
    return tied.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
        tied.select("b", "b").distinct()
    )


def _state(edges: DataFrame) -> tuple:
    """Row count and checksum, by which two rounds are compared."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
    )


def attach(rows: DataFrame, few: DataFrame, key: str, most_bytes: int = 8 << 20) -> DataFrame:
    """``rows`` with the columns of ``few``, which has one row per ``key``; nulls match.

    ``few`` is materialized already. It goes to every executor if its measured
    size is within ``most_bytes``; beyond that rows of a key are spread over 16
    parts, and ``few`` is copied to each.
    """
    renamed = few.withColumnRenamed(key, "_key")
    size = few.agg(
        F.sum(F.coalesce(F.octet_length(column(key).cast("string")), F.lit(0)) + 64)
    ).first()[0]
    same = column(key).eqNullSafe(F.col("_key"))
    if (size or 0) <= most_bytes:
        return rows.join(F.broadcast(renamed), same).drop("_key")
    part = F.pmod(F.xxhash64(*names_of(rows.columns)), F.lit(16))
    copies = renamed.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return (
        rows.withColumn("_part", part)
        .join(copies, same & (F.col("_part") == F.col("_copy")))
        .drop("_key", "_part", "_copy")
    )


def running_offsets(
    counts: DataFrame, keys: Sequence[str], place: str, numbers: Sequence[str], run: int = 1_024
) -> DataFrame:
    """``counts`` with ``<number>_before``: the sum over lower ``place`` of the same keys.

    ``place`` is a whole number from 0, once per key. Sums of ``run`` places are
    added up first, so no task sees more than that many rows of a key, or one in
    ``run``.
    """
    own = names_of(keys)
    coarse = counts.withColumn("_run", F.floor(column(place) / run))
    sums = coarse.groupBy(*own, "_run").agg(*[F.sum(n).alias(f"_{n}") for n in numbers])
    before = Window.partitionBy(*own).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[column(k).alias(f"_{k}") for k in keys],
        F.col("_run").alias("_of"),
        *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in numbers],
    )
    match = F.col("_run") == F.col("_of")
    for k in keys:
        match = match & column(k).eqNullSafe(column(f"_{k}"))
    inside = Window.partitionBy(*own, "_run").orderBy(column(place))
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    within = coarse.withColumns(
        {f"_in_{n}": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in numbers}
    )
    return within.join(sums, match).select(
        *names_of(counts.columns),
        *[(F.col(f"_{n}") + F.col(f"_in_{n}")).alias(f"{n}_before") for n in numbers],
    )


#: Rows that may share a hash before they are told apart.
MOST_ALIKE = 1_024


def told_apart(rows: DataFrame, lot: str, number: str, most: int = MOST_ALIKE) -> DataFrame:
    """``rows`` with another ``lot`` for each of those that share one with more than ``most``.

    ``rows`` are stored, and ``number`` differs from row to row. Rows are put in order
    by ranges of their lots: equal rows, which share one, would all fall into one range.
    All others keep theirs, which follows from the row alone.
    """
    counts = rows.groupBy(F.col(lot).alias("_lot")).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialize(counts.where(F.col("_n") > most).select("_lot"), "alike")
    other = F.when(F.col("_lot").isNull(), F.col(lot)).otherwise(F.xxhash64(lot, number))
    names = [column(c) for c in rows.columns if c not in (lot, number)]
    met = rows.join(hot, F.col(lot) == F.col("_lot"), "left")
    return met.select(*names, other.alias(lot))


def equal_part(value: Column, parts: int) -> Column:
    """Which of ``parts`` equal ranges a number from 0 to 1 lies in."""
    return F.least(F.floor(value * parts), F.lit(parts - 1)).cast("long")


def spread(lot: Column) -> Column:
    """A 64-bit hash as a number from 0 to 1, in the same order."""
    return (lot.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)


def names_of(columns: Sequence[str]) -> list[Column]:
    return [column(c) for c in columns]
