"""Joins that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A lookup goes to every executor only up to this many rows, and up to this size.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20
# Rows of one hot key that a single task should join.
ROWS_PER_SPLIT = 1_000_000


def row_hash(df: DataFrame) -> Column:
    """Hash of the whole row: the same on every retry of a task."""
    return F.xxhash64(*[F.col(f"`{name}`") for name in df.columns])


def hot_keys(
    rows: DataFrame, key: str, rows_per_split: int = ROWS_PER_SPLIT, count: Column | None = None
) -> DataFrame:
    """Keys with more rows than one task should join, and the number of parts to cut each into.

    There are never more than ``BROADCAST_ROWS`` of them: a part is at least as
    large as all rows over that number, which counts from a hundred billion rows on.
    ``count`` is for sums in which a row stands for as many rows.
    """
    number = F.count(F.lit(1)) if count is None else F.sum(count)
    counts = rows.groupBy(key).agg(number.alias("_n"))
    share = counts.agg(F.ceil(F.sum("_n") / F.lit(BROADCAST_ROWS))).scalar()
    size = F.greatest(F.lit(rows_per_split).cast("long"), F.coalesce(share, F.lit(0).cast("long")))
    sized = counts.withColumn("_size", size).where(F.col("_n") > F.col("_size"))
    return sized.select(
        F.col(key).alias("_hot_key"), F.ceil(F.col("_n") / F.col("_size")).alias("_splits")
    )


def join_on_unique_key(
    rows: DataFrame,
    entities: DataFrame,
    rows_key: str,
    entity_key: str,
    rows_per_split: int = ROWS_PER_SPLIT,
    how: str = "inner",
    nulls_match: bool = False,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join of ``rows`` with the one row per key of ``entities``.

    Rows of a hot key are spread over several parts by their hash, and only
    the hot entities are copied to as many parts. Everything else meets in one
    ordinary shuffled join (or a broadcast one, if AQE finds a side small).
    Rows need a column, such as an id, in which those of one key differ.
    ``hot`` is the outcome of ``hot_keys`` if it is known already; it has a bounded
    number of rows, and is therefore broadcast.
    """

    def same(left: str, right: str) -> Column:
        if nulls_match:
            return F.col(left).eqNullSafe(F.col(right))
        return F.col(left) == F.col(right)

    matched = rows if nulls_match else rows.where(F.col(rows_key).isNotNull())
    hot = F.broadcast(hot_keys(matched, rows_key, rows_per_split) if hot is None else hot)
    spread = rows.join(hot, same(rows_key, "_hot_key"), "left").select(
        *rows.columns,
        F.when(F.col("_splits").isNull(), F.lit(0).cast("long"))
        .otherwise(F.pmod(row_hash(rows), F.col("_splits")))
        .alias("_part"),
    )
    copied = entities.join(hot, same(entity_key, "_hot_key"), "left").select(
        *entities.columns,
        F.explode(
            F.sequence(F.lit(0).cast("long"), F.coalesce("_splits", F.lit(1)) - 1)
        ).alias("_copy"),
    )
    joined = spread.join(
        copied, same(rows_key, entity_key) & (F.col("_part") == F.col("_copy")), how
    )
    return joined.drop("_part", "_copy")


def at_most(df: DataFrame, rows: int, size: int | None = None) -> bool:
    """Size check before a broadcast: rows, and bytes written out as text.

    Stops counting beyond ``rows``.
    """
    written = F.octet_length(F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in df.columns]))
    found = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(written), F.lit(0))).first()
    return found[0] <= rows and found[1] <= (BROADCAST_BYTES if size is None else size)


def attach_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    small: bool,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Left join of per-key values, nulls matching nulls.

    ``small`` is the outcome of a size check, see ``at_most``: then the lookup
    is broadcast. If not, the join splits hot keys.
    """
    values = [name for name in lookup.columns if name != key]
    right = lookup.withColumnRenamed(key, "_lookup_key")
    if small:
        same = F.col(key).eqNullSafe(F.col("_lookup_key"))
        joined = rows.join(F.broadcast(right), same, "left")
    else:
        joined = join_on_unique_key(
            rows, right, key, "_lookup_key", rows_per_split, "left", nulls_match=True
        )
    return joined.select(*rows.columns, *values)
