"""Contiguous surrogate keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.joins import BROADCAST_ROWS, at_most, attach_lookup
from riskframe.session import materialize

# A running id holds the place in the partition in its low bits.
PLACE = (1 << 33) - 1


#: Partition of a row, and its place there, once they are stored with it.
PLACES = ("_partition", "_place")


def with_places(df: DataFrame) -> DataFrame:
    """Where each row stands. Only what is stored of it stays the same when it is read again."""
    running = F.monotonically_increasing_id()
    places = (F.shiftright(running, 33), running.bitwiseAND(F.lit(PLACE)))
    return df.withColumns(dict(zip(PLACES, places, strict=True)))


def assign_ids(df: DataFrame, name: str = "id", start: int = 1) -> DataFrame:
    """Number the rows ``start, start + 1, …`` in partition order.

    The rows are written out once, each with its partition and its place there;
    these stay the same however the files are split or a task is repeated. Rows that
    were stored ``with_places`` are not written again. Only
    the partitions' sizes are summed up: no row is shuffled and no key can be
    hot. The offsets, one row per partition, are broadcast after a size check.
    """
    placed = set(PLACES) <= set(df.columns)
    stored = df if placed else materialize(with_places(df), "numbered")
    sizes = stored.groupBy("_partition").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        sizes.select("_partition", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")),
        "offsets",
    )
    met = attach_lookup(stored, offsets, "_partition", at_most(offsets, BROADCAST_ROWS))
    return met.select(
        (F.col("_offset") + F.col("_place") + start).cast("long").alias(name),
        *[c for c in df.columns if c not in PLACES],
    )
