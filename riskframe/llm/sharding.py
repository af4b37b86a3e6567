"""Shards that all match the mixture of sources, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.llm.common import (
    ceil_div,
    column,
    equal_part,
    names_of,
    running_offsets,
    spread,
    table,
    told_apart,
    whole_text,
)
from riskframe.session import materialize

#: Rows that are put in order by one task at a time, about.
RUN_ROWS = 4_096


def interleave(
    docs: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    keep: Sequence[str] = (),
    seed: int = 7,
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Rows dealt to shards in proportion: every shard holds the same mixture of sources.

    The rows of a source are put in a seeded random order; row r of n gets the
    fractional rank (r - 1/2) / n. Sorted by that rank all sources are evenly
    interleaved, and the sorted rows are cut into ``shards`` runs whose lengths
    differ by one row at most. Inside a shard the same holds of any part of it.

    Columns doc_id, source, size (bytes of the text in UTF-8, plus 1), text_crc32,
    fraction, shard from 0, slot (place in the shard, gapless from 0), and ``kept``, a
    struct of the ``keep`` columns, if any are named.

    A null source is a source of its own, a null text is empty, and a null id is
    an id like any other. Repeated rows each get a place; rows that are equal in
    id, source and text are interchangeable, and are spread like others. With fewer rows than shards some
    shards stay empty.

    Neither sort is a window over a source or the table: random numbers (and
    fractional ranks) are spread evenly, so equal ranges of them hold about
    ``run_rows`` rows each, and running sums of the ranges' counts place them.
    """
    text = whole_text(text_col)
    rows = docs.select(
        column(id_col).alias("doc_id"),
        column(source_col).cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        *([F.struct(*names_of(keep)).alias("kept")] if keep else []),
    )
    lot = F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")
    numbered = rows.withColumns({"lot": lot, "number": F.monotonically_increasing_id()})
    rows = told_apart(materialize(numbered, "rows"), "lot", "number")
    total = rows.count()
    parts = ceil_div(total, run_rows)

    rows = rows.withColumn("run", equal_part(spread(F.col("lot")), parts))
    counts = rows.groupBy("source", "run").agg(F.count(F.lit(1)).alias("rows"))
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("of"))
    offsets = running_offsets(counts, ["source"], "run", ["rows"])
    offsets = (
        offsets.join(
            sizes.withColumnRenamed("source", "_source"),
            F.col("source").eqNullSafe(F.col("_source")),
        )
        .select(
            F.col("source").alias("_source"), F.col("run").alias("_run"), "rows_before", "of"
        )
    )
    inside = Window.partitionBy("source", "run").orderBy("lot", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("place", F.row_number().over(inside)).join(
        offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("run") == F.col("_run"))
    )
    names = [n for n in rows.columns if n != "run"]
    ranked = ranked.select(
        *names, ((F.col("rows_before") + F.col("place") - 0.5) / F.col("of")).alias("fraction")
    )
    ranked = materialize(ranked.withColumn("run", equal_part(F.col("fraction"), parts)), "fractions")

    counts = ranked.groupBy("run").agg(F.count(F.lit(1)).alias("rows"))
    offsets = running_offsets(counts, [], "run", ["rows"]).select(
        F.col("run").alias("_run"), "rows_before"
    )
    inside = Window.partitionBy("run").orderBy(
        "fraction", F.xxhash64(F.lit(seed), "source"), "source", "lot", "doc_id", "text_crc32"
    )
    order = F.col("rows_before") + F.row_number().over(inside) - 1
    shard = F.expr(f"order * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards} - 1) div {shards}")
    return (
        ranked.join(offsets, F.col("run") == F.col("_run"))
        .withColumn("order", order)
        .withColumn("shard", shard)
        .withColumn("slot", F.col("order") - first)
        .select(
            "doc_id", "source", "size", "text_crc32", "fraction",
            F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
            *(["kept"] if keep else []),
        )
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, **options) -> None:
    """Write whole rows as Parquet, one folder a shard, each in the order of its slots.

    A shard is cut into files by ranges of slots, so none is written by one task alone.
    """
    dealt = interleave(docs, shards, keep=docs.columns, **options)
    (
        dealt.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .select("shard", "slot", "kept")
        .write.partitionBy("shard")
        .parquet(path)
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: all documents in 16 shards, by the law of equal counts."""
    dealt = interleave(table(spark, sf_dir, "documents"))
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source", "fraction",
    )
