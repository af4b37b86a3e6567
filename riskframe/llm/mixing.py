"""Mixing sources to target weights by temperature."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.llm.common import (
    attach,
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

#: Rows of a block, about.
BLOCK_ROWS = 4_096
#: Exponents that one pass over the sources tries.
TRIES = 64


def _curve(sources: DataFrame, exponents: Sequence[float]) -> list[tuple[float, float, float]]:
    """(exponent, entropy, most passes) at each exponent, in one pass over the sources.

    Passes are counted against the source that is seen least, which is seen once.
    """
    tried = sources.select("share", F.explode(F.array(*map(F.lit, exponents))).alias("exponent"))
    power = F.pow("share", F.col("exponent"))
    gain = F.pow("share", F.col("exponent") - 1)
    sums = tried.groupBy("exponent").agg(
        F.sum(power).alias("z"),
        F.sum(power * F.log("share")).alias("e"),
        (F.max(gain) / F.min(gain)).alias("passes"),
    )
    return [
        (r["exponent"], math.log(r["z"]) - r["exponent"] * r["e"] / r["z"], r["passes"])
        for r in sums.orderBy("exponent").collect()
    ]


def exponent_for(
    sources: DataFrame,
    entropy: float | None = None,
    most_passes: float | None = None,
    precision: float = 1e-9,
) -> float:
    """The exponent from 0 (all sources alike) to 1 (as they come).

    ``sources`` has a positive ``share`` per source. Both entropy and passes fall
    as the exponent grows. With ``most_passes`` the smallest exponent that keeps
    to it is a lower bound; with ``entropy`` (in nats) the largest exponent that
    reaches it is taken, or that bound if it is higher. An entropy beyond that of
    equal weights gives 0, one below that of the shares 1. Without either it is 1.

    The interval is cut into 64 at a time, as each step is one Spark job; only
    as many rows as exponents reach the driver, however many sources there are.
    """

    def edge(holds, lower_side: bool) -> float:
        """Where ``holds`` changes, on the side that holds; it holds at 0 or at 1."""
        low, high = 0.0, 1.0
        while high - low > precision:
            step = (high - low) / TRIES
            curve = _curve(sources, [low + step * i for i in range(TRIES + 1)])
            kept = [point[0] for point in curve if holds(point)]
            if not kept:
                return 0.0 if lower_side else 1.0
            if lower_side:
                low, high = kept[-1], min(high, kept[-1] + step)
            else:
                low, high = max(low, kept[0] - step), kept[0]
        return low if lower_side else high

    least = 0.0
    if most_passes is not None:
        least = edge(lambda p: p[2] <= most_passes * (1 + 1e-12), lower_side=False)
    if entropy is None:
        return least if most_passes is not None else 1.0
    return max(least, edge(lambda p: p[1] >= entropy, lower_side=True))


def mix(
    docs: DataFrame,
    entropy: float | None = None,
    most_passes: float | None = 2.0,
    budget: float | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: int = 17,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows in the proportions that a temperature gives their sources.

    A source's share is its part of all tokens (words, and one end for each
    document). Its weight is share ** exponent, normalised, with the exponent
    that ``exponent_for`` finds. ``budget`` is the number of tokens of the
    mixture; by default it is as large as it takes for every document to be seen
    once, so that weights are met by repeating documents of small sources, and
    nothing is left out.

    Weight times budget over its tokens is how often a source is passed. In each
    pass its documents stand in blocks of about ``block_rows``, a new
    permutation each time: a document's block and its place there follow from a
    hash of pass and document. The last pass is cut where the budget is used up:
    it takes the documents, in that order, that fit in whole.

    Columns doc_id, source, tokens, weight, pass, block, place (in the pass, from
    0) and ``fraction`` (place in the whole mixture, from 0 to 1: sorted by it the
    sources are evenly interleaved). Texts are read once, to count their tokens.

    A null source is a source of its own; null texts are empty. Repeated rows
    are rows like any other, and are spread over blocks like others. An empty table stays empty.
    """
    text = whole_text(text_col)
    rows = docs.select(
        column(id_col).alias("doc_id"),
        column(source_col).cast("string").alias("source"),
        (F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")) + 1).cast("long").alias("tokens"),
        F.xxhash64(F.lit(seed), column(id_col), F.crc32(text)).alias("lot"),
    )
    numbered = rows.withColumn("number", F.monotonically_increasing_id())
    rows = told_apart(materialize(numbered, "tokens"), "lot", "number", block_rows // 4)
    sums = rows.groupBy("source").agg(
        F.sum("tokens").alias("of_tokens"), F.count(F.lit(1)).alias("of_rows")
    )
    sums = materialize(sums, "sources")
    all_tokens, all_rows = sums.agg(F.sum("of_tokens"), F.sum("of_rows")).first()
    sources = sums.withColumn("share", F.col("of_tokens") / F.lit(float(all_tokens or 1)))
    if all_rows:
        exponent = exponent_for(sources, entropy, most_passes)
        raw = sources.withColumn("power", F.pow("share", F.lit(exponent)))
        total, once = raw.agg(
            F.sum("power"), F.max(F.col("of_tokens") / F.col("power"))
        ).first()
        budget = once * total if budget is None else budget
    else:
        raw, total, budget = sources.withColumn("power", F.lit(1.0)), 1.0, 0.0
    # Rounding must not cut the last document of a pass that is meant to be whole.
    passes = F.col("power") / total * budget / F.col("of_tokens") + 1e-9
    plan = materialize(
        raw.select("source", "of_tokens", (F.col("power") / total).alias("weight"),
                   passes.alias("passes")),
        "plan",
    )
    dealt = attach(rows, plan, "source").withColumn(
        "pass", F.explode(F.sequence(F.lit(0), F.floor("passes").cast("int")))
    )
    parts = ceil_div(all_rows or 0, block_rows)
    dealt = dealt.withColumn("order", F.xxhash64("lot", "pass"))
    dealt = dealt.withColumn("block", equal_part(spread(F.col("order")), parts))
    counts = dealt.groupBy("source", "pass", "block").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("sums")
    )
    offsets = running_offsets(counts, ["source", "pass"], "block", ["rows", "sums"]).select(
        F.col("source").alias("_source"), F.col("pass").alias("_pass"),
        F.col("block").alias("_block"), "rows_before", "sums_before",
    )
    inside = Window.partitionBy("source", "pass", "block").orderBy("order", "doc_id", "tokens")
    placed = dealt.withColumns(
        {
            "within": F.row_number().over(inside) - 1,
            "used": F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).join(
        offsets,
        F.col("source").eqNullSafe(F.col("_source"))
        & (F.col("pass") == F.col("_pass"))
        & (F.col("block") == F.col("_block")),
    )
    passed = F.col("pass") + (F.col("sums_before") + F.col("used")) / F.col("of_tokens")
    return placed.where(passed <= F.col("passes")).select(
        "doc_id", "source", "tokens", "weight", "pass", "block",
        (F.col("rows_before") + F.col("within")).alias("place"),
        ((passed - 0.5 * F.col("tokens") / F.col("of_tokens")) / F.col("passes")).alias("fraction"),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """Whole rows of ``docs`` in the order of the mixture, as often as they are passed.

    Rows are told apart by a number that is stored with them once: how a table is
    cut into partitions may change from job to job. Texts are shuffled once to meet
    their places in the mixture, and once into order.
    """
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    numbered = materialize(rows, "numbered")
    places = mix(numbered, id_col="_row", **options).select(
        F.col("doc_id").alias("_of"), F.col("fraction").alias("_fraction")
    )
    return (
        numbered.join(places, F.col("_row") == F.col("_of"))
        .repartitionByRange("_fraction", "_row")
        .sortWithinPartitions("_fraction", "_row")
        .select(*names_of(docs.columns))
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed so that no source is passed more than twice."""
    return mix(table(spark, sf_dir, "documents"))
