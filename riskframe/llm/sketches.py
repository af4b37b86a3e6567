"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.llm.common import column, names_of, table, whole_text
from riskframe.session import materialize

#: Hashes that a sketch keeps; estimates of resemblance are off by 1/sqrt(SIZE) or less.
SIZE = 128
SHINGLE = 5


def _let(value: Column, then) -> Column:
    """``then`` of ``value``, which is computed once however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def sketch(text: Column, size: int = SIZE, shingle: int = SHINGLE) -> Column:
    """The ``size`` smallest distinct hashes of the shingles of ``text``, ascending.

    Words are runs of anything but white space in the lower-cased text; a
    shingle is ``shingle`` words in a row. A shorter text is one shingle, a text
    without words has an empty sketch, and the sketch of a null is null. A
    sketch with fewer than ``size`` hashes holds all of the text's shingles.
    """
    words = F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        return (
            F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
            .when(F.size(w) < shingle, F.array(F.xxhash64(F.concat_ws(" ", w))))
            .otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.size(w) - shingle),
                    lambda i: F.xxhash64(*[w[i + k] for k in range(shingle)]),
                )
            )
        )

    return F.slice(F.sort_array(F.array_distinct(_let(words, hashes))), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of the shingles of either text that both have, from 0 to 1.

    Exact if both sketches are complete. Two texts without words are alike (1),
    one without words resembles no other (0), and with a null the result is null.
    """
    both = F.sort_array(F.array_union(a, b))
    complete = (F.size(a) < size) & (F.size(b) < size)
    seen = F.when(complete, both).otherwise(F.slice(both, 1, size))
    shared = F.array_intersect(a, b)
    estimate = _let(
        F.struct(seen.alias("seen"), shared.alias("shared")),
        lambda s: F.size(F.array_intersect(s["seen"], s["shared"])) / F.size(s["seen"]),
    )
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(
        (F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)
    ).otherwise(estimate)


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact if the sketch is complete."""
    last = a[size - 1].cast("double")
    part = (last + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise(F.lit(size - 1.0) / part)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of the shingles of the first text that the second has too.

    1 if the first has none.
    """
    alike = resemblance(a, b, size)
    shared = alike / (1 + alike) * (distinct_shingles(a, size) + distinct_shingles(b, size))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), shared / distinct_shingles(a, size))
    )


def as_text(a: Column) -> Column:
    """The hashes as hexadecimal digits, 16 for each."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def merge_sketches(
    parts: DataFrame, keys: Sequence[str], sketch_col: str = "sketch", size: int = SIZE
) -> DataFrame:
    """One sketch per key of all its parts: that of the parts' texts taken together.

    Shingles over the seam between two parts are in neither. Repeats drop out
    before and in the first shuffle, and each task hands on its ``size``
    smallest hashes of a key at most, so that a key may own any number of
    parts. A key whose parts are all empty or null has no row.
    """
    hashes = parts.select(*names_of(keys), F.explode(column(sketch_col)).alias("_hash")).distinct()
    order = Window.partitionBy(*names_of(keys)).orderBy("_hash")
    smallest = hashes.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= size)
    return smallest.groupBy(*names_of(keys)).agg(
        F.sort_array(F.collect_list("_hash")).alias(sketch_col)
    )


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id): each id and the next lower one; the first follows the last.

    ``ids`` has one row per ``doc_id`` and none that is null; other columns stay.
    The ids are sorted over all partitions; neighbours meet inside a partition,
    and only one row per partition is needed to tie the partitions together.
    """
    placed = materialize(
        ids.repartitionByRange(F.col("doc_id").desc()).withColumn("_part", F.spark_partition_id()),
        "order",
    )
    inside = Window.partitionBy("_part").orderBy(F.col("doc_id").desc())
    heads = placed.groupBy("_part").agg(F.max("doc_id").alias("_head"))
    first = heads.agg(F.max("_head")).scalar()
    parts = Window.orderBy("_part")
    follows = heads.select(
        F.col("_part").alias("_from"),
        F.coalesce(F.lead("_head").over(parts), first).alias("_over"),
    )
    return (
        placed.withColumn("_next", F.lead("doc_id").over(inside))
        .join(follows, F.col("_part") == F.col("_from"))
        .select(*ids.columns, F.coalesce("_next", "_over").alias("next_id"))
    )


def neighbour_edits(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    shingle: int = SHINGLE,
) -> DataFrame:
    """Each text beside one whose end comes from the next document.

    Columns doc_id, text, edited, next_sketch. The last third of the code points
    (rounded down) is replaced by as many from the start of the next document in
    descending order of ids, or by all it has. After the last comes the first.

    A null text is empty. If an id repeats, its rows keep their own texts, share
    the next document, and the smallest of the texts stands as the next document
    of others. Rows without an id stand outside the order; the first document
    follows them. Each text is shuffled once, and the start of it that the
    document before needs once more.
    """
    rows = docs.select(
        column(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")
    )
    named = rows.where("doc_id is not null")
    need = named.groupBy("doc_id").agg(F.floor(F.max(F.char_length("text")) / 3).alias("need"))
    order = materialize(next_ids(need), "next").withColumnRenamed("doc_id", "_for")
    # Both sides of the last join, and the smallest text of an id, use one shuffle by id.
    placed = named.repartition("doc_id")
    ahead = placed.groupBy("doc_id").agg(F.min("text").alias("ahead"))
    ahead = ahead.join(order, F.col("doc_id") == F.col("next_id")).select(
        "_for",
        F.substring("ahead", F.lit(1), F.col("need").cast("int")).alias("start"),
        sketch(F.col("ahead"), size, shingle).alias("next_sketch"),
    )
    paired = placed.join(ahead, F.col("doc_id") == F.col("_for"))
    pairs = paired.select("doc_id", "text", "start", "next_sketch")
    strays = rows.where("doc_id is null")
    if not strays.select("doc_id").isEmpty():
        first = named.agg(F.min_by("text", F.struct(-F.col("doc_id"), "text"))).scalar()
        strays = strays.withColumn("start", F.coalesce(first, F.lit("")))
        pairs = pairs.union(strays.withColumn("next_sketch", sketch(F.col("start"), size, shingle)))
    third = F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.char_length("text") - third),
        F.substring("start", F.lit(1), third),
    )
    return pairs.select("doc_id", "text", edited.alias("edited"), "next_sketch")


def op9_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest, with estimates of containment and of distinct shingles."""
    rows = neighbour_edits(table(spark, sf_dir, "documents")).withColumns(
        {"own": sketch(F.col("text")), "changed": sketch(F.col("edited"))}
    )
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed")).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("own"), F.col("changed")).alias("kept_in_edited"),
        distinct_shingles(F.col("own")).alias("n_shingles"),
    )
