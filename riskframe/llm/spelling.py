"""Spelling variants of words, found through Bloom filters and an exact join."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import LOWER, ceil_div, column, table, whole_text
from riskframe.session import materialize

#: Letters of a word: a-z, and U+00C0 to U+00FF.
LETTERS = (*range(0x61, 0x7B), *range(0xC0, 0x100))
#: Words of this length or more share a shard of the filter.
LONGEST_SHARD = 32
#: Bits of a block (eight lanes of 64), bits per word, and blocks that are broadcast at once: 16 MB.
LANES = 8
BITS_PER_WORD = 12
SLICE_BLOCKS = 1 << 18
#: Words that a task counts before it hands its counts on, and edits that it holds at once.
HELD_WORDS = 100_000
HELD_EDITS = 1 << 20
#: Words whose edits one task probes, about.
TASK_WORDS = 10_000

_RUNS = re.compile("[a-zÀ-ÿ]+")


def count_words(
    docs: DataFrame,
    least_chars: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    edit: Callable[[int | None, str], str] | None = None,
) -> DataFrame:
    """``word`` and ``n``, how often it stands in all texts, of words of ``least_chars`` or more.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased;
    ``edit``, if given, makes of an id's prefix (CRC-32 of the id and a colon) and
    a run the word that is counted, which is not longer. Words are counted per task
    before anything is shuffled, so that a frequent word is a few rows. A null text has no
    words; repeated rows count as often as they stand there.
    """

    def handed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "n"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for row, doc_id in enumerate(batch.column(0).to_pylist()):
                prefix = zlib.crc32((b"" if doc_id is None else str(doc_id).encode()) + b":")
                text = texts[row].as_py().translate(LOWER).decode("utf-8", "replace")
                for run, n in Counter(_RUNS.findall(text)).items():
                    if len(run) < least_chars:
                        continue
                    if edit:
                        run = edit(prefix, run)
                        if len(run) < least_chars:
                            continue
                    counts[run] += n
                if len(counts) >= HELD_WORDS:
                    yield handed(counts)
                    counts = Counter()
        yield handed(counts)

    given = docs.select(column(id_col).cast("long").alias("doc_id"), whole_text(text_col))
    counted = given.mapInArrow(rows, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that depend on all bits of ``x`` (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _placed(letters: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number of 64 bits for each letter at its place."""
    both = (places.astype(np.uint64) << np.uint64(21)) | letters.astype(np.uint64)
    return _mixed((both + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _matrix(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    joined = "".join(words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, dtype="<u4").reshape(len(words), -1)


def hashes(words: np.ndarray) -> np.ndarray:
    """A word's hash: the sum of the numbers of its letters at their places."""
    return _placed(words, np.arange(words.shape[1])).sum(axis=1, dtype=np.uint64)


def edits(words: np.ndarray, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row, hash) of each word with one letter deleted, and with one letter replaced
    by a later one, row by row of ``words``.

    A pair of words a letter apart is met once: from the longer word, or from the
    one whose letter comes first. No text is built: a hash follows from the word's
    own. Of equal neighbouring letters only the last is deleted.
    """
    number, length = words.shape
    here = _placed(words, np.arange(length))
    back = np.zeros_like(here)
    back[:, 1:] = _placed(words[:, 1:], np.arange(length - 1))
    before = np.cumsum(here, axis=1, dtype=np.uint64) - here
    after = back[:, ::-1].cumsum(axis=1, dtype=np.uint64)[:, ::-1] - back
    lasts = np.ones(words.shape, dtype=bool)
    lasts[:, :-1] = words[:, 1:] != words[:, :-1]
    row, place = np.nonzero(lasts)
    yield length - 1, row, (before + after)[row, place]
    own = here.sum(axis=1, dtype=np.uint64)
    for place in range(length):
        put = _placed(letters, np.full(len(letters), place))
        later = letters[None, :] > words[:, place, None]
        row, letter = np.nonzero(later)
        yield length, row, own[row] - here[row, place] + put[letter]


def _shard(length: int) -> int:
    return min(length, LONGEST_SHARD)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the list, code points) of words of the same length, a bounded number at once."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    for length in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == length)
        step = max(1, HELD_EDITS // (max(length, 1) * len(LETTERS)))
        for start in range(0, len(places), step):
            part = places[start : start + step]
            if length:
                yield part, _matrix([words[i] for i in part.tolist()])


def hashed_words(vocabulary: DataFrame) -> DataFrame:
    """``vocabulary`` (word, n) with ``shard``, by length, and ``hash``; empty words go."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            found = np.zeros(len(words), dtype=np.uint64)
            for places, matrix in _by_length(words):
                found[places] = hashes(matrix)
            shards = [_shard(len(w)) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(shards, pa.int32()),
                 pa.array(found.view(np.int64)), pa.array(_mixed(found).view(np.int64))],
                names=["word", "n", "shard", "hash", "bits"],
            )

    words = vocabulary.select("word", F.col("n").cast("long").alias("n")).where("word <> ''")
    return words.mapInArrow(rows, "word string, n long, shard int, hash long, bits long")


def _filter_slice(words: DataFrame, blocks: dict[int, int], first: int) -> np.ndarray:
    """The filter's blocks from ``first`` on, ``SLICE_BLOCKS`` at most, as (blocks, lanes)."""
    offset, own, where = 0, F.lit(None).cast("long"), F.lit(None).cast("long")
    for shard, number in sorted(blocks.items()):
        own = F.when(F.col("shard") == shard, F.lit(number).cast("long")).otherwise(own)
        where = F.when(F.col("shard") == shard, F.lit(offset).cast("long")).otherwise(where)
        offset += number
    size = min(SLICE_BLOCKS, offset - first)
    block = where + F.shiftright(F.shiftrightunsigned("hash", 32) * own, 32) - F.lit(first)
    placed = words.withColumn("block", block).where(F.col("block").between(0, size - 1))
    lanes = [
        F.bit_or(
            F.expr(f"shiftleft(1L, cast(shiftrightunsigned(bits, {6 * i}) & 63L as int))")
        ).alias(f"lane{i}")
        for i in range(LANES)
    ]
    found = placed.groupBy("block").agg(*lanes).toArrow()
    table = np.zeros((size, LANES), dtype=np.uint64)
    at = found.column("block").to_numpy()
    for i in range(LANES):
        table[at, i] = found.column(f"lane{i}").to_numpy().view(np.uint64)
    return table


def _in_filter(
    found: np.ndarray, number: int, offset: int, first: int, table: np.ndarray
) -> np.ndarray:
    """Which hashes the slice from block ``first`` on may hold, of a shard of ``number`` blocks."""
    block = ((found >> np.uint64(32)) * np.uint64(number)) >> np.uint64(32)
    block = block.astype(np.int64) + (offset - first)
    inside = np.flatnonzero((block >= 0) & (block < len(table)))
    block, bits = block[inside], _mixed(found[inside])
    for lane in range(LANES):
        bit = (bits >> np.uint64(6 * lane)) & np.uint64(63)
        hit = (table[block, lane] >> bit) & np.uint64(1) == 1
        inside, block, bits = inside[hit], block[hit], bits[hit]
    return inside


def near_words(words: DataFrame, letters: tuple[int, ...] = LETTERS) -> DataFrame:
    """Pairs of words that differ by one inserted, deleted or replaced code point.

    ``words`` are ``hashed_words``, stored, each word once, over ``letters``. Rows
    (a, a_n, b, b_n), each pair once.

    A blocked Bloom filter holds all words, shard by shard of their length. Each
    word's edits are probed against the shard of the edit's length; those that the
    filter may hold are shuffled by hash to the words themselves and compared letter
    by letter, so no false positive is left and no pair is lost.
    The filter is broadcast in slices of 16 MB at most, one after another, however
    many words there are; a slice is a range of blocks.
    """
    spark = words.sparkSession
    sizes = {r["shard"]: r["count"] for r in words.groupBy("shard").count().collect()}
    blocks = {s: ceil_div(n * BITS_PER_WORD, 64 * LANES) for s, n in sizes.items()}
    offsets, total = {}, 0
    for shard, number in sorted(blocks.items()):
        offsets[shard] = total
        total += number
    alphabet = np.array(sorted(letters), dtype=np.uint32)
    tasks, asked = ceil_div(sum(sizes.values()), TASK_WORDS), []
    for first in range(0, total, SLICE_BLOCKS):
        part = spark.sparkContext.broadcast(_filter_slice(words, blocks, first))

        def probe(
            batches: Iterator[pa.RecordBatch], first: int = first, part=part
        ) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(0).to_pylist()
                for places, matrix in _by_length(own):
                    for length, row, found in edits(matrix, alphabet):
                        shard = _shard(length)
                        if shard not in blocks:
                            continue
                        hit = _in_filter(
                            found, blocks[shard], offsets[shard], first, part.value
                        )
                        if len(hit):
                            of = pa.array(places[row[hit]])
                            yield pa.RecordBatch.from_arrays(
                                [batch.column(0).take(of), batch.column(1).take(of),
                                 pa.array(found[hit].view(np.int64))],
                                names=["a", "a_n", "edited"],
                            )

        # Words are far fewer than texts, and their edits far more.
        spread = words.select("word", "n").repartition(tasks, "word")
        positives = spread.mapInArrow(probe, "a string, a_n long, edited long")
        asked.append(materialize(positives, "positives"))
    if not asked:
        return words.select(
            F.col("word").alias("a"), F.col("n").alias("a_n"),
            F.col("word").alias("b"), F.col("n").alias("b_n"),
        )
    positives = asked[0]
    for more in asked[1:]:
        positives = positives.union(more)
    exact = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), "hash")
    return positives.join(exact, F.col("edited") == F.col("hash")).where(
        F.levenshtein("a", "b", 1) == 1
    ).select("a", "a_n", "b", "b_n")


def variants(vocabulary: DataFrame, ratio: int = 2, letters: tuple[int, ...] = LETTERS) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of each word.

    ``vocabulary`` has ``word``, each once, over ``letters`` (code points), and
    ``n``. Two words are near if they differ by one code point inserted, deleted or
    replaced. ``form`` is the near word of largest n, of those the first in
    code-point order, if its n (``form_n``) is ``ratio`` times the word's own or
    more; else it is null. ``root`` is where the forms lead in the end, the word
    itself if it has none. ``n_near`` counts near words.

    A word has no more near words than edits, and a chain of forms no more than 63
    steps with a ratio of 2; roots are found by doubling steps. Null and empty words
    are left out; an empty vocabulary gives no rows.
    """
    words = materialize(hashed_words(vocabulary), "words")
    pairs = materialize(near_words(words, letters), "pairs")
    ways = pairs.select("a", "a_n", "b", "b_n").union(pairs.select("b", "b_n", "a", "a_n"))
    found = ways.groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.first("a_n").alias("own_n"),
        F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"),
    )
    enough = -F.col("best.less") >= F.lit(ratio) * F.col("own_n")
    found = materialize(
        found.select(
            F.col("a").alias("of"),
            "n_near",
            F.when(enough, F.col("best.form")).alias("form"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = materialize(
        found.where("form is not null").select("of", F.col("form").alias("root")), "roots"
    )
    while True:
        step = roots.select(F.col("of").alias("_of"), F.col("root").alias("_root"))
        further = roots.join(step, F.col("root") == F.col("_of"), "left").select(
            "of", F.coalesce("_root", "root").alias("root"), F.col("_of").isNotNull().alias("moved")
        )
        further = materialize(further, "roots")
        if further.where("moved").isEmpty():
            break
        roots = further.select("of", "root")
    ends = roots.select(F.col("of").alias("_end_of"), "root")
    return (
        words.select("word", "n")
        .join(found, F.col("word") == F.col("of"), "left")
        .join(ends, F.col("word") == F.col("_end_of"), "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            "form_n",
        )
    )


def planted(prefix: int, run: str) -> str:
    """The contract's edit: of one run in 97 of a document a code point is deleted."""
    lot = zlib.crc32(run.encode(), prefix)
    if lot % 97:
        return run
    place = lot % len(run)
    return run[:place] + run[place + 1 :]


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's words, of five code points or more and found three times or more."""
    counted = count_words(table(spark, sf_dir, "documents"), edit=planted)
    return variants(counted.where("n >= 3"))
