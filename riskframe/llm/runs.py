"""Periodic runs of words, found as maximal pairs."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import column, table, whole_text

#: Words that a run has at least.
LEAST = 12
#: Words of all the texts that are looked through together; a longer text comes alone.
TOGETHER = 200_000

Run = tuple[int, int, int]


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that depend on all bits of ``x`` (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _repeated(ids: np.ndarray, size: int) -> np.ndarray:
    """Places where ``size`` words stand whose hash is found twice or more."""
    number = len(ids) - size + 1
    if number < 2:
        return np.zeros(0, dtype=np.int64)
    mixed = _mixed((ids + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sums = np.zeros(number, dtype=np.uint64)
    for k in range(size):
        sums = sums * np.uint64(0x9E3779B97F4A7C15) + mixed[k : k + number]
    sums = _mixed(sums)
    order = np.argsort(sums)
    same = sums[order[1:]] == sums[order[:-1]]
    found = np.zeros(number, dtype=bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return np.flatnonzero(found)


def sorted_suffixes(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the suffixes that begin there, and the words each shares with the
    one before it (0 if fewer than ``size``).

    Places whose next ``size`` words are found once are left out, but for those
    that follow on a stretch found twice: they are needed to order others. Ranks
    are doubled in length until all differ.
    """
    first = _repeated(ids, size)
    places = np.union1d(first, first + size)
    places = places[places < len(ids)]
    padded = np.concatenate([ids, np.full(size + 1, -1, dtype=ids.dtype)])
    slot = np.full(len(ids) + size + 1, -1, dtype=np.int64)
    slot[places] = np.arange(len(places))

    def ranks(order: np.ndarray, differs: np.ndarray) -> np.ndarray:
        """Rank of each slot: where its group of equals begins in ``order``."""
        begins = np.concatenate([[0], np.flatnonzero(differs) + 1])
        out = np.empty(len(order), dtype=np.int64)
        out[order] = np.repeat(begins, np.diff(np.append(begins, len(order))))
        return out

    if not len(places):
        return places, places
    order = np.lexsort([padded[places + k] for k in reversed(range(size))])
    differs = np.zeros(len(order) - 1, dtype=bool)
    for k in range(size):
        words = padded[places[order] + k]
        differs |= words[1:] != words[:-1]
    rank, length, levels = ranks(order, differs), size, []
    while not differs.all():
        levels.append((length, rank))
        # Groups of equals only; the rest keep their place.
        tied = np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)
        follow = np.minimum(places[tied] + length, len(ids))
        after = np.where(slot[follow] >= 0, rank[slot[follow]], -1)
        inner = np.lexsort([after, rank[tied]])
        order = order.copy()
        order[rank[tied][inner] + _within(rank[tied][inner])] = tied[inner]
        second = np.full(len(rank), -1, dtype=np.int64)
        second[tied] = after
        differs = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        rank, length = ranks(order, differs), 2 * length
    suffixes = places[order]
    shared = np.zeros(len(order), dtype=np.int64)
    if levels:
        base = levels[0][1][order]
        pairs = np.flatnonzero(base[1:] == base[:-1]) + 1
        a, b = suffixes[pairs - 1].copy(), suffixes[pairs].copy()
        for length, rank in reversed(levels):
            at, bt = slot[np.minimum(a, len(ids))], slot[np.minimum(b, len(ids))]
            equal = (at >= 0) & (bt >= 0)
            equal &= rank[at] == rank[bt]
            a[equal] += length
            b[equal] += length
        equal = np.ones(len(pairs), dtype=bool)
        for _ in range(size - 1):
            equal &= (padded[a] == padded[b]) & (np.maximum(a, b) < len(ids))
            a[equal] += 1
            b[equal] += 1
        shared[pairs] = b - suffixes[pairs]
    return suffixes, shared


def _within(groups: np.ndarray) -> np.ndarray:
    """Place of each element among the equal ones, which stand together."""
    begins = np.concatenate([[0], np.flatnonzero(groups[1:] != groups[:-1]) + 1])
    return np.arange(len(groups)) - np.repeat(begins, np.diff(np.append(begins, len(groups))))


def _joined(
    length: int, one: list[int], two: list[int], left: list[int], least: int, found: dict
) -> list[int]:
    """The occurrences of two children of an interval in one list; maximal pairs go to ``found``.

    A list holds the classes of left words in the order of places: neighbours of
    one class are a stretch, and only where two classes meet can a pair be
    maximal. A pair closer than ``length`` is the run of its distance; if other
    occurrences stand between, its distance is a multiple of the run's period, so
    that neighbours are all that has to be looked at.
    """
    if len(one) < len(two):
        one, two = two, one
    for place in two:
        at = bisect_left(one, place)
        for other in one[max(at - 1, 0) : at + 1]:
            low, high = (other, place) if other < place else (place, other)
            period = high - low
            if period <= length and length + period >= least and left[low] != left[high]:
                run = (low, length + period)
                found[run] = min(period, found.get(run, period))
    for place in two:
        if place > one[-1]:
            one.append(place)
        else:
            one.insert(bisect_left(one, place), place)
    return one


def maximal_pairs(ids: np.ndarray, least: int = LEAST) -> list[Run]:
    """Runs (start, length, period) in a row of whole numbers, in order of start and period.

    A run of period q and length L >= max(``least``, 2q) is the maximal pair of its
    start and the place q further on: they share L - q words, at least as many as
    they are apart. Intervals of suffixes that share a number of words are built
    from the leaves up; where children meet, they differ in the next word, and
    pairs of them that differ in the word before are maximal.
    """
    size = -(-least // 2)
    suffixes, shared = sorted_suffixes(ids, size)
    if not len(suffixes):
        return []
    left = np.concatenate([[-1], ids[:-1]]).tolist()
    found: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, list[int]]] = []
    places, lengths = suffixes.tolist(), np.append(shared[1:], 0).tolist()
    for place, length in zip(places, lengths, strict=True):
        if not stack and not length:
            continue
        node = [place]
        while stack and stack[-1][0] > length:
            inner, occurrences = stack.pop()
            node = _joined(inner, occurrences, node, left, least, found)
        if not length:
            continue
        if stack and stack[-1][0] == length:
            _, occurrences = stack.pop()
            node = _joined(length, occurrences, node, left, least, found)
        stack.append((length, node))
    return sorted((start, length, period) for (start, length), period in found.items())


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[list[Run]]:
    """The runs of each of several lists of words."""
    numbers = defaultdict(count().__next__)
    words = np.array([numbers[w] for text in texts for w in text], dtype=np.int64)
    sizes = np.array([len(text) for text in texts], dtype=np.int64)
    # No word of one text equals one of another.
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])
    found: list[list[Run]] = [[] for _ in texts]
    for start, length, period in maximal_pairs(owner * (len(numbers) + 1) + words, least):
        text = int(owner[start])
        found[text].append((start - int(first[text]), length, period))
    return found


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Words that stand in no run after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(depth).tolist(), strict=False) if d == 0]


def word_runs(
    docs: DataFrame,
    least: int = LEAST,
    id_col: str = "doc_id",
    text_col: str = "text",
    edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` and ``collapsed`` of each row.

    Words are what stands between ASCII white space; ``edit``, if given, makes the
    words that are looked at from the id and the words of the text. ``runs`` has
    (start, length, period) of every stretch of ``least`` words or more, and of two
    periods or more, that no neighbouring word extends, in order of start and
    period. ``collapsed`` are the words that stand in no run after its first
    period, joined by one space.

    Texts are looked at one by one, each whole, in time that grows with its words
    and the words that repeat; nothing is shuffled. A null or empty text has no
    words and no runs. Repeated rows each get a row; other columns are left behind.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            ids = batch.column(0).to_pylist()
            start, held, size = 0, [], 0
            for row, doc_id in enumerate(ids):
                words = texts[row].as_py().split()
                held.append(edit(doc_id, words) if edit else words)
                size += len(held[-1])
                if size >= TOGETHER or row + 1 == len(ids):
                    yield answer(batch.column(0).slice(start, len(held)), held)
                    start, held, size = row + 1, [], 0

    def answer(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(texts, least)
        kept = [b" ".join(collapsed(w, r)) for w, r in zip(texts, found, strict=True)]
        triples = [[dict(zip(_NAMES, run, strict=True)) for run in runs] for runs in found]
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([len(w) for w in texts], pa.int64()),
                pa.array(triples, pa.list_(_RUN)),
                pa.array(kept, pa.binary()),
            ],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )

    given = docs.select(column(id_col).cast("long").alias("doc_id"), whole_text(text_col))
    schema = (
        "doc_id long, n_words long, "
        "runs array<struct<start: long, length: long, period: long>>, collapsed binary"
    )
    return given.mapInArrow(rows, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


_NAMES = ("start", "length", "period")
_RUN = pa.struct([(name, pa.int64()) for name in _NAMES])


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's edit: the words of one document in ten repeat from some word on.

    A null id counts as empty text.
    """
    lot = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    number = len(words)
    if lot % 10 or not number:
        return words
    g = lot // 10
    a = g % number
    p = 1 + (number - a) // (3 + g % 8)
    cycle = words[a : a + p]
    rest = number - a
    return words[:a] + (cycle * (rest // p + 1))[:rest]


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: number of runs, the longest one, and hashes of runs and text."""
    found = word_runs(table(spark, sf_dir, "documents"), edit=planted)
    order = F.transform(
        "runs",
        lambda r: F.struct(
            (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")
        ),
    )
    longest = F.array_min(order)
    lines = F.transform(
        "runs",
        lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")),
    )
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        longest["start"].alias("start"),
        (-longest["less"]).alias("length"),
        longest["period"].alias("period"),
        F.floor(-1000 * longest["less"] / longest["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
