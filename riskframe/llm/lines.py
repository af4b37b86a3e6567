"""Lines that many documents share, dropped through sorted ranges of hashes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import LOWER, column, table, whole_text
from riskframe.session import materialize

#: White space of ASCII, which a line's key has at neither end.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: What is known of a line in its range: it goes; its key is in too few documents of this
#: range, which is not all of the key; its key is in enough, and it is the first line here.
GOES, OPEN, FIRST = 0, 1, 2

_ORDER = ("h1", "h2", "doc_id", "text_key", "line")
_STATES = "h1 long, h2 long, doc_id long, text_key long, line int, state int"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text_key`` and ``text`` of each row.

    Rows of equal id and equal text are one document; ``text_key`` tells apart
    documents that repeat an id, or have none.
    """
    text = whole_text(text_col)
    return docs.select(
        column(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        text.alias("text"),
    )


def hashed_lines(docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """(h1, h2, doc_id, text_key, line) of each line with a key of ``least_chars`` code points.

    ``docs`` are ``keyed``. h1 and h2 are the halves of the key's 128-bit hash, and ``line`` is
    the line's number from 0. Copies of a row within a batch give their lines once.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            seen, digests, numbers, owners = set(), [], [], []
            texts = batch.column(2).cast(pa.binary())
            for row, own in enumerate(zip(ids.to_pylist(), keys.to_pylist(), strict=True)):
                if own in seen:
                    continue
                seen.add(own)
                for number, part in enumerate(texts[row].as_py().translate(LOWER).split(b"\n")):
                    key = part.strip(BLANKS)
                    if _chars(key) >= least_chars:
                        digests.append(xxhash.xxh3_128_digest(key))
                        numbers.append(number)
                        owners.append(row)
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            of = pa.array(owners, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ascontiguousarray(halves[:, 0])),
                    pa.array(np.ascontiguousarray(halves[:, 1])),
                    ids.take(of),
                    keys.take(of),
                    pa.array(numbers, pa.int32()),
                ],
                names=list(_ORDER),
            )

    return docs.mapInArrow(rows, "h1 long, h2 long, doc_id long, text_key long, line int")


def _chars(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _streamed(
    batches: Iterator[pa.RecordBatch], least_documents: int, keep_first: bool
) -> Iterator[pa.RecordBatch]:
    """Lines that go, or may go, of one sorted range.

    Held back are the lines of one key while it has fewer than ``least_documents``
    documents, and after that its first line.
    """
    held: list[np.ndarray] | None = None
    enough_held = False
    at_start = True

    def out(rows: list[np.ndarray], pick: np.ndarray, state: int) -> pa.RecordBatch:
        h1, h2, ids, none, keys, lines = (r[pick] for r in rows)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(h1), pa.array(h2), pa.array(ids, mask=none), pa.array(keys),
                pa.array(lines), pa.array(np.full(len(h1), state, dtype=np.int32)),
            ],
            names=[*_ORDER, "state"],
        )

    for batch in batches:
        if batch.num_rows == 0:
            continue
        ids = batch.column(2)
        rows = [
            batch.column(0).to_numpy(),
            batch.column(1).to_numpy(),
            ids.fill_null(0).to_numpy(zero_copy_only=False),
            ids.is_null().to_numpy(zero_copy_only=False),
            batch.column(3).to_numpy(),
            batch.column(4).to_numpy(),
        ]
        if held is not None:
            rows = [np.concatenate(pair) for pair in zip(held, rows, strict=True)]
        # Copies of a row are one document, and stand together.
        other = np.ones(len(rows[0]), dtype=bool)
        other[1:] = np.logical_or.reduce([r[1:] != r[:-1] for r in rows])
        rows = [r[other] for r in rows]
        number = len(rows[0])
        new_key = np.ones(number, dtype=bool)
        new_key[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        new_doc = new_key.copy()
        for own in rows[2:5]:
            new_doc[1:] |= own[1:] != own[:-1]
        starts = np.flatnonzero(new_key)
        enough = np.add.reduceat(new_doc, starts, dtype=np.int64) >= least_documents
        enough[0] |= enough_held
        goes = np.repeat(enough, np.diff(np.append(starts, number)))
        last = starts[-1]
        if at_start and len(starts) > 1:
            # The range's first key may have begun in the one before.
            first = np.zeros(number, dtype=bool)
            first[0 if enough[0] else slice(0, starts[1])] = True
            yield out(rows, first, FIRST if enough[0] else OPEN)
            goes[0] = False
        if keep_first:
            goes[starts] = False
        # The last key may go on: in the next batch, or in the next range.
        held_rows = slice(last, last + 1) if enough[-1] else slice(last, number)
        goes[held_rows] = False
        held, enough_held = [r[held_rows].copy() for r in rows], bool(enough[-1])
        at_start = at_start and len(starts) == 1
        yield out(rows, goes, GOES)
    if held is not None:
        yield out(held, np.ones(len(held[0]), dtype=bool), FIRST if enough_held else OPEN)


def dropped_lines(
    lines: DataFrame, least_documents: int = 10, keep_first: bool = False
) -> DataFrame:
    """(doc_id, text_key, line) of each line that goes; see ``keep_bitmaps``.

    Hashes are cut into ranges by key, document and line, so that a key of many
    documents fills several ranges and no task is larger than others. Each range
    is sorted and streamed. Only of its first and its last key can a range not see
    all: what it knows of them, fewer than ``least_documents`` documents each or
    one line, is put together with the neighbours'.
    """
    ranges = lines.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    known = materialize(
        ranges.mapInArrow(lambda b: _streamed(b, least_documents, keep_first), _STATES), "known"
    )
    edge = known.where(F.col("state") != GOES)
    place = F.struct("doc_id", "text_key", "line")
    whole = edge.groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(
        F.max("state").alias("most"),
        F.count_distinct(F.struct("doc_id", "text_key")).alias("documents"),
        F.min(place).alias("first"),
    )
    goes = (F.col("most") == FIRST) | (F.col("documents") >= least_documents)
    if keep_first:
        goes = goes & (place != F.col("first"))
    edge = edge.join(whole, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    names = ("doc_id", "text_key", "line")
    return known.where(F.col("state") == GOES).select(*names).union(
        edge.where(goes).select(*names)
    )


def keep_bitmaps(
    docs: DataFrame,
    least_documents: int = 10,
    least_chars: int = 1,
    keep_first: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Which lines each document keeps: ``doc_id``, ``text_key``, ``n_dropped`` and ``keep``.

    A line's key is the line without ASCII white space at its ends, A-Z
    lower-cased. Lines whose key has ``least_chars`` code points or more and stands
    in ``least_documents`` documents or more go: all of them, or with
    ``keep_first`` all but the first by document and line (with
    ``least_documents=1``, plain removal of repeated lines; a null id comes first).
    Keys are compared by 128-bit hashes.

    ``keep`` is a zlib-compressed string of bits, little end first: 1 for a line
    that stays. It ends with the byte of the last line that goes, and documents that lose no
    line have no row, so nothing of the texts is written or moved here.

    Rows of equal id and equal text are one document; a null or empty text is one
    empty line; an empty table gives no rows; other columns are not looked at.
    """
    lines = materialize(hashed_lines(keyed(docs, id_col, text_col), least_chars), "lines")
    gone = dropped_lines(lines, least_documents, keep_first)
    # A document's own lines only, however many rows share its id.
    sets = gone.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("gone"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bitmaps, numbers = [], []
            for gone in batch.column(2):
                places = gone.values.to_numpy()
                # Whole bytes: what follows on the last line that goes stays.
                bits = np.ones(int(places.max()) // 8 * 8 + 8, dtype=bool)
                bits[places] = False
                bitmaps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
                numbers.append(len(places))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array(numbers, pa.int64()), pa.array(bitmaps, pa.binary()),
                ],
                names=["doc_id", "text_key", "n_dropped", "keep"],
            )

    return sets.mapInArrow(packed, "doc_id long, text_key long, n_dropped long, keep binary")


def kept_lines(text: bytes, keep: bytes) -> bytes:
    """``text`` without the lines whose bit in ``keep`` is 0."""
    parts = text.split(b"\n")
    bits = np.frombuffer(zlib.decompress(keep), dtype=np.uint8)
    bits = np.unpackbits(bits, bitorder="little")
    gone = set(np.flatnonzero(bits == 0).tolist())
    return b"\n".join([p for i, p in enumerate(parts) if i not in gone])


def apply_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_lines`` (before), ``n_dropped`` and ``kept``, the text that stays, of each row.

    Texts are shuffled once, to meet their bitmaps.
    """
    marks = bitmaps.select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_dropped", "keep"
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    met = keyed(docs, id_col, text_col).join(marks, same, "left").select(
        "doc_id", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), "keep", "text"
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).cast(pa.binary()).to_pylist()
            keeps = batch.column(2).to_pylist()
            kept = [t if k is None else kept_lines(t, k) for t, k in zip(texts, keeps, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([t.count(b"\n") + 1 for t in texts], pa.int64()),
                    batch.column(1),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_lines", "n_dropped", "kept"],
            )

    found = met.mapInArrow(rows, "doc_id long, n_lines long, n_dropped long, kept binary")
    return found.withColumn("kept", F.col("kept").cast("string"))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: lines of keys in ten documents or more go everywhere."""
    docs = table(spark, sf_dir, "documents")
    return apply_bitmaps(docs, keep_bitmaps(docs)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


OP11_SQL = """
with cut as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents
), lines as (
  select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as i from cut
), keys as (
  select *, translate(
    trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), frequent as (
  select key from keys where key <> '' group by key having count(distinct doc_id) >= 10
)
select k.doc_id, count(*) as n_lines, count(f.key) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (f.key is null), ''))
    as kept_sha256
from keys k left join frequent f on k.key = f.key
group by k.doc_id
"""
