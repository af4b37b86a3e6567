"""SentencePiece encoding and decoding on the tokenizers library."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from riskframe.llm.common import column, table, whole_text

#: Where the public model lies on the machines of the tests; a parameter everywhere.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Threads of the tokenizers library in one task.
THREADS = 2
#: Units that are strung together in one call.
STRUNG = 128
#: A task forgets its units at this number, or at this many characters of them.
KNOWN_UNITS = 600_000
KNOWN_CHARS = 12_000_000

# Fixed values of the model's protobuf: kinds of model and of piece.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, data[at : at + size]
            at += size


@dataclass
class PieceModel:
    """What a model file says: pieces with scores and kinds, and its normaliser."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    drop_extra_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                inner = dict(_fields(value))
                score = struct.unpack("<f", inner.get(2, b"\0\0\0\0"))[0]
                model.pieces.append((inner[1].decode(), score, inner.get(3, NORMAL)))
            elif number == 2:
                inner = dict(_fields(value))
                model.kind = inner.get(3, UNIGRAM)
                model.byte_fallback = bool(inner.get(35, 0))
                model.unknown_id = inner.get(40, 0)
            elif number == 3:
                inner = dict(_fields(value))
                model.charsmap = inner.get(2, b"")
                model.dummy_prefix = bool(inner.get(3, 1))
                model.drop_extra_spaces = bool(inner.get(4, 1))
                model.escape_spaces = bool(inner.get(5, 1))
        return model

    def splits_at_marks(self) -> bool:
        """No piece reaches over the start of a word, so words can be encoded one by one."""
        over = re.compile(f"[^{MARK}]{MARK}")
        return self.escape_spaces and not any(
            over.search(p) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED)
        )

    def merges(self) -> list[tuple[str, str]]:
        """Pairs to merge, best score of the merged piece first."""
        place = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        found = []
        for piece, index in place.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in place and right in place:
                    found.append((-self.pieces[index][1], index, place[left], left, right))
        return [(left, right) for *_, left, right in sorted(found)]


def build_tokenizer(model: PieceModel):
    """The same tokenizer in the tokenizers library."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if model.kind == UNIGRAM:
        vocabulary = [(piece, score) for piece, score, _ in model.pieces]
        core = models.Unigram(vocabulary, model.unknown_id, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE(
            {piece: i for i, (piece, _, _) in enumerate(model.pieces)},
            model.merges(),
            unk_token=model.pieces[model.unknown_id][0],
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    else:
        raise ValueError(f"models of kind {model.kind} are not supported")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.drop_extra_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(True, True)]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    own = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(
        own + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])
    )
    defined = [p for p, _, kind in model.pieces if kind == USER_DEFINED]
    tokenizer.add_tokens([AddedToken(p, normalized=True) for p in defined])
    return tokenizer


class Encoder:
    """Encodes batches of texts; each distinct unit is encoded, and verified, once.

    A unit is a word with the marks before it, if no piece of the model reaches
    over the start of a word; else the whole text is the unit. New units go to
    the tokenizers library in one multithreaded batch. Each is verified against
    the sentencepiece library; where the two differ (pieces that can be built in
    two ways, as of repeated letters), the ids of sentencepiece hold. Each is
    decoded once too: marks start whole characters, so a text's ids decode to
    what its units decode to, one after another.
    """

    def __init__(self, data: bytes) -> None:
        # Read when the library starts its threads: other tasks use the machine too.
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        import sentencepiece
        from tokenizers import Regex, decoders, normalizers, pre_tokenizers

        self.model = PieceModel.parse(data)
        self.tokenizer = build_tokenizer(self.model)
        # Units hold the text as normalised already, and keep the space before a word.
        self.units = build_tokenizer(self.model)
        self.units.normalizer = normalizers.Sequence([])
        unit = f"{MARK}*[^{MARK}]+|{MARK}+"
        if self.model.splits_at_marks():
            self.units.pre_tokenizer = pre_tokenizers.Split(Regex(unit), "isolated")
        self.units.decoder = decoders.Sequence(
            [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        )
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.unit = re.compile(unit)
        self.by_word = self.model.splits_at_marks()
        self.marked = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.normalise = self.tokenizer.normalizer.normalize_str
        model = self.model
        if model.escape_spaces and model.dummy_prefix and not (model.charsmap or model.drop_extra_spaces):
            # All that the normaliser does then.
            self.normalise = lambda text: MARK + text.replace(" ", MARK)
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.decoded: list[str] = []
        self.ids = np.empty(0, np.int32)
        self.lengths, self.same = np.empty(0, np.int64), np.empty(0, bool)
        self.all_ids, self.all_lengths, self.all_same = [], [], []
        self.chars = 0

    def _learn(self, units: list[str]) -> None:
        """Encode, verify and decode new units, many to a call.

        Units that start with one mark are strung together: where a piece starts
        with a mark, the next unit begins. A string that fails a check is gone
        through unit by unit.
        """
        strings, alone = [], []
        if self.by_word:
            alone = [u for u in units if u[0] != MARK or u[1:2] in ("", MARK)]
            fit = list(set(units).difference(alone)) if alone else units
            strings = [fit[i : i + STRUNG] for i in range(0, len(fit), STRUNG)]
        else:
            alone = units
        texts = ["".join(s) for s in strings]
        ids = [e.ids for e in self.units.encode_batch_fast(texts, add_special_tokens=False)]
        decoded = self.units.decode_batch(ids, skip_special_tokens=False)
        for string, text, own, theirs, again in zip(
            strings, texts, ids, self._expected(texts, ids), decoded, strict=True
        ):
            numbers = np.array(own, dtype=np.int32)
            starts = np.flatnonzero(self.marked[numbers])
            if len(starts) == len(string) and own == theirs and again == text.replace(MARK, " "):
                lengths = np.diff(starts, append=len(own))
                self._keep(string, numbers, lengths, None, np.ones(len(string), bool))
            else:
                alone += string
        if alone:
            found = [e.ids for e in self.units.encode_batch_fast(alone, add_special_tokens=False)]
            expected = self._expected(alone, found)
            same = np.fromiter(map(eq, found, expected), dtype=bool, count=len(alone))
            lengths = np.fromiter(map(len, expected), dtype=np.int64, count=len(alone))
            decoded = self.units.decode_batch(expected, skip_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(expected), np.int32, int(lengths.sum()))
            self._keep(alone, ids, lengths, decoded, same)
        self.lengths, self.same, self.ids = (
            np.concatenate(parts) for parts in (self.all_lengths, self.all_same, self.all_ids)
        )
        self.all_lengths, self.all_same, self.all_ids = [self.lengths], [self.same], [self.ids]

    def _expected(self, units: list[str], found: list[list[int]]) -> list[list[int]]:
        """What the reference makes of units; it adds the prefix by itself, and where it
        would drop something, what was found stands."""
        prefix = 1 if self.model.dummy_prefix else 0
        plain = [u[prefix:].replace(MARK, " ") for u in units]
        return [
            ours if not p or (self.model.drop_extra_spaces and p != p.strip()) else theirs
            for ours, theirs, p in zip(
                found, self.reference.encode(plain, num_threads=1), plain, strict=True
            )
        ]

    def _keep(
        self, units: list[str], ids: np.ndarray, lengths: np.ndarray, decoded: list[str] | None,
        same: np.ndarray,
    ) -> None:
        """Without ``decoded`` each unit decodes to itself."""
        first = len(self.places)
        self.places.update(zip(units, range(first, first + len(units)), strict=True))
        self.decoded += [u.replace(MARK, " ") for u in units] if decoded is None else decoded
        self.all_ids.append(ids)
        self.all_lengths.append(lengths)
        self.all_same.append(same)
        self.chars += sum(map(len, units))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool], np.ndarray]:
        """Ids of all texts in a row; of each text the number of ids, whether decoding them
        gives the text again, and whether parity held."""
        split = self.unit.findall if self.by_word else (lambda t: [t] if t else [])
        units = [split(self.normalise(t)) if t else [] for t in texts]
        places = self.places
        new = list(set(chain.from_iterable(units)).difference(places))
        if new:
            self._learn(new)
        counts = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        used = np.fromiter(
            map(places.__getitem__, chain.from_iterable(units)),
            dtype=np.int64,
            count=int(counts.sum()),
        )
        starts = np.cumsum(self.lengths) - self.lengths
        own = self.lengths[used]
        ends = np.cumsum(own)
        within = np.arange(ends[-1] if len(ends) else 0)
        ids = self.ids[within + np.repeat(starts[used] - ends + own, own)]
        text_of = np.repeat(np.arange(len(texts)), counts)
        sizes = np.bincount(text_of, own, minlength=len(texts)).astype(np.int64)
        start = 1 if self.model.dummy_prefix else 0
        parts = map(self.decoded.__getitem__, used.tolist())
        again = ["".join(islice(parts, n))[start:] == t for n, t in zip(counts, texts, strict=True)]
        differing = np.bincount(text_of, ~self.same[used], minlength=len(texts))
        if len(places) > KNOWN_UNITS or self.chars > KNOWN_CHARS:
            self.forget()
        return ids, sizes, again, differing == 0


def _model_bytes(model_path: str) -> bytes:
    with open(model_path, "rb") as file:
        return file.read()


def _some(texts: list, most: int = 512) -> Iterator[slice]:
    for start in range(0, len(texts), most):
        yield slice(start, start + most)


def encode(
    docs: DataFrame,
    model_path: str = MODEL_PATH,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every row's whole text as ids: doc_id, ids, n_tokens, round_trip, parity.

    ``round_trip``: decoding the ids gives the text again (it does not if the
    text holds the mark itself, or spaces that the model's normaliser drops).
    ``parity``: both libraries agree on each of the text's units; the ids are
    those of sentencepiece either way. A null or empty text has no ids. Extra
    columns are left behind.

    The model file is read on the driver and sent to the executors.
    """
    shipped = docs.sparkSession.sparkContext.broadcast({"model": _model_bytes(model_path)})

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The worker keeps the value, and what is built from it, from task to task.
        kept = shipped.value
        encoder = kept.get("encoder") or kept.setdefault("encoder", Encoder(kept["model"]))
        for batch in batches:
            all_texts = batch.column(1).to_pylist()
            for part in _some(all_texts):
                texts = all_texts[part]
                ids, sizes, again, same = encoder.encode(texts)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, len(texts)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())),
                        pa.array(sizes, pa.int64()),
                        pa.array(again, pa.bool_()),
                        pa.array(same, pa.bool_()),
                    ],
                    names=["doc_id", "ids", "n_tokens", "round_trip", "parity"],
                )

    rows = docs.select(column(id_col).alias("doc_id"), whole_text(text_col))
    schema = StructType(
        [
            rows.schema.fields[0],
            StructField("ids", ArrayType(IntegerType())),
            StructField("n_tokens", LongType()),
            StructField("round_trip", BooleanType()),
            StructField("parity", BooleanType()),
        ]
    )
    return rows.mapInArrow(encoded, schema)


def decode(
    encoded: DataFrame,
    model_path: str = MODEL_PATH,
    id_col: str = "doc_id",
    ids_col: str = "ids",
) -> DataFrame:
    """``doc_id`` and ``text`` of rows of ids; null ids make a null text."""
    shipped = encoded.sparkSession.sparkContext.broadcast({"model": _model_bytes(model_path)})

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shipped.value
        tokenizer = kept.get("tokenizer") or kept.setdefault(
            "tokenizer", build_tokenizer(PieceModel.parse(kept["model"]))
        )
        for batch in batches:
            ids = batch.column(1).to_pylist()
            texts = tokenizer.decode_batch([i or [] for i in ids], skip_special_tokens=False)
            texts = [None if i is None else t for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    rows = encoded.select(column(id_col).alias("doc_id"), column(ids_col).cast("array<int>"))
    schema = StructType([rows.schema.fields[0], StructField("text", StringType())])
    return rows.mapInArrow(decoded, schema)


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding and by a second library."""
    return encode(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_tokens", "ids", "round_trip", "parity", F.xxhash64("ids").alias("ids_hash")
    )
