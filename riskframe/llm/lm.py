"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from riskframe.llm.common import LOWER, ceil_div, column, crc_of_id, table, whole_text
from riskframe.session import materialize

#: Words that are outputs of the model of their own; all others share classes by how they begin.
WORDS = 2_048
SHARED = 512
BEGINNING = 3
#: Words whose counts every task has at hand, and the longest of them in bytes. The counts of
#: all other words are joined.
AT_HAND = 262_144
LONGEST = 64
SIZE = 16
#: Counts are smoothed by this.
ADDED = 0.1
#: A task that counts hands its counts on at this many distinct words.
MOST_COUNTED = 200_000
#: A copy of the model goes through its tokens at this many, in random order.
MOST_HELD = 400_000
#: Tokens that a copy sees in a round, about, and the most copies; beyond, a copy sees more.
COPY_TOKENS = 1_000_000
MOST_COPIES = 4_096
#: Steps that a copy makes in a round at least, if its tokens are enough for steps of LEAST_STEP.
LEAST_STEPS = 256
LEAST_STEP = 64
#: A task that scores hands results on at this many texts.
MOST_TEXTS = 256


def tokens_of(text: bytes) -> list[bytes]:
    """Runs of anything but white space, A-Z lower-cased."""
    return text.translate(LOWER).split()


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all whole texts.

    Each task adds up its words first and hands them on whenever they are many,
    so a frequent word costs each task a few rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def handed_on() -> Iterator[pa.RecordBatch]:
            words = list(counts)
            for start in range(0, len(words), 50_000):
                part = words[start : start + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array([counts[w] for w in part], pa.int64()),
                    ],
                    names=["word", "n"],
                )
            counts.clear()

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                counts.update(tokens_of(text))
                if len(counts) > MOST_COUNTED:
                    yield from handed_on()
        yield from handed_on()

    partial = docs.select(whole_text(text_col)).mapInArrow(count, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def beginning_class(word: Column) -> Column:
    """The shared class of a word, from 0."""
    return F.pmod(F.crc32(F.substring(word.cast("binary"), 1, BEGINNING)), F.lit(SHARED))


class Classes(dict):
    """Number of each word at hand; other words get -1 - their shared class."""

    def __missing__(self, word: bytes) -> int:
        return -1 - zlib.crc32(word[:BEGINNING]) % SHARED


@dataclass
class Vocabulary:
    """Words at hand, most frequent first, with what is known of all training tokens."""

    words: list[bytes]
    counts: np.ndarray
    own: int
    tokens: int
    distinct: int
    documents: int
    shared_tokens: np.ndarray
    shared_words: np.ndarray

    def __post_init__(self) -> None:
        self.end = self.own + SHARED
        self.begin = self.end + 1
        self.classes = Classes(zip(self.words, range(len(self.words)), strict=True))
        shared = [
            self.own + zlib.crc32(w[:BEGINNING]) % SHARED for w in self.words[self.own :]
        ]
        self.class_of = np.concatenate([np.arange(self.own), np.array(shared, dtype=np.int64)])

    def noise(self) -> np.ndarray:
        """Share of each class in the training tokens, smoothed."""
        found = np.concatenate(
            [self.counts[: self.own], self.shared_tokens, [self.documents]]
        ).astype(np.float64) + ADDED
        return found / found.sum()

    def model_classes(self, places: np.ndarray) -> np.ndarray:
        """Classes of the model for numbers of ``classes``."""
        known = np.maximum(places, 0)
        own = self.class_of[known] if len(self.class_of) else known
        return np.where(places >= 0, own, self.own - 1 - places)


def histories(
    places: np.ndarray, lengths: np.ndarray, begin: int
) -> tuple[np.ndarray, np.ndarray]:
    """The class before each token and the one before that; texts do not see each other."""
    first = np.cumsum(lengths) - lengths
    before = np.concatenate([[begin], places[:-1]])
    before[first] = begin
    earlier = np.concatenate([[begin], before[:-1]])
    earlier[first] = begin
    return before, earlier


class LogBilinear:
    """Score of a class after two others: (c1 * r[before] + c2 * r[earlier]) . q[class] + b[class]."""

    def __init__(self, parameters: np.ndarray, outputs: int) -> None:
        size = SIZE
        self.parameters, self.outputs = parameters, outputs
        cuts = np.cumsum([(outputs + 1) * size, outputs * size, outputs, size, size])
        r, q, self.b, self.c1, self.c2, _ = np.split(parameters, cuts)
        self.r, self.q = r.reshape(-1, size), q.reshape(-1, size)

    @classmethod
    def start(cls, noise: np.ndarray, seed: int) -> LogBilinear:
        random = np.random.default_rng(seed)
        outputs = len(noise)
        return cls(
            np.concatenate(
                [
                    random.normal(0, 0.1, (2 * outputs + 1) * SIZE),
                    np.log(noise),
                    np.ones(SIZE),
                    np.full(SIZE, 0.5),
                ]
            ).astype(np.float32),
            outputs,
        )

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What classes add to the context as the one before, as the one before that, and
        log of the norm of each pair.

        The score is a sum of the two, so the norm of a pair of classes is a
        product of two rows of exponentials: one matrix product has them all. It
        is worked out a few rows at a time, as the norms are large by themselves.
        """
        near, far = self.r * self.c1, self.r * self.c2
        high = far @ self.q.T
        high += self.b
        top_far = high.max(axis=1)
        high -= top_far[:, None]
        np.exp(high, out=high)
        norm = np.empty((len(near), len(far)), dtype=np.float32)
        for start in range(0, len(near), 256):
            low = near[start : start + 256] @ self.q.T
            top = low.max(axis=1)
            low -= top[:, None]
            part = np.matmul(np.exp(low, out=low), high.T, out=norm[start : start + 256])
            np.log(np.maximum(part, 1e-30, out=part), out=part)
            part += top[:, None] + top_far
        return near, far, norm

    def log_probabilities(
        self, tables: tuple, target: np.ndarray, before: np.ndarray, earlier: np.ndarray
    ) -> np.ndarray:
        near, far, norm = tables
        logits = np.einsum("ij,ij->i", near[before] + far[earlier], self.q[target]) + self.b[target]
        return (logits - norm[before, earlier]).astype(np.float64)


class Trainer:
    """Noise-contrastive steps of one copy of the model.

    ``squares`` are the sums of squared slopes, by which steps grow shorter.
    """

    def __init__(
        self,
        model: LogBilinear,
        noise: np.ndarray,
        seed: int | list[int],
        rate: float,
        squares: np.ndarray | None = None,
    ) -> None:
        self.model, self.noise, self.rate = model, noise, rate
        self.random = np.random.default_rng(seed)
        fresh = np.full(len(model.parameters), 1e-6, dtype=np.float32)
        self.squares = fresh if squares is None else squares
        self.ladder = np.cumsum(noise)
        self.log_noise = np.log(noise).astype(np.float32)

    def step(self, target: np.ndarray, before: np.ndarray, earlier: np.ndarray, drawn: int) -> None:
        """One step: the tokens' own classes against ``drawn`` classes drawn for all of them."""
        m = self.model
        lots = self.random.random(drawn)
        other = np.minimum(np.searchsorted(self.ladder, lots), m.outputs - 1)
        near, far = m.r[before], m.r[earlier]
        context = near * m.c1 + far * m.c2
        own = m.q[target]
        surplus = m.b - self.log_noise - np.float32(np.log(drawn))
        right = np.einsum("ij,ij->i", context, own) + surplus[target]
        others = m.q[other]
        down = context @ others.T
        down += surplus[other]
        # Slopes of the loss: how far each is from being told apart. An overflow is a
        # slope of 0.
        with np.errstate(over="ignore"):
            up = 1 / (1 + np.exp(-right)) - 1
            np.exp(np.negative(down, out=down), out=down)
        down += 1
        np.reciprocal(down, out=down)
        at_context = up[:, None] * own + down @ others
        gradient = LogBilinear(np.zeros_like(m.parameters), m.outputs)
        _add_rows(gradient.q, target, up[:, None] * context)
        np.add.at(gradient.q, other, down.T @ context)
        gradient.b += np.bincount(target, up, minlength=m.outputs).astype(np.float32)
        np.add.at(gradient.b, other, down.sum(axis=0))
        _add_rows(gradient.r, before, at_context * m.c1)
        _add_rows(gradient.r, earlier, at_context * m.c2)
        gradient.c1 += (at_context * near).sum(axis=0)
        gradient.c2 += (at_context * far).sum(axis=0)
        slope = gradient.parameters / len(target)
        self.squares += slope * slope
        m.parameters -= self.rate * slope / np.sqrt(self.squares)


def _add_rows(matrix: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add each of ``values`` to its row of ``matrix``; rows repeat."""
    cells = (rows[:, None] * SIZE + np.arange(SIZE)).ravel()
    sums = np.bincount(cells, values.ravel(), minlength=matrix.size)
    matrix += sums.reshape(matrix.shape)


def _vocabulary(counts: DataFrame, documents: int) -> Vocabulary:
    """What every task has at hand; at most AT_HAND words of at most LONGEST bytes reach the driver."""
    short = F.octet_length("word") <= LONGEST
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    levels = counts.where(short).groupBy(level.alias("level")).count().collect()
    room, least = AT_HAND, None
    for row in sorted(levels, key=lambda r: -r["level"]):
        room -= row["count"]
        if room < 0:
            break
        least = row["level"]
    at_hand = (
        counts.where(short & (level >= least)).toPandas()
        if least is not None
        else counts.limit(0).toPandas()
    )
    at_hand = at_hand.sort_values(["n", "word"], ascending=[False, True])
    words = [w.encode() for w in at_hand["word"]]
    found = at_hand["n"].to_numpy(dtype=np.int64)
    own = min(WORDS, len(words))
    rest = F.lit(True)
    if own:
        n, word = int(found[own - 1]), at_hand["word"].iloc[own - 1]
        rest = ~(short & ((F.col("n") > n) | ((F.col("n") == n) & (F.col("word") <= word))))
    shared = counts.where(rest).groupBy(beginning_class(F.col("word")).alias("shared")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")
    )
    shared_tokens, shared_words = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
    for row in shared.collect():
        shared_tokens[row["shared"]], shared_words[row["shared"]] = row["n"], row["words"]
    tokens = int(shared_tokens.sum() + found[:own].sum()) + documents
    distinct = int(shared_words.sum()) + own + (documents > 0)
    return Vocabulary(
        words, found, own, tokens, distinct, documents, shared_tokens, shared_words
    )


def _round(
    rows: DataFrame,
    state: np.ndarray,
    noise: np.ndarray,
    copies: int,
    number: int,
    drawn: int,
    batch: int,
    rate: float,
    seed: int,
) -> np.ndarray:
    """One round: each copy of the model goes on with its rows, and the copies are averaged by
    tokens. ``state`` holds the parameters and the sums of squared slopes.

    ``rows`` are (copy, lot, classes). Which rows a copy has, and in which order,
    follows from the rows alone, however the table is cut.
    """
    shipped = rows.sparkSession.sparkContext.broadcast({"state": state, "noise": noise})
    outputs = len(noise)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = shipped.value
        trainer, copy, tokens = None, None, 0
        found: list[np.ndarray] = []
        held = 0

        def learn() -> None:
            places = np.concatenate(found).astype(np.int64)
            lengths = np.array([len(x) for x in found])
            before, earlier = histories(places, lengths, outputs)
            order = trainer.random.permutation(len(places))
            for part in np.array_split(order, max(1, len(order) // batch)):
                trainer.step(places[part], before[part], earlier[part], drawn)
            found.clear()

        def finished() -> pa.RecordBatch:
            if found:
                learn()
            return _copy(tokens, np.concatenate([trainer.model.parameters, trainer.squares]))

        for arrow in batches:
            owners = arrow.column(0).to_pylist()
            for owner, packed in zip(owners, arrow.column(2).to_pylist(), strict=True):
                if owner != copy:
                    if trainer is not None:
                        yield finished()
                    parameters, squares = np.split(given["state"].copy(), 2)
                    model = LogBilinear(parameters, outputs)
                    trainer = Trainer(
                        model, given["noise"], [seed, number, owner], rate, squares
                    )
                    copy, tokens, held = owner, 0, 0
                # The end of a text is the last class, and is not stored.
                found.append(np.append(np.frombuffer(packed, dtype="<u2"), outputs - 1))
                tokens += len(found[-1])
                held += len(found[-1])
                if held >= MOST_HELD:
                    learn()
                    held = 0
        if trainer is not None:
            yield finished()

    dealt = rows.repartitionById(copies, F.col("copy")).sortWithinPartitions("copy", "lot")
    trained = dealt.mapInArrow(train, "tokens long, parameters binary")
    left = copies
    while left > 8:
        left = ceil_div(left, 8)
        trained = trained.repartition(left).mapInArrow(_average, "tokens long, parameters binary")
    trained = trained.toPandas()
    if not len(trained):
        return state
    sums = _weighted(zip(trained["tokens"], trained["parameters"], strict=True))
    return (sums[1] / sums[0]).astype(np.float32)


def _weighted(copies: Iterator[tuple[int, bytes]]) -> tuple[int, np.ndarray]:
    total, sums = 0, 0.0
    for tokens, parameters in copies:
        total += tokens
        sums = sums + tokens * np.frombuffer(parameters, dtype=np.float32).astype(np.float64)
    return total, sums


def _copy(tokens: int, parameters: np.ndarray) -> pa.RecordBatch:
    packed = parameters.astype(np.float32).tobytes()
    return pa.RecordBatch.from_arrays(
        [pa.array([tokens], pa.int64()), pa.array([packed], pa.binary())],
        names=["tokens", "parameters"],
    )


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams copies past a running sum."""
    pairs = (
        pair
        for batch in batches
        for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
    )
    total, sums = _weighted(pairs)
    if total:
        yield _copy(total, sums / total)


@dataclass
class Model:
    """A trained model, and the table of all training words with their counts."""

    network: LogBilinear
    vocabulary: Vocabulary
    counts: DataFrame


def vocabulary_of(docs: DataFrame, text_col: str = "text") -> tuple[Vocabulary, DataFrame]:
    """What tasks have at hand of the words of all whole texts, and the table of all counts."""
    counts = materialize(count_words(docs, text_col), "words")
    return _vocabulary(counts, docs.count()), counts


def learn(
    digests: DataFrame,
    vocabulary: Vocabulary,
    rounds: int = 4,
    drawn: int = 128,
    batch: int = 1_024,
    rate: float = 0.1,
    seed: int = 5,
    copy_tokens: int = COPY_TOKENS,
) -> LogBilinear:
    """Log-bilinear model of all texts of ``digests``, which are stored.

    Training sees every token once: in each of ``rounds`` rounds copies of the
    model go on with a share of the texts, and copies and their step lengths are
    averaged, tree-wise, before the next. A text's round and copy follow from a
    hash of the row. There is a copy for every ``copy_tokens`` of a round, so that
    each makes enough steps to be worth averaging, whether the table is small
    or large, and the result does not depend on partitions. A step tells the tokens
    of a batch from ``drawn`` classes drawn from the unigram distribution; few
    tokens are cut into smaller batches. Without any text the model stays at its start,
    all classes alike.
    """
    noise = vocabulary.noise()
    start = LogBilinear.start(noise, seed)
    state = np.concatenate([start.parameters, np.full(len(start.parameters), 1e-6, np.float32)])
    in_round = vocabulary.tokens // rounds
    copies = min(MOST_COPIES, max(1, round(in_round / copy_tokens)))
    batch = min(batch, max(LEAST_STEP, in_round // copies // LEAST_STEPS))
    rows = digests.select(
        F.pmod("lot", F.lit(rounds)).alias("turn"),
        F.pmod(F.xxhash64("lot"), F.lit(copies)).cast("int").alias("copy"),
        "lot",
        "classes",
    )
    for number in range(rounds):
        own = rows.where(F.col("turn") == number).select("copy", "lot", "classes")
        state = _round(own, state, noise, copies, number, drawn, batch, rate, seed)
    return LogBilinear(np.split(state, 2)[0], len(noise))


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> Model:
    """Counts and model of all whole texts of ``docs``; ``options`` are those of ``learn``.

    Outputs are the ``WORDS`` most frequent words, ``SHARED`` classes for all
    other words by their beginnings, and the end of a text.
    """
    vocabulary, counts = vocabulary_of(docs, text_col)
    digests = stored_digest(docs, vocabulary, id_col, text_col)
    return Model(learn(digests, vocabulary, **options), vocabulary, counts)


DIGEST = StructType(
    [
        StructField("lot", LongType()),
        StructField("n_tokens", LongType()),
        StructField("known", LongType()),
        StructField("log_counts", DoubleType()),
        StructField("log_in_class", DoubleType()),
        StructField("classes", BinaryType()),
        StructField(
            "rare",
            ArrayType(
                StructType([StructField("word", StringType()), StructField("n", IntegerType())])
            ),
        ),
    ]
)


def digest(
    docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """What training and scoring need of each whole text; texts are split into words here only.

    doc_id; ``lot``, a hash of the row (copies of a row get different ones);
    ``n_tokens``, words and one end; ``known``, ``log_counts`` and ``log_in_class`` of the
    tokens whose counts are at hand; ``classes`` of the words, two bytes each; and
    the words ``rare`` enough not to be at hand. A null text is empty.
    """
    v = vocabulary
    shipped = docs.sparkSession.sparkContext.broadcast(
        (
            v.words, v.counts, v.own, v.tokens, v.distinct, v.documents, v.shared_tokens,
            v.shared_words,
        )
    )
    kinds = {
        "lot": pa.int64(), "n_tokens": pa.int64(), "known": pa.int64(),
        "log_counts": pa.float64(), "log_in_class": pa.float64(), "classes": pa.binary(),
    }

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(*shipped.value)
        log_counts = np.log10(np.append(v.counts, 1) + ADDED)
        end_log = np.log10(v.documents + ADDED)
        share = np.zeros(v.end + 1)
        share[v.own : v.end] = np.log10(v.shared_tokens + ADDED * (v.shared_words + 1))

        def part_of(ids: pa.Array, lots: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
            words = [tokens_of(t) for t in texts]
            lengths = np.array([len(w) for w in words])
            flat = [w for text in words for w in text]
            places = np.fromiter(map(v.classes.__getitem__, flat), dtype=np.int64, count=len(flat))
            unseen = places < 0
            target = v.model_classes(places)
            own_logs = np.where(unseen, 0.0, log_counts[np.maximum(places, 0)])
            in_class = np.where(places >= v.own, own_logs, 0.0) - share[target]
            first = np.cumsum(lengths) - lengths
            rare_words: list[str] = []
            rare_counts: list[int] = []
            ends = [0]
            gone = unseen.tolist()
            for text, start in zip(words, first.tolist(), strict=True):
                found = Counter(compress(text, gone[start : start + len(text)]))
                rare_words += [w.decode("utf-8", "replace") for w in found]
                rare_counts += found.values()
                ends.append(len(rare_words))
            rare = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()),
                pa.StructArray.from_arrays(
                    [pa.array(rare_words, pa.string()), pa.array(rare_counts, pa.int32())],
                    names=["word", "n"],
                ),
            )
            packed = target.astype("<u2").tobytes()
            # Copies of a row must not all come to one copy of the model.
            seen: Counter[int] = Counter()
            spread = []
            for lot in lots.to_pylist():
                moved = lot + seen[lot] * 0x9E3779B97F4A7C15
                spread.append((moved + (1 << 63)) % (1 << 64) - (1 << 63))
                seen[lot] += 1
            columns = {
                "lot": spread,
                "n_tokens": lengths + 1,
                "known": _sums(~unseen, first, lengths).astype(np.int64) + (v.documents > 0),
                "log_counts": _sums(own_logs, first, lengths) + end_log,
                "log_in_class": _sums(in_class, first, lengths),
                "classes": [
                    packed[2 * start : 2 * (start + n)]
                    for start, n in zip(first.tolist(), lengths.tolist(), strict=True)
                ],
            }
            return pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c, kinds[name]) for name, c in columns.items()), rare],
                names=["doc_id", *DIGEST.fieldNames()],
            )

        for batch in batches:
            # The words of few texts at a time, so that a task holds little beside its batch.
            for start in range(0, batch.num_rows, MOST_TEXTS):
                part = batch.slice(start, MOST_TEXTS)
                texts = part.column(2).cast(pa.binary()).to_pylist()
                yield part_of(part.column(0), part.column(1), texts)

    text = whole_text(text_col)
    lot = F.xxhash64(text, column(id_col).cast("string"))
    rows = docs.select(column(id_col).alias("doc_id"), lot.alias("lot"), text)
    return rows.mapInArrow(digested, StructType([rows.schema.fields[0], *DIGEST.fields]))


def _sums(values: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each stretch of ``values``; an empty one has 0."""
    out = np.zeros(len(lengths))
    filled = lengths > 0
    if filled.any():
        out[filled] = np.add.reduceat(values, first[filled], dtype=np.float64)
    return out


def stored_digest(
    docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The ``digest``, written out with a number ``row`` for each row."""
    rows = digest(docs, vocabulary, id_col, text_col)
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every whole text.

    A text's tokens are its words and one end. ``base_score`` is the sum of
    their log10 unigram probabilities (c + 0.1) / (N + 0.1 (V + 1)); ``score`` is
    the model's log10 probability of the text: that of each token's class after
    the two classes before it, exactly normalised, times that of the word within
    a shared class, by its count and 0.1 for any unseen word. A null text is
    empty and has its end alone. Repeated rows each get the same scores.

    Tasks have the counts of frequent words at hand. All other words of a text,
    however many there are, are joined with the table of counts.
    """
    return score_digests(stored_digest(docs, model.vocabulary, id_col, text_col), model)


def score_digests(digests: DataFrame, model: Model) -> DataFrame:
    """Scores, as of ``score``, of texts whose ``stored_digest`` is known."""
    v = model.vocabulary
    shipped = digests.sparkSession.sparkContext.broadcast(
        {"parameters": model.network.parameters, "outputs": v.end + 1}
    )
    handed_on = ("doc_id", "row", "n_tokens", "known", "log_counts", "log_in_class")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The worker keeps the value, and what is built from it, from task to task.
        kept = shipped.value
        outputs = kept["outputs"]
        if "tables" not in kept:
            network = LogBilinear(kept["parameters"], outputs)
            kept.update(network=network, tables=network.tables())
        network, tables = kept["network"], kept["tables"]
        for batch in batches:
            for start in range(0, batch.num_rows, MOST_TEXTS):
                part = batch.slice(start, MOST_TEXTS)
                texts = [
                    np.append(np.frombuffer(x, dtype="<u2"), outputs - 1)
                    for x in part.column(len(handed_on)).to_pylist()
                ]
                lengths = np.array([len(x) for x in texts])
                target = np.concatenate(texts).astype(np.int64)
                before, earlier = histories(target, lengths, outputs)
                logs = network.log_probabilities(tables, target, before, earlier)
                sums = np.add.reduceat(logs, np.cumsum(lengths) - lengths) / np.log(10)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(handed_on))), pa.array(sums)],
                    names=[*handed_on, "log_model"],
                )

    given = digests.select(*handed_on, "classes")
    schema = StructType([*given.schema.fields[:-1], StructField("log_model", DoubleType())])
    partial = given.mapInArrow(scored, schema)
    rare = digests.select("row", F.explode("rare").alias("rare")).select("row", "rare.*")
    counts = model.counts.select(F.col("word").alias("_word"), F.col("n").alias("c"))
    seen = F.coalesce("c", F.lit(0))
    rest = (
        rare.join(counts, F.col("word") == F.col("_word"), "left")
        .groupBy(F.col("row").alias("_row"))
        .agg(
            F.sum(F.when(seen > 0, F.col("n")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("n") * F.log10(seen + ADDED)).alias("rare_logs"),
        )
    )
    logs = F.coalesce("rare_logs", F.lit(0.0))
    norm = float(np.log10(v.tokens + ADDED * (v.distinct + 1)))
    return partial.join(rest, F.col("row") == F.col("_row"), "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("log_counts") + logs - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("log_model") + F.col("log_in_class") + logs).alias("score"),
    )


def held_out(id_col: str = "doc_id") -> Column:
    """Fold 0 of ten by the CRC-32 of the id."""
    return F.pmod(crc_of_id(id_col), F.lit(10)) == 0


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: all documents scored, learned from nine folds of ten."""
    docs = table(spark, sf_dir, "documents")
    vocabulary, counts = vocabulary_of(docs.where(~held_out()))
    digests = stored_digest(docs, vocabulary)
    network = learn(digests.where(~held_out()), vocabulary)
    model = Model(network, vocabulary, counts)
    return score_digests(digests, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.vocabulary.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
