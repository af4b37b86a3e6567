"""Toxicity through non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from riskframe.llm.common import column, crc_of_id, table, whole_text
from riskframe.session import materialize

#: Features are hashed to this many places.
PLACES = 1 << 18
#: Words as a reader sees them: letters, digits and marks, without punctuation.
WORD = re.compile(r"[^\W_]+")
#: Lengths of the word beginnings that are features beside the word itself.
STEMS = (3, 4, 5, 6)
#: A task forgets its words at this number, so that its memory stays bounded.
KNOWN_WORDS = 200_000


def _features(word: str) -> tuple[int, ...]:
    """Places of a word and of its beginnings."""
    parts = ["=" + word] + [word[:n] for n in STEMS if len(word) >= n]
    return tuple({zlib.crc32(p.encode("utf-8", "surrogatepass")) % PLACES for p in parts})


class _Words:
    """Features of words; of each word they are worked out once."""

    def __init__(self, weights: np.ndarray | None = None) -> None:
        self.weights, self.known = weights, {}

    def of(self, text: str) -> set[int]:
        """The places a text fills; with weights, only those that weigh something."""
        words = set(WORD.findall(text.lower()))
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known, found = self.known, set()
        for word in words:
            places = known.get(word)
            if places is None:
                places = _features(word)
                if self.weights is not None:
                    places = tuple(p for p in places if self.weights[p])
                if len(word) <= 64:
                    known[word] = places
            found.update(places)
        return found


@dataclass(frozen=True)
class Model:
    """Bias and weights; the score is the logistic function of their sum over a text."""

    bias: float
    weights: np.ndarray

    def score(self, words: _Words, text: str) -> float:
        places = sorted(words.of(text))
        margin = self.bias + float(self.weights[places].sum(dtype=np.float64)) if places else self.bias
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


def _rows_with_each(rows: list[np.ndarray]) -> np.ndarray:
    """In how many rows each feature occurs, added up a few rows at a time."""
    found = np.zeros(PLACES, dtype=np.int64)
    for start in range(0, len(rows), 256):
        found += np.bincount(np.concatenate(rows[start : start + 256]), minlength=PLACES)
    return found


def telling_places(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    ratio: float = 4.0,
    deviations: float = 5.0,
) -> np.ndarray:
    """Which features are clearly more frequent in positive rows than in unlabelled ones.

    A feature must be ``ratio`` times as frequent, by ``deviations`` standard
    deviations. All others say nothing about toxicity, and their small weights
    would add up to noise in a long text.
    """
    ours, theirs = _rows_with_each(positive), _rows_with_each(unlabelled)
    share = ours / max(len(positive), 1)
    usual = (theirs + 1) / (len(unlabelled) + 2)
    spread = np.sqrt(usual * (1 - usual) / max(len(positive), 1))
    return (ours >= 2) & (share >= ratio * usual) & (share - usual >= deviations * spread)


def fit_nnpu(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    prior: float,
    epochs: int = 300,
    batches: int = 1,
    rate: float = 0.1,
    decay: float = 3e-4,
    seed: int = 11,
) -> Model:
    """Linear classifier from positive and unlabelled rows of feature places.

    The risk is prior * P(+ as +) + max(0, U(as -) - prior * P(+ as -)) with
    logistic losses: the negative part is what unlabelled rows cost as
    negatives, less what the positives among them would. Where a batch drives
    that difference below zero, the classifier has begun to learn positives as
    negatives by heart, and the step goes the other way instead. Steps are
    Adam's, over the telling features alone.
    """
    telling = telling_places(positive, unlabelled)
    positive, unlabelled = ([r[telling[r]] for r in rows] for rows in (positive, unlabelled))
    weights, bias = np.zeros(PLACES), np.log(prior / (1 - prior))
    mean, square = np.zeros(PLACES + 1), np.zeros(PLACES + 1)
    order = np.random.default_rng(seed)
    batches = max(1, min(batches, len(positive) // 8))
    step = 0
    for epoch in range(epochs):
        shrink = rate * (1 - epoch / epochs)
        cuts = [
            np.array_split(order.permutation(len(rows)), batches) for rows in (positive, unlabelled)
        ]
        for some, others in zip(*cuts, strict=True):
            if not len(some) or not len(others):
                continue
            chosen = [positive[i] for i in some] + [unlabelled[i] for i in others]
            places = np.concatenate(chosen)
            row = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
            margin = bias + np.bincount(row, weights[places], minlength=len(chosen))
            chance = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
            is_positive = np.arange(len(chosen)) < len(some)
            as_negative = np.logaddexp(0, margin)
            difference = as_negative[~is_positive].mean() - prior * as_negative[is_positive].mean()
            # Slopes of the two parts by the margin of each row.
            upward = np.where(is_positive, prior * (chance - 1) / len(some), 0)
            rest = np.where(is_positive, -prior * chance / len(some), chance / len(others))
            slope = upward + rest if difference >= 0 else -rest
            gradient = np.append(
                np.bincount(places, slope[row], minlength=PLACES) + decay * weights, slope.sum()
            )
            step += 1
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.99 * square + 0.01 * gradient**2
            move = (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
            weights -= shrink * move[:-1] * telling
            bias -= shrink * move[-1]
    return Model(float(bias), weights)


def _sample(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """A random sample of about ``most`` rows, the same on every run."""
    share = min(1.0, most / max(rows.count(), 1))
    lot = F.xxhash64(F.lit(seed), "_id", "_text")
    return rows.where(lot.cast("double") < F.lit((2 * share - 1) * 2.0**63)) if share < 1 else rows


def _gathered(rows: DataFrame) -> list[np.ndarray]:
    """Feature places of a bounded sample, worked out on the executors."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            found = [
                np.fromiter(sorted(words.of(t)), dtype="<i4").tobytes()
                for t in batch.column(0).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["places"])

    # Views of what Arrow received, so that the driver holds a sample once.
    packed = rows.select("_text").mapInArrow(features, "places binary").toArrow()["places"]
    return [np.frombuffer(p.as_buffer(), dtype="<i4") for p in packed]


def train(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    most_positive: int = 8_000,
    most_unlabelled: int = 16_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 11,
) -> Model:
    """Model from the confirmed toxic documents and unlabelled ones.

    ``learn`` says of a row of documents (column ``_id``) whether it may be
    learned from; the default is all. Labels give two things: which documents
    are confirmed toxic (1 in ``toxic``), and the class prior, their share among
    labelled documents. The unlabelled sample is drawn from all texts that may
    be learned from, whatever their labels. ``most_positive`` and
    ``most_unlabelled`` bound the samples, and the samples alone reach the driver.

    A document with several labels is toxic if any says so; labels that are null
    or of unknown documents do not count. Without any confirmed example the
    model scores all texts alike, at the prior.
    """
    rows = docs.select(
        column(id_col).alias("_id"), whole_text(text_col).alias("_text")
    ).where(F.lit(True) if learn is None else learn)
    marks = (
        labels.where(F.col("toxic").isNotNull() & column(id_col).isNotNull())
        .groupBy(column(id_col).alias("_labelled"))
        .agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    )
    marked = materialize(
        rows.select("_id").distinct().join(marks, F.col("_id") == F.col("_labelled")).select("_labelled", "_toxic"),
        "labels",
    )
    confirmed, known = marked.agg(
        F.coalesce(F.sum("_toxic"), F.lit(0)), F.count(F.lit(1))
    ).first()
    prior = min(max(confirmed / known if known else 0.01, 1e-4), 0.9)
    if not confirmed:
        return Model(float(np.log(prior / (1 - prior))), np.zeros(PLACES))
    toxic = rows.join(marked.where("_toxic = 1"), F.col("_id") == F.col("_labelled")).select("_id", "_text")
    positive = _gathered(_sample(toxic, most_positive, seed))
    unlabelled = _gathered(_sample(rows, most_unlabelled, seed + 1))
    return fit_nnpu(positive, unlabelled, prior)


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False
) -> DataFrame:
    """``doc_id`` and ``score`` of every row, from 0 to 1; higher is likelier toxic.

    A null text counts as empty, and an empty one gets the score of the bias
    alone. Nothing but the text enters the score. With ``keep`` the row's other
    columns follow in a struct ``kept``.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shipped.value)
        words = _Words(model.weights)
        for batch in batches:
            found = [model.score(words, t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(found, pa.float64())]
            names = ["doc_id", "score"]
            if keep:
                columns, names = [*columns, batch.column(2)], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(
        column(id_col).alias("doc_id"),
        whole_text(text_col),
        *([F.struct(*[column(c) for c in docs.columns]).alias("kept")] if keep else []),
    )
    given = rows.schema.fields
    schema = StructType([given[0], StructField("score", DoubleType()), *given[2:]])
    return rows.mapInArrow(scores, schema)


def learned_rows() -> Column:
    """Folds 0 and 2 of the CRC-32 of the id; fold 1 is held out."""
    return F.pmod(crc_of_id("_id"), F.lit(3)) != 1


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: every document scored, learned from two folds of three."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), learned_rows())
    return score(docs, model).select(
        "doc_id",
        (F.pmod(crc_of_id(), F.lit(3)) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
