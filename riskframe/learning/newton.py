"""Linear classifiers by Newton's method, for many penalties and folds at once.

Minimised is, for each problem, half the squared length of the coefficients,
intercept included, plus C times the weighted sum of the losses. Each pass over
the rows brings value, gradient and curvature of all problems that are still
open: a grid of penalties with its folds takes as many scans as the slowest of
its problems, not as many as there are problems.

Losses are ``logistic`` and ``hinge``, the latter rounded off where it bends, as
proposed for training on the primal (Chapelle, 2007).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.classification import LinearSVCModel, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A fit is at rest once no slope is steeper than this, per unit of weight and of a column's
#: root mean square. Where the hinge bends its curvature jumps, and the end is slow.
AT_REST = {"logistic": 1e-11, "hinge": 1e-8}
#: Passes after which a fit that is not at rest is an error.
MOST_PASSES = 200
#: Half the width of the bend of the hinge.
BEND = 0.5
#: Sums of tasks that are added up in one group, about, and those that are left to the driver.
FANIN, FEW = 64, 8
#: Rows whose sums are taken in one step.
STEP_ROWS = 2048


@dataclass(frozen=True)
class Problem:
    """Penalty and the fold whose rows are left out, if any."""

    C: float
    left_out: int | None = None


Mapping = Callable[[np.ndarray], np.ndarray]


def logistic_loss(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log(1 + exp(-m)), its fall and its curvature, without overflow."""
    small = np.exp(-np.abs(margin))
    fall = np.where(margin >= 0, small, 1.0) / (1 + small)
    return np.log1p(small) + np.maximum(-margin, 0), fall, fall * (1 - fall)


def hinge_loss(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """max(0, 1 - m) with a bend of width 2 * ``BEND``, its fall and its curvature."""
    short = 1 + BEND - margin
    bent = (short > 0) & (short < 2 * BEND)
    loss = np.where(bent, short**2 / (4 * BEND), np.maximum(1 - margin, 0))
    fall = np.clip(short / (2 * BEND), 0, 1)
    return loss, fall, np.where(bent, 1 / (2 * BEND), 0.0)


LOSSES = {"logistic": logistic_loss, "hinge": hinge_loss}


def added_up(partials: DataFrame, tasks: int) -> dict[int, np.ndarray]:
    """Sum of the arrays ``sums`` (as bytes) of each ``key``, added up as a tree.

    ``tasks`` is the number of tasks that make them. No group holds more than about
    ``FANIN`` arrays, and a few arrays of each key reach the driver.
    """

    def total(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py()) for x in table.column("sums")]
        sums = pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())
        return table.slice(0, 1).select(["key", "part"]).append_column("sums", sums)

    partials = partials.select("key", F.spark_partition_id().alias("part"), "sums")
    while tasks > FEW:
        tasks = -(-tasks // FANIN)
        groups = partials.withColumn("part", F.pmod("part", F.lit(tasks))).groupBy("key", "part")
        partials = groups.applyInArrow(total, "key int, part int, sums binary")
    out: dict[int, np.ndarray] = {}
    for row in partials.collect():
        out[row["key"]] = out.get(row["key"], 0) + np.frombuffer(row["sums"])
    return out


def _scales(rows: DataFrame, mapped: Mapping) -> tuple[np.ndarray, float, int]:
    """Root mean square of each feature and 1 for the intercept, all weight, and the tasks."""

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, _, weight, _ = _arrays(batch, mapped)
            own = np.concatenate([[1.0, weight.sum()], [len(x)], (x * x).sum(axis=0)])
            total = own if total is None else total + own
        if total is not None:
            yield _partial(0, total)

    tasks = rows.rdd.getNumPartitions()
    sums = added_up(rows.mapInArrow(squares, _SUMS), tasks).get(0)
    if sums is None:
        raise ValueError("no rows to learn from")
    means = sums[3:] / sums[2]
    means[means == 0] = 1.0
    return np.sqrt(np.append(means, 1.0)), float(sums[1]), int(sums[0])


_SUMS = "key int, sums binary"


def _partial(key: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([key], pa.int32()), pa.array([sums.tobytes()], pa.binary())],
        names=["key", "sums"],
    )


def _arrays(batch: pa.RecordBatch, mapped: Mapping) -> tuple[np.ndarray, ...]:
    """Features, label (1 or -1), weight and fold of a batch."""
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False)
    x = mapped(x.reshape(batch.num_rows, -1))
    label = batch.column(1).to_numpy(zero_copy_only=False)
    return (
        x,
        np.where(label == 1, 1.0, -1.0),
        batch.column(2).to_numpy(zero_copy_only=False),
        batch.column(3).to_numpy(zero_copy_only=False),
    )


def _evaluated(
    rows: DataFrame,
    scales: np.ndarray,
    at: dict[int, tuple[np.ndarray, int | None]],
    tasks: int,
    loss_of: Callable,
    mapped: Mapping,
) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and curvature of the losses of several problems, in one pass."""
    upper = np.triu_indices(len(scales))

    def of_rows(x, sign, weight, fold) -> Iterator[tuple[int, np.ndarray]]:
        for key, (beta, left_out) in at.items():
            own = weight if left_out is None else np.where(fold == left_out, 0.0, weight)
            loss, fall, bend = loss_of(sign * (x @ beta))
            slope = -(own * sign * fall) @ x
            # Rows left out or off the bend have no curvature; a product of a matrix with
            # itself takes half the work of another.
            bend = own * bend
            bent = np.flatnonzero(bend)
            rooted = x[bent] * np.sqrt(bend[bent])[:, None]
            curve = rooted.T @ rooted
            yield key, np.concatenate([[own @ loss], slope, curve[upper]])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, sign, weight, fold = _arrays(batch, mapped)
            x = np.hstack([x, np.ones((len(x), 1))]) / scales
            for start in range(0, len(x), STEP_ROWS):
                some = slice(start, start + STEP_ROWS)
                for key, found in of_rows(x[some], sign[some], weight[some], fold[some]):
                    totals[key] = totals[key] + found if key in totals else found
        for key, found in totals.items():
            yield _partial(key, found)

    out = {}
    for key, found in added_up(rows.mapInArrow(sums, _SUMS), tasks).items():
        size = len(scales)
        curve = np.zeros((size, size))
        curve[upper] = found[1 + size :]
        out[key] = (found[0], found[1 : 1 + size], curve + np.triu(curve, 1).T)
    return out


def fit_linear(
    df: DataFrame,
    problems: Sequence[Problem],
    features: str = "features",
    label: str = "target",
    weight: str | None = None,
    fold: str | None = None,
    loss: str = "logistic",
    mapped: Mapping = lambda x: x,
) -> list[np.ndarray]:
    """Coefficients of each problem, the intercept last.

    ``df`` is read once per step and should be stored. Steps solve the curvature's
    equations, damped until the loss falls; columns are scaled for that, which
    changes nothing in the result. A fit that does not come to rest is an error.
    Problems that leave a fold out wait for the one of the same penalty that leaves out none,
    and start from its end, which is near theirs; where they end does not depend on that.
    ``mapped`` makes the features that are learned from out of those that are
    stored, batch by batch, so that wide ones need not be stored or moved.
    A table of d features sends d * d / 2 numbers per problem and task.
    """
    rows = df.select(
        vector_to_array(F.col(features)).alias("x"),
        F.col(label).cast("double").alias("y"),
        (F.lit(1.0) if weight is None else F.col(weight)).cast("double").alias("w"),
        (F.lit(-1) if fold is None else F.col(fold)).cast("int").alias("f"),
    )
    loss_of, rest = LOSSES[loss], AT_REST[loss]
    scales, all_weight, tasks = _scales(rows, mapped)
    size = len(scales)
    ridge = 1.0 / scales**2

    def value(problem: Problem, beta: np.ndarray, found: tuple) -> tuple:
        total, slope, curve = found
        return (
            0.5 * (ridge * beta) @ beta + problem.C * total,
            ridge * beta + problem.C * slope,
            np.diag(ridge) + problem.C * curve,
        )

    betas = {i: np.zeros(size) for i in range(len(problems))}
    damping = dict.fromkeys(betas, 0.0)
    state: dict[int, tuple] = {}
    whole = {problem.C: i for i, problem in enumerate(problems) if problem.left_out is None}
    waiting: dict[int, list[int]] = {}
    for i, problem in enumerate(problems):
        if problem.left_out is not None and problem.C in whole:
            waiting.setdefault(whole[problem.C], []).append(i)
    later = {i for some in waiting.values() for i in some}
    trial = {i: beta for i, beta in betas.items() if i not in later}
    rejected = dict.fromkeys(betas, 0)
    # Those that wait get as many passes as those that they wait for.
    for _ in range(MOST_PASSES * (2 if later else 1)):
        at = {i: (beta, problems[i].left_out) for i, beta in trial.items()}
        found = _evaluated(rows, scales, at, tasks, loss_of, mapped)
        for i, beta in list(trial.items()):
            problem = problems[i]
            # A fold may hold all rows; then the loss is nothing.
            none = (0.0, np.zeros(size), np.zeros((size, size)))
            new = value(problem, beta, found.get(i, none))
            old = state.get(i)
            unit = problem.C * all_weight
            steep = np.abs(new[1]).max()
            better = old is None or new[0] <= old[0] + 1e-14 * abs(old[0])
            # Near the end the loss can no longer tell, but the slope can.
            if not better and np.abs(new[0] - old[0]) <= 1e-9 * abs(old[0]):
                better = steep < np.abs(old[1]).max()
            if better:
                betas[i], state[i], rejected[i] = beta, new, 0
                damping[i] = damping[i] / 10 if damping[i] > 1e-12 else 0.0
            else:
                rejected[i] += 1
                damping[i] = max(10 * damping[i], 1e-6)
            best = np.abs(state[i][1]).max()
            # Rounding sets in where a step can no longer lower either.
            if best <= rest * unit or (rejected[i] >= 8 and best <= 1e3 * rest * unit):
                del trial[i]
                for j in waiting.pop(i, []):
                    betas[j] = trial[j] = betas[i]
                continue
            _, slope, curve = state[i]
            # Scaled to a unit diagonal, the equations are as well posed as they can be.
            root = 1.0 / np.sqrt(np.diag(curve))
            posed = curve * np.outer(root, root) + damping[i] * np.eye(size)
            trial[i] = betas[i] - root * np.linalg.solve(posed, root * slope)
        if not trial:
            return [betas[i] / scales for i in range(len(problems))]
    raise RuntimeError(f"not at rest after {MOST_PASSES} passes: {[problems[i] for i in trial]}")


MODELS = {"logistic": LogisticRegressionModel, "hinge": LinearSVCModel}


def linear_model(
    df: DataFrame,
    coefficients: np.ndarray,
    features: str,
    label: str,
    weight: str | None,
    loss: str = "logistic",
) -> LogisticRegressionModel | LinearSVCModel:
    """Spark's own model with these coefficients, the intercept last."""
    context = df.sparkSession.sparkContext
    kind = MODELS[loss]
    made = getattr(context._jvm.org.apache.spark.ml.classification, kind.__name__)(
        f"{kind.__name__}_{np.random.default_rng().integers(1 << 48):012x}",
        _py2java(context, Vectors.dense(coefficients[:-1].tolist())),
        float(coefficients[-1]),
    )
    model = kind(made)
    model._set(featuresCol=features, labelCol=label)
    if weight is not None:
        model._set(weightCol=weight)
    model._transfer_params_to_java()
    return model


class NewtonClassifier(
    Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable
):
    """L2-penalised linear classifier, intercept penalised too, solved to rest.

    ``C`` scales the sum of the weighted losses, of the kind ``loss`` names.
    """

    C = Param(Params._dummy(), "C", "weight of the losses", TypeConverters.toFloat)
    loss = Param(Params._dummy(), "loss", "logistic or hinge", TypeConverters.toString)

    @keyword_only
    def __init__(
        self,
        *,
        featuresCol: str = "features",
        labelCol: str = "label",
        weightCol: str | None = None,
        C: float = 1.0,
        loss: str = "logistic",
    ):
        super().__init__()
        self._setDefault(C=1.0, loss="logistic")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> LogisticRegressionModel | LinearSVCModel:
        names = (
            self.getFeaturesCol(),
            self.getLabelCol(),
            self.getWeightCol() if self.isDefined(self.weightCol) else None,
        )
        loss = self.getOrDefault(self.loss)
        found = fit_linear(dataset, [Problem(self.getOrDefault(self.C))], *names, loss=loss)
        return linear_model(dataset, found[0], *names, loss)
