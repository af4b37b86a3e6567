"""Feature vectors, grid search and ensembles."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.learning.kernel import Nystrom, NystromModel
from riskframe.learning.models import (
    FEATURES,
    FOLD,
    FOLDS,
    KERNEL_FEATURES,
    LABEL,
    SEED,
    SVM,
    WEIGHT,
    Params,
    Spec,
    cut_of,
)
from riskframe.learning.newton import NewtonClassifier, Problem, fit_linear, linear_model
from riskframe.learning.stages import SoftVote
from riskframe.learning.trees import Cut, SavedTrees
from riskframe.operators.joins import BROADCAST_ROWS, at_most, attach_lookup
from riskframe.operators.metrics import class_weights
from riskframe.operators.sampling import assign_folds
from riskframe.session import materialize

NOT_FEATURES = ("id", LABEL, "created_at")
#: Landmarks of the kernel machine, at most.
LANDMARKS = 256


def feature_columns(df: DataFrame, exclude: Sequence[str] = NOT_FEATURES) -> list[str]:
    return [c for c in df.columns if c not in exclude]


def numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Flags and codes as numbers, as the assembler takes them."""
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


@dataclass(frozen=True)
class TrainingSet:
    """Numeric rows with feature vector, class weight and fold, stored once."""

    rows: DataFrame
    assembler: VectorAssembler
    size: int
    #: What makes a linear model's features out of the assembled ones.
    mapped: Callable[[np.ndarray], np.ndarray] = lambda x: x

    @property
    def columns(self) -> list[str]:
        return self.assembler.getInputCols()

    def outside(self, fold: int) -> DataFrame:
        return self.rows.where(F.col(FOLD) != fold)

    def inside(self, fold: int) -> DataFrame:
        return self.rows.where(F.col(FOLD) == fold)

    @property
    def fold_size(self) -> float:
        """Rows a fold's model is trained on."""
        return self.size * (FOLDS - 1) / FOLDS


def training_set(train: DataFrame, cols: Sequence[str] | None = None) -> TrainingSet:
    """Prepare ``train``, which should be a stored table: it is read several times."""
    cols = list(cols or feature_columns(train))
    assembler = VectorAssembler(inputCols=cols, outputCol=FEATURES, handleInvalid="error")
    folded = assign_folds(numeric(train, cols), LABEL, FOLDS, SEED)
    weights = class_weights(train, LABEL).select(LABEL, F.col("weight").alias(WEIGHT))
    prepared = attach_lookup(folded, weights, LABEL, at_most(weights, BROADCAST_ROWS))
    # One folder per fold, so that a fold's rows are found by partition pruning.
    stored = materialize(prepared, "training", partition_by=[FOLD])
    rows = assembler.transform(stored).withColumn(LABEL, F.col(LABEL).cast("double"))
    return TrainingSet(rows, assembler, stored.count())


# --- grid search ---------------------------------------------------------


@dataclass(frozen=True)
class SearchResult:
    """The chosen candidate, fitted on all rows and once without each fold."""

    name: str
    params: Params
    cv_precision: float
    model: Model
    fold_models: list[Model]


def precisions(models: Sequence[Model], rows: DataFrame) -> list[float]:
    """Precision of class 1 for every model, all in one pass over the rows."""
    scored, cells = rows, []
    for i, model in enumerate(models):
        out = f"_prediction{i}"
        quiet = model.copy().setPredictionCol(out).setRawPredictionCol("")
        if quiet.hasParam("probabilityCol"):
            quiet = quiet.setProbabilityCol("")
        scored = quiet.transform(scored)
        cells.append(precision_of(F.col(out) == 1).alias(out))
    return list(scored.agg(*cells).first())


def in_threads(tasks: Iterable[Callable[[], Any]], parallelism: int) -> list:
    """Submit several Spark jobs at a time from the driver, in order of results."""
    with ThreadPoolExecutor(parallelism) as pool:
        return [future.result() for future in [pool.submit(task) for task in tasks]]


def grid_search(train: TrainingSet, spec: Spec, parallelism: int = 8) -> SearchResult:
    """The candidate with the best mean precision over the folds, refitted on all rows.

    Candidates share what they can: those that are one deep tree or forest cut
    back share its fit, and all penalties and folds of a logistic regression
    share their passes. The candidates of a fold are scored together, the rows of a
    fold are picked by a plain filter, and the best candidate's fold models are
    kept, which stacking and calibration need again.
    """
    if spec.cut:
        return _search_cuts(train, spec, parallelism)
    candidates = spec.candidates()
    if spec.loss:
        problems = [
            Problem(params["C"], fold) for fold in (*range(FOLDS), None) for params in candidates
        ]
        found = fit_linear(
            train.rows, problems, FEATURES, LABEL, WEIGHT, FOLD, spec.loss, train.mapped
        )
        fitted = [
            linear_model(train.rows, x, spec.features, LABEL, WEIGHT, spec.loss) for x in found
        ]
    else:
        fits = [
            lambda fold=fold, params=params: spec.build(params, train.fold_size).fit(
                train.outside(fold)
            )
            for fold in range(FOLDS)
            for params in candidates
        ]
        fitted = in_threads(fits, parallelism)
    by_fold = [fitted[i : i + len(candidates)] for i in range(0, len(fitted), len(candidates))]
    scores = [precisions(by_fold[fold], train.inside(fold)) for fold in range(FOLDS)]
    means = [sum(column) / FOLDS for column in zip(*scores)]
    best = means.index(max(means))
    if spec.loss:
        model = by_fold[FOLDS][best]
    else:
        model = spec.build(candidates[best], train.size).fit(train.rows)
    return SearchResult(
        spec.name, candidates[best], means[best], model,
        [by_fold[fold][best] for fold in range(FOLDS)],
    )


def _search_cuts(train: TrainingSet, spec: Spec, parallelism: int) -> SearchResult:
    """Search over candidates that come from a few deep fits."""
    spark = train.rows.sparkSession
    candidates = spec.candidates()
    # Candidates by what a cut cannot change.
    families: dict[tuple, list[int]] = {}
    for i, params in enumerate(candidates):
        rest = tuple((k, v) for k, v in params.items() if k not in spec.cut)
        families.setdefault(rest, []).append(i)
    largest = {k: max(spec.grid[k]) for k in spec.cut if k != "min_samples_split"}

    def fitted(rows: DataFrame, some: Sequence[tuple], size: float) -> list[SavedTrees]:
        built = [spec.build({**dict(family), **largest}, size) for family in some]
        if spec.together:
            return spec.together(built, rows)
        return [SavedTrees(spark, estimator.fit(rows)) for estimator in built]

    groups = [list(families)] if spec.together else [[family] for family in families]
    tasks = [
        lambda fold=fold, group=group: fitted(train.outside(fold), group, train.fold_size)
        for fold in range(FOLDS)
        for group in groups
    ]
    deep = [saved for found in in_threads(tasks, parallelism) for saved in found]
    models = {
        (fold, family): deep[fold * len(families) + j]
        for fold in range(FOLDS)
        for j, family in enumerate(families)
    }

    def scores(fold: int, family: tuple) -> list[float]:
        cuts = [cut_of(candidates[i]) for i in families[family]]
        return cut_precisions(models[fold, family], train.inside(fold), cuts)

    scored = in_threads(
        [lambda fold=f, family=g: scores(fold, family) for f in range(FOLDS) for g in families],
        parallelism,
    )
    sums = [0.0] * len(candidates)
    for at, values in enumerate(scored):
        family = list(families)[at % len(families)]
        for i, value in zip(families[family], values, strict=True):
            sums[i] += value
    best = sums.index(max(sums))
    params = candidates[best]
    family = next(f for f, members in families.items() if best in members)
    whole = fitted(train.rows, [family], train.size)[0]
    cut = cut_of(params)
    fold_models = in_threads(
        [lambda fold=fold: models[fold, family].cut_back(cut) for fold in range(FOLDS)], parallelism
    )
    return SearchResult(spec.name, params, sums[best] / FOLDS, whole.cut_back(cut), fold_models)


def cut_precisions(saved: SavedTrees, rows: DataFrame, cuts: Sequence[Cut]) -> list[float]:
    """Precision of class 1 of a deep model after each cut, all in one pass over the rows."""
    rows, classes = saved.classes(rows, cuts)
    cells = []
    for i in range(len(cuts)):
        positive = F.col("_classes")[i] == 1
        cells.append(precision_of(positive).alias(f"_{i}"))
    return list(rows.select(LABEL, classes.alias("_classes")).agg(*cells).first())


def precision_of(positive: Column) -> Column:
    """Share of label 1 among the rows held positive; 0 where none is."""
    true = F.count_if(positive & (F.col(LABEL) == 1))
    return F.coalesce(F.try_divide(true, F.count_if(positive)), F.lit(0.0))


# --- models ready for scoring --------------------------------------------


def renamed(model: Model, prefix: str) -> Model:
    """The model with output columns of its own, so that several fit in one pipeline."""
    return (
        model.copy()
        .setPredictionCol(f"{prefix}_prediction")
        .setRawPredictionCol(f"{prefix}_raw")
        .setProbabilityCol(f"{prefix}_probability")
    )


def scorer(train: TrainingSet, model: Model) -> PipelineModel:
    return PipelineModel([train.assembler, model])


def soft_vote(train: TrainingSet, bases: Sequence[SearchResult]) -> PipelineModel:
    """Equal-weight mean of the models' probabilities."""
    voters = [renamed(base.model, base.name) for base in bases]
    vote = SoftVote(inputCols=[f"{base.name}_probability" for base in bases])
    return PipelineModel([train.assembler, *voters, vote])


def logistic_gradient(train: TrainingSet, model: Model, C: float) -> float:
    """Largest slope of the penalised loss at the fitted coefficients, in one aggregate.

    Per unit of weight, and per feature in units of its root mean square.
    """
    scored = model.transform(train.rows)
    off = F.col(WEIGHT) * (vector_to_array(model.getProbabilityCol())[1] - F.col(LABEL))
    cols = train.columns
    sums = scored.agg(
        F.sum(WEIGHT).alias("_weight"),
        F.sum(off).alias("_intercept"),
        *[F.sum(off * F.col(c)).alias(f"_g{i}") for i, c in enumerate(cols)],
        *[F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"_s{i}") for i, c in enumerate(cols)],
    ).first()
    unit = C * sums["_weight"]
    slopes = [abs(C * sums["_intercept"] + model.intercept) / unit]
    for i, beta in enumerate(model.coefficients.toArray()):
        if sums[f"_s{i}"]:
            slopes.append(abs(C * sums[f"_g{i}"] + float(beta)) / sums[f"_s{i}"] / unit)
    return max(slopes)


def out_of_fold(train: TrainingSet, models: Callable[[int], Sequence[Model]]) -> DataFrame:
    """Every training row, scored by models that did not see it; ``left_out`` is their fold."""

    def scored(fold: int) -> DataFrame:
        rows = train.inside(fold).withColumn("left_out", F.lit(fold))
        return reduce(lambda df, model: model.transform(df), models(fold), rows)

    return reduce(DataFrame.unionByName, [scored(fold) for fold in range(FOLDS)])


def unseen_scores(train: TrainingSet, bases: Sequence[SearchResult]) -> DataFrame:
    """Training rows with each base's probability by the model that did not see them."""
    return out_of_fold(
        train, lambda fold: [renamed(base.fold_models[fold], base.name) for base in bases]
    )


def fit_stacking(
    train: TrainingSet, bases: Sequence[SearchResult], unseen: DataFrame | None = None
) -> PipelineModel:
    """A balanced logistic regression on out-of-fold probabilities of the bases.

    New rows are scored by the bases fitted on all rows. Who has stored ``unseen_scores`` hands
    them in, so that they are not made again.
    """
    if unseen is None:
        unseen = unseen_scores(train, bases)
    joined = VectorAssembler(
        inputCols=[f"{base.name}_probability" for base in bases], outputCol="_all_probabilities"
    )
    # Each probability vector has two entries; keep those of class 1.
    slicer = VectorSlicer(
        inputCol="_all_probabilities",
        outputCol="_base_scores",
        indices=[2 * i + 1 for i in range(len(bases))],
    )
    scored = slicer.transform(joined.transform(unseen))
    inputs = materialize(scored.select("_base_scores", LABEL, WEIGHT), "stacking")
    final = LogisticRegression(
        featuresCol="_base_scores",
        labelCol=LABEL,
        weightCol=WEIGHT,
        regParam=1.0 / train.size,
        standardization=False,
    ).fit(inputs)
    voters = [renamed(base.model, base.name) for base in bases]
    return PipelineModel([train.assembler, *voters, joined, slicer, final])


def with_kernel(train: TrainingSet, size: int) -> tuple[TrainingSet, NystromModel]:
    stage = Nystrom(
        featuresCol=FEATURES, outputCol=KERNEL_FEATURES, size=size, seed=SEED
    ).fit(train.rows)
    mapped = stage.transform(train.rows)
    return TrainingSet(mapped, train.assembler, train.size, stage.mapping()), stage


def fit_svm(
    train: TrainingSet, spec: Spec = SVM, size: int = LANDMARKS, parallelism: int = 8
) -> tuple[SearchResult, PipelineModel]:
    """Support vector machine with a Gaussian kernel and probabilities.

    The kernel is that of standardised columns, approximated by ``size`` landmarks
    at most. The margins are turned into probabilities by a logistic regression on
    out-of-fold margins (Platt, 1999).
    """
    mapped, stage = with_kernel(train, size)
    found = grid_search(mapped, spec, parallelism)
    # The raw prediction is [-margin, margin].
    slicer = VectorSlicer(inputCol="rawPrediction", outputCol="_margin", indices=[1])
    unseen = out_of_fold(mapped, lambda fold: [found.fold_models[fold]])
    inputs = slicer.transform(unseen).select("_margin", LABEL, WEIGHT)
    calibration = NewtonClassifier(featuresCol="_margin", labelCol=LABEL, weightCol=WEIGHT).fit(
        materialize(inputs, "margins")
    )
    calibration.setRawPredictionCol("_calibrated_raw").setPredictionCol("_calibrated")
    return found, PipelineModel([train.assembler, stage, found.model, slicer, calibration])
