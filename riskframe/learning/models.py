"""The base classifiers and their parameter grids."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.ml import Estimator
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame

from riskframe.learning.forests import fit_together
from riskframe.learning.newton import NewtonClassifier
from riskframe.learning.trees import Cut, SavedTrees

LABEL, FEATURES, WEIGHT, FOLD = "target", "features", "weight", "fold"
KERNEL_FEATURES = "kernel_features"
SEED = 42
FOLDS = 5
Params = dict[str, float]


def logistic(params: Params, rows: float) -> Estimator:
    return NewtonClassifier(
        featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, C=float(params["C"])
    )


def tree(params: Params, rows: float, merged: bool = True) -> Estimator:
    """A tree; ``merged`` as a classifier does it, where two leaves of one class become one.

    Without, the splits above such leaves stay. Labels of 0 and 1 have a variance of half
    their Gini impurity, so a tree on their means has the same splits, and equal means
    are met only where a split gains nothing.
    """
    kind = DecisionTreeClassifier if merged else DecisionTreeRegressor
    return kind(
        featuresCol=FEATURES,
        labelCol=LABEL,
        weightCol=WEIGHT,
        maxDepth=int(params["max_depth"]),
        minInstancesPerNode=int(params["min_samples_leaf"]),
        seed=SEED,
    )


def forest(params: Params, rows: float) -> Estimator:
    return RandomForestClassifier(
        featuresCol=FEATURES,
        labelCol=LABEL,
        weightCol=WEIGHT,
        numTrees=int(params["n_estimators"]),
        maxDepth=int(params["max_depth"]),
        minInstancesPerNode=int(params["min_samples_leaf"]),
        featureSubsetStrategy="sqrt",
        seed=SEED,
    )


def svm(params: Params, rows: float) -> Estimator:
    """Linear machine on kernel features, which makes it one with the kernel."""
    return NewtonClassifier(
        featuresCol=KERNEL_FEATURES,
        labelCol=LABEL,
        weightCol=WEIGHT,
        C=float(params["C"]),
        loss="hinge",
    )


def cut_of(params: Params) -> Cut:
    """How far a deep fit has to be cut back to be this candidate."""
    trees = params.get("n_estimators")
    return Cut(
        int(params["max_depth"]),
        int(params.get("min_samples_split", 2)),
        None if trees is None else int(trees),
    )


@dataclass(frozen=True)
class Spec:
    """A classifier and its grid.

    Candidates that differ in the parameters of ``cut`` alone come from one fit with
    the largest of these, cut back. With a ``loss``, candidates are penalties ``C``
    of a linear model on the column ``features``, and all are solved together. Deep
    fits of the same rows may be grown ``together``.
    """

    name: str
    build: Callable[[Params, float], Estimator]
    grid: dict[str, Sequence[float]]
    cut: tuple[str, ...] = ()
    loss: str | None = None
    features: str = FEATURES
    #: Fits estimators that differ in what a cut cannot change, all at once.
    together: Callable[[Sequence[Estimator], DataFrame], list[SavedTrees]] | None = None

    def candidates(self) -> list[Params]:
        return [dict(zip(self.grid, values)) for values in product(*self.grid.values())]


# The grids searched.
LOGISTIC = Spec("logistic_regression", logistic, {"C": (0.1, 1, 10)}, loss="logistic")
TREE = Spec(
    "decision_tree",
    tree,
    {"max_depth": (3, 4, 5), "min_samples_split": (2, 5), "min_samples_leaf": (1, 2)},
    cut=("max_depth", "min_samples_split"),
)
FOREST = Spec(
    "random_forest",
    forest,
    {
        "n_estimators": (100, 200),
        "max_depth": (5, 6, 7),
        "min_samples_split": (2, 3),
        "min_samples_leaf": (1, 2),
    },
    cut=("n_estimators", "max_depth", "min_samples_split"),
    together=fit_together,
)
SVM = Spec("svm", svm, {"C": (0.1, 1, 10)}, loss="hinge", features=KERNEL_FEATURES)
SPECS = (LOGISTIC, TREE, FOREST, SVM)
