"""Trees cut back, against trees grown that far."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskframe.learning import models, training
from riskframe.learning.trees import Cut, SavedTrees

WIDTH = 4


@pytest.fixture(scope="module")
def points():
    draw = np.random.default_rng(11)
    x = draw.integers(0, 15, size=(300, WIDTH)).astype(float)
    y = ((x[:, 0] > 7) ^ (x[:, 1] > 9) ^ (draw.random(300) < 0.2)).astype(float)
    return x, y, draw.uniform(0.5, 2.0, 300)


@pytest.fixture(scope="module")
def rows(spark, points):
    made = [(x.tolist(), float(y), float(w)) for x, y, w in zip(*points, strict=True)]
    df = spark.createDataFrame(made, "x array<double>, target double, weight double")
    return df.select(array_to_vector("x").alias("features"), "target", "weight").coalesce(2)


def fit(rows, depth, leaf=1):
    return models.tree({"max_depth": depth, "min_samples_leaf": leaf}, 0).fit(rows)


def text(model):
    return model.toDebugString.split("\n", 1)[1]


def grown(points, depth, least, leaf):
    """A tree grown step by step, as nested tuples: (feature, threshold, left, right) or a class."""

    def gini(w, y):
        one, all_ = w[y == 1].sum(), w.sum()
        return 1 - (one / all_) ** 2 - (1 - one / all_) ** 2 if all_ else 0.0

    def grow(x, y, w, level):
        label = int(w[y == 1].sum() > w[y == 0].sum())
        if level == depth or len(y) < least:
            return label
        best = None
        for feature in range(x.shape[1]):
            values = np.unique(x[:, feature])
            for value in values[:-1]:
                left = x[:, feature] <= value
                if min(left.sum(), (~left).sum()) < leaf:
                    continue
                parts = sum(w[s].sum() * gini(w[s], y[s]) for s in (left, ~left)) / w.sum()
                gain = gini(w, y) - parts
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, feature, left)
        if best is None:
            return label
        _, feature, left = best
        below, above = grow(x[left], y[left], w[left], level + 1), grow(x[~left], y[~left], w[~left], level + 1)
        if not isinstance(below, tuple) and below == above:
            return below
        return (feature, x[left, feature].max(), below, above)

    return grow(*points, 0)


def as_grown(tree, node=0):
    row = tree.rows[node]
    if row["leftChild"] < 0:
        return int(row["prediction"])
    split = row["split"]
    # Thresholds lie between two values.
    below = np.floor(split["leftCategoriesOrThreshold"][0])
    return (split["featureIndex"], below, as_grown(tree, row["leftChild"]), as_grown(tree, row["rightChild"]))


@pytest.mark.parametrize("leaf", [1, 4])
def test_smaller_depths_are_the_deep_tree_cut_back(spark, rows, leaf):
    deep = SavedTrees(spark, fit(rows, 6, leaf))
    for depth in range(1, 7):
        cut = deep.cut_back(Cut(depth))
        assert text(cut) == text(fit(rows, depth, leaf)), depth
        assert cut.getMaxDepth() == depth


@pytest.mark.parametrize("leaf", [1, 3])
@pytest.mark.parametrize("least", [2, 5, 20, 60])
def test_minimum_rows_to_split(spark, rows, points, least, leaf):
    deep = SavedTrees(spark, fit(rows, 5, leaf))
    for depth in (3, 5):
        cut = SavedTrees(spark, deep.cut_back(Cut(depth, least)))
        assert as_grown(cut.trees[0]) == grown(points, depth, least, leaf)


def test_classes_of_cuts_are_those_of_the_models_cut_back(spark, rows):
    cuts = [Cut(6), Cut(4, 30), Cut(2), Cut(0), Cut(6, 10_000)]
    for model in (fit(rows, 6), models.forest({"n_estimators": 12, "max_depth": 6, "min_samples_leaf": 2}, 0).fit(rows)):
        saved = SavedTrees(spark, model)
        of = [c if not saved.is_forest else Cut(c.depth, c.least_to_split, 12 - i) for i, c in enumerate(cuts)]
        reached, classes = saved.classes(rows, of)
        reached = reached.withColumn("classes", classes)
        for i, cut in enumerate(of):
            back = saved.cut_back(cut)
            got = back.transform(reached).select(F.col("classes")[i].cast("double").alias("c"), "prediction")
            assert got.where("c <> prediction").count() == 0, cut
        assert training.cut_precisions(saved, rows, of) == training.precisions(
            [saved.cut_back(c) for c in of], rows
        )


def test_rows_go_through_trees_without_a_column_of_leaves(spark, rows):
    """Two hundred leaves of each row as doubles were most of what a search's scores took."""
    saved = SavedTrees(spark, models.forest({"n_estimators": 3, "max_depth": 3, "min_samples_leaf": 1}, 0).fit(rows))
    reached, _ = saved.classes(rows, [Cut(3, 2, 3)])
    assert reached.columns == rows.columns


def test_categories_are_split_as_spark_does(spark, points):
    x, y, _ = points
    made = [(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame(made, "x array<double>, target double")
    df = df.select(array_to_vector("x").alias("raw"), "target", F.lit(1.0).alias("weight"))
    coded = VectorIndexer(inputCol="raw", outputCol="features", maxCategories=20).fit(df).transform(df)
    saved = SavedTrees(spark, fit(coded, 4))
    assert any(r["split"]["numCategories"] > 0 for r in saved.trees[0].rows)
    reached, classes = saved.classes(coded, [Cut(4)])
    reached = saved.model.transform(reached.withColumn("own", classes[0]))
    assert reached.where("own <> prediction").count() == 0


def test_a_forest_keeps_its_first_trees(spark, rows, tmp_path):
    forest = models.forest({"n_estimators": 6, "max_depth": 4, "min_samples_leaf": 1}, 0).fit(rows)
    cut = SavedTrees(spark, forest).cut_back(Cut(4, 2, 3))
    assert cut.getNumTrees == 3 and len(cut.trees) == 3
    assert [text(t) for t in cut.trees] == [text(t) for t in forest.trees[:3]]
    assert cut.featureImportances.toArray().sum() == pytest.approx(1)
    cut.write().save(f"{tmp_path}/again")
    again = type(cut).load(f"{tmp_path}/again")
    assert again.toDebugString == cut.toDebugString


def test_search_equals_separate_fits(spark, rows):
    """The whole grid of the tree, against a fit for each candidate whose minimum is 2."""
    folded = rows.withColumn("fold", (F.monotonically_increasing_id() % training.FOLDS).cast("int"))
    from riskframe.session import materialize

    stored = materialize(folded, "folded")
    train = training.TrainingSet(stored, None, stored.count())
    found = training.grid_search(train, models.TREE)
    assert len(models.TREE.candidates()) == 12 and len(models.FOREST.candidates()) == 24
    assert found.params in models.TREE.candidates()
    plain = models.Spec("decision_tree", models.tree, {"max_depth": (3, 4, 5), "min_samples_split": (2,), "min_samples_leaf": (1, 2)})
    apart = training.grid_search(train, plain)
    same = models.Spec("decision_tree", models.tree, plain.grid, cut=models.TREE.cut)
    together = training.grid_search(train, same)
    assert together.params == apart.params
    assert together.cv_precision == pytest.approx(apart.cv_precision, abs=1e-12)
    assert text(together.model) == text(apart.model)
    for a, b in zip(together.fold_models, apart.fold_models, strict=True):
        assert text(a) == text(b)
    assert found.cv_precision >= together.cv_precision - 1e-12


def test_a_root_stays_where_all_leaves_are_of_one_class(spark):
    """Nine of ten labels are 1 on either side, or a few less: a classifier merges all of it."""
    made = [([float(i % 2), float(i % 7)], float(i % 10 > 0 and i % 22 > 1)) for i in range(770)]
    df = spark.createDataFrame(made, "x array<double>, target double").select(
        array_to_vector("x").alias("features"), "target", F.lit(1.0).alias("weight")
    )
    assert len(SavedTrees(spark, fit(df, 1)).trees[0].rows) == 1
    whole = models.tree({"max_depth": 1, "min_samples_leaf": 1}, 0, merged=False).fit(df)
    root, left, right = SavedTrees(spark, whole).trees[0].rows
    assert root["split"]["featureIndex"] == 0 and left["rawCount"] == right["rawCount"] == 385
    cases = [sum(y for x, y in made if x[0] == side) for side in (0.0, 1.0)]
    assert [n["impurityStats"][1] for n in (left, right)] == pytest.approx(cases)
    gini = [2 * (c / 385) * (1 - c / 385) for c in cases]
    share = sum(cases) / 770
    assert root["gain"] == pytest.approx(2 * share * (1 - share) - sum(gini) / 2)
    assert {n["prediction"] for n in (root, left, right)} == {1.0}
