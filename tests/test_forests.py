"""Forests grown level by level, against trees grown node by node."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskframe.learning import forests, models

TREES, DEPTH, SIZE = 4, 3, 5


@pytest.fixture(scope="module")
def points():
    draw = np.random.default_rng(5)
    x = draw.integers(0, 12, size=(700, SIZE)).astype(float)
    x[:, 4] = draw.normal(size=700)
    y = ((x[:, 0] > 5) ^ (x[:, 4] > 0.2) ^ (draw.random(700) < 0.2)).astype(int)
    return x, y, draw.uniform(0.5, 2.0, 700)


def table(spark, points, weights):
    made = [
        (i, a.tolist(), float(b), float(w)) for i, (a, b, w) in enumerate(zip(*points[:2], weights))
    ]
    df = spark.createDataFrame(made, "id long, x array<double>, target double, weight double")
    return df.select("id", array_to_vector("x").alias("features"), "target", "weight")


def grown(df, leaves):
    return forests.grow(df, leaves, TREES, DEPTH, "features", "target", "weight", seed=7)


def splits(nodes, at=0):
    node = nodes[at]
    if node["leftChild"] < 0:
        return node["prediction"]
    split = node["split"]
    return (
        split["featureIndex"], split["leftCategoriesOrThreshold"][0],
        splits(nodes, node["leftChild"]), splits(nodes, node["rightChild"]),
    )


def node_by_node(x, y, w, edges, subsets, leaf):
    def unlike(s):
        ones, both = w[s & (y == 1)].sum(), w[s].sum()
        return 2 * ones * (both - ones) / both if both else 0.0

    def at(node, level, rows):
        label = float(w[rows & (y == 1)].sum() > w[rows & (y == 0)].sum())
        best = (0, None)
        if level < DEPTH:
            for i in subsets[node]:
                for edge in edges[i]:
                    left = rows & (x[:, i] <= edge)
                    right = rows & ~left
                    if min(times[left].sum(), times[right].sum()) < leaf:
                        continue
                    gain = (unlike(rows) - unlike(left) - unlike(right)) / w[rows].sum()
                    if gain > best[0] + 1e-9:
                        best = (gain, (int(i), float(edge), left, right))
        if best[1] is None:
            return label
        i, edge, left, right = best[1]
        below, above = at(2 * node + 1, level + 1, left), at(2 * node + 2, level + 1, right)
        return below if not isinstance(below, tuple) and below == above else (i, edge, below, above)

    # Rows that were not drawn weigh nothing and count nothing.
    times = w[1]
    w = w[0] * times
    return at(0, 0, np.ones(len(y), bool))


@pytest.mark.parametrize("by_class", [True, False])
def test_trees_are_those_grown_node_by_node(spark, points, by_class):
    x, y, w = points
    w = np.where(y == 1, 1.5, 0.75) if by_class else w
    df = table(spark, points, w).repartition(3)
    keys = np.array([r[0] for r in df.orderBy("id").select(F.xxhash64("id")).collect()], np.int64)
    rows = df.select(vector_to_array("features").alias("x"))
    edges = forests.bin_edges(rows, SIZE)
    assert [len(e) for e in edges[:4]] == [11] * 4 and len(edges[4]) == 31
    draw = np.random.default_rng(7)
    hashes = draw.integers(0, 1 << 63, TREES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    subsets = draw.random((TREES, 2**DEPTH - 1, SIZE)).argsort(axis=2)[:, :, :3]
    found = grown(df, [1, 60])
    for leaf in (1, 60):
        for t in range(TREES):
            times = forests.drawn(keys.view(np.uint64), hashes[t]).astype(float)
            expected = node_by_node(x, y, (w, times), edges, subsets[t], leaf)
            assert splits(found[leaf][t]) == expected
            assert found[leaf][t][0]["rawCount"] == times.sum()
            assert found[leaf][t][0]["impurityStats"] == pytest.approx(
                [(w * times)[y == c].sum() for c in (0, 1)]
            )


def test_growing_together_and_partitions_change_nothing(spark, points):
    df = table(spark, points, np.where(points[1] == 1, 1.5, 0.75))
    together = grown(df.repartition(2), [1, 60])
    assert together[1] != together[60]
    for leaf in (1, 60):
        assert grown(df.repartition(5), [leaf])[leaf] == together[leaf]


def test_draws_are_poisson():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 400_000, dtype=np.uint64)
    a, b = (forests.drawn(keys, np.uint64(t)).astype(float) for t in (11, 12345678901234567))
    assert a.mean() == pytest.approx(1, abs=0.01) and a.var() == pytest.approx(1, abs=0.02)
    assert (a == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.01


def test_a_search_counts_rows_once_for_all_smallest_leaves(spark, points, monkeypatch):
    """Two smallest leaves of a forest on many rows are one growth until they differ."""
    df = table(spark, points, np.ones(700))
    counted, level = [], forests._level

    def watched(rows, tasks, growths, *rest):
        counted.append(len(growths))
        return level(rows, tasks, growths, *rest)

    monkeypatch.setattr(forests, "_level", watched)
    built = [
        models.forest({"n_estimators": TREES, "max_depth": 2, "min_samples_leaf": leaf}, 0)
        for leaf in (1, 2)
    ]
    found = models.FOREST.together(built, df)
    assert counted == [TREES, TREES]
    for estimator, saved in zip(built, found):
        assert saved.model.getMinInstancesPerNode() == estimator.getMinInstancesPerNode()
        assert saved.model.getNumTrees == TREES
        right = saved.model.transform(df).where("prediction = target").count()
        assert right > 0.7 * 700 * 0.75
