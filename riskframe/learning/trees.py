"""Trees cut back: one deep fit serves all depths and minimum rows to split of a grid.

A tree is grown greedily: whether and how a node is split depends on its own
rows alone. So the tree of a smaller depth, or of a larger minimum of rows to
split a node, is the deep tree with some of its inner nodes made leaves, and
every node knows its class counts and its rows. This is exact for a single
tree that looks at all features. A forest draws features and rows for the nodes
in the order they are grown in; one that is cut back is a forest of that size and
depth, with other draws than a forest fitted to them would have made.

What is handled here is the model, whose size follows from the grid alone. The
rows are read by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from copy import copy
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from riskframe.session import scratch_path

#: Rows that go through the trees in one step, which fit a core's cache.
STEP_ROWS = 2048


@dataclass(frozen=True)
class Cut:
    """How far a model is cut back."""

    depth: int
    least_to_split: int = 2
    trees: int | None = None


@dataclass(frozen=True)
class Steps:
    """A tree for rows to go through: for each node its feature and threshold, and both children one
    after another; a leaf's are itself. Where categories are split, those to the left are ``among``.
    """

    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    children: np.ndarray
    among: dict[int, list[float]]

    def reached(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row ends in."""
        values, place = x.ravel(), np.arange(len(x)) * x.shape[1]
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            # As in Spark ML, what is not a number goes to the right.
            value = values.take(place + self.feature.take(node))
            left = value <= self.threshold.take(node)
            for at, categories in self.among.items():
                here = node == at
                left[here] = np.isin(value[here], categories)
            node = self.children.take(2 * node + 1 - left)
        return node


class Tree:
    """The nodes of one tree as its saved form lists them, each before its children."""

    def __init__(self, rows: list[dict]):
        self.rows = sorted(rows, key=lambda r: r["id"])
        self.leaves = [r["id"] for r in self.rows if r["leftChild"] < 0]

    def cut(self, cut: Cut) -> list[int]:
        """For each node that is left or has gone, the node that stands for it as a leaf (-1 for
        a node that is still split).

        As in a fit, two leaves of the same class under one node become one.
        """
        stands = [-1] * len(self.rows)
        order: list[tuple[int, int]] = []
        open_nodes = [(0, 0)]
        ends = set()
        while open_nodes:
            node, depth = open_nodes.pop()
            order.append((node, depth))
            row = self.rows[node]
            if row["leftChild"] < 0 or depth >= cut.depth or row["rawCount"] < cut.least_to_split:
                ends.add(node)
            else:
                open_nodes += [(row["rightChild"], depth + 1), (row["leftChild"], depth + 1)]
        for node, _ in reversed(order):
            row = self.rows[node]
            children = (row["leftChild"], row["rightChild"])
            if node not in ends and all(c in ends for c in children):
                if len({self.rows[c]["prediction"] for c in children}) == 1:
                    ends.add(node)
        # Parents come before children, so each hands its leaf on.
        for node, row in enumerate(self.rows):
            if stands[node] < 0 and node in ends:
                stands[node] = node
            if row["leftChild"] >= 0 and stands[node] >= 0:
                stands[row["leftChild"]] = stands[row["rightChild"]] = stands[node]
        return stands

    def shares(self, cut: Cut) -> np.ndarray:
        """For each leaf of the whole tree, the class shares of the leaf it is in after the cut."""
        stands = self.cut(cut)
        counts = np.array([self.rows[stands[leaf]]["impurityStats"] for leaf in self.leaves])
        totals = counts.sum(axis=1, keepdims=True)
        return np.divide(counts, totals, out=np.zeros_like(counts), where=totals > 0)

    def votes(self, cuts: Sequence[Cut], number: int) -> np.ndarray:
        """For each node that is a leaf, its class shares after each cut, one cut after another.

        A cut that keeps no tree of this ``number`` has nothing of it.
        """
        shares = [self.shares(cut) * (cut.trees is None or number < cut.trees) for cut in cuts]
        votes = np.zeros((len(self.rows), len(cuts) * shares[0].shape[1]))
        votes[self.leaves] = np.hstack(shares)
        return votes

    def steps(self) -> Steps:
        """The nodes as arrays."""
        feature = np.zeros(len(self.rows), np.int64)
        threshold = np.zeros(len(self.rows))
        children = np.repeat(np.arange(len(self.rows)), 2)
        level = np.zeros(len(self.rows), np.int64)
        among: dict[int, list[float]] = {}
        for node, row in enumerate(self.rows):
            if row["leftChild"] >= 0:
                own = row["split"]["leftCategoriesOrThreshold"]
                feature[node] = row["split"]["featureIndex"]
                if row["split"]["numCategories"] < 0:
                    threshold[node] = own[0]
                else:
                    among[node] = own
                children[2 * node : 2 * node + 2] = row["leftChild"], row["rightChild"]
                level[[row["leftChild"], row["rightChild"]]] = level[node] + 1
        return Steps(int(level.max()), feature, threshold, children, among)

    def after(self, cut: Cut) -> list[dict]:
        """The nodes that are left, numbered anew."""
        stands = self.cut(cut)
        left, todo = [], [0]
        while todo:
            node = todo.pop()
            left.append(node)
            if stands[node] != node:
                todo += [self.rows[node]["rightChild"], self.rows[node]["leftChild"]]
        number = {node: i for i, node in enumerate(left)}
        out = []
        for node in left:
            row = dict(self.rows[node], id=number[node])
            if stands[node] == node:
                nothing = {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}
                row.update(leftChild=-1, rightChild=-1, gain=-1.0, split=nothing)
            else:
                row.update(
                    leftChild=number[row["leftChild"]], rightChild=number[row["rightChild"]]
                )
            out.append(row)
        return out


def by_classes(row: dict) -> dict:
    """The node of a tree on the means of labels, as a classifier's node."""
    weight, ones, _ = row["impurityStats"]
    return dict(
        row,
        prediction=float(2 * ones > weight),
        impurity=2 * row["impurity"],
        impurityStats=[weight - ones, ones],
        gain=2 * row["gain"] if row["leftChild"] >= 0 else row["gain"],
    )


class SavedTrees:
    """A fitted tree or forest, read back from its saved form.

    Of a tree on the means of labels the nodes are read as a classifier's; it is not cut back.
    """

    def __init__(self, spark: SparkSession, model: Model):
        self.spark, self.model, self.fitted = spark, model, model
        self.path = scratch_path(spark, "model")
        model.write().save(self.path)
        self.is_forest = isinstance(model, RandomForestClassificationModel)
        self.data = spark.read.parquet(f"{self.path}/data")
        by_tree: dict[int, list[dict]] = {}
        for row in self.data.collect():
            tree, node = (row["treeID"], row["nodeData"]) if self.is_forest else (0, row)
            node = node.asDict(recursive=True)
            if isinstance(model, DecisionTreeRegressionModel):
                node = by_classes(node)
            by_tree.setdefault(tree, []).append(node)
        self.trees = [Tree(by_tree[t]) for t in sorted(by_tree)]

    @cached_property
    def model(self) -> Model:
        """Of trees from elsewhere written and loaded where it is first asked for."""
        path = scratch_path(self.spark, "model")
        kept = [tree.rows for tree in self.trees]
        return self._written(path, kept, self.fitted.getMaxDepth())

    def cut_back(self, cut: Cut) -> Model:
        """The model that is left, written and loaded by Spark ML as any other."""
        path = scratch_path(self.spark, "model")
        return self._written(path, [tree.after(cut) for tree in self.trees[: cut.trees]], cut.depth)

    def with_trees(self, kept: Sequence[list[dict]]) -> SavedTrees:
        """A model of the same settings and number of trees with these nodes."""
        made = copy(self)
        made.trees = [Tree(nodes) for nodes in kept]
        # The settings are still those of the model that was fitted.
        made.__dict__.pop("model", None)
        return made

    def _written(self, path: str, kept: Sequence[list[dict]], depth: int) -> Model:
        rows = []
        for number, nodes in enumerate(kept):
            rows += [{"treeID": number, "nodeData": x} if self.is_forest else x for x in nodes]
        table = pa.Table.from_pylist(rows, to_arrow_schema(self.data.schema))
        written = self.spark.createDataFrame(table, self.data.schema).coalesce(1)
        written.write.parquet(f"{path}/data")
        about = json.loads(self.spark.read.text(f"{self.path}/metadata").first()[0])
        about["paramMap"]["maxDepth"] = depth
        if self.is_forest:
            about["paramMap"]["numTrees"] = about["numTrees"] = len(kept)
            trees = self.spark.read.parquet(f"{self.path}/treesMetadata")
            trees = trees.where(F.col(trees.columns[0]) < len(kept)).coalesce(1)
            trees.write.parquet(f"{path}/treesMetadata")
        text = self.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1)
        text.write.text(f"{path}/metadata")
        return type(self.fitted).load(path)

    def classes(self, df: DataFrame, cuts: Sequence[Cut]) -> tuple[DataFrame, Column]:
        """``df``, and a column of the class that each cut gives its rows.

        The rows go through the deep model once, some thousand at a time and tree by tree. A cut
        is a look at the shares of the leaves that are left, added up as the model does it.
        """
        plan = [(tree.steps(), tree.votes(cuts, i)) for i, tree in enumerate(self.trees)]
        tables = self.spark.sparkContext.broadcast(plan)

        @F.pandas_udf("array<int>")
        def voted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                found: list[np.ndarray] = []
                for start in range(0, len(batch), STEP_ROWS):
                    x = np.stack(batch.iloc[start : start + STEP_ROWS].to_list())
                    votes = 0.0
                    for steps, shares in tables.value:
                        votes = votes + shares.take(steps.reached(x), axis=0)
                    votes = votes.reshape(len(x), len(cuts), -1)
                    found += list(votes.argmax(axis=2).astype(np.int32))
                yield pd.Series(found, dtype=object)

        return df, voted(vector_to_array(self.fitted.getFeaturesCol()))

