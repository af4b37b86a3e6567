"""Forests grown level by level, several smallest leaves at a time.

For every level the tasks count, tree by tree, the rows that a tree drew, by node, feature,
bin and class. The counts are added up by tree, and a split is chosen where they meet; what
reaches the driver are the splits. A tree's counts are a few hundred KB however many rows
there are, and a task holds those of one tree at a time.

Rows are drawn by a hash of their key and the tree, features by tree and node. So a tree does
not depend on partitions, and trees that differ in the smallest leaf alone are the same tree
until this makes a difference: up to there they are counted once.

As in Spark ML, a tree draws as many rows as there are, with repeats (a Poisson number of each),
a node looks at the square root of the features, and a feature has 32 bins at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import ceil, exp, factorial, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.learning.newton import FANIN
from riskframe.learning.trees import Cut, SavedTrees, Tree
from riskframe.session import materialize

BINS = 32
#: Rows of a task, about, and those looked at in one step, which fit a core's cache.
TASK_ROWS, STEP_ROWS = 500_000, 1 << 15
#: A split that gains no more is none.
LEAST_GAIN = 1e-12
#: How often a row is drawn, by 16 bits of its hash.
_SHARES = np.cumsum([exp(-1) / factorial(k) for k in range(12)])
DRAWN = np.searchsorted(_SHARES, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def drawn(keys: np.ndarray, tree: np.uint64) -> np.ndarray:
    """How often a tree draws each of the rows with these hashed keys."""
    z = (keys ^ tree) * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(32)
    z *= np.uint64(0x94D049BB133111EB)
    return DRAWN[z >> np.uint64(48)]


def tasks_for(spark: SparkSession, rows: int) -> int:
    """All cores, or more tasks where one would have too many rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


# --- bins ------------------------------------------------------------------


def bin_edges(rows: DataFrame, size: int) -> list[np.ndarray]:
    """For each of the ``size`` features in the array ``x``, what its bins end with.

    Between all values where they are few, else quantiles.
    """

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = [np.array([]) for _ in range(size)]
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for i in range(size):
                if len(seen[i]) <= BINS:
                    seen[i] = np.unique(np.append(seen[i], x[:, i]))[: BINS + 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array([s.tolist() for s in seen])],
            names=["feature", "found"],
        )

    # A task has a value more than there are bins at most.
    values: list[set] = [set() for _ in range(size)]
    listed = rows.select("x").mapInArrow(few, "feature int, found array<double>")
    together = listed.select("feature", F.explode("found").alias("value")).distinct()
    for row in together.collect():
        values[row["feature"]].add(row["value"])
    many = [i for i in range(size) if len(values[i]) > BINS]
    places = [k / BINS for k in range(1, BINS)]
    cells = [F.percentile_approx(F.col("x")[i], places, 10_000).alias(f"_{i}") for i in many]
    quantiles = rows.agg(*cells).first() if many else None
    edges = []
    for i in range(size):
        if i in many:
            edges.append(np.unique(quantiles[f"_{i}"]))
        else:
            own = np.sort(list(values[i]))
            edges.append((own[1:] + own[:-1]) / 2)
    return edges


def binned(rows: DataFrame, edges: Sequence[np.ndarray]) -> DataFrame:
    """Rows with one byte for each feature, twice the number of its bin."""

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            x = x.reshape(batch.num_rows, -1)
            bins = np.stack([2 * np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], axis=1)
            packed = [row.tobytes() for row in bins.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(packed, pa.binary()), *batch.columns[1:]], names=["x", "y", "w", "key"]
            )

    return rows.mapInArrow(to_bins, "x binary, y int, w double, key long")


# --- growth ----------------------------------------------------------------


@dataclass
class Growth:
    """A tree that is the same for all of these smallest leaves, its nodes as in a heap."""

    number: int
    leaves: tuple[int, ...]
    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    #: What is known of a node: gain, weight of both classes, rows drawn.
    nodes: dict[int, tuple] = field(default_factory=dict)
    open: set[int] = field(default_factory=lambda: {0})

    def __post_init__(self):
        # A node that is no longer split hands all rows to the left, where nobody looks.
        self.feature = np.zeros(2**self.depth - 1, np.int64)
        self.bin = np.full(2**self.depth - 1, 255, np.uint8)

    def fork(self, leaves: tuple[int, ...]) -> Growth:
        other = Growth(self.number, leaves, self.depth)
        other.feature, other.bin = self.feature.copy(), self.bin.copy()
        other.nodes, other.open = dict(self.nodes), set(self.open)
        return other

    def take(self, level: int, chosen: np.ndarray, features: np.ndarray) -> None:
        """Split the level's open nodes as ``chosen`` has it."""
        first, todo = 2**level - 1, set()
        for node in sorted(self.open):
            at, b, gain, *stats = chosen[node - first].tolist()
            own, left, right = stats[:3], stats[3:6], stats[6:]
            if at < 0:
                self.nodes[node] = (-1.0, *own)
                continue
            self.nodes[node] = (gain, *own)
            self.feature[node] = features[node, int(at)]
            self.bin[node] = 2 * int(b)
            for child, found in ((2 * node + 1, left), (2 * node + 2, right)):
                self.nodes[child] = (-1.0, *found)
                # Nodes of one class are done, as are those of the last level.
                if level + 1 < self.depth and min(found[:2]) > 0:
                    todo.add(child)
        self.open = todo

    def tree(self, edges: Sequence[np.ndarray]) -> list[dict]:
        """The nodes as Spark ML saves them; two leaves of one class become one."""
        order, todo = [], [0]
        while todo:
            node = todo.pop()
            order.append(node)
            if self.nodes[node][0] > 0:
                todo += [2 * node + 2, 2 * node + 1]
        number = {node: i for i, node in enumerate(order)}
        rows = []
        for node in order:
            gain, zeros, ones, count = self.nodes[node]
            split = {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}
            left = right = -1
            if gain > 0:
                left, right = number[2 * node + 1], number[2 * node + 2]
                at = int(self.feature[node])
                threshold = float(edges[at][self.bin[node] // 2])
                split.update(featureIndex=at, leftCategoriesOrThreshold=[threshold])
            weight = zeros + ones
            rows.append({
                "id": number[node],
                "prediction": float(ones > zeros),
                "impurity": 2 * zeros * ones / weight**2 if weight else 0.0,
                "impurityStats": [zeros, ones],
                "rawCount": int(count),
                "gain": gain,
                "leftChild": left,
                "rightChild": right,
                "split": split,
            })
        return Tree(rows).after(Cut(self.depth))


def best_splits(rows: np.ndarray, weights: np.ndarray, leaf: int) -> np.ndarray:
    """For each node: feature (its place among those drawn, -1 without a split), bin and gain, then
    weights of both classes and rows of the node and of what is to the left and right.

    Both arrays are by node, feature, bin and class.
    """
    counts = rows.sum(axis=3)
    below_n = counts.cumsum(axis=2)[:, :, :-1]
    all_n = counts[:, :1].sum(axis=2)[:, :, None]
    below = weights.cumsum(axis=2)[:, :, :-1]
    total = weights[:, :1].sum(axis=2)[:, :, None]
    above, above_n = total - below, all_n - below_n

    def unlike(w: np.ndarray) -> np.ndarray:
        """Gini impurity times weight."""
        both = w.sum(axis=-1)
        return np.divide(2 * w[..., 0] * w[..., 1], both, out=np.zeros_like(both), where=both > 0)

    weight = np.maximum(total.sum(axis=-1), 1e-300)
    gain = (unlike(total) - unlike(below) - unlike(above)) / weight
    gain[(below_n < leaf) | (above_n < leaf)] = -1
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    node = np.arange(len(gain))
    at, cut = np.divmod(best, gain.shape[2])
    found = flat[node, best]
    none = found <= LEAST_GAIN
    return np.column_stack([
        np.where(none, -1, at), cut, found,
        total[:, 0, 0], all_n[:, 0, 0],
        below[node, at, cut], below_n[node, at, cut],
        above[node, at, cut], above_n[node, at, cut],
    ])


def _level(
    table: DataFrame,
    tasks: int,
    growths: Sequence[Growth],
    level: int,
    trees: np.ndarray,
    features: np.ndarray,
    by_class: np.ndarray | None,
) -> dict[int, dict[int, np.ndarray]]:
    """The splits of a level for each place among ``growths`` and each smallest leaf."""
    first, count, looked = 2**level - 1, 2**level, features.shape[2]
    plan = []
    for at, growth in enumerate(growths):
        is_open = np.zeros(count, bool)
        is_open[[node - first for node in growth.open]] = True
        own = growth.feature[:first], growth.bin[:first]
        plan.append((at, growth.number, growth.leaves, *own, is_open))
    plan = table.sparkSession.sparkContext.broadcast((plan, features[:, first : first + count]))
    size = count * looked * 2 * BINS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [
            (
                np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8),
                b.column(1).to_numpy(),
                b.column(2).to_numpy(),
                b.column(3).to_numpy().view(np.uint64),
            )
            for b in batches
            if b.num_rows
        ]
        if not parts:
            return
        x, y, w, keys = (np.concatenate(column) for column in zip(*parts))
        width = len(x) // len(y)
        # A byte holds bin and class, and so is the place of what is counted.
        x = (x.reshape(-1, width) + y.astype(np.uint8)[:, None]).ravel()
        listed, drawn_features = plan.value
        for at, number, _, feature, cut, is_open in listed:
            rows = np.zeros(size)
            weights = None if by_class is not None else np.zeros(size)
            # Either class of a bin that ends at the cut goes to the left.
            cut = cut | 1
            columns = [np.ascontiguousarray(c) for c in drawn_features[number].T]
            for start in range(0, len(y), STEP_ROWS):
                times = drawn(keys[start : start + STEP_ROWS], trees[number])
                own = np.flatnonzero(times)
                place, times = (own + start) * width, times.take(own).astype(float)
                node = np.zeros(len(own), np.int64)
                for _ in range(level):
                    right = x.take(place + feature.take(node)) > cut.take(node)
                    node += node
                    node += 1
                    node += right
                node -= first
                if not is_open.all():
                    kept = np.flatnonzero(is_open.take(node))
                    node, own, place, times = (a.take(kept) for a in (node, own, place, times))
                weight = None if weights is None else times * w[start:].take(own)
                cells = node * (looked * 2 * BINS)
                for column in columns:
                    found = cells + x.take(place + column.take(node))
                    rows += np.bincount(found, times, size)
                    if weights is not None:
                        weights += np.bincount(found, weight, size)
                    cells += 2 * BINS
            rows = rows.astype(np.int64)
            # No task has two thousand million rows of a node.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([at], pa.int32()),
                    pa.array([rows.tobytes()], pa.binary()),
                    pa.array([None if weights is None else weights.tobytes()], pa.binary()),
                ],
                names=["key", "rows", "weights"],
            )

    def summed(found: pa.Table) -> tuple[np.ndarray, np.ndarray | None]:
        rows = sum(np.frombuffer(v.as_buffer(), np.int64) for v in found.column("rows"))
        if by_class is not None:
            return rows, None
        return rows, sum(np.frombuffer(v.as_buffer()) for v in found.column("weights"))

    def total(found: pa.Table) -> pa.Table:
        rows, weights = summed(found)
        out = found.slice(0, 1).select(["key", "part"])
        out = out.append_column("rows", pa.array([rows.tobytes()], pa.binary()))
        sums = None if weights is None else weights.tobytes()
        return out.append_column("weights", pa.array([sums], pa.binary()))

    def split(found: pa.Table) -> pa.Table:
        at = found.column("key")[0].as_py()
        rows, weights = summed(found)
        rows = rows.reshape(count, looked, BINS, 2)
        weights = rows * by_class if weights is None else weights.reshape(rows.shape)
        leaves = plan.value[0][at][2]
        chosen = [best_splits(rows, weights, leaf).tobytes() for leaf in leaves]
        return pa.table({
            "key": pa.array([at] * len(leaves), pa.int32()),
            "leaf": pa.array(leaves, pa.int32()),
            "chosen": pa.array(chosen, pa.binary()),
        })

    partials = table.mapInArrow(counted, "key int, rows binary, weights binary")
    while tasks > FANIN:
        tasks = -(-tasks // FANIN)
        part = F.pmod(F.spark_partition_id(), F.lit(tasks))
        partials = (
            partials.withColumn("part", part)
            .groupBy("key", "part")
            .applyInArrow(total, "key int, part int, rows binary, weights binary")
        )
    chosen = partials.groupBy("key").applyInArrow(split, "key int, leaf int, chosen binary")
    out: dict[int, dict[int, np.ndarray]] = {}
    for row in chosen.collect():
        out.setdefault(row["key"], {})[row["leaf"]] = np.frombuffer(row["chosen"]).reshape(count, -1)
    plan.unpersist()
    return out


def grow(
    df: DataFrame,
    leaves: Sequence[int],
    trees: int,
    depth: int,
    features: str,
    label: str,
    weight: str,
    key: str = "id",
    seed: int = 42,
) -> dict[int, list[list[dict]]]:
    """For each smallest leaf a forest, as the nodes of its trees.

    ``df`` is read three times, and then stored with a byte for each feature. Labels are 0 and 1.
    """
    rows = df.select(
        vector_to_array(F.col(features)).alias("x"),
        F.col(label).cast("int").alias("y"),
        F.col(weight).cast("double").alias("w"),
        F.xxhash64(key).alias("key"),
    )
    known = rows.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.min("w").alias("least"), F.max("w").alias("most"),
        F.max(F.size("x")).alias("size"),
    ).collect()
    if not known or any(r["y"] not in (0, 1) for r in known):
        raise ValueError("a forest learns from labels 0 and 1")
    by_class = None
    if all(r["least"] == r["most"] for r in known):
        by_class = np.array([sum(r["least"] for r in known if r["y"] == c) for c in (0.0, 1.0)])
    size, n = known[0]["size"], sum(r["n"] for r in known)
    edges = bin_edges(rows, size)
    tasks = tasks_for(df.sparkSession, n)
    table = materialize(binned(rows, edges).repartition(tasks, "key"), "binned")
    tasks = table.rdd.getNumPartitions()

    draw = np.random.default_rng(seed)
    hashes = draw.integers(0, 1 << 63, trees, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    looked = ceil(sqrt(size))
    subsets = draw.random((trees, 2**depth - 1, size)).argsort(axis=2)[:, :, :looked]
    growths = [Growth(number, tuple(leaves), depth) for number in range(trees)]
    for level in range(depth):
        todo = [g for g in growths if g.open]
        if not todo:
            break
        found = _level(table, tasks, todo, level, hashes, subsets, by_class)
        first = 2**level - 1
        for at, growth in enumerate(todo):
            # Leaves whose splits are alike go on together.
            nodes = sorted(node - first for node in growth.open)
            alike: dict[bytes, list[int]] = {}
            for leaf in growth.leaves:
                alike.setdefault(found[at][leaf][nodes, :2].tobytes(), []).append(leaf)
            for together in list(alike.values())[1:]:
                other = growth.fork(tuple(together))
                other.take(level, found[at][together[0]], subsets[growth.number])
                growths.append(other)
            growth.leaves = tuple(next(iter(alike.values())))
            growth.take(level, found[at][growth.leaves[0]], subsets[growth.number])
    growths.sort(key=lambda growth: growth.number)
    return {leaf: [g.tree(edges) for g in growths if leaf in g.leaves] for leaf in leaves}


def fit_together(estimators: Sequence[RandomForestClassifier], df: DataFrame) -> list[SavedTrees]:
    """Forests with the settings of Spark's estimators, which differ in the smallest leaf alone."""
    first = estimators[0]
    leaves = [estimator.getMinInstancesPerNode() for estimator in estimators]
    names = first.getFeaturesCol(), first.getLabelCol(), first.getWeightCol()
    found = grow(
        df, leaves, first.getNumTrees(), first.getMaxDepth(), *names, seed=first.getSeed()
    )
    size = len(df.first()[names[0]])
    # How Spark saves a model of these settings is taken from one fitted to two rows.
    two = df.sparkSession.createDataFrame(
        [([float(y)] * size, float(y), 1.0) for y in (0, 1)],
        "x array<double>, y double, w double",
    ).select(array_to_vector("x").alias(names[0]), *[
        F.col(c).alias(name) for c, name in zip(("y", "w"), names[1:])
    ])
    return [
        SavedTrees(df.sparkSession, estimator.fit(two)).with_trees(found[leaf])
        for estimator, leaf in zip(estimators, leaves, strict=True)
    ]
