"""Nearest neighbours by inner product through a block matrix join."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import ceil_div, column, table
from riskframe.session import materialize

#: Rows of a tile on either side; a tile of products holds their product in numbers.
TILE_QUERIES = 512
TILE_VECTORS = 4096
#: Memory of a block of queries, bytes that it takes per component (a double and a float32),
#: and the most queries in one.
BLOCK_BYTES, NUMBER_BYTES, MOST_QUERIES = 64 << 20, 12, 65_536
#: Products of two int8 numbers that float32 adds up without rounding: 127 * 127 * 1040 < 2 ** 24.
EXACT_TERMS = 1040
#: More than what products of small numbers lose, and nothing beside others.
TINY = 1e-300


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and every component a finite number."""
    infinite = F.lit(float("inf"))
    return (
        vector.isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
        & F.exists(vector, lambda x: x != 0)
    )


def one_per_id(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Usable vectors as (vec_id, vector): of rows with one id the smallest vector."""
    rows = vectors.select(
        column(id_col).cast("long").alias("vec_id"), column(vector_col).alias("vector")
    )
    return (
        rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
    )


class Block:
    """Vectors of one length with their int8 form and what it leaves over.

    But for ``exact`` all is of the vectors over the power of two that brings their
    largest component below 1, so that no square overflows or vanishes.
    """

    def __init__(self, ids: np.ndarray, exact: np.ndarray) -> None:
        self.ids, self.exact = ids, exact
        _, self.power = np.frexp(np.abs(exact).max(axis=1))
        near_one = np.ldexp(exact, -self.power[:, None])
        self.scale = np.abs(near_one).max(axis=1) / 127
        whole = np.rint(near_one / self.scale[:, None])
        rounded = whole * self.scale[:, None]
        # Kept as float32, in which the products of whole numbers up to 127 are exact.
        self.int8 = whole.astype(np.float32)
        self.norm = np.sqrt((near_one**2).sum(axis=1))
        self.rounded_norm = np.sqrt((rounded**2).sum(axis=1))
        self.left_over = np.sqrt(((near_one - rounded) ** 2).sum(axis=1))

    def part(self, rows: slice) -> Block:
        piece = object.__new__(Block)
        for name, values in vars(self).items():
            setattr(piece, name, values[rows])
        return piece


def _tile(queries: Block, vectors: Block) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of the int8 forms, and how far the true ones can be from them.

    <q, v> - <q', v'> = <q, v - v'> + <q - q', v'>, so |q| |v - v'| + |q - q'| |v'|
    bounds the error; a little is added for the rounding of this computation itself.
    Either may overflow; such a pair is to be looked at.
    """
    total = np.zeros((len(queries.ids), len(vectors.ids)))
    for start in range(0, queries.int8.shape[1], EXACT_TERMS):
        terms = slice(start, start + EXACT_TERMS)
        total += queries.int8[:, terms] @ vectors.int8[:, terms].T
    total *= queries.scale[:, None] * vectors.scale
    error = np.outer(queries.norm, vectors.left_over)
    error += np.outer(queries.left_over, vectors.rounded_norm)
    error += 1e-9 * np.outer(queries.norm, vectors.norm)
    power = queries.power[:, None] + vectors.power
    with np.errstate(over="ignore"):
        # What vanishes in either is less than what is added.
        return np.ldexp(total, power), np.ldexp(error, power) + TINY


class Search:
    """The nearest vectors so far of one block of queries."""

    def __init__(self, queries: Block, nearest: int) -> None:
        self.queries, self.nearest = queries, nearest
        self.found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.least = np.full(len(queries.ids), -np.inf)

    def add(self, ids: np.ndarray, exact: np.ndarray) -> None:
        # Of equal vectors only the smallest ids can be among the nearest; one more than
        # asked for, since the query itself may be one of them.
        rows = np.ascontiguousarray(exact).view(f"V{exact.dtype.itemsize * exact.shape[1]}").ravel()
        _, kind = np.unique(rows, return_inverse=True)
        order = np.lexsort((ids, kind))
        place = np.arange(len(ids)) - np.searchsorted(kind[order], kind[order])
        keep = order[place <= self.nearest]
        vectors = Block(ids[keep], exact[keep])
        for q in range(0, len(self.queries.ids), TILE_QUERIES):
            for v in range(0, len(vectors.ids), TILE_VECTORS):
                self._add_tile(q, self.queries.part(slice(q, q + TILE_QUERIES)),
                               vectors.part(slice(v, v + TILE_VECTORS)))

    def _add_tile(self, first: int, queries: Block, vectors: Block) -> None:
        about, error = _tile(queries, vectors)
        own = queries.ids[:, None] == vectors.ids
        about[own] = -np.inf
        least = self.least[first : first + len(queries.ids)]
        with np.errstate(invalid="ignore", over="ignore"):
            low, high = about - error, about + error
        if len(vectors.ids) > self.nearest:
            low[~np.isfinite(low)] = -np.inf
            low = np.partition(low, -self.nearest, axis=1)[:, -self.nearest]
            least = np.maximum(least, low)
        # A bound that is no number keeps its pair.
        q, v = np.nonzero(~(high < least[:, None]) & ~own)
        step = max(1, 4_000_000 // queries.exact.shape[1])
        scores = np.zeros(len(q))
        for start in range(0, len(q), step):
            some = slice(start, start + step)
            # Term by term from the first component on, as a plain loop adds them up.
            with np.errstate(over="ignore", invalid="ignore"):
                for a, b in zip(queries.exact[q[some]].T, vectors.exact[v[some]].T, strict=True):
                    scores[some] += a * b
        number = ~np.isnan(scores)
        self._merge(q[number] + first, vectors.ids[v[number]], scores[number])

    def _merge(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        query, ids, scores = (
            np.concatenate(pair) for pair in zip(self.found, (query, ids, scores), strict=True)
        )
        order = np.lexsort((ids, -scores, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[place < self.nearest]
        self.found = (query[place < self.nearest], ids[kept], scores[kept])
        last = place == self.nearest - 1
        self.least[query[last]] = scores[order][last]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, ids, scores = self.found
        return self.queries.ids[query], ids, scores


def _matrices(ids: np.ndarray, lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors as rows) for each length of vector."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(offsets)
    for length in np.unique(lengths):
        own = np.nonzero(lengths == length)[0]
        yield ids[own], values[offsets[own][:, None] + np.arange(length)]


def _search_cells(nearest: int):
    """Over rows sorted by (cell, side): the partial lists of each cell's queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, searches = None, {}, None

        def results() -> Iterator[pa.RecordBatch]:
            for found in (searches or {}).values():
                query, ids, scores = found.rows()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query), pa.array(ids), pa.array(scores)],
                    names=["query_id", "vec_id", "score"],
                )

        for batch in batches:
            cells = batch.column(0).to_numpy()
            side = batch.column(1).to_numpy()
            ids = batch.column(2).to_numpy()
            turns = np.nonzero((np.diff(cells) != 0) | (np.diff(side) != 0))[0] + 1
            edges = [0, *turns.tolist(), len(cells)]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                if cells[start] != cell:
                    yield from results()
                    cell, asked, searches = cells[start], {}, None
                lists = batch.column(3).slice(start, end - start)
                for some_ids, exact in _matrices(ids[start:end], lists):
                    if side[start] == 0:
                        asked.setdefault(exact.shape[1], []).append((some_ids, exact))
                        continue
                    if searches is None:
                        searches = {
                            size: Search(Block(*map(np.concatenate, zip(*parts, strict=True))), nearest)
                            for size, parts in asked.items()
                        }
                    if exact.shape[1] in searches:
                        searches[exact.shape[1]].add(some_ids, exact)
        yield from results()

    return search


def _merge_by_heap(nearest: int):
    """Over rows sorted by query: the nearest of all its partial lists, one heap at a time."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, heap = None, []

        def ranked() -> list[tuple]:
            best = sorted(heap, reverse=True)
            return [(query, n, -v, s) for n, (s, v) in enumerate(best, 1)]

        for batch in batches:
            done: list[tuple] = []
            for q, v, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if q != query:
                    done += ranked()
                    query, heap = q, []
                if len(heap) < nearest:
                    heappush(heap, (s, -v))
                elif (s, -v) > heap[0]:
                    heapreplace(heap, (s, -v))
            yield _ranks(done)
        yield _ranks(ranked())

    return merge


def _ranks(rows: list[tuple]) -> pa.RecordBatch:
    query, rank, ids, scores = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(query, pa.int64()), pa.array(rank, pa.int32()),
         pa.array(ids, pa.int64()), pa.array(scores, pa.float64())],
        names=["query_id", "rank", "vec_id", "score"],
    )


def nearest_neighbours(
    queries: DataFrame,
    vectors: DataFrame,
    nearest: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cell_rows: int = 65_536,
    block_queries: int | None = None,
) -> DataFrame:
    """The ``nearest`` of ``vectors`` to each query by inner product, exactly.

    Rows (query_id, rank from 1, vec_id, score), nearest first and ties to the
    smaller id; a query's own id is no candidate, and with fewer candidates all
    are returned. The score is computed in double precision from the vectors as
    they are.

    Vectors are dealt by their id to cells of about ``cell_rows`` (at least two
    for each core, so that small tables keep all cores busy), and each block of
    ``block_queries`` visits every cell. By default a block is as large as
    ``BLOCK_BYTES`` hold, since every vector is shuffled once per block and every
    query once per cell. A task holds one block of queries and
    streams a cell past it in tiles. Products of the int8 forms come with a
    bound of their error; pairs whose upper bound misses the query's ``nearest``
    best lower bounds are done with, and the others are computed in double.
    The cells' lists of a query then meet in a heap of ``nearest`` entries.

    Rows with a null id take no part, nor do vectors that are null, empty, zero
    or hold a null or non-finite component. Of several rows with one id the
    smallest vector counts. Vectors of another length than the query's are no
    candidates. A score beyond the range of doubles is infinite; a pair whose products
    run out of it in both directions has none and takes no part. An empty table on
    either side gives no rows.
    """
    spark = vectors.sparkSession
    corpus = materialize(one_per_id(vectors, id_col, vector_col), "vectors")
    asked = materialize(one_per_id(queries, id_col, vector_col), "queries")
    cells = max(ceil_div(corpus.count(), cell_rows), 2 * spark.sparkContext.defaultParallelism)
    number, width = asked.agg(
        F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))
    ).first()
    if block_queries is None:
        block_queries = min(MOST_QUERIES, max(TILE_QUERIES, BLOCK_BYTES // (NUMBER_BYTES * width)))
    blocks = ceil_div(number, block_queries)
    dealt = F.xxhash64("vec_id")

    def copies(number: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1)))

    left = asked.select(
        F.pmod(dealt, F.lit(blocks)).alias("block"), copies(cells).alias("cell"),
        F.lit(0).alias("side"), "vec_id", "vector",
    )
    right = corpus.select(
        copies(blocks).alias("block"), F.pmod(dealt, F.lit(cells)).alias("cell"),
        F.lit(1).alias("side"), "vec_id", "vector",
    )
    cell = (F.col("block") * cells + F.col("cell")).cast("long").alias("cell")
    tiles = left.union(right).select(cell, "side", "vec_id", "vector")
    partial = (
        tiles.repartition(cells * blocks, "cell")
        .sortWithinPartitions("cell", "side")
        .mapInArrow(_search_cells(nearest), "query_id long, vec_id long, score double")
    )
    return (
        partial.repartition("query_id")
        .sortWithinPartitions("query_id")
        .mapInArrow(_merge_by_heap(nearest), "query_id long, rank int, vec_id long, score double")
    )


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings to each whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows.where(F.col("vec_id") % 20 == 0), rows)


OP1_SQL = """
WITH usable AS (
    SELECT vec_id, min(embedding) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    GROUP BY vec_id
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS score
    FROM usable q JOIN usable c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
    WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place
    FROM scored
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 20
"""
