import math
import random

import numpy as np
import pytest

from riskframe.llm import neighbours


def brute(vectors, queries, k):
    usable = {}
    for i, v in vectors:
        if i is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        if not any(v):
            continue
        usable[i] = min(usable.get(i, v), v)
    found = []
    for q in sorted(set(queries) & set(usable)):
        scores = [
            (-float((np.array(usable[q]) * np.array(v)).sum()), i)
            for i, v in usable.items()
            if i != q and len(v) == len(usable[q])
        ]
        found += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return found


def rows(seed=3, number=300, size=7):
    random.seed(seed)
    made = [(i, [random.gauss(0, 1) for _ in range(size)]) for i in range(number)]
    made += [(1000 + i, made[4][1]) for i in range(40)]
    made += [(2000, [0.0] * size), (2001, None), (2002, []), (2003, [1.0] * (size - 1) + [math.nan])]
    made += [(2004, [1.0] * (size - 1) + [None]), (2005, [math.inf] * size), (None, [1.0] * size)]
    made += [(2006, [1.0, 2.0]), (2020, [2.0, 1.0]), (2007, [3.0]), (40, made[40][1]), (60, [9.0] * size)]
    return made


@pytest.mark.parametrize("cell_rows, block", [(65_536, 8_192), (20, 3)])
def test_nearest_equal_brute_force(spark, cell_rows, block):
    made = rows()
    table = spark.createDataFrame(
        [(i, v, "x", 1.0, 2) for i, v in made],
        "vec_id long, embedding array<double>, cell string, side double, rank int",
    )
    found = neighbours.nearest_neighbours(
        table.where("vec_id % 20 = 0"), table, 5, cell_rows=cell_rows, block_queries=block
    ).collect()
    expected = brute(made, [i for i, _ in made if i is not None and i % 20 == 0], 5)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == [e[:3] for e in expected]
    scores = {(r.query_id, r.rank): r.score for r in found}
    assert all(abs(scores[e[:2]] - e[3]) < 1e-12 for e in expected)


def test_float_vectors_fewer_candidates_than_asked_for(spark):
    table = spark.createDataFrame([(20, [1.0, 0.5]), (3, [0.25, 1.0])], "vec_id long, embedding array<float>")
    found = neighbours.nearest_neighbours(table.where("vec_id = 20"), table).collect()
    assert [tuple(r) for r in found] == [(20, 1, 3, 0.75)]


def test_empty_tables(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest_neighbours(table, table).count() == 0


def test_products_lie_within_their_bounds():
    random_numbers = np.random.default_rng(0)
    a = neighbours.Block(np.arange(50), random_numbers.normal(size=(50, 2500)))
    b = neighbours.Block(np.arange(70), random_numbers.normal(size=(70, 2500)) ** 3)
    about, error = neighbours._tile(a, b)
    assert (np.abs(about - a.exact @ b.exact.T) <= error).all()


def test_very_large_and_very_small_vectors(spark):
    draw = np.random.default_rng(5)
    made = []
    for i in range(160):
        power = [0.0, 100.0, -150.0, -300.0][i % 4]
        made.append((i, (draw.normal(size=6) * 10.0**power).tolist()))
    made += [(200, [5e-324] * 6), (220, [5e-324, 0.0, 0.0, 0.0, 0.0, 0.0]), (240, [1e200] * 6), (241, [5e-324] * 6)]
    table = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    found = neighbours.nearest_neighbours(table.where("vec_id % 20 = 0"), table, 30, cell_rows=40).collect()
    expected = []
    for q, a in made:
        if q % 20:
            continue
        scores = []
        for v, b in made:
            total = 0.0
            for x, y in zip(a, b, strict=True):
                total += x * y
            if v != q:
                scores.append((-total, v))
        expected += [(q, n, v, -s) for n, (s, v) in enumerate(sorted(scores)[:30], 1)]
    assert [tuple(r) for r in sorted(found)] == sorted(expected)


def test_clashing_columns_and_awkward_vectors(spark):
    from awkward import CLASHING

    rows = [(i, [float(i % 7), 1.0]) for i in range(50)] + [(60, None), (80, [0.0, 0.0]), (None, [1.0, 2.0])]
    names = [n for n in (*CLASHING, "cell", "side", "block", "query_id", "rank", "vector") if n != "score"]
    names = list(dict.fromkeys(names))
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    extra = plain.selectExpr("*", *[f"'x' as `{n}`" for n in names])
    a, b = (
        sorted(map(tuple, neighbours.nearest_neighbours(t.where("vec_id % 20 = 0"), t, 3).collect())) for t in (plain, extra)
    )
    assert a == b and {q for q, *_ in a} == {0, 20, 40}
