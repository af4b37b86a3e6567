import math
from collections import defaultdict

import pytest

from riskframe.llm import mixing
from riskframe.llm.common import attach


def entropy(shares, exponent):
    powers = [s**exponent for s in shares]
    return -sum(p / sum(powers) * math.log(p / sum(powers)) for p in powers)


def test_exponents(spark):
    shares = [0.1, 0.2, 0.3, 0.4]
    table = spark.createDataFrame([(s,) for s in shares], "share double")
    exponent = mixing.exponent_for(table, entropy=1.35)
    assert entropy(shares, exponent) == pytest.approx(1.35, abs=1e-6)
    exponent = mixing.exponent_for(table, most_passes=1.5)
    assert 4 ** (1 - exponent) == pytest.approx(1.5, abs=1e-6)
    assert mixing.exponent_for(table, entropy=9.0) == 0
    assert mixing.exponent_for(table, entropy=0.1) == 1
    assert mixing.exponent_for(table, most_passes=100) == 0
    assert mixing.exponent_for(table) == 1
    # The limit on passes holds against the entropy.
    assert mixing.exponent_for(table, entropy=9.0, most_passes=1.5) == pytest.approx(exponent)


def tokens(text):
    return len((text or "").encode().split()) + 1


@pytest.mark.parametrize("block_rows", [4_096, 3])
def test_mixture_meets_weights_and_leaves_nothing_out(docs, awkward, block_rows):
    rows = mixing.mix(docs, most_passes=3.0, block_rows=block_rows).collect()
    own = defaultdict(int)
    for _, text, source in awkward:
        own[source] += tokens(text)
    first = sorted(((r.doc_id is None, r.doc_id or 0, r.tokens) for r in rows if r["pass"] == 0))
    assert first == sorted((i is None, i or 0, tokens(t)) for i, t, _ in awkward)
    weight = {r.source: r.weight for r in rows}
    assert sum(weight.values()) == pytest.approx(1)
    ratio = {s: weight[s] / own[s] for s in own}
    assert max(ratio.values()) / min(ratio.values()) == pytest.approx(3.0, rel=1e-6)
    for source, total in own.items():
        wanted = ratio[source] / min(ratio.values()) * total
        taken = sum(r.tokens for r in rows if r.source == source)
        longest = max(tokens(t) for _, t, s in awkward if s == source)
        assert wanted - longest - 1 <= taken <= wanted + 1
        for number in {r["pass"] for r in rows if r.source == source}:
            places = sorted(r.place for r in rows if r.source == source and r["pass"] == number)
            assert places == list(range(len(places)))
    assert all(0 <= r.fraction <= 1 for r in rows)


def test_passes_are_different_permutations(spark):
    table = spark.createDataFrame(
        [(i, f"text {i}", "small") for i in range(50)] + [(i, f"text {i}", "big") for i in range(100, 900)],
        "doc_id long, text string, source string",
    )
    rows = [r for r in mixing.mix(table, most_passes=4.0, block_rows=16).collect() if r.source == "small"]
    orders = [
        [r.doc_id for r in sorted(rows, key=lambda r: r.place) if r["pass"] == number] for number in (0, 1)
    ]
    assert sorted(orders[0]) == sorted(orders[1]) == list(range(50))
    assert orders[0] != orders[1]


def test_budget_below_the_corpus_takes_whole_documents(spark):
    table = spark.createDataFrame(
        [(i, "a b c d", "s" if i % 3 else "t") for i in range(300)], "doc_id long, text string, source string"
    )
    rows = mixing.mix(table, most_passes=None, budget=500.0, block_rows=8).collect()
    assert 480 <= sum(r.tokens for r in rows) <= 500
    assert len({r.doc_id for r in rows}) == len(rows)


def test_empty_table(no_docs):
    assert mixing.mix(no_docs).count() == 0


def test_large_lookups_are_spread_not_broadcast(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else "k") for i in range(60)], "doc_id long, key string")
    few = spark.createDataFrame([(None, 1), ("k", 2)], "key string, value int")
    for most in (8 << 20, 0):
        found = attach(rows, few, "key", most).collect()
        assert sorted((r.doc_id, r.value) for r in found) == [(i, 1 if i % 3 == 0 else 2) for i in range(60)]


def test_equal_rows_fill_many_blocks(spark):
    rows = [(None, "the same row", "s")] * 20_000 + [(i, f"text {i}", "s") for i in range(500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = mixing.mix(table, most_passes=None)
    sizes = [r["count"] for r in found.groupBy("pass", "block").count().collect()]
    assert sum(sizes) == 20_500 and max(sizes) < 1.2 * mixing.BLOCK_ROWS
    places = sorted(r.place for r in found.collect())
    assert places == list(range(20_500))
    # All other rows stand where they stood without the number.
    again = {r.doc_id: r.block for r in mixing.mix(table.repartition(7), most_passes=None).collect() if r.doc_id}
    assert again == {r.doc_id: r.block for r in found.collect() if r.doc_id}
