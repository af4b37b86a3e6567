import zlib
from collections import Counter

import pytest

from riskframe.llm import sharding
from riskframe.session import materialize


@pytest.mark.parametrize("run_rows", [4_096, 5])
def test_shards_have_equal_counts_and_the_same_mixture(docs, awkward, run_rows):
    rows = sharding.interleave(docs, 4, run_rows=run_rows).collect()
    assert len(rows) == len(awkward)
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    for shard, count in counts.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(count))
    by_source = Counter((r.source, r.shard) for r in rows)
    for source in {r.source for r in rows}:
        held = [by_source[source, shard] for shard in range(4)]
        assert max(held) - min(held) <= 2
    expected = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in awkward)
    assert sorted((r.size, r.text_crc32) for r in rows) == expected


def test_order_is_that_of_fractional_ranks(docs):
    rows = sharding.interleave(docs, 3).collect()
    placed = [r.fraction for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert placed == sorted(placed)
    for source in {r.source for r in rows}:
        own = sorted(r.fraction for r in rows if r.source == source)
        assert own == pytest.approx([(n + 0.5) / len(own) for n in range(len(own))])


def test_same_result_whatever_the_partitions(docs):
    key = lambda r: (r.shard, r.slot)
    one = [(r.doc_id, r.text_crc32) for r in sorted(sharding.interleave(docs).collect(), key=key)]
    two = [(r.doc_id, r.text_crc32) for r in sorted(sharding.interleave(docs.repartition(7)).collect(), key=key)]
    assert one == two


def test_written_shards_hold_whole_rows(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, 3)
    back = spark.read.parquet(path)
    assert back.select("shard").distinct().count() == 3
    assert back.select("kept.*").exceptAll(docs).count() == 0
    assert back.count() == docs.count()


def test_fewer_rows_than_shards_and_none(docs, no_docs):
    rows = sharding.interleave(docs.limit(3), 16).collect()
    assert len({r.shard for r in rows}) == 3 and all(r.slot == 0 for r in rows)
    assert sharding.interleave(no_docs).count() == 0


def test_plan_has_no_python(docs):
    plan = sharding.interleave(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_equal_rows_are_put_in_order_by_many_tasks(spark):
    rows = [(None, "the same row", "s")] * 9_000 + [(i, f"text {i}", "s") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = sharding.interleave(table, 4, run_rows=1_000)
    slots = {}
    for r in found.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert {s: sorted(x) for s, x in slots.items()} == {s: list(range(2_325)) for s in range(4)}
    from riskframe.llm.common import equal_part, spread, told_apart

    numbered = spark.createDataFrame([(5, i) for i in range(9_000)], "lot long, number long")
    apart = told_apart(materialize(numbered), "lot", "number")
    runs = apart.groupBy(equal_part(spread(apart["lot"]), 9)).count().collect()
    assert len(runs) == 9 and max(r["count"] for r in runs) < 1_300
