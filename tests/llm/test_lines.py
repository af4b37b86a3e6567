import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from riskframe.llm import lines


def key_of(line):
    key = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)


def by_hand(rows, least_documents, least_chars=1, keep_first=False):
    """(id, text) -> (lines, dropped, kept text), rows of equal id and text being one document."""
    documents, where = {(i, t or "") for i, t in rows}, {}
    for doc in documents:
        for number, line in enumerate(doc[1].split("\n")):
            if len(key_of(line)) >= least_chars:
                where.setdefault(key_of(line), []).append((doc, number))
    gone = set()
    for places in where.values():
        if len({doc for doc, _ in places}) >= least_documents:
            places.sort(key=lambda p: (p[0][0] is not None, p[0][0] or 0, p[1]))
            gone.update(places[1:] if keep_first else places)
    out = {}
    for doc in documents:
        parts = doc[1].split("\n")
        kept = [p for n, p in enumerate(parts) if (doc, n) not in gone]
        out[doc] = (len(parts), len(parts) - len(kept), "\n".join(kept))
    return out


def made_rows(seed=4, number=120):
    random.seed(seed)
    shared = [f"Shared line {i}" for i in range(12)] + ["", "  ", "Ä", "the end"]
    rows = []
    for i in range(number):
        parts = [
            random.choice(shared).upper() + random.choice(["", " ", "\t\r"])
            if random.random() < 0.4
            else f"line {random.randint(0, 400)}"
            for _ in range(random.randint(1, 12))
        ]
        rows.append((i, "\n".join(parts)))
    rows += [(300 + i, "hot\nhot\nonly here " + str(i)) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "x\n" * 3_000), (504, "x y")]
    rows += [(None, "no id\nhot"), (None, "no id either"), (510, "twice"), (510, "twice")]
    return rows


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("least_documents", [1, 2, 10])
def test_lines_go_as_by_hand(spark, least_documents, keep_first):
    rows = made_rows()
    if least_documents == 1 and not keep_first:
        rows = rows[:40]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bitmaps = lines.keep_bitmaps(table, least_documents, keep_first=keep_first)
    found = lines.apply_bitmaps(table, bitmaps).collect()
    expected = by_hand(rows, least_documents, keep_first=keep_first)
    assert len(found) == len(rows)
    given = sorted(((i, *expected[(i, t or "")]) for i, t in rows), key=repr)
    assert sorted(map(tuple, found), key=repr) == given


def test_keys_that_cross_ranges(spark):
    """Many more ranges than keys, so that each key fills several and begins inside others."""
    rows = [(i, "\n".join(f"key {(i * j) % 7}" for j in range(5))) for i in range(200)]
    rows += [(1000 + i, f"rare {i // 9}") for i in range(90)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for keep_first in (False, True):
            bitmaps = lines.keep_bitmaps(table, 10, keep_first=keep_first)
            found = {r[0]: tuple(r[1:]) for r in lines.apply_bitmaps(table, bitmaps).collect()}
            expected = by_hand(rows, 10, keep_first=keep_first)
            assert found == {i: v for (i, _), v in expected.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_bitmap_of_a_document(spark):
    table = spark.createDataFrame([(i, "own %d\nall\nlast %d" % (i, i)) for i in range(3)], "doc_id long, text string")
    rows = lines.keep_bitmaps(table, 3).collect()
    assert len(rows) == 3 and {r.n_dropped for r in rows} == {1}
    # Bits 0 and 1 of the first byte: the first line stays, the second goes.
    assert {zlib.decompress(r.keep)[0] & 3 for r in rows} == {1}
    assert lines.keep_bitmaps(table, 4).count() == 0


def test_short_keys_stay(spark):
    table = spark.createDataFrame([(i, "ÄÖ\nlonger") for i in range(4)], "doc_id long, text string")
    found = lines.apply_bitmaps(table, lines.keep_bitmaps(table, 2, least_chars=3)).collect()
    assert {(r.n_lines, r.n_dropped, r.kept) for r in found} == {(2, 1, "ÄÖ")}


def test_awkward_tables(spark, docs, no_docs, awkward):
    bitmaps = lines.keep_bitmaps(docs, 2)
    found = lines.apply_bitmaps(docs, bitmaps)
    expected = by_hand([(i, t) for i, t, _ in awkward], 2)
    digests = found.select("doc_id", "n_dropped", F.sha2("kept", 256).alias("sha"))
    given = [(i, *expected[(i, t or "")]) for i, t, _ in awkward]
    assert sorted(map(tuple, digests.collect()), key=repr) == sorted(
        ((i, dropped, hashlib.sha256(kept.encode()).hexdigest()) for i, _, dropped, kept in given), key=repr
    )
    empty = lines.apply_bitmaps(no_docs, lines.keep_bitmaps(no_docs))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_lines", "n_dropped", "kept"]


def test_a_third_of_all_rows_alike(spark):
    rows = [(None, "hot\ncopy")] * 2_000 + [(i, f"hot\nown {i}") for i in range(4_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = lines.apply_bitmaps(table, lines.keep_bitmaps(table, 10)).collect()
    assert len(found) == 6_000 and all(r.n_dropped == 1 for r in found)
