import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from riskframe.llm import spelling
from riskframe.session import materialize


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted(rows, least=5, delete=True):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if delete and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return counts


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def by_hand(counts, ratio=2):
    near = {w: [v for v in counts if v != w and is_near(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    rows = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(rows)


def vocabulary(seed=2, number=300):
    random.seed(seed)
    counts = {}
    for _ in range(number):
        word = "".join(random.choice("abéÿ") for _ in range(random.randint(3, 7)))
        counts[word] = random.randint(1, 400)
    counts |= {"a" * 60: 9, "a" * 61: 90, "a" * 59 + "b": 3, "x" * 500: 1, "x" * 499: 2}
    # A chain of forms.
    counts |= {"chain" + "abcdefghij"[:i] + "zzzzzzzzzz"[i:]: 3 * 2**i for i in range(11)}
    return counts


def table_of(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)


def test_variants_of_random_words(spark):
    counts = vocabulary()
    found = spelling.variants(table_of(spark, counts)).collect()
    assert sorted(map(tuple, found)) == by_hand(counts)
    assert max(r.n_near for r in found) > 3 and any(r.root != (r.form or r.word) for r in found)


def test_filter_in_slices(spark, monkeypatch):
    counts = vocabulary(seed=9)
    monkeypatch.setattr(spelling, "SLICE_BLOCKS", 2)
    monkeypatch.setattr(spelling, "HELD_EDITS", 3_000)
    found = spelling.variants(table_of(spark, counts)).collect()
    assert sorted(map(tuple, found)) == by_hand(counts)


def test_filter_loses_nothing_and_holds_little_else(spark):
    random.seed(1)
    texts = {"".join(random.choice("abcdefghij") for _ in range(8)) for _ in range(4_000)}
    inside, outside = sorted(texts)[::2], sorted(texts)[1::2]
    words = materialize(spelling.hashed_words(table_of(spark, dict.fromkeys(inside, 1))))
    blocks = {8: -(-len(inside) * spelling.BITS_PER_WORD // 512)}
    lanes = spelling._filter_slice(words, blocks, 0)
    hit = [
        len(spelling._in_filter(spelling.hashes(spelling._matrix(w)), blocks[8], 0, 0, lanes))
        for w in (inside, outside)
    ]
    assert hit[0] == len(inside) and hit[1] < 0.03 * len(outside)


def test_edits_have_the_hashes_of_the_edited_words():
    word, letters = "aabé", np.array([ord(c) for c in "abcé"], dtype=np.uint32)
    expected = {word[:i] + word[i + 1 :] for i in range(4)}
    expected |= {word[:i] + c + word[i + 1 :] for i in range(4) for c in "abcé" if c > word[i]}
    hashes = sorted(int(spelling.hashes(spelling._matrix([w]))[0]) for w in expected)
    found = [h for _, _, part in spelling.edits(spelling._matrix([word]), letters) for h in part.tolist()]
    assert sorted(found) == hashes


def test_words_are_counted(spark, docs, awkward):
    rows = [(i, t) for i, t, _ in awkward]
    # So small a table has few of the planted edits: delete in one run of three.
    for edit, hand in ((spelling.planted, counted(rows)), (None, counted(rows, delete=False))):
        found = dict(spelling.count_words(docs, edit=edit).collect())
        assert found == dict(hand)


def test_query_against_the_contract(spark, tmp_path):
    random.seed(8)
    words = [random.choice("bdfg") + random.choice("aeéo") + random.choice("mnr") + "al" for _ in range(40)]
    rows = [(i, " ".join(random.choice(words).title() + random.choice(["", "s,", "-"]) for _ in range(60))) for i in range(120)]
    rows += [(None, "nobody nobody nobody"), (500, None), (501, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = spelling.op13_spelling(spark, str(tmp_path))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    counts = {w: n for w, n in counted(rows).items() if n >= 3}
    assert sorted(map(tuple, found.collect())) == by_hand(counts)


def test_counts_are_handed_on(spark, monkeypatch):
    rows = [(i, f"alpha beta gamma{'abcdefgh'[i % 8]}") for i in range(200)]
    monkeypatch.setattr(spelling, "HELD_WORDS", 2)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert dict(spelling.count_words(table).collect()) == dict(counted(rows, delete=False))


@pytest.mark.parametrize("rows", [[], [("alone", 4)], [(None, 3), ("", 2), ("words", 1)]])
def test_few_words(spark, rows):
    found = spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()
    assert [tuple(r) for r in found] == [(w, None, w, n, 0, None) for w, n in rows if w]
