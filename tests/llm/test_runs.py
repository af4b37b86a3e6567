import hashlib
import random
import zlib

from riskframe.llm import runs

SPACES = " \t\n\x0b\x0c\r"


def by_hand(words, least=12):
    """Runs by comparing words q apart, for every q; of one stretch the smallest period."""
    number, found = len(words), {}
    for q in range(1, number // 2 + 1):
        i = 0
        while i + q < number:
            start = i
            while i + q < number and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, 2 * q):
                found.setdefault((start, length), q)
            i += i == start
    return sorted((start, length, q) for (start, length), q in found.items())


def split(text):
    for space in SPACES[1:]:
        text = text.replace(space, " ")
    return [w for w in text.split(" ") if w]


def test_runs_of_random_words():
    random.seed(3)
    for least in (2, 3, 5, 12):
        for _ in range(250):
            texts = []
            for _ in range(random.randint(1, 4)):
                letters, number = random.choice([1, 2, 2, 3, 5]), random.randint(0, 60)
                words = [random.choice("abcde"[:letters]).encode() for _ in range(number)]
                if random.random() < 0.4 and number > 4:
                    a = random.randrange(number)
                    p = random.randint(1, max(1, (number - a) // 3))
                    words = [words[i] if i < a else words[a + (i - a) % p] for i in range(number)]
                texts.append(words)
            assert runs.runs_of(texts, least) == [by_hand(w, least) for w in texts]


def test_runs_of_long_texts():
    assert runs.runs_of([[b"word"] * 100_000]) == [[(0, 100_000, 1)]]
    random.seed(5)
    words = [random.choice([b"a", b"b"]) for _ in range(1_500)]
    assert runs.runs_of([words]) == [by_hand(words)]
    one, two = [b"b"], [b"a"]
    while len(two) < 1_200:
        one, two = two, two + one
    assert runs.runs_of([two]) == [by_hand(two)]


def test_suffixes_are_in_order():
    random.seed(6)
    import numpy as np

    ids = np.array([random.randint(0, 2) for _ in range(300)])
    suffixes, shared = runs.sorted_suffixes(ids, 4)
    tails = [ids[s:].tolist() for s in suffixes]
    assert tails == sorted(tails)
    for i in range(1, len(tails)):
        same = 0
        for x, y in zip(tails[i - 1], tails[i], strict=False):
            if x != y:
                break
            same += 1
        assert shared[i] == (same if same >= 4 else 0)


def test_collapsed_words():
    words = b"x a b a b a b a b a b a b a b y".split()
    found = runs.runs_of([words])[0]
    assert found == [(1, 14, 2)]
    assert runs.collapsed(words, found) == [b"x", b"a", b"b", b"y"]


def digest(doc_id, text):
    """The contract, word by word."""
    words = split(text or "")
    number = len(words)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and number:
        g = h // 10
        a = g % number
        p = 1 + (number - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = by_hand(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    longest = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id, len(found), *longest, 1000 * longest[1] // longest[2] if found else None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def test_query_against_the_contract(spark, tmp_path, docs, awkward, no_docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = runs.op12_runs(spark, str(tmp_path)).collect()
    # The one very long text is of one word; by hand it would take all periods.
    expected = [digest(i, t) for i, t, _ in awkward if len(t or "") < 10_000]
    assert sorted((tuple(r) for r in found if r.doc_id != 240), key=repr) == sorted(expected, key=repr)
    long = next(r for r in found if r.doc_id == 240)
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 20_000, 1)
    assert any(r.n_runs for r in found if r.doc_id != 240)
    assert runs.word_runs(no_docs).count() == 0


def test_texts_are_looked_at_in_parts(spark, monkeypatch):
    rows = [(i, " ".join(f"w{j % (3 + i)}" for j in range(40))) for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = {r.doc_id: r.runs for r in runs.word_runs(table).collect()}
    assert {i: [tuple(x) for x in v] for i, v in whole.items()} == {
        i: by_hand(t.split()) for i, t in rows
    }
