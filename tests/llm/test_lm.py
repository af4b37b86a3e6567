import math
import zlib
from collections import Counter

import numpy as np
import pytest

from riskframe.llm import lm


def words(text):
    return lm.tokens_of((text or "").encode())


def unigrams(rows, all_rows):
    c = Counter()
    for _, text, _ in rows:
        c.update(words(text))
        c[None] += 1
    n, v = sum(c.values()), len(c)
    return n, [
        (
            len(words(t)) + 1,
            sum(c[w] > 0 for w in [*words(t), None]),
            sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None]),
        )
        for _, t, _ in all_rows
    ]


@pytest.fixture
def small(monkeypatch):
    """Few words at hand, so that every path is taken."""
    monkeypatch.setattr(lm, "WORDS", 20)
    monkeypatch.setattr(lm, "SHARED", 16)
    monkeypatch.setattr(lm, "AT_HAND", 60)
    monkeypatch.setattr(lm, "LONGEST", 6)
    monkeypatch.setattr(lm, "MOST_COUNTED", 30)


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0


def test_base_scores_equal_brute_force(docs, awkward, small):
    model = lm.train(docs.where(~lm.held_out()), drawn=8, batch=64)
    rows = lm.score(docs, model).collect()
    n, expected = unigrams([r for r in awkward if not held(r[0])], awkward)
    assert model.vocabulary.tokens == n
    found = sorted((r.n_tokens, r.n_known, r.base_score) for r in rows)
    for ours, theirs in zip(found, sorted(expected), strict=True):
        assert ours[:2] == theirs[:2]
        assert ours[2] == pytest.approx(theirs[2], rel=1e-9)
    assert all(r.score < 0 for r in rows)


def test_probabilities_of_every_next_token_add_up_to_one(docs, small):
    model = lm.train(docs, drawn=8, batch=64)
    network, v = model.network, model.vocabulary
    tables = network.tables()
    classes = np.arange(v.end + 1)
    for before, earlier in ((v.begin, v.begin), (0, v.begin), (v.own + 3, 1)):
        logs = network.log_probabilities(
            tables, classes, np.full(len(classes), before), np.full(len(classes), earlier)
        )
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)
    # Words of a shared class, and one that was never seen, share the class between them.
    for shared in range(lm.SHARED):
        total = v.shared_tokens[shared] + lm.ADDED * (v.shared_words[shared] + 1)
        seen = [r.n for r in model.counts.collect() if r.word.encode() not in v.words[: v.own]
                and zlib.crc32(r.word.encode()[: lm.BEGINNING]) % lm.SHARED == shared]
        assert (sum(seen) + lm.ADDED * (len(seen) + 1)) / total == pytest.approx(1)


def test_gradient_is_that_of_the_loss():
    noise = np.array([0.5, 0.3, 0.2])
    model = lm.LogBilinear.start(noise, 1)
    model.parameters[:] = model.parameters.astype(np.float32)
    trainer = lm.Trainer(model, noise, 1, 0.0)
    target, before, earlier = np.array([0, 1, 2, 1]), np.array([3, 0, 1, 2]), np.array([3, 3, 0, 1])
    drawn = 5
    other = np.minimum(
        np.searchsorted(np.cumsum(noise), np.random.default_rng(1).random(drawn)), 2
    )

    def loss(parameters):
        m = lm.LogBilinear(parameters, 3)
        context = m.r[before] * m.c1 + m.r[earlier] * m.c2
        right = (context * m.q[target]).sum(1) + m.b[target] - np.log(drawn * noise[target])
        wrong = context @ m.q[other].T + m.b[other] - np.log(drawn * noise[other])
        return (np.logaddexp(0, -right).sum() + np.logaddexp(0, wrong).sum()) / len(target)

    trainer.step(target, before, earlier, drawn)
    found = np.sqrt(np.maximum(trainer.squares - 1e-6, 0))
    exact = model.parameters.astype(np.float64)
    for place in range(0, len(exact), 7):
        up, down = exact.copy(), exact.copy()
        up[place] += 1e-5
        down[place] -= 1e-5
        slope = (loss(up) - loss(down)) / 2e-5
        assert found[place] == pytest.approx(abs(slope), abs=2e-3)


def test_model_beats_unigrams_on_held_out_text(spark):
    import random

    random.seed(4)
    spoken = [["der", "die", "und", "ein", "zu"], ["the", "of", "and", "in", "to"]]
    rows = [(i, " ".join(random.choices(spoken[i % 2], k=40))) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = lm.train(table.where("doc_id < 500"), batch=128)
    last = lm.score(table.where("doc_id >= 500"), model).agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    gain = (last["sum(score)"] - last["sum(base_score)"]) / last["sum(n_tokens)"]
    assert gain > 0.15


def test_nothing_to_learn_from_and_nothing_to_score(docs, no_docs, small):
    model = lm.train(no_docs)
    rows = lm.score(docs, model).collect()
    assert all(r.n_known == 0 and r.base_score == pytest.approx(0.0) for r in rows)
    assert lm.score(no_docs, model).count() == 0


def test_many_copies_are_averaged(spark):
    packed = spark.createDataFrame(
        [(n, np.full(3, float(n), dtype=np.float32).tobytes()) for n in (1, 2, 3)],
        "tokens long, parameters binary",
    ).coalesce(1)
    row = packed.mapInArrow(lm._average, packed.schema).first()
    assert row.tokens == 6
    assert np.frombuffer(row.parameters, np.float32) == pytest.approx([14 / 6] * 3)


def test_all_words_of_their_own_in_little_memory():
    import tracemalloc

    assert lm.WORDS >= 2_048
    outputs = lm.WORDS + lm.SHARED + 1
    noise = np.random.default_rng(1).random(outputs)
    network = lm.LogBilinear.start(noise / noise.sum(), 1)
    square = 4 * (outputs + 1) ** 2
    tracemalloc.start()
    tables = network.tables()
    kept, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    # One square of single precision stays, and one more beside it is needed to work it out.
    assert kept < 1.1 * square and most < 2.5 * square
    before, earlier = np.array([0, 7, outputs]), np.array([outputs, 3, 9])
    near, far = network.r[before] * network.c1, network.r[earlier] * network.c2
    logits = ((near + far) @ network.q.T + network.b).astype(np.float64)
    target = np.array([5, 2_000, 2_400])
    expected = logits[np.arange(3), target] - np.log(np.exp(logits).sum(axis=1))
    found = network.log_probabilities(tables, target, before, earlier)
    assert found == pytest.approx(expected, abs=1e-4)


def test_the_model_depends_on_the_rows_alone(spark):
    """Not on how the table is cut; and each of several copies is worth averaging."""
    import random

    random.seed(7)
    spoken = [["der", "die", "und", "ein", "zu"], ["the", "of", "and", "in", "to"]]
    rows = [(i, " ".join(random.choices(spoken[i % 2], k=60))) for i in range(400)]
    rows += [(1000 + i, "the same copy of one text " * 8) for i in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for parts in (1, 5, 32):
        docs = table.repartition(parts)
        vocabulary, counts = lm.vocabulary_of(docs)
        digests = lm.stored_digest(docs, vocabulary)
        network = lm.learn(digests, vocabulary, batch=128, copy_tokens=1_500)
        model = lm.Model(network, vocabulary, counts)
        sums = lm.score_digests(digests, model).agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
        found.append((sums["sum(score)"], (sums["sum(score)"] - sums["sum(base_score)"]) / sums["sum(n_tokens)"]))
    assert all(gain > 0.15 for _, gain in found)
    assert found[0][0] == pytest.approx(found[1][0], rel=1e-6) == pytest.approx(found[2][0], rel=1e-6)


def test_copies_of_a_row_are_spread(spark):
    rows = [(None, "one row of many")] * 3_000 + [(i, f"text {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    vocabulary, _ = lm.vocabulary_of(docs)
    digests = lm.stored_digest(docs, vocabulary)
    hot = digests.where("doc_id is null")
    assert hot.select("lot").distinct().count() > 100
    shares = [r["count"] for r in hot.groupBy((hot["lot"] % 4)).count().collect()]
    assert len(shares) > 4 and max(shares) < 0.3 * 3_000
    same = digests.where("doc_id is not null").join(
        lm.stored_digest(docs.repartition(7), vocabulary).where("doc_id is not null").select("doc_id", "lot"),
        ["doc_id", "lot"],
    )
    assert same.count() == 100


def test_digest_of_awkward_texts(docs, no_docs, awkward, small):
    vocabulary, _ = lm.vocabulary_of(docs)
    rows = lm.digest(docs, vocabulary).collect()
    assert len(rows) == len(awkward)
    assert sorted(len(r.classes) // 2 + 1 for r in rows) == sorted(len(words(t)) + 1 for _, t, _ in awkward)
    assert all(r.known + sum(x.n for x in r.rare) == r.n_tokens for r in rows)
    assert lm.digest(no_docs, vocabulary).count() == 0
