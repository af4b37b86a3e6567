import random
import zlib

import numpy as np
import pytest

from riskframe.llm import toxicity


def corpus(number=1500, seed=9):
    """Texts of invented words; every ninth holds a foul one, and most of those are labelled."""
    random.seed(seed)
    plain = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("ba", "do", "fi", "gu", "he")]
    rows, labels = [], []
    for i in range(number):
        text = random.choices(plain, k=random.randint(3, 80))
        foul = i % 9 == 0
        if foul:
            text[random.randrange(len(text))] = random.choice(["Vermin!", "scumbag", "filthy,"])
        rows.append((i, " ".join(text), "en", "s", 1))
        if i % 2 == 0:
            labels.append((i, 1, int(foul)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, marks


def test_held_out_documents(tables):
    docs, marks = tables
    model = toxicity.train(docs, marks, toxicity.learned_rows())
    rows = toxicity.score(docs, model).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 300
    caught = [r.score >= 0.7 for r in held if r.doc_id % 9 == 0]
    assert sum(caught) / len(caught) > 0.9
    assert sum(r.score >= 0.7 for r in held if r.doc_id % 9) <= 2


def test_labels_of_the_held_out_fold_are_never_seen(spark, tables):
    docs, marks = tables
    held = [r.doc_id for r in marks.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    turned = marks.selectExpr(
        "doc_id", "quality", f"if(doc_id in ({','.join(map(str, held))}), 1 - toxic, toxic) as toxic"
    )
    one = toxicity.train(docs, marks, toxicity.learned_rows())
    two = toxicity.train(docs, turned, toxicity.learned_rows())
    assert one.bias == two.bias and (one.weights == two.weights).all()


def test_awkward_documents_and_labels(spark, docs, awkward, no_docs):
    marks = spark.createDataFrame(
        [(3, 1, 1), (3, 0, 0), (6, 1, None), (None, 1, 1), (9999, 1, 1), (9, 1, 0), (15, 0, 1)],
        "doc_id long, quality int, toxic int",
    )
    model = toxicity.train(docs, marks)
    rows = toxicity.score(docs, model, keep=True).collect()
    assert len(rows) == len(awkward)
    assert all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if not (r.kept.text or "").strip()}
    assert len(empty) == 1
    same = {}
    for r in rows:
        same.setdefault(r.kept.text, set()).add(r.score)
    assert all(len(v) == 1 for v in same.values())
    assert toxicity.score(no_docs, model).count() == 0


def test_without_confirmed_examples_all_score_alike(docs, no_docs, spark):
    marks = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    for model in (toxicity.train(docs, marks), toxicity.train(no_docs, marks)):
        assert not model.weights.any()
        assert len({r.score for r in toxicity.score(docs, model).collect()}) == 1


def test_risk_is_not_driven_below_zero():
    """Positives that look like everything else get no weight, however often they are seen."""
    random.seed(1)
    rows = [np.array(sorted(random.sample(range(50), 8)), dtype=np.int32) for _ in range(400)]
    model = toxicity.fit_nnpu(rows[:100], rows[100:], 0.2)
    assert not model.weights.any()
    assert -4 < model.bias < 1


def by_hand(positive, unlabelled, prior, epochs, rate=0.1, decay=3e-4):
    """The fit in plain loops, its slopes set against differences of the risk."""
    places = sorted({int(p) for r in [*positive, *unlabelled] for p in r})
    share = {p: sum(p in r for r in positive) / len(positive) for p in places}
    usual = {p: (sum(p in r for r in unlabelled) + 1) / (len(unlabelled) + 2) for p in places}
    telling = [
        p for p in places
        if share[p] * len(positive) >= 2 and share[p] >= 4 * usual[p]
        and share[p] - usual[p] >= 5 * (usual[p] * (1 - usual[p]) / len(positive)) ** 0.5
    ]

    def margin(values, row):
        return values[-1] + sum(values[telling.index(p)] for p in row if p in telling)

    def risk(values):
        ours, theirs = ([margin(values, r) for r in rows] for rows in (positive, unlabelled))
        as_positive = sum(np.logaddexp(0, -m) for m in ours) / len(ours)
        as_negative = sum(np.logaddexp(0, m) for m in ours) / len(ours)
        rest = sum(np.logaddexp(0, m) for m in theirs) / len(theirs) - prior * as_negative
        return prior * as_positive, rest

    def slopes(values, below):
        found = [0.0] * len(values)
        for rows, ours in ((positive, True), (unlabelled, False)):
            for row in rows:
                chance = 1 / (1 + np.exp(-margin(values, row)))
                rest = (-prior if ours else 1) * chance / len(rows)
                up = prior * (chance - 1) / len(rows) if ours else 0
                for i in [*(telling.index(p) for p in row if p in telling), len(telling)]:
                    found[i] += -rest if below else up + rest
        return found

    def checked(values, below):
        """The slopes, after a look at the differences of the risk."""
        found = slopes(values, below)
        for i in range(len(values)):
            ahead, behind = ([x + (j == i) * side for j, x in enumerate(values)] for side in (1e-6, -1e-6))
            pairs = [risk(v) for v in (ahead, behind)]
            parts = [-rest if below else up + rest for up, rest in pairs]
            assert found[i] == pytest.approx((parts[0] - parts[1]) / 2e-6, abs=1e-6)
        return found

    values = [0.0] * len(telling) + [float(np.log(prior / (1 - prior)))]
    mean, square = [0.0] * len(values), [0.0] * len(values)
    turned = 0
    for epoch in range(epochs):
        below = risk(values)[1] < 0
        turned += below
        for i, slope in enumerate(checked(values, below) if epoch % 10 == 3 else slopes(values, below)):
            slope += decay * values[i] if i < len(telling) else 0.0
            mean[i] = 0.9 * mean[i] + 0.1 * slope
            square[i] = 0.99 * square[i] + 0.01 * slope**2
        for i in range(len(values)):
            step = (mean[i] / (1 - 0.9 ** (epoch + 1))) / ((square[i] / (1 - 0.99 ** (epoch + 1))) ** 0.5 + 1e-8)
            values[i] -= rate * (1 - epoch / epochs) * step
    return telling, values, turned


@pytest.mark.parametrize("prior", [0.1, 0.85])
def test_fit_equals_brute_force(prior):
    random.seed(3)
    positive = [np.array(sorted({random.randrange(6), 10 + random.randrange(3)}), dtype=np.int32) for _ in range(24)]
    unlabelled = [np.array(sorted(random.sample(range(8), 3)), dtype=np.int32) for _ in range(80)]
    unlabelled[0] = np.array([1, 11], dtype=np.int32)
    telling, values, turned = by_hand(positive, unlabelled, prior, 40)
    model = toxicity.fit_nnpu(positive, unlabelled, prior, epochs=40)
    assert telling and set(np.flatnonzero(model.weights)) == set(telling)
    assert model.bias == pytest.approx(values[-1], abs=1e-3)
    assert model.weights[telling] == pytest.approx(values[:-1], abs=1e-3)
    # With the high prior the part that must not be negative is, and steps are turned.
    assert (turned > 0) == (prior > 0.5)


def test_scores_equal_brute_force(docs, awkward):
    draw = np.random.default_rng(2)
    model = toxicity.Model(-1.0, draw.normal(size=toxicity.PLACES) * (draw.random(toxicity.PLACES) < 0.3))
    expected = []
    for i, text, _ in awkward:
        places = set()
        word = ""
        for c in (text or "").lower() + " ":
            if c.isalnum():
                word += c
                continue
            if word:
                parts = {"=" + word, *(word[:n] for n in (3, 4, 5, 6) if len(word) >= n)}
                places |= {zlib.crc32(p.encode()) % toxicity.PLACES for p in parts}
            word = ""
        expected.append((i, 1 / (1 + np.exp(1.0 - sum(model.weights[p] for p in places)))))
    found = [tuple(r) for r in toxicity.score(docs, model).collect()]

    def in_order(rows):
        return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))

    for ours, theirs in zip(in_order(found), in_order(expected), strict=True):
        assert ours[0] == theirs[0] and ours[1] == pytest.approx(theirs[1], rel=1e-9)
