import hashlib

from pyspark.sql import functions as F

from riskframe.llm import sketches


def shingles(text, size=5):
    words = (text or "").lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size)), strict=False))


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edits(rows):
    """(doc_id, text, edited, next text) by the rule, in plain Python."""
    own = {}
    for i, text, *_ in rows:
        if i is not None:
            own[i] = min(own.get(i, text or ""), text or "")
    order = sorted(own, reverse=True)
    follows = {i: own[order[(n + 1) % len(order)]] for n, i in enumerate(order)}
    made = []
    for i, text, *_ in rows:
        text = text or ""
        after = follows[i] if i is not None else own[order[0]] if order else ""
        third = len(text) // 3
        made.append((i, text, text[: len(text) - third] + after[:third], after))
    return made


def test_edits_and_estimates_against_plain_python(docs, awkward):
    rows = sketches.neighbour_edits(docs).select(
        "doc_id", "text", "edited",
        sketches.resemblance(sketches.sketch(F.col("text")), sketches.sketch(F.col("edited"))).alias("near"),
        sketches.resemblance(sketches.sketch(F.col("text")), F.col("next_sketch")).alias("next"),
        sketches.distinct_shingles(sketches.sketch(F.col("text"))).alias("number"),
        sketches.containment(sketches.sketch(F.col("text")), sketches.sketch(F.col("edited"))).alias("kept"),
    ).collect()
    expected = edits(awkward)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    for found, (i, text, edited, after) in zip(sorted(rows, key=order), sorted(expected, key=order), strict=True):
        assert (found.doc_id, found.text, found.edited) == (i, text, edited)
        a, b = shingles(text), shingles(edited)
        # All of these texts have fewer shingles than a sketch holds.
        assert abs(found.near - alike(a, b)) < 1e-12
        assert abs(found.next - alike(a, shingles(after))) < 1e-12
        assert found.number == len(a)
        assert abs(found.kept - (len(a & b) / len(a) if a else 1.0)) < 1e-9


def test_long_texts_are_estimated(spark):
    words = [f"w{i}" for i in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[1000:5000])
    table = spark.createDataFrame([(a, b)], "a string, b string")
    one, two = sketches.sketch(F.col("a")), sketches.sketch(F.col("b"))
    near, number, kept = table.select(
        sketches.resemblance(one, two), sketches.distinct_shingles(one), sketches.containment(one, two)
    ).first()
    assert abs(near - 0.6) < 0.15
    assert abs(number / 3996 - 1) < 0.3
    assert abs(kept - 0.75) < 0.2


def test_merged_sketches_equal_the_sketch_of_all_shingles(spark):
    rows = [("k", f"a{i} b{i} c{i} d{i} e{i}") for i in range(900)] + [("k", "a0 b0 c0 d0 e0"), ("m", ""), ("m", None), (None, "x")]
    table = spark.createDataFrame(rows, "key string, text string").repartition(5)
    parts = table.withColumn("sketch", sketches.sketch(F.col("text")))
    merged = dict(sketches.merge_sketches(parts, ["key"]).collect())
    every = sorted({h for (k, _), r in zip(rows, rows, strict=True) if k == "k" for h in ()})
    every = sorted({r.h for r in parts.where("key = 'k'").select(F.explode("sketch").alias("h")).collect()})
    assert merged["k"] == every[: sketches.SIZE]
    assert "m" not in merged
    assert len(merged[None]) == 1


def test_digest_of_contract(spark, tmp_path, docs, awkward):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sketches.op9_sketches(spark, str(tmp_path)).collect()
    assert len(rows) == len(awkward)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.edited_sha256, set()).add(r.edited_fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    expected = {hashlib.sha256(e.encode()).hexdigest() for _, _, e, _ in edits(awkward)}
    assert {r.edited_sha256 for r in rows} == expected


def test_empty_table_and_single_document(spark, no_docs):
    assert sketches.neighbour_edits(no_docs).count() == 0
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert sketches.neighbour_edits(one).first().edited == "abcdab"


def test_plan_has_no_python(docs):
    plan = sketches.neighbour_edits(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
