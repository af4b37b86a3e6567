import hashlib
import math

import numpy as np
import pytest
from helpers import near, table
from pyspark.sql import functions as F

from riskframe.operators import (
    cleaning,
    encoding,
    features,
    ids,
    joins,
    metrics,
    quality,
    quantiles,
    sampling,
)
from riskframe.session import materialize
from riskframe.sources.schemas import FEATURE_TYPES

QUARTILES = [0.0, 0.25, 0.5, 0.75, 1.0]

# --- quantiles -----------------------------------------------------------


@pytest.mark.parametrize("accuracy", [20, 200, 10_000])
@pytest.mark.parametrize("direct_rows", [0, 5, 100, 1_000_000])
def test_exact_quantiles_match_numpy(spark, accuracy, direct_rows):
    draw = np.random.default_rng(7)
    free = np.concatenate([draw.normal(size=500), draw.exponential(1e6, 80), [0.25] * 300])
    whole = draw.integers(-20, 20, len(free))
    df = spark.createDataFrame(
        [(float(a), int(b)) for a, b in zip(free, whole)], "a double, `b c` int"
    ).repartition(5)
    direct = max(direct_rows, 1)
    got = quantiles.exact_quantiles(df, ["a", "b c"], QUARTILES, accuracy, direct)
    assert got["a"] == pytest.approx(np.quantile(free, QUARTILES).tolist(), rel=1e-14)
    assert got["b c"] == np.quantile(whole, QUARTILES).tolist()


def test_quantiles_take_two_scans_of_the_table(spark):
    """Whatever the values are: here they are told apart in the last bits only."""
    base = spark.range(40_000).select((F.lit(1.0) + F.col("id") * F.lit(2.0**-52)).alias("x"))
    stored = materialize(base, "values")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    watched = stored.mapInArrow(counted, "x double")
    probs = [0.0, 0.1, 0.5, 1.0]
    got = quantiles.exact_quantiles(watched, ["x"], probs, 1_000, 100)["x"]
    expected = np.quantile(1.0 + np.arange(40_000) * 2.0**-52, probs, method="lower")
    assert [round((a - b) * 2**52) for a, b in zip(got, expected)] in ([0, 0, 0, 0], [0, 1, 0, 0], [0, 1, 1, 0], [0, 0, 1, 0])
    assert read.value == 2 * 40_000


def test_models_fitted_in_the_same_session_can_be_shipped(spark):
    """A fitted model holds the session, which quantiles must leave fit to be shipped."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame([(float(i), float(i % 3 > 0)) for i in range(60)], "x double, label double")
    quantiles.exact_quantiles(df, ["x"], [0.5], 50, 1)
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    assert LogisticRegression(maxIter=2).fit(rows).transform(rows).count() == 60


def test_infinite_values_are_the_ends(spark):
    rows = [(-math.inf,)] * 3 + [(float(i),) for i in range(10)] + [(math.inf,)] * 2 + [(math.nan,), (None,)]
    df = spark.createDataFrame(rows, "a double")
    for direct in (1, 1_000_000):
        got = quantiles.exact_quantiles(df, ["a"], [0.0, 0.15, 0.5, 12 / 14, 0.9, 1.0], 50, direct)["a"]
        assert got[0] == -math.inf and got[1] == -math.inf and got[2] == 4.0
        assert got[3] == 9.0 and got[4] == got[5] == math.inf


def test_quantiles_skip_null_and_nan(spark):
    rows = [(1.0, None), (None, None), (math.nan, None), (4.0, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert quantiles.exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [2.5], "b": [None]}


def test_quantiles_of_extreme_values(spark):
    top = 1.7e308
    df = spark.createDataFrame([(x,) for x in (-top, -1.0, 0.0, 5e-324, 1e-323, top)], "a double")
    for direct in (1, 1_000_000):
        got = quantiles.exact_quantiles(df, ["a"], [0.0, 0.4, 0.6, 0.8, 1.0], 8, direct)
        assert got["a"] == [-top, 0.0, 5e-324, 1e-323, top]


def test_quantile_bins(spark):
    df = spark.createDataFrame([(x / 7,) for x in range(1, 9)] + [(None,)], "x double")
    out = quantiles.quantile_bins(df, "x", "level", ("L", "M", "H", "V"))
    assert [r.level for r in out.orderBy(F.col("x").asc_nulls_last()).collect()] == [
        *"LLMMHHVV", None,
    ]


# --- cleaning ------------------------------------------------------------

RAW = "age int, sex int, trestbps int, chol int, thalach int, target int"


def test_clean_removes_copies_before_taking_medians(spark):
    rows = [(50, 1, 100, 200, 80, 1)] * 5 + [
        (51, 1, 120, None, 80, 1),
        (52, 0, None, 260, 90, 0),
        (53, 0, 141, 220, None, 0),
    ]
    df = spark.createDataFrame(rows, RAW)
    assert table(cleaning.clean(df).select("age", "trestbps", "chol", "thalach")) == [
        (50, 100.0, 200.0, 80.0),
        (51, 120.0, 220.0, 80.0),
        (52, 120.0, 260.0, 90.0),
        (53, 141.0, 220.0, 80.0),
    ]


def test_clean_with_approximate_medians(spark):
    df = spark.createDataFrame([(i, 1, i, 1, 1, 1) for i in range(1, 100)], RAW)
    df = df.withColumn("trestbps", F.when(F.col("age") != 7, F.col("trestbps")))
    got = cleaning.clean(df, ["trestbps"], approx=True).where("age = 7").first()
    assert got.trestbps == pytest.approx(50, abs=1)


def test_clean_of_an_empty_table(spark):
    assert cleaning.clean(spark.createDataFrame([], RAW)).collect() == []


def test_min_max(spark):
    df = spark.createDataFrame([(1, 5), (3, 5), (None, 5)], "a int, b int")
    out = cleaning.min_max_normalize(df, {"a": "a_normalized", "b": "b_normalized"})
    assert table(out) == [(1, 5, 0.0, None), (3, 5, 1.0, None), (None, 5, None, None)]


def test_decode(spark):
    df = spark.createDataFrame([(0,), (1,), (9,), (None,)], "fbs int")
    out = cleaning.decode(df, {"fbs": ("fbs_text", {0: "No", 1: "Yes"})})
    assert table(out) == [(0, "No"), (1, "Yes"), (9, None), (None, None)]


# --- features ------------------------------------------------------------


def engineered(spark, rows, **options):
    return features.engineer_features(spark.createDataFrame(rows, RAW), **options)


def test_feature_columns_and_order(spark):
    out = engineered(spark, [(50, 1, 100, 200, 80, 1)])
    assert out.columns == list(FEATURE_TYPES)


def test_rule_score_at_the_thresholds(spark):
    rows = [
        (55, 0, 130, 200, 100, 0),
        (56, 1, 131, 201, 101, 1),
        (56, 1, 140, 240, 120, 0),
        (56, 1, 141, 241, 121, 1),
        (None, None, None, None, None, None),
    ]
    out = engineered(spark, rows)
    assert [r.risk_score for r in out.collect()] == [0, 11, 11, 17, 0]


def test_feature_values(spark):
    row = engineered(spark, [(60, 1, 120, 240, 90, 1)]).first()
    pattern = math.sin(6.0) * math.cos(6.0) * math.sin(4.8)
    assert row.age_group == "55-60"
    assert (row.bp_age_interaction, row.chol_age_interaction, row.hr_bp_interaction) == (
        7200.0, 14400.0, 10800.0,
    )
    assert (row.high_bp_risk, row.high_chol_risk, row.high_hr_risk) == (0, 1, 0)
    assert (row.age_squared, row.bp_squared, row.chol_squared) == (3600.0, 14400.0, 57600.0)
    assert (row.bp_chol_ratio, row.hr_bp_ratio) == (0.5, 0.75)
    assert row.quantum_pattern == pytest.approx(pattern)
    assert row.quantum_pattern_cubed == pytest.approx(pattern**3)
    assert row.sex_age_group == "1_55-60"
    assert (row.healthy_bp, row.healthy_chol, row.healthy_hr) == (True, False, True)
    assert row.health_score == 2


def test_missing_values_and_zero_denominators(spark):
    row = engineered(spark, [(101, 0, 0, 0, None, 1)]).first()
    assert row.age_group is None
    assert row.sex_age_group == "0_nan"
    assert row.bp_chol_ratio is None and row.hr_bp_ratio is None
    assert (row.healthy_hr, row.high_hr_risk) == (False, 0)


def test_large_integers_do_not_overflow(spark):
    row = engineered(spark, [(60, 1, 2_000_000_000, 2_000_000_000, 90, 1)]).first()
    assert row.bp_age_interaction == 1.2e11


def test_id_and_raw_pattern_are_carried_on_request(spark):
    df = spark.createDataFrame(
        [(7, 50, 1, 100, 200, 80, 8.5, 1)],
        "id long, age int, sex int, trestbps int, chol int, thalach int, "
        "quantum_pattern_raw double, target int",
    )
    assert "quantum_pattern_raw" not in features.engineer_features(df).columns
    out = features.engineer_features(df, keep_raw_pattern=True)
    assert out.columns[:2] == ["id", "quantum_pattern_raw"]
    assert out.first().quantum_pattern_raw == 8.5


# --- joins ---------------------------------------------------------------


def test_every_key_too_large_for_one_task_is_hot(spark):
    key = F.when(F.col("id") < 400, 1).when(F.col("id") < 460, 2).otherwise(F.col("id"))
    rows = spark.range(1000).select(key.alias("k"))
    assert table(joins.hot_keys(rows, "k", rows_per_split=50)) == [(1, 8), (2, 2)]
    sums = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert table(joins.hot_keys(sums, "k", 50, F.col("n"))) == [(1, 8), (2, 2)]


def test_large_lookup_with_hot_and_null_keys(spark):
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id"))
    rows = spark.range(300).withColumn("k", key)
    lookup = spark.createDataFrame([(7, "seven"), (None, "none"), (10, "ten")], "k long, v string")
    assert table(joins.hot_keys(rows, "k", 30)) == [(7, 4), (None, 4)]
    got = joins.attach_lookup(rows, lookup, "k", False, rows_per_split=30)
    plain = joins.attach_lookup(rows, lookup, "k", True)
    assert got.columns == plain.columns and table(got) == table(plain)
    # Row 7 has the key 7 as well.
    counts = dict(table(got.groupBy("v").count()))
    assert counts == {"seven": 101, "none": 100, "ten": 1, None: 98}


@pytest.mark.parametrize("rows_per_split", [1, 7, 10_000])
def test_split_join_equals_plain_join(spark, patients, predictions, rows_per_split):
    right = patients.select(F.col("id").alias("pid"), "age_group")
    got = joins.join_on_unique_key(
        predictions, right, "patient_id", "pid", rows_per_split
    )
    plain = predictions.join(right, F.col("patient_id") == F.col("pid"))
    assert got.columns == plain.columns
    assert table(got) == table(plain)


def test_split_join_spreads_a_hot_key(spark, patients, predictions):
    assert table(joins.hot_keys(predictions, "patient_id", 10)) == [(3, 6)]
    parts = predictions.where("patient_id = 3").select(
        F.pmod(joins.row_hash(predictions), F.lit(6)).alias("part")
    )
    assert parts.distinct().count() >= 4


def test_size_check(spark):
    assert joins.at_most(spark.range(5), 5) and not joins.at_most(spark.range(6), 5)
    long_text = spark.createDataFrame([("x" * 100,)], "k string")
    assert joins.at_most(long_text, 5, 100) and not joins.at_most(long_text, 5, 99)
    assert joins.at_most(spark.range(0), 5)


@pytest.mark.parametrize("small, rows_per_split", [(True, 1), (False, 1), (False, 1000)])
def test_lookup_keeps_rows_and_matches_nulls(spark, patients, small, rows_per_split):
    lookup = spark.createDataFrame(
        [("<30", 1), ("40-50", 2), (None, 3)], "age_group string, v int"
    )
    out = joins.attach_lookup(
        patients.select("id", "age_group"), lookup, "age_group", small, rows_per_split
    )
    assert table(out.select("id", "v")) == [
        (1, 1), (2, 2), (3, None), (4, None), (5, 3), (6, 2), (7, None), (8, None),
    ]


def test_large_lookup_is_not_broadcast(spark, patients):
    lookup = patients.select("age_group").distinct().withColumn("v", F.lit(1))
    out = joins.attach_lookup(patients.select("id", "age_group"), lookup, "age_group", small=False)
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joined = [x for x in plan if "Join " in x and "_lookup_key" in x and "_hot_key" not in x]
    assert len(joined) == 1 and "strategy=broadcast" not in joined[0]
    # Only the list of hot keys is, once for either side.
    assert sum("strategy=broadcast" in x for x in plan) == 2


# --- ids -----------------------------------------------------------------


@pytest.mark.parametrize("partitions", [1, 5])
def test_ids_are_contiguous(spark, partitions):
    df = spark.range(0, 103, numPartitions=partitions).withColumnRenamed("id", "x")
    got = ids.assign_ids(df)
    assert got.columns == ["id", "x"]
    assert sorted(tuple(r) for r in got.collect()) == [(i + 1, i) for i in range(103)]
    assert table(got) == table(got)


def test_ids_of_an_empty_table(spark):
    assert ids.assign_ids(spark.createDataFrame([], "x int")).count() == 0


# --- encoding ------------------------------------------------------------


@pytest.mark.parametrize("max_rows", [1000, 2])
def test_codes_are_ranks_in_byte_order(spark, max_rows):
    groups = ["30-40", ">70", "<30", "65-70", None, "30-40"]
    df = spark.createDataFrame([(g, i % 2) for i, g in enumerate(groups)], "g string, s int")
    codes = encoding.category_codes(df, ["g", "s"], max_rows)
    assert table(codes) == [
        ("g", "30-40", 0), ("g", "65-70", 1), ("g", "<30", 2), ("g", ">70", 3), ("g", "None", 4),
        ("s", "0", 0), ("s", "1", 1),
    ]
    coded = encoding.apply_codes(df, codes, ["g", "s"], max_rows)
    assert table(coded) == [(0, 0), (0, 1), (1, 1), (2, 0), (3, 1), (4, 0)]


def test_unknown_categories_and_absent_columns(spark):
    df = spark.createDataFrame([("x",), ("y",)], "risk_level string")
    encoded, codes = encoding.encode_categoricals(df)
    assert table(encoded) == [(0,), (1,)]
    other = spark.createDataFrame([("z",)], "risk_level string")
    assert table(encoding.apply_codes(other, codes, ["risk_level"])) == [(None,)]


# --- splits and folds ----------------------------------------------------


def expected_parts(rows, shares, seed):
    """Brute force: sort each class by hash, cut at the rounded shares."""
    out = {}
    for label in {label for _, label in rows}:
        keys = [k for k, other in rows if other == label]
        keys.sort(key=lambda k: (hashlib.md5(f"{k}:{seed}".encode()).hexdigest(), k))
        total = 0.0
        cuts = []
        for share in shares:
            total += share
            cuts.append(math.floor(len(keys) * total + 0.5))
        for place, key in enumerate(keys, start=1):
            out[key] = sum(place > cut for cut in cuts)
    return out


@pytest.mark.parametrize(
    "shares", [[0.2], [0.2] * 4, [0.0, 0.5], [1.0], [0.001], [0.3, 0.0, 0.3], [0.0]]
)
def test_parts_match_brute_force(spark, shares):
    rows = [(k, 0 if k % 3 else 1) for k in range(300)] + [(1000, 2), (1001, 2), (1002, None)]
    df = spark.createDataFrame(rows, "id long, target int").repartition(3)
    got = sampling.stratified_parts(df, "target", "id", shares, 42)
    assert {r.id: r.part for r in got.collect()} == expected_parts(rows, shares, 42)


def test_many_classes_need_no_broadcast(spark, monkeypatch):
    rows = [(k, k % 50) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, target int")
    monkeypatch.setattr(sampling, "BROADCAST_ROWS", 3)
    got = sampling.stratified_parts(df, "target", "id", [0.2], 1)
    assert {r.id: r.part for r in got.collect()} == expected_parts(rows, [0.2], 1)


def test_split_is_disjoint_and_exact(spark):
    rows = [(k, int(k < 300)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, target int")
    train, test = sampling.stratified_split(df)
    train_ids, test_ids = ({r.id for r in part.collect()} for part in (train, test))
    assert not train_ids & test_ids and len(train_ids | test_ids) == 500
    assert dict(table(test.groupBy("target").count())) == {0: 40, 1: 60}
    again = sampling.stratified_split(df.repartition(7))[1]
    assert {r.id for r in again.collect()} == test_ids
    other = sampling.stratified_split(df, seed=1)[1]
    assert {r.id for r in other.collect()} != test_ids


def test_folds_are_even(spark):
    df = spark.createDataFrame([(k, int(k < 301)) for k in range(502)], "id long, target int")
    counts = sampling.assign_folds(df).groupBy("target", "fold").count().collect()
    assert len(counts) == 10
    for label in (0, 1):
        sizes = [r["count"] for r in counts if r.target == label]
        assert max(sizes) - min(sizes) <= 1


# --- metrics and checks --------------------------------------------------


def test_class_weights(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(0,)] + [(None,)], "target int")
    assert table(metrics.class_weights(df)) == [(0, 1, 2.0), (1, 3, 4 / 6)]


OUTCOMES = (
    [("m", 1, 1)] * 3 + [("m", 0, 1)] + [("m", 1, 0)] * 2 + [("m", 0, 0)] * 4
    + [("no positive call", 1, 0), ("no positive call", 0, 0), ("no positive label", 0, 0)]
)


def test_classification_metrics(spark):
    df = spark.createDataFrame(OUTCOMES, "model_name string, target int, prediction int")
    assert near(table(metrics.classification_metrics(df)), 6) == near([
        ("m", 0.7, 0.75, 0.6, 0.666667, 3, 1, 2, 4),
        ("no positive call", 0.5, 0.0, 0.0, 0.0, 0, 0, 1, 1),
        ("no positive label", 1.0, 0.0, 0.0, 0.0, 0, 0, 0, 1),
    ])
    summed = df.groupBy("model_name", "target", "prediction").count()
    assert table(metrics.classification_metrics(summed, n="count")) == table(
        metrics.classification_metrics(df)
    )


def test_confusion_matrix(spark):
    df = spark.createDataFrame(OUTCOMES, "model_name string, target int, prediction int")
    got = dict(table(metrics.confusion_matrix(df)))
    assert got["m"] == [[4, 1], [2, 3]]


def test_orphans(patients, predictions):
    assert table(quality.orphan_predictions(patients, predictions)) == [(99, 3)]
