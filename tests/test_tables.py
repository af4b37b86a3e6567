"""Stored tables: staged writes, runs, layout, lines that cannot be read."""

from datetime import datetime, timedelta

import pytest
from helpers import table
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.operators.layout import interleaved, ordered_by_all
from riskframe.sources import files, tables

NAMES = T.StructType([T.StructField("id", T.LongType()), T.StructField("kind", T.StringType())])


def numbers(spark, *ids):
    return spark.createDataFrame([(i, f"k{i % 2}") for i in ids], NAMES).coalesce(1)


def failing(spark):
    """Rows of which the last cannot be made."""
    stop = F.when(F.col("id") < 990, F.col("id")).otherwise(F.raise_error(F.lit("stop")).cast("long"))
    return spark.range(1000).repartition(3).select(stop.alias("id"), F.lit("k").alias("kind"))


def test_a_write_that_fails_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace(numbers(spark, 1, 2), path)
    for _ in range(2):
        with pytest.raises(PySparkException, match="stop"):
            tables.replace(failing(spark), path)
    assert table(tables.read(spark, path, NAMES)) == [(1, "k1"), (2, "k0")]
    tables.replace(numbers(spark, 3), path)
    assert table(tables.read(spark, path, NAMES)) == [(3, "k1")]


def test_readers_keep_the_version_before(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace(numbers(spark, 1), path)
    reader = tables.read(spark, path, NAMES)
    tables.replace(numbers(spark, 2), path)
    assert table(reader) == [(1, "k1")]
    for i in range(3, 8):
        tables.replace(numbers(spark, i), path)
    assert table(tables.read(spark, path, NAMES)) == [(7, "k1")]
    assert len(list((tmp_path / "t").glob("version=*"))) == 2
    assert len([p for p in (tmp_path / "t" / "_commits").iterdir() if not p.name.startswith(".")]) == 2


def test_a_table_of_plain_files_can_be_read(spark, tmp_path):
    path = str(tmp_path / "t")
    numbers(spark, 5).write.parquet(path)
    assert table(tables.read(spark, path, NAMES)) == [(5, "k1")]
    tables.replace(numbers(spark, 6), path)
    assert table(tables.read(spark, path, NAMES)) == [(6, "k0")]


def test_a_repeated_run_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.runs(spark, path) == [] and tables.read_runs(spark, path, NAMES).count() == 0
    run = tables.put_run(numbers(spark, 1, 2), path, "2024-02-01T00:00:00/é", ["kind"])
    tables.put_run(numbers(spark, 7, 9), path, "other", ["kind"])
    assert tables.runs(spark, path) == sorted([run, "other"])
    # The repeated run has no row of k1 any more.
    tables.put_run(numbers(spark, 4), path, run, ["kind"])
    got = tables.read_runs(spark, path, NAMES)
    assert table(got) == [(4, "k0", run), (7, "k1", "other"), (9, "k1", "other")]
    with pytest.raises(PySparkException):
        tables.put_run(failing(spark), path, "other", ["kind"])
    with pytest.raises(PySparkException):
        tables.put_run(failing(spark), path, "new", ["kind"])
    assert tables.runs(spark, path) == sorted([run, "other"])
    assert table(tables.read_runs(spark, path, NAMES)) == table(got)
    assert table(tables.read_runs(spark, path, NAMES, [run])) == [(4, "k0", run)]
    tables.drop_run(spark, path, run)
    assert tables.runs(spark, path) == ["other"]


def test_files_that_no_run_committed_are_not_overlooked(spark, tmp_path):
    numbers(spark, 5).write.parquet(str(tmp_path / "t"))
    with pytest.raises(LookupError, match="no run"):
        tables.read_runs(spark, str(tmp_path / "t"), NAMES)


def test_a_run_without_a_key_is_a_new_one(spark, predictions, tmp_path):
    path = str(tmp_path / "p")
    first, second = (files.append_predictions(predictions, path) for _ in range(2))
    assert first != second
    assert files.read_predictions(spark, path).count() == 2 * predictions.count()
    assert files.stored_predictions(spark, path, second).count() == predictions.count()
    assert files.stored_predictions(spark, str(tmp_path / "none")) is None
    only = files.read_predictions(spark, path, [first])
    assert all(f"run={first}/" in name for name in only.inputFiles())


# --- layout ----------------------------------------------------------------


def test_interleaved_bits(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (5, 3), (65535, 65535)], "a long, b long")
    got = [r[0] for r in rows.select(interleaved([F.col("a"), F.col("b")])).collect()]
    # 5 = 101 and 3 = 011 in turn: bits of a at even places, of b at odd ones.
    assert got == [0, 1, 2, 0b011011, 2**32 - 1]


def scanned(df):
    """Rows that the scan hands on, after parts of files were skipped by their extremes."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    leaves = plan.collectLeaves()
    leaf = leaves.apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_either_filter_skips_most_rows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = spark.range(40_000).select(
        "id",
        F.pmod(F.xxhash64("id"), F.lit(500)).alias("patient_id"),
        F.lit(1).alias("prediction"),
        F.lit(0.5).alias("probability"),
        F.lit("m").alias("model_name"),
        (F.lit(start) + F.make_dt_interval(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(60)).cast("int"))).cast("timestamp_ntz").alias("created_at"),
    )
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.append_predictions(rows, str(tmp_path / "laid"), by_day_and_patient=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files.append_predictions(rows.repartition(64), str(tmp_path / "any"))
    dates = (start + timedelta(days=30, hours=-1), start + timedelta(31))
    filters = [
        lambda path: files.read_predictions(spark, path, dates=dates),
        lambda path: files.read_predictions(spark, path).where("patient_id = 123"),
    ]
    for kept in filters:
        laid, other = kept(str(tmp_path / "laid")), kept(str(tmp_path / "any"))
        assert scanned(laid) < 0.4 * 40_000 and scanned(laid) < 0.6 * scanned(other)
        assert table(laid) == table(other)
    assert table(filters[0](str(tmp_path / "any"))) == table(
        files.read_predictions(spark, str(tmp_path / "any")).where(
            "created_at >= timestamp_ntz'2024-01-30 23:00' and created_at < timestamp_ntz'2024-02-01'"
        )
    )


def test_layout_keeps_all_rows(spark):
    rows = [(i, None if i % 5 == 0 else i % 3, 7.0) for i in range(50)] + [(99, 1, None)]
    df = spark.createDataFrame(rows, "id long, a long, b double")
    assert table(ordered_by_all(df, [F.col("a"), F.col("b")], "id")) == table(df)
    assert ordered_by_all(df.limit(0), [F.col("a")], "id").count() == 0


# --- lines that cannot be read ---------------------------------------------

HEADER = "Age,Gender,BloodPressure,Cholesterol,HeartRate,QuantumPatternFeature,HeartDisease"
GOOD = ["68,1,105,191,107,8.36,1", "58,0,,249,89,,0"]
BAD = {
    "68,1,high,191,107,8.36,1": "BloodPressure is no int",
    "1,2,3": "3 fields, not 7",
    "1,2,3,4,5,6,7,8": "8 fields, not 7",
    "1,2,3,4,5,x,1": "QuantumPatternFeature is no double",
}


def test_bad_lines_are_put_apart(spark, tmp_path):
    path, beside = str(tmp_path / "raw.csv"), str(tmp_path / "bad")
    (tmp_path / "raw.csv").write_text("\n".join([HEADER, GOOD[0], *BAD, GOOD[1]]) + "\n")
    loaded = files.load_raw(spark, path, beside, most_bad=4)
    assert table(loaded) == [(58, 0, None, 249, 89, None, 0), (68, 1, 105, 191, 107, 8.36, 1)]
    assert dict(table(files.read_bad_lines(spark, beside))) == BAD
    with pytest.raises(files.TooManyBadLines, match="4 lines"):
        files.load_raw(spark, path, beside, most_bad=3)
    assert files.read_bad_lines(spark, beside).count() == 4
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        files.load_raw(spark, path).collect()


def test_no_bad_lines(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("\n".join([HEADER, *GOOD]) + "\n")
    loaded = files.load_raw(spark, str(tmp_path / "raw.csv"), str(tmp_path / "bad"), most_bad=0)
    assert loaded.count() == 2 and files.read_bad_lines(spark, str(tmp_path / "bad")).count() == 0
