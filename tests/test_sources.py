from datetime import datetime

import pytest
from helpers import table
from pyspark.sql import functions as F

from riskframe import session
from riskframe.sources import files, jdbc, schemas, stores


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


HEADER = "Age,Gender,BloodPressure,Cholesterol,HeartRate,QuantumPatternFeature,HeartDisease"


def test_load_raw(spark, tmp_path):
    lines = f"{HEADER}\r\n68,1,105,191,107,8.36,1\r\n58,0,,249,89,,0\r\n"
    path = write(tmp_path / "raw.csv", lines)
    df = files.load_raw(spark, path)
    assert df.columns == [
        "age", "sex", "trestbps", "chol", "thalach", "quantum_pattern_raw", "target",
    ]
    assert [tuple(r) for r in df.collect()] == [
        (68, 1, 105, 191, 107, 8.36, 1), (58, 0, None, 249, 89, None, 0),
    ]


def test_malformed_csv_fails(spark, tmp_path):
    path = write(tmp_path / "bad.csv", f"{HEADER}\n68,1,high,191,107,8.36,1\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        files.load_raw(spark, path).collect()


def test_conform(spark):
    df = spark.createDataFrame([(1, 2.5, 7)], "id int, age double, extra int")
    out = schemas.conform(df, schemas.PATIENTS)
    assert [f.dataType for f in out.schema] == [f.dataType for f in schemas.PATIENTS]
    row = out.first()
    # A fractional value is rounded into an integer column.
    assert (row.id, row.age, row.sex) == (1, 3, None)


def test_patients_are_replaced(spark, patients, tmp_path):
    path = str(tmp_path / "patients")
    files.write_patients(patients, path)
    files.write_patients(patients.where("id < 3").drop("created_at"), path, datetime(2024, 1, 2))
    stored = files.read_patients(spark, path)
    assert stored.schema == schemas.PATIENTS
    assert table(stored.select("id", "created_at")) == [
        (1, datetime(2024, 1, 2)), (2, datetime(2024, 1, 2)),
    ]


def test_predictions_are_appended(spark, predictions, tmp_path):
    path = str(tmp_path / "predictions")
    files.append_predictions(predictions.where("model_name = 'a'"), path)
    files.append_predictions(predictions.where("model_name <> 'a'"), path)
    stored = files.read_predictions(spark, path)
    assert stored.columns == predictions.columns
    assert table(stored) == table(predictions)
    plan = stored.where("model_name = 'b'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model_name" in plan


def test_csv_has_as_many_files_as_partitions(spark, tmp_path):
    path = tmp_path / "importance"
    files.write_csv(spark.createDataFrame([("x", 0.5)], "feature string, importance double"), str(path))
    texts = [f.read_text() for f in path.glob("part-*.csv")]
    assert "feature,importance\nx,0.5\n" in texts
    files.write_csv(spark.range(100_001).repartition(3), str(path))
    assert len(list(path.glob("part-*.csv"))) == 3


def test_metrics_and_codes_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("m", 0.5, 0.25, 1.0, 0.4, [[1, 2], [3, 4]], 0.3, {"C": "1"}, "[]", datetime(2024, 1, 1))],
        schemas.MODEL_METRICS,
    )
    path = str(tmp_path / "metrics")
    stores.append_metrics(rows, path)
    stores.append_metrics(rows, path)
    assert table(stores.read_metrics(spark, path)) == table(rows.union(rows))
    codes = spark.createDataFrame([("f", "a", 0)], "feature string, value string, code long")
    stores.save_codes(codes, str(tmp_path / "codes"))
    assert table(stores.read_codes(spark, str(tmp_path / "codes"))) == [("f", "a", 0)]


def test_jdbc_options(monkeypatch):
    monkeypatch.delenv("DATABASE_URL", raising=False)
    with pytest.raises(ValueError):
        jdbc.jdbc_options("t")
    monkeypatch.setenv("DATABASE_URL", "postgresql://host/db")
    options = jdbc.jdbc_options(
        "t", partition_column="id", bounds=(1, 100), partitions=8, fetchsize="9"
    )
    assert options == {
        "url": "jdbc:postgresql://host/db", "dbtable": "t", "fetchsize": "9",
        "partitionColumn": "id", "lowerBound": "1", "upperBound": "100", "numPartitions": "8",
    }
    with pytest.raises(ValueError):
        jdbc.jdbc_options("t", partition_column="id")


def test_scratch_is_in_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert session.scratch_path(spark, "x").startswith(named)
    df = session.materialize(spark.range(5).withColumn("p", F.col("id") % 2), "t", ["p"])
    assert df.columns == ["id", "p"]
    assert all(name.startswith(f"file://{named}") for name in df.inputFiles())


def test_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())
