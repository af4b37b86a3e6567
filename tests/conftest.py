from datetime import datetime

import pytest

from riskframe.session import build_session
from riskframe.sources.schemas import PATIENTS, PREDICTIONS, conform


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        master="local[4]",
        shuffle_partitions=4,
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def patients(spark):
    """Eight patients, one without an age group, one without predictions."""
    rows = [
        # id, age, sex, age_group, target, exang, trestbps_normalized, risk_score
        (1, 25, 0, "<30", 0, "No", 0.1, 2),
        (2, 45, 1, "40-50", 1, "Yes", 0.5, 5),
        (3, 58, 1, "55-60", 1, "No", 0.9, 9),
        (4, 72, 0, ">70", 0, "Yes", 0.7, 7),
        (5, None, 1, None, 1, "Yes", None, 4),
        (6, 48, 0, "40-50", 0, "No", 0.2, 1),
        (7, 59, 1, "55-60", 0, None, 0.4, 8),
        (8, 33, 1, "30-40", 1, "No", 0.6, 3),
    ]
    names = "id long, age int, sex int, age_group string, target int, exang string, " \
        "trestbps_normalized double, risk_score int"
    return conform(spark.createDataFrame(rows, names), PATIENTS)


@pytest.fixture(scope="session")
def prediction_rows():
    """Patient 3 owns most of the rows; patient 99 does not exist."""
    rows, number = [], 0
    for patient in (1, 2, 4, 5, 6, 7, 99):
        for model, p in (("a", 0.1 * patient % 1), ("b", 0.2), ("c", None)):
            number += 1
            day = 1 + number % 3
            prediction = None if p is None else int(p > 0.5)
            rows.append((number, patient, prediction, p, model, datetime(2024, 3, day, 5)))
    for i in range(60):
        number += 1
        p = (i * 7 % 61) / 61
        model = "abc"[i % 3]
        rows.append((number, 3, int(p >= 0.4), p, model, datetime(2024, 3, 1 + i % 9, 23, 59)))
    number += 1
    rows.append((number, None, 1, 0.7, "a", datetime(2024, 3, 2)))
    return rows


@pytest.fixture(scope="session")
def predictions(spark, prediction_rows):
    return spark.createDataFrame(prediction_rows, PREDICTIONS).repartition(3)
