"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.operators.layout import ordered_by_all
from riskframe.session import materialize
from riskframe.sources import tables
from riskframe.sources.schemas import (
    PATIENTS,
    PREDICTIONS,
    RAW,
    RAW_CLINICAL,
    RAW_COLUMNS,
    conform,
)


#: The day of a prediction, which is stored beside its time.
DAY = "_day"
#: The line of a record that could not be read.
LINE = "_line"


class TooManyBadLines(ValueError):
    """A file has more lines that cannot be read than it may."""


def load_raw(
    spark: SparkSession, path: str, bad_lines: str | None = None, most_bad: int | None = None
) -> DataFrame:
    """Raw CSV with a header, under the canonical column names.

    The schema is given, so no pass is spent on inferring it. A malformed line
    fails the read; with ``bad_lines`` such lines are kept apart instead, in the
    table of that name, with the reason, and the rest is loaded. More than
    ``most_bad`` of them are an error; the table tells which. Either way it
    replaces that of an earlier load.
    """
    reader = spark.read.option("header", True)
    if bad_lines is None:
        raw = reader.schema(RAW).option("mode", "FAILFAST").csv(path)
        return raw.withColumnsRenamed(RAW_COLUMNS)
    schema = T.StructType([*RAW.fields, T.StructField(LINE, T.StringType())])
    reader = reader.schema(schema).option("mode", "PERMISSIVE")
    # Stored, so that the file is parsed once for good and bad lines.
    lines = materialize(reader.option("columnNameOfCorruptRecord", LINE).csv(path), "lines")
    bad = lines.where(F.col(LINE).isNotNull())
    tables.replace(bad.select(F.col(LINE).alias("line"), _reason(F.col(LINE))), bad_lines)
    number = read_bad_lines(spark, bad_lines).count()
    if most_bad is not None and number > most_bad:
        raise TooManyBadLines(f"{number} lines of {path} cannot be read, see {bad_lines}")
    good = lines.where(F.col(LINE).isNull()).drop(LINE)
    return good.withColumnsRenamed(RAW_COLUMNS)


def read_bad_lines(spark: SparkSession, path: str) -> DataFrame:
    return tables.read(spark, path, "line string, reason string")


def _reason(line: Column) -> Column:
    """What is wrong with a line: its number of fields, or the first that is no number."""
    fields = F.split(line, ",", -1)
    reason = F.lit("not readable")
    for i, field in reversed(list(enumerate(RAW))):
        text = F.trim(F.get(fields, F.lit(i)))
        wrong = (text != "") & text.try_cast(field.dataType).isNull()
        reason = F.when(wrong, F.lit(f"{field.name} is no {field.dataType.simpleString()}")).otherwise(reason)
    number = F.size(fields)
    return (
        F.when(number != len(RAW), F.concat(number.cast("string"), F.lit(f" fields, not {len(RAW)}")))
        .otherwise(reason)
        .alias("reason")
    )


def write_patients(df: DataFrame, path: str, created_at: datetime | None = None) -> None:
    """Replace the patients table, once the write has succeeded.

    ``created_at`` defaults to the current time.
    """
    stamped = df
    if "created_at" not in df.columns:
        stamped = df.withColumn("created_at", run_time(created_at))
    tables.replace(conform(stamped, PATIENTS), path)


def read_patients(spark: SparkSession, path: str) -> DataFrame:
    return tables.read(spark, path, PATIENTS)


def append_predictions(
    df: DataFrame, path: str, run: str | None = None, by_day_and_patient: bool = False
) -> str:
    """Add a run's predictions, in one folder per run and model; returns the run's key.

    A run that is repeated under its key replaces what it added before. With
    ``by_day_and_patient`` the rows are laid out so that filters on the time and on
    the patient each skip most of a file's parts.
    """
    rows = conform(df, PREDICTIONS).withColumn(DAY, F.col("created_at").cast("date"))
    if by_day_and_patient:
        keys = [F.unix_date(DAY), F.col("patient_id")]
        rows = ordered_by_all(rows, keys, "created_at", "patient_id", "id")
    return tables.put_run(rows, path, run, ["model_name"])


def read_predictions(
    spark: SparkSession,
    path: str,
    runs: Sequence[str] | None = None,
    dates: tuple[datetime | None, datetime | None] = (None, None),
) -> DataFrame:
    """Predictions of all runs, or of those named; from the first of ``dates`` on, and before the
    second.

    The extremes of days in a file's parts tell which of them are read; Spark does
    not look at those of a time without zone.
    """
    schema = T.StructType([*PREDICTIONS.fields, T.StructField(DAY, T.DateType())])
    rows = tables.read_runs(spark, path, schema, runs)
    start, end = dates
    if start is not None:
        late = F.col("created_at") >= F.lit(start).cast("timestamp_ntz")
        rows = rows.where((F.col(DAY) >= F.lit(start.date())) & late)
    if end is not None:
        early = F.col("created_at") < F.lit(end).cast("timestamp_ntz")
        rows = rows.where((F.col(DAY) <= F.lit(end.date())) & early)
    return rows.select(*PREDICTIONS.fieldNames())


def stored_predictions(spark: SparkSession, path: str, but: str | None = None) -> DataFrame | None:
    """The predictions at ``path`` of all runs ``but`` one, if there are any yet."""
    others = [run for run in tables.runs(spark, path) if run != but]
    return read_predictions(spark, path, others) if others else None


def read_clinical(spark: SparkSession, path: str) -> DataFrame:
    """The raw clinical table, with coded attributes."""
    return spark.read.schema(RAW_CLINICAL).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, as many as the table has partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)


def run_time(at: datetime | None):
    """The run's time stamp as a column."""
    stamp = F.current_timestamp() if at is None else F.lit(at)
    return stamp.cast("timestamp_ntz")
