"""Stored tables that change only once a write has succeeded.

A table is a folder of versions. A write makes a new version and then a commit,
an empty file whose name carries a number and the version; readers take the
version of the last commit. Until then, and if the job fails, they see the table as
it was. The version before is kept for those who are still reading it. Making one
file is the only step that has to be atomic, on any file system.

A table that is appended to is a folder of runs, each such a table: a run that is
repeated replaces what it wrote before and nothing else.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

COMMITS = "_commits"


def quoted(run: str) -> str:
    """The key as the name of a folder, in the form that Spark reads a partition's value from."""
    return re.sub(r"[^\w. -]", lambda c: f"%{ord(c[0]):02X}" if c[0].isascii() else c[0], run)


def unquoted(name: str) -> str:
    return re.sub("%([0-9A-F]{2})", lambda c: chr(int(c[1], 16)), name)


def _place(spark: SparkSession, path: str):
    """The path and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _place(spark, path)
    return system.exists(place)


def _names(spark: SparkSession, path: str) -> list[str]:
    place, system = _place(spark, path)
    if not system.exists(place):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(place))


def staged(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill the folder of a new version, then commit it.

    Versions older than the one before are deleted. Folders that were never
    committed are left alone: another write may be at work in them.
    """
    version = f"version={uuid.uuid4().hex}"
    write(f"{path}/{version}")
    commits = _names(spark, f"{path}/{COMMITS}")
    number = int(commits[-1].split("-")[0]) + 1 if commits else 1
    folder, system = _place(spark, f"{path}/{COMMITS}")
    system.mkdirs(folder)
    commit, _ = _place(spark, f"{path}/{COMMITS}/{number:012d}-{version}")
    if not system.createNewFile(commit):
        raise RuntimeError(f"{path} was committed to by another write")
    kept = {version, *(name.split("-")[1] for name in commits[-1:])}
    for name in commits[:-1]:
        system.delete(_place(spark, f"{path}/{COMMITS}/{name}")[0], False)
        if name.split("-")[1] not in kept:
            system.delete(_place(spark, f"{path}/{name.split('-')[1]}")[0], True)


def current(spark: SparkSession, path: str) -> str:
    """The folder that holds the table as last committed; ``path`` itself if it has no commits."""
    commits = _names(spark, f"{path}/{COMMITS}")
    return f"{path}/{commits[-1].split('-')[1]}" if commits else path


def replace(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), format: str = "parquet"
) -> None:
    """Replace the table at ``path``, or leave it as it is if the job fails."""
    staged(
        df.sparkSession,
        path,
        lambda folder: df.write.partitionBy(*partition_by).format(format).save(folder),
    )


def read(
    spark: SparkSession, path: str, schema: T.StructType | str, format: str = "parquet"
) -> DataFrame:
    return spark.read.schema(schema).format(format).load(current(spark, path))


def put_run(
    df: DataFrame,
    path: str,
    run: str | None = None,
    partition_by: Sequence[str] = (),
    format: str = "parquet",
) -> str:
    """Write what a run adds to the table at ``path``; returns the run's key.

    Without a key the run is a new one. With the key of an earlier run its rows
    take the place of that run's.
    """
    run = uuid.uuid4().hex if run is None else run
    replace(df, f"{path}/run={quoted(run)}", partition_by, format)
    return run


def run_folder(spark: SparkSession, path: str, run: str) -> str:
    """The folder that holds a run's rows as last committed."""
    return current(spark, f"{path}/run={quoted(run)}")


def drop_run(spark: SparkSession, path: str, run: str) -> None:
    """Take a run's rows out of the table."""
    place, system = _place(spark, f"{path}/run={quoted(run)}")
    system.delete(place, True)


def runs(spark: SparkSession, path: str) -> list[str]:
    """Keys of the runs whose rows are in the table."""
    folders = [n for n in _names(spark, path) if n.startswith("run=")]
    return [unquoted(n[4:]) for n in folders if _names(spark, f"{path}/{n}/{COMMITS}")]


def read_runs(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    only: Sequence[str] | None = None,
    format: str = "parquet",
) -> DataFrame:
    """Rows of all runs, or of those named: no folder of another run is opened.

    Columns of ``schema`` and ``run``. Columns that a run is partitioned by are
    found as such.
    """
    wanted = runs(spark, path) if only is None else list(only)
    whole = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
    if only is None and not wanted and any(n[0] not in "_." for n in _names(spark, path)):
        raise LookupError(f"{path} holds files, but no run that was committed")
    folders = [run_folder(spark, path, run) for run in wanted]
    if not folders:
        return spark.createDataFrame([], whole)
    reader = spark.read.schema(whole).option("basePath", path).format(format)
    return reader.load(folders).select(*whole.fieldNames())
