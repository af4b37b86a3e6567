"""Spark session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Report a shuffle block truthfully once it is five times the median, so
    # that AQE sees a hot key even when every map task holds little of it.
    "spark.shuffle.accurateBlockSkewedFactor": "5",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    app: str = "riskframe",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """Session with the settings above.

    ``shuffle_partitions`` is the number AQE starts from and coalesces down;
    on a cluster choose it so that one partition is about 200 MB.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(SETTINGS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors can reach, as named in ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="riskframe-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder; deleted with the scope that is open, if one is."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _OPEN_SCOPES:
        _OPEN_SCOPES[-1].append(path)
    return path


def materialize(
    df: DataFrame, name: str = "table", partition_by: Sequence[str] = ()
) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage at a place that outlives executors, and unlike a
    checkpoint the copy still serves single columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


_OPEN_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes what is written inside under a ``scratch_path``, as by ``materialize``, once the
    work in it is stored.

    For jobs that end in a write. A table that is still to be read must not
    leave the scope. Tables written by other threads at the same time belong to
    the scope too.
    """
    _OPEN_SCOPES.append([])
    try:
        yield
    finally:
        context = spark.sparkContext
        for path in _OPEN_SCOPES.pop():
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
