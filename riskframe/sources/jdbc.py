"""Tables in an external database."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(
    table: str,
    url: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 200,
    **extra: str,
) -> dict[str, str]:
    """Options for Spark's JDBC source; the URL comes from ``DATABASE_URL``.

    With ``partition_column`` and its ``bounds`` the table is read in parallel
    ranges instead of through one connection.
    """
    url = url or os.environ.get("DATABASE_URL")
    if not url:
        raise ValueError("give a url or set DATABASE_URL")
    if not url.startswith("jdbc:"):
        url = f"jdbc:{url}"
    options = {"url": url, "dbtable": table, **extra}
    if partition_column:
        if bounds is None:
            raise ValueError("partition_column needs bounds")
        options.update(
            partitionColumn=partition_column,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )
    return options


def read_table(spark: SparkSession, table: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(table, **options)).load()


def write_table(df: DataFrame, table: str, mode: str = "append", **options) -> None:
    df.write.format("jdbc").options(**jdbc_options(table, **options)).mode(mode).save()
