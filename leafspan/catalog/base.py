"""Registry of queries with the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, the statement it must match."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


SMALL_INPUT_BYTES = 512 * 1024 * 1024


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """Read one of the given tables.

    ``spread`` redistributes the rows of a small input, whose single row group would otherwise keep one core busy.
    The size is checked first; a large input has enough splits and is left as it is.
    """
    path = f"{folder}/{name}.parquet"
    df = spark.read.parquet(path)
    if spread:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.getContentSummary(hadoop_path).getLength() <= SMALL_INPUT_BYTES:
            return df.repartition(spark.sparkContext.defaultParallelism)
    return df
