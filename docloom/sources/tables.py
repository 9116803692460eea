"""Tables as the queries read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of fewer bytes aren't worth a shuffle.
LEAST_SPREAD = 64 << 10
#: Bytes of a table that a task of long work on every row is given.
TASK_BYTES = 4 << 20


def read_table(spark: SparkSession, path: str, heavy: bool = False) -> DataFrame:
    """heavy: each row is long work, and the rows are dealt out by dealt()."""
    table = spark.read.parquet(path)
    return dealt(table) if heavy else spread(table)


def dealt(df: DataFrame) -> DataFrame:
    """df, dealt out to tasks of TASK_BYTES and to all cores at least, whatever its size, unless it lies in as many files: a row group isn't split, and may be hours of work."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return df.repartition(n) if size >= LEAST_SPREAD and len(df.inputFiles()) < n else df


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if it is a table in fewer files than there are cores and smaller than a split for each.

    A file is read by a task a row group, so one small file would keep one core busy. Larger tables, and those in more files, are left as they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = cores * int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if LEAST_SPREAD <= size < most and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df
