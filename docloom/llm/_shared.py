"""Written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset, on a local master, a temporary one (single-machine tests)."""
    folder = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_CONF} must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='docloom-')}"
        spark.conf.set(_CONF, folder)
        atexit.register(_remove_local, folder)
    return folder.rstrip("/")


def _remove_local(folder: str) -> None:
    import shutil

    shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the application's own part of the shared folder, with its file system's scheme."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/docloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: its lineage ends there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._docloom_path = path  # type: ignore[attr-defined]
    return back


def drop_written(df: DataFrame) -> None:
    """Deletes a table of written() that no later plan reads."""
    path = getattr(df, "_docloom_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def size_of(value: str) -> int:
    """Bytes of a size as Spark's settings have it: 8388608, 64m, 1gb."""
    found = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)b?\s*", value.lower())
    if not found:
        raise ValueError(f"no size: {value!r}")
    return int(found[1]) << 10 * " kmgtp".index(found[2] or " ")


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches of most bytes at most for the session (Spark's own default is 64 MB): what a worker holds follows them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < size_of(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


def null_safe_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """df's wanted columns, cast; a column that is missing is null. Other columns, whatever their names, stay out."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])
