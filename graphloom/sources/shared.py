"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting, off by default.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where that is unset and Spark runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the JVM may have ended before
        pass


@contextmanager
def swept(spark: SparkSession):
    """Shuffle files of the queries that run inside go when each has ended, not when the driver next collects garbage."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SWEEP)
        else:
            spark.conf.set(SWEEP, before)


def written(df: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
    """Writes df as a Parquet table, in folders by the columns ``by``, and reads it back.

    The table cuts the lineage, outlives lost executors and gives the optimizer its
    true size.  Returns the table and its path, for ``remove``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with swept(spark):
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def in_buckets(df: DataFrame, name: str, n: int, by: str) -> DataFrame:
    """Writes df in n buckets by a column, so that joins, groups and windows by it read rows where they are.

    The table is dropped when the driver ends.
    """
    return bucketed(df, name, n, by)[0]


def bucketed(df: DataFrame, name: str, n: int, by: str) -> tuple[DataFrame, str]:
    """The same with the table's path, for ``remove``."""
    spark = df.sparkSession
    path, table = new_path(spark, name), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    with swept(spark):
        df.write.bucketBy(n, by).option("path", path).option("compression", "zstd").saveAsTable(table)
    atexit.register(_drop_quietly, spark, table)
    return spark.table(table), path


def _drop_quietly(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:  # noqa: BLE001  the session may have ended before
        pass
