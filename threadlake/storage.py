"""Shared-folder tables that cut lineage, size-checked broadcasts, and file-system helpers.

Intermediate tables go below ``spark.checkpoint.dir`` of the session: a folder that every
executor sees, so a lost executor costs a re-read, never the data. Only in local mode, where
driver and executors are one process, a temporary folder is used when that setting is absent.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KNOWN: set[str] = set()
#: Rows up to which a table may be broadcast; with the narrow rows used here a few tens of MB.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables of this application; it goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        base = "file://" + tempfile.mkdtemp(prefix="threadlake-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(_quietly_delete, base[7:])
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{base.rstrip('/')}/threadlake/{spark.sparkContext.applicationId}"
    if path not in _KNOWN:
        _KNOWN.add(path)
        fs, p = hadoop_path(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return path


def _quietly_delete(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df below the shared folder and read it back; returns the table and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as its object."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores. Only a table of fewer splits than
    cores, hence a small one, is moved; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def is_bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint when its size is proven to be bounded, else df as it is (a
    shuffle join, which adaptive execution splits where it is skewed)."""
    return F.broadcast(df) if is_bounded(df, rows) else df
