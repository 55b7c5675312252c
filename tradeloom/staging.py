"""Tables written once inside a job and read back several times.

A derived table that feeds several branches is written to the shared folder the cluster
names in ``spark.checkpoint.dir``. Reading it back cuts the lineage, survives lost
executors, keeps column pruning, and gives Catalyst the real size of the table: a side
that is small on disk is broadcast by the normal threshold, a large one is shuffled. No
operator in this library hints a broadcast of data whose size is not fixed by a literal.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """Folder reachable by every executor; a temporary one only in local mode."""
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tradeloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(_SETTING, folder)
    return folder


def job_folder(spark: SparkSession) -> str:
    """Folder of this application inside the shared one."""
    return f"{shared_folder(spark)}/tradeloom/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path inside the job's folder."""
    return f"{job_folder(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and return the table read back."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query that ends in here go at once, not when the driver happens to collect
    its garbage. For jobs that write one large table after the other; the setting is the session's."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def release(spark: SparkSession) -> None:
    """Delete everything this application staged. Call it when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(job_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
