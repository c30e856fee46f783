"""Write a small, much-reused intermediate once instead of recomputing it.

A staged frame is a parquet table in the shared folder named by
``spark.checkpoint.dir``, so it survives the loss of executors, gives the
optimizer real sizes and lets every branch read only the columns it needs.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes the shuffle files of a statement when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Without it a local session gets a private folder, removed at exit. On several
    machines such a folder would silently lose rows, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="spark-marketpulse-")
        atexit.register(shutil.rmtree, _fallback[app], ignore_errors=True)
    return _fallback[app]


def app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/marketpulse/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{app_dir(spark)}/{label}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = file_system(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    target, fs = file_system(spark, path)
    fs.delete(target, True)


def clear(spark: SparkSession) -> None:
    """Delete what this application staged; frames read from it become invalid."""
    remove(spark, app_dir(spark))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes in this block leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame reading it.

    Meant for frames that are small next to their inputs and read several times.
    """
    path = shared_path(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.mode("errorifexists").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Delete staged frames that nothing reads any more, not even a frame that is still to be computed."""
    for df in staged:
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            remove(df.sparkSession, folder)
