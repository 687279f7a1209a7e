"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Where the setting is missing, a local session (tests) gets a folder of its own; a cluster must name one.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        if context.applicationId not in _local:
            _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="run-", dir="/tmp")
        root = _local[context.applicationId]
    return f"{root.rstrip('/')}/{context.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path that was never used before, so that no live plan loses its files."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def publish(frame: DataFrame, name: str) -> DataFrame:
    """Write a table once and go on from its files: no recomputation, short lineage, safe from lost executors."""
    path = new_path(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Meanwhile a query's shuffles are deleted when it ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(published: DataFrame) -> None:
    """Delete the files of a table from ``publish`` that nothing reads any more."""
    spark = published.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in published.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; results not yet written can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
