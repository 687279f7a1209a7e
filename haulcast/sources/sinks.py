"""Tables, views, files and their housekeeping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder of this application that every executor can reach: below the cluster's checkpoint directory.

    Where ``spark.checkpoint.dir`` is not set, a local session (tests, the benchmark) gets a folder of its own; a cluster
    must name one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        if context.applicationId not in _local:
            _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="run-", dir="/tmp")
        folder = _local[context.applicationId]
    return f"{folder.rstrip('/')}/{context.applicationId}"


def overwrite_path(frame: DataFrame, path: str) -> DataFrame:
    """Replace the files at ``path``: written aside whole, then put in place, so a frame may read what it replaces."""
    spark = frame.sparkSession
    aside = f"{path.rstrip('/')}.next-{uuid.uuid4().hex}"
    frame.write.parquet(aside)
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, aside))
    files = new.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"could not put {aside} in place of {path}")
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


# A row group is what a scan skips by its smallest and largest values; a smaller one skips more finely.
ROW_GROUP_BYTES = 16 << 20


def clustered(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt to tasks by ranges of the keys and sorted within, so that files and row groups cover narrow ranges.

    A last key spreads the rows of one key value, such as a day with a third of all orders, over several ranges.
    """
    spread = F.xxhash64(*(F.col(f"`{c}`") for c, kind in frame.dtypes if c not in keys and not kind.startswith("map")))
    return frame.repartitionByRange(*keys, spread).sortWithinPartitions(*keys)


def write_new(frame: DataFrame, folder: str, name: str, cluster_by: Sequence[str] = ()) -> DataFrame:
    """Write below ``folder`` at a path never used before, so that no live frame loses its files."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    writer = frame.write
    if cluster_by:
        writer = clustered(frame, cluster_by).write.option("parquet.block.size", ROW_GROUP_BYTES)
    writer.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


KEPT_VERSIONS = 2


def _files(spark: SparkSession, path: str):
    """Hadoop's path, and the file system it is in."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, log: str) -> list[int]:
    """Numbers of the versions claimed or published at ``path``, ascending."""
    folder, files = _files(spark, f"{path}/{log}")
    return sorted(int(s.getPath().getName()) for s in files.listStatus(folder)) if files.exists(folder) else []


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The newest published version at ``path``, whole: one that is being written, or whose write failed, is never read."""
    root = path.rstrip("/")
    versions = _numbers(spark, root, "_published")
    if not versions:
        raise FileNotFoundError(f"no version was published at {path}")
    return spark.read.parquet(f"{root}/v{versions[-1]}")


def write_version(frame: DataFrame, path: str, keep: int = KEPT_VERSIONS) -> DataFrame:
    """Write the frame as the next version at ``path``, then publish it; until then readers see the version before.

    A writer first claims a number by creating a file that must not exist, so writers at the same time get numbers of
    their own, and nothing is renamed or overwritten. A failed write leaves its claim and is never published. Frames read
    from the ``keep`` newest versions stay valid; older ones are deleted. The frame may read what it replaces.
    """
    spark, root = frame.sparkSession, path.rstrip("/")
    number = max(_numbers(spark, root, "_claimed"), default=0) + 1
    while True:
        claim, files = _files(spark, f"{root}/_claimed/{number}")
        try:
            files.create(claim, False).close()
            break
        except Py4JJavaError:
            if not files.exists(claim):
                raise
            number += 1
    frame.write.parquet(f"{root}/v{number}")
    files.create(_files(spark, f"{root}/_published/{number}")[0], False).close()
    for stale in _numbers(spark, root, "_published")[:-keep]:
        for name in (f"_published/{stale}", f"v{stale}"):
            files.delete(_files(spark, f"{root}/{name}")[0], True)
    return read_version(spark, root)


# Tables up to this size are worth a copy on every executor.
BROADCAST_BYTES = 64 << 20


def stored_bytes(frame: DataFrame) -> int:
    """Size of what a frame of a written table reads, by Spark's statistics of the files; no job runs."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(frame: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The written table marked for broadcast if it is small, else as it is, for Spark to choose another join."""
    return F.broadcast(frame) if stored_bytes(frame) <= most else frame


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def overwrite_table(frame: DataFrame, name: str, comment: str = "") -> DataFrame:
    """Replace a managed table, its schema included."""
    spark = frame.sparkSession
    frame.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(name)
    if comment:
        spark.sql(f"COMMENT ON TABLE {name} IS '{_quoted(comment)}'")
    return spark.table(name)


def replace_view(frame: DataFrame, name: str) -> DataFrame:
    """A view of this session over a frame."""
    frame.createOrReplaceTempView(name)
    return frame.sparkSession.table(name)


def create_view(spark: SparkSession, name: str, sql: str, comment: str = "") -> DataFrame:
    """A view of the catalog from SQL text, in place of whatever table or view has its name; it outlives the session."""
    drop_relation(spark, name)
    said = f" COMMENT '{_quoted(comment)}'" if comment else ""
    spark.sql(f"CREATE OR REPLACE VIEW {name}{said} AS {sql}")
    return spark.table(name)


def _quoted(comment: str) -> str:
    return comment.splitlines()[0].replace("\\", "\\\\").replace("'", "\\'")


def ensure_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}")


def drop_relation(spark: SparkSession, name: str) -> None:
    """Drop a view or table of that name, whichever it is; absent is fine."""
    spark.catalog.dropTempView(name)
    if spark.catalog.tableExists(name):
        kind = "VIEW" if spark.catalog.getTable(name).tableType == "VIEW" else "TABLE"
        spark.sql(f"DROP {kind} IF EXISTS {name}")


def table_or_placeholder(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """The table if it exists, else an empty frame of its schema, so readers can plan."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema)


def list_views(spark: SparkSession, schema: str | None = None) -> list[str]:
    tables = spark.catalog.listTables(schema)
    return sorted(t.name for t in tables if t.tableType in ("VIEW", "TEMPORARY"))


def row_counts(frames: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """One row per named frame with its row count, as a single plan."""
    counted = [
        f.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, f in frames
    ]
    return reduce(DataFrame.unionByName, counted)


def export_csv(frame: DataFrame, path: str) -> None:
    """CSV with header, one file per task."""
    frame.write.mode("overwrite").option("header", True).csv(path)
