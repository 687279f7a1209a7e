"""Session settings: a local session for tests, and shuffle sizing from the input size."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession

INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
# Order lines take about 14 times their stored size in the memory of a sort.
BYTES_PER_PARTITION = 8 * 1024 * 1024

_chosen: dict[str, int] = {}  # by application: the number set here, which later inputs may raise

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str, cores: str = "*", memory: str = "8g") -> SparkSession:
    """Local session for tests and the benchmark; never used on a cluster."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    shuffle = cores if cores.isdigit() else "8"
    spark = (
        builder.config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def size_shuffles(spark: SparkSession, *inputs: DataFrame) -> int:
    """Start shuffles with one partition per 8 MB of input where that is more than the default.

    Adaptive execution merges partitions that turn out small, but cannot cut a plain aggregate's
    partitions finer than it starts with. A session that sets the number keeps its own; a number
    that was set here rises with larger inputs. The sizes come from file listings, so no job runs.
    """
    given, application = spark.conf.get(INITIAL_PARTITIONS, None), spark.sparkContext.applicationId
    start = int(given or spark.conf.get("spark.sql.shuffle.partitions"))
    if given is None or given == str(_chosen.get(application)):
        size = sum(int(str(f._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for f in inputs)
        wanted = ceil(size / BYTES_PER_PARTITION)
        if wanted > start:
            spark.conf.set(INITIAL_PARTITIONS, wanted)
            _chosen[application] = start = wanted
    return start
