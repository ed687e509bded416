"""Session settings shared by jobs, benchmarks and tests."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings every job relies on. All of them can be changed on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even when the following aggregate then needs its own exchange:
    # that exchange moves partial aggregates only.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Shuffle files go when the execution that wrote them ends. Otherwise they stay on the executors' disks until the
    # driver happens to collect garbage, and a run of many executions holds nearly all of them at once.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


_MB = 1024 * 1024


def sized_for(largest_shuffle_bytes: int, task_bytes: int = 256 * _MB) -> dict[str, str]:
    """Settings that keep a task of the largest shuffle near ``task_bytes``.

    AQE starts from that many partitions and merges the ones that turn out small, so one setting
    serves the large and the small shuffles of a job.
    """
    partitions = max(1, -(-largest_shuffle_bytes // task_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(task_bytes // 2),
        "spark.sql.files.maxPartitionBytes": str(task_bytes),
    }


def tune(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    return spark


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach. The cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    return path
