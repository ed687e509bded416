"""Raw landing: configured objects become committed batches that keep source values and lineage.

Layout below ``root``::

    bronze/<object>/batch_id=<id>/   rows of one batch
    control/manifest/                one small file per committed batch, written last

A batch without a manifest does not exist for readers, so a failed copy needs no clean-up and leaves
the checkpoint where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.rules import batch_id
from millrace.sources.contracts import check_contract, require_contract

SNAPSHOT = "snapshot_append"
WATERMARK = "watermark_incremental"

CONFIG_SCHEMA = (
    "object_id int, object_name string, source_kind string, location string, strategy string, "
    "stamp string, options map<string,string>, is_active boolean"
)
MANIFEST_SCHEMA = (
    "batch_id string, object_name string, strategy string, lower_bound string, upper_bound string, "
    "row_count bigint, committed_at timestamp, fingerprint string"
)
LINEAGE = ["batch_id", "source_object", "ingest_ts"]
#: Rows are stored for long and read seldom: zstd takes about a third less disk than the default codec.
CODEC = "zstd"

Reader = Callable[[SparkSession, Row], DataFrame]


class CopyMismatch(RuntimeError):
    pass


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only JSON log; empty before the first entry."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_entry(entries: DataFrame, path: str) -> None:
    """Append as a single file: it becomes visible in one rename, whole or not at all."""
    entries.coalesce(1).write.mode("append").json(path)


def manifest_path(root: str) -> str:
    return f"{root}/control/manifest"


def manifests(spark: SparkSession, root: str) -> DataFrame:
    return read_log(spark, manifest_path(root), MANIFEST_SCHEMA)


# -- bounds --------------------------------------------------------------------------------------


def newest(df: DataFrame, stamp: str) -> str | None:
    return df.agg(F.max(stamp).cast("string")).first()[0]


def committed_bound(spark: SparkSession, root: str, object_name: str) -> str | None:
    """Checkpoint of an object: the greatest upper bound among its committed batches."""
    mine = manifests(spark, root).where(F.col("object_name") == object_name)
    return mine.agg(F.max(F.col("upper_bound").cast("timestamp_ntz")).cast("string")).first()[0]


def last_fingerprint(spark: SparkSession, root: str, object_name: str) -> str | None:
    mine = manifests(spark, root).where(F.col("object_name") == object_name)
    return mine.agg(F.max_by("fingerprint", "committed_at")).first()[0]


def in_bounds(df: DataFrame, stamp: str, lower: str | None, upper: str, overlap_seconds: int = 0) -> DataFrame:
    """Rows in ``(lower, upper]``; literals of the column's own type, so the scan takes the filter.

    ``overlap_seconds`` moves the lower bound back for sources whose rows may become visible after a
    younger row was already read; the repeats are removed by deduplication.
    """
    kind = df.schema[stamp].dataType
    rows = df.where(F.col(stamp) <= F.lit(upper).cast(kind))
    if lower is not None:
        start = F.lit(lower).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(overlap_seconds))
        rows = rows.where(F.col(stamp) > start.cast(kind))
    return rows


def watermark_slice(df: DataFrame, stamp: str, lower: str | None, overlap_seconds: int = 0) -> DataFrame:
    """The increment above a committed bound, with the upper bound fixed once before reading."""
    upper = newest(df.select(stamp), stamp)
    if upper is None:
        return df.where(F.lit(False))
    return in_bounds(df, stamp, lower, upper, overlap_seconds)


def not_yet_landed(
    spark: SparkSession, root: str, object_name: str, source: DataFrame, stamp: str, lower: str, upper: str, overlap_seconds: int
) -> DataFrame:
    """Rows above the bound, and those within the overlap or on the bound itself that no batch holds yet.

    A source may show a row after one with the same or a later stamp was read. The rows that may have
    been read already are compared with Bronze as a whole, copies counted.
    """
    kind = source.schema[stamp].dataType
    start = (F.lit(lower).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(overlap_seconds))).cast(kind)
    at, bound = F.col(stamp), F.lit(lower).cast(kind)
    batches = manifests(spark, root).where(F.col("object_name") == object_name).select("batch_id").distinct()
    landed = read_batches(spark, root, object_name, [r.batch_id for r in batches.collect()])
    newer = source.where((at > bound) & (at <= F.lit(upper).cast(kind)))
    edge = source.where((at >= start) & (at <= bound))
    known = [c for c in source.columns if c in landed.columns]
    missing = [F.lit(None).cast(source.schema[c].dataType).alias(c) for c in source.columns if c not in known]
    held = landed.where((at >= start) & (at <= bound)).select(*[F.col(c).cast(source.schema[c].dataType) for c in known], *missing)
    return newer.unionByName(edge.exceptAll(held.select(*source.columns)))


def fingerprint(rows: DataFrame) -> str:
    """Identity of a table's content, whatever the order of its rows."""
    total = F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))
    count, value = rows.agg(F.count(F.lit(1)), total.cast("string")).first()
    return f"{count}:{value}"


# -- landing -------------------------------------------------------------------------------------


def with_lineage(df: DataFrame, object_name: str, ingest_ts: datetime) -> DataFrame:
    """Add lineage next to the untouched source columns."""
    return df.withColumns({"source_object": F.lit(object_name), "ingest_ts": F.lit(ingest_ts)})


def land(spark: SparkSession, root: str, object_name: str, batch: str, rows: DataFrame) -> int:
    """Write one batch and return its row count. A retry replaces this batch and nothing else."""
    path = f"{root}/bronze/{object_name}/batch_id={batch}"
    stamped = with_lineage(rows, object_name, datetime.now(timezone.utc))
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", CODEC).parquet(path)
    return spark.read.parquet(path).count()


def ingest(
    spark: SparkSession,
    root: str,
    obj: Row,
    source: DataFrame,
    contract: T.StructType | None = None,
    overlap_seconds: int = 0,
) -> str | None:
    """Copy one object and commit its batch. Returns the batch id, or None without new rows.

    A snapshot is new if its content differs from that of the last committed one, whatever its stamps say.
    Source rows are counted while they are copied, so the source is computed once; a copy without rows is not committed.
    The batch id depends on the committed state alone, so a retry replaces its own partial rows.
    """
    if contract is not None:
        drift = check_contract(spark, source.schema, contract)
        append_entry(drift.where("drift <> 'SAME'").withColumn("object_name", F.lit(obj.object_name)), f"{root}/control/drift")
        require_contract(drift)

    lower = committed_bound(spark, root, obj.object_name)
    upper = newest(source.select(obj.stamp), obj.stamp)
    if upper is None:
        return None
    if lower is not None and obj.strategy == WATERMARK and _not_after(upper, lower):
        upper = lower
    content = None
    if obj.strategy == WATERMARK:
        if lower is None:
            rows = in_bounds(source, obj.stamp, lower, upper)
        else:
            rows = not_yet_landed(spark, root, obj.object_name, source, obj.stamp, lower, upper, overlap_seconds)
    elif obj.strategy == SNAPSHOT:
        # rows that appear between the bound and the copy belong to the next snapshot
        rows = source.where(F.col(obj.stamp).isNull() | (F.col(obj.stamp) <= F.lit(upper).cast(source.schema[obj.stamp].dataType)))
        content = fingerprint(rows)
        if content == last_fingerprint(spark, root, obj.object_name):
            return None
    else:
        raise ValueError(f"unknown load strategy {obj.strategy}")
    before = manifests(spark, root).where(F.col("object_name") == obj.object_name).count()
    identity = F.concat_ws("#", F.lit(lower), F.lit(before).cast("string"))
    batch = spark.range(1).select(batch_id(obj.object_name, identity)).first()[0]
    copied = Observation()
    landed = land(spark, root, obj.object_name, batch, rows.observe(copied, F.count(F.lit(1)).alias("rows")))
    expected = copied.get.get("rows", 0)
    if not (expected or landed):
        return None
    if landed != expected:
        raise CopyMismatch(f"{obj.object_name}: {expected} source rows, {landed} landed")
    commit(spark, root, batch, obj.object_name, obj.strategy, lower, upper, landed, content)
    return batch


def commit(
    spark: SparkSession,
    root: str,
    batch: str,
    object_name: str,
    strategy: str,
    lower: str | None,
    upper: str,
    rows: int,
    content: str | None = None,
) -> None:
    entry = (batch, object_name, strategy, lower, upper, rows, datetime.now(timezone.utc), content)
    append_entry(spark.createDataFrame([entry], MANIFEST_SCHEMA), manifest_path(root))


def _not_after(upper: str, lower: str) -> bool:
    return datetime.fromisoformat(upper) <= datetime.fromisoformat(lower)


def active_objects(config: DataFrame) -> list[Row]:
    """Configured objects in load order; a handful of rows."""
    return config.where("is_active").orderBy("object_id").collect()


def load_object(
    spark: SparkSession,
    root: str,
    obj: Row,
    readers: dict[str, Reader],
    contracts: dict[str, T.StructType] | None = None,
) -> str | None:
    """Read one object by its source kind and land it by its strategy."""
    source = readers[obj.source_kind](spark, obj)
    overlap = int((obj.options or {}).get("overlap_seconds", 0))
    return ingest(spark, root, obj, source, (contracts or {}).get(obj.object_name), overlap)


def run_objects(
    spark: SparkSession,
    root: str,
    config: DataFrame,
    readers: dict[str, Reader],
    contracts: dict[str, T.StructType] | None = None,
) -> dict[str, str | None]:
    """Load every active object; the first failure stops the run."""
    return {o.object_name: load_object(spark, root, o, readers, contracts) for o in active_objects(config)}


# -- committed reads -----------------------------------------------------------------------------


def committed_batches(
    spark: SparkSession, root: str, object_name: str, batches: Sequence[str]
) -> DataFrame | None:
    """Rows of the given committed batches of an object, read from their partitions only."""
    mine = manifests(spark, root).where((F.col("object_name") == object_name) & F.col("batch_id").isin(list(batches)))
    return read_batches(spark, root, object_name, [r.batch_id for r in mine.select("batch_id").distinct().collect()])


def read_batches(spark: SparkSession, root: str, object_name: str, batches: Sequence[str]) -> DataFrame | None:
    """The partitions of batches already known to be committed."""
    if not batches:
        return None
    base = f"{root}/bronze/{object_name}"
    return spark.read.option("basePath", base).option("mergeSchema", "true").parquet(*[f"{base}/batch_id={b}" for b in batches])
