"""Versioned tables on plain Parquet and the publish log that makes a version visible.

A dated table is partitioned by month. A version writes only the months it touches, as
``<table>/version=N/part_month=YYYY-MM``; a reader takes, for each month, the newest published version.
A month that lost its last row is published as gone. Overwriting months in place would be shorter, but
a reader would then see some months of an increment without the others.
Publishing appends one file to the log, so all tables of a version appear at the same instant and an
unpublished or half-written version is never read. One writer runs at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_dir
from millrace.sources.bronze import CODEC, append_entry, read_log

LOG_SCHEMA = "version bigint, kind string, table_name string, item string"
WHOLE = "whole"
MONTH = "part_month"
UNDATED = "undated"

Entry = tuple[int, str, str | None, str | None]


def month_of(at: str) -> Column:
    """Name of the month a date or time falls into; rows without one share a name of their own."""
    return F.coalesce(F.date_format(F.to_date(at), "yyyy-MM"), F.lit(UNDATED))


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cut the lineage of an intermediate result that several branches read."""
    return written_to(scratch_path(spark), df)


def scratch_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"


def written_to(path: str, df: DataFrame) -> DataFrame:
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, on whatever file system the shared folder is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@dataclass
class Snapshot:
    """One published state: where each table's parts are and which input batches it contains.

    Only this map, at most one entry per table and month, is held on the driver.
    """

    store: TableStore
    version: int
    parts: dict[str, dict[str, int]] = field(default_factory=dict)
    batches: set[str] = field(default_factory=set)

    def read(self, table: str, schema: str | None = None, months: Sequence[str] | None = None) -> DataFrame | None:
        """Rows of a table, from all months or some. None, or no rows under ``schema``, if there are none."""
        spark, parts = self.store.spark, self.parts.get(table, {})
        if months is not None:
            wanted = set(months)
            parts = {item: version for item, version in parts.items() if item in wanted}
        if not parts:
            return spark.createDataFrame([], schema) if schema else None
        base = f"{self.store.root}/{table}"
        paths = [
            f"{base}/version={version}" + ("" if item.startswith(WHOLE) else f"/{MONTH}={item}")
            for item, version in parts.items()
        ]
        reader = spark.read.option("basePath", base)
        if schema:
            reader = reader.schema(schema)
        return reader.parquet(*paths).drop("version", MONTH)

    def months(self, table: str) -> list[str]:
        return sorted(self.parts.get(table, {}))


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    @property
    def _log_path(self) -> str:
        return f"{self.root}/publish_log"

    def snapshot(self, as_of: int | None = None) -> Snapshot:
        """The published state now or at an earlier version. Later publications do not alter it."""
        log = read_log(self.spark, self._log_path, LOG_SCHEMA)
        if as_of is not None:
            log = log.where(F.col("version") <= as_of)
        rows = log.groupBy("kind", "table_name", "item").agg(F.max("version").alias("version")).collect()
        rebuilt = max((r.version for r in rows if r.kind == "reset"), default=0)
        state = Snapshot(self, max((r.version for r in rows), default=0))
        gone = {(r.table_name, r.item): r.version for r in rows if r.kind == "gone"}
        for r in rows:
            if r.kind == "part" and r.version >= rebuilt and r.version > gone.get((r.table_name, r.item), 0):
                state.parts.setdefault(r.table_name, {})[r.item] = r.version
            elif r.kind == "batch" and r.version >= rebuilt:
                state.batches.add(r.item)
        return state

    def version(self) -> int:
        return self.snapshot().version

    def read(self, table: str, schema: str | None = None, as_of: int | None = None) -> DataFrame | None:
        return self.snapshot(as_of).read(table, schema)

    # -- write ------------------------------------------------------------------------------

    def write_months(
        self,
        table: str,
        df: DataFrame,
        at: str,
        version: int,
        touched: Sequence[str] = (),
        derive: Callable[[DataFrame], DataFrame] | None = None,
        dealt: bool = False,
    ) -> list[Entry]:
        """Write all rows of the touched months and return the log entries that publish them.

        ``touched`` names months that were read for this version; one that has no row any more is gone.
        The rebalance hint lets adaptive execution merge small and split large months; rows that are ``dealt``
        to tasks by month already are not moved again. ``derive`` adds columns that follow from the others
        after the rows have moved.
        """
        path = f"{self.root}/{table}/version={version}"
        rows = df.withColumn(MONTH, month_of(at))
        if not dealt:
            rows = rows.hint("rebalance", MONTH)
        if derive is not None:
            rows = derive(rows)
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", CODEC)
        writer.partitionBy(MONTH).parquet(path)
        stored = self.spark.read.schema(rows.schema).parquet(path).select(MONTH).distinct()
        present = {r[MONTH] for r in stored.collect()}
        kept = [(version, "part", table, month) for month in sorted(present)]
        return kept + [(version, "gone", table, month) for month in sorted(set(touched) - present)]

    def write_whole(self, table: str, df: DataFrame, version: int, append: bool = False) -> list[Entry]:
        """Write a table without months; with ``append`` earlier versions stay part of it."""
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", CODEC)
        writer.parquet(f"{self.root}/{table}/version={version}")
        return [(version, "part", table, f"{WHOLE}-{version}" if append else WHOLE)]

    # -- publish ----------------------------------------------------------------------------

    def publish(self, version: int, parts: Sequence[Entry], batches: Sequence[str] = (), reset: bool = False) -> None:
        """Make a version visible; with ``reset`` it replaces everything published before."""
        head = (version, "reset" if reset else "version", None, None)
        entries = [head, *parts, *[(version, "batch", None, b) for b in batches]]
        append_entry(self.spark.createDataFrame(entries, LOG_SCHEMA), self._log_path)

    def candidate(self, table: str, version: int, schema: str | None = None) -> DataFrame:
        """A table of one version, published or not."""
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.root}/{table}/version={version}").drop(MONTH)
