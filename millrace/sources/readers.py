"""Source readers: relational tables, CSV files and committed raw batches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def jdbc_options(
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a partitioned table read; without a partition column one task reads the table."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), "pushDownPredicate": "true"}
    if partition_column and bounds:
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": bounds[0],
            "upperBound": bounds[1],
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, options: Mapping[str, str], credentials: Mapping[str, str] | None = None) -> DataFrame:
    """Relational scan. Watermark filters put on the result are pushed to the database."""
    return spark.read.format("jdbc").options(**options, **(credentials or {})).load()


def read_csv(spark: SparkSession, path: str | list[str], schema: str, header: bool = True) -> DataFrame:
    """CSV scan under a fixed schema. Rows that do not fit keep their text in ``_corrupt_record``."""
    return (
        spark.read.schema(f"{schema}, {CORRUPT} string")
        .option("header", header)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )


def read_reference_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Full reference snapshot with the file and its change time, which identifies the snapshot."""
    return read_csv(spark, path, schema).select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_modification_time").alias("file_changed_at"),
    )
