"""File inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path and size of the files below ``path``; their content is not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    )
    return files.select("path", "length", "modificationTime")
