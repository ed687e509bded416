"""Audits, reconciliation, quality counts and source diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def grain_violations(df: DataFrame, key: Sequence[str], table: str) -> DataFrame:
    """One row: how many keys repeat and how many are null. Both must be zero."""
    key = list(key)
    incomplete = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    return per_key.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("row_count"),
        F.count(F.lit(1)).alias("key_count"),
        F.count_if(F.col("copies") > 1).alias("repeated_keys"),
        count_where(incomplete).alias("null_keys"),
    ).select(F.lit(table).alias("table_name"), "*")


def totals(df: DataFrame, table: str, **measures: Column) -> DataFrame:
    """Long form ``(table_name, measure, value)`` of one-row aggregates."""
    row = df.agg(*[F.coalesce(v.cast("decimal(38,2)"), F.lit(0)).cast("decimal(38,2)").alias(k) for k, v in measures.items()])
    long = row.unpivot([], list(measures), "measure", "value")
    return long.select(F.lit(table).alias("table_name"), "measure", "value")


def reconcile(expected: DataFrame, actual: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer comparison of two ``(…, value)`` tables; a missing side is a difference."""
    left = expected.select(*on, F.col("value").alias("expected"))
    right = actual.select(*on, F.col("value").alias("actual"))
    return left.join(right, list(on), "full_outer").select(
        *on, "expected", "actual", F.col("expected").eqNullSafe(F.col("actual")).alias("matches")
    )


def rule_counts(df: DataFrame, rules: dict[str, Column], **labels: str) -> DataFrame:
    """Failed and total rows per rule in one pass over the data."""
    row = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[count_where(failed).alias(name) for name, failed in rules.items()],
    )
    long = row.unpivot(["total_rows"], list(rules), "rule", "failed_rows")
    return long.select(*[F.lit(v).alias(k) for k, v in labels.items()], "rule", "failed_rows", "total_rows")


def copy_validation(source_counts: DataFrame, landed_counts: DataFrame) -> DataFrame:
    """Source against landed row counts per object, both as ``(object_name, value)``."""
    return reconcile(source_counts, landed_counts, ["object_name"])


def inconsistent_orders(lines: DataFrame, order: str, identity: Sequence[str]) -> DataFrame:
    """Orders whose lines disagree on customer or date.

    Minimum against maximum says the same as a distinct count and is combined on the map side.
    """
    spans = [c for name in identity for c in (F.min(name).alias(f"min_{name}"), F.max(name).alias(f"max_{name}"))]
    spread = reduce(lambda a, b: a | b, [F.col(f"min_{c}") != F.col(f"max_{c}") for c in identity])
    return lines.groupBy(order).agg(F.count(F.lit(1)).alias("line_count"), *spans).where(spread)
