"""Accepted and rejected lines as two views of one keyed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.dedup import upsert

ACCEPTED = "ACCEPTED"
REJECTED = "REJECTED"


def with_class(df: DataFrame, failures: str = "failed_rules") -> DataFrame:
    """``dq_class`` from the names of the failed hard rules."""
    return df.withColumn("dq_class", F.when(F.size(failures) == 0, ACCEPTED).otherwise(REJECTED))


def accepted(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("dq_class") == ACCEPTED)


def rejected(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("dq_class") == REJECTED)


def reconcile_classes(
    current: DataFrame, incoming: DataFrame, key: Sequence[str], newest_by: Sequence[str]
) -> DataFrame:
    """Current classification of each key after an increment.

    A key has one row, so it cannot be accepted and rejected at once, and replaying an increment
    adds no reject.
    """
    return upsert(current, incoming, key, newest_by)


def transitions(before: DataFrame | None, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys whose class differs between two states; feeds the append-only audit history.

    ``after`` may be cut to the rows that can differ; without a state before, each of its keys is new.
    """
    if before is None:
        return after.select(*key, F.col("dq_class").alias("to_class"), "failed_rules", F.lit(None).cast("string").alias("from_class"))
    old = before.select(*key, F.col("dq_class").alias("from_class"))
    new = after.select(*key, F.col("dq_class").alias("to_class"), F.col("failed_rules"))
    joined = new.join(old, list(key), "left")
    return joined.where(~F.col("from_class").eqNullSafe(F.col("to_class")))


def to_reprocess(classified: DataFrame, arrived: DataFrame, on: str) -> DataFrame:
    """Rejected lines that refer to dimension keys which have arrived since."""
    return rejected(classified).join(arrived.select(on), on, "left_semi")
