"""Deduplication and upsert by source key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of ``within`` that a merge is laid out for: some seven years of months.
GROUPS = 84


def latest_per_key(df: DataFrame, key: Sequence[str], newest_by: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``newest_by``, then by every other column.

    All columns take part in the order, so the choice is total and does not depend on partitioning.
    ``max`` over a struct is combined on the map side: a key repeated billions of times leaves each
    map task as one row.
    """
    key, newest_by = list(key), list(newest_by)
    rest = [c for c in df.columns if c not in key and c not in newest_by]
    newest = F.max(F.struct(*newest_by, *rest)).alias("newest")
    kept = df.groupBy(*key).agg(newest)
    return kept.select(*[F.col(c) if c in key else F.col("newest")[c].alias(c) for c in df.columns])


def merge_unique(
    target: DataFrame, source: DataFrame, key: Sequence[str], newest_by: Sequence[str], within: Sequence[str] = ()
) -> DataFrame:
    """:func:`upsert` of two sides that hold each key once, a null key included.

    A key then has two rows at most, so nothing is gained by combining before the shuffle: each row moves once. Rows of one
    key have to agree on the columns ``within``. Rows are dealt to tasks by these columns and a share of the keys, some
    four shares for each task, so that a task holds few of their values and the result can be written by them
    without moving again. ``within`` stays in the result.
    """
    key, newest_by, within = list(key), list(newest_by), list(within)
    rows = target.unionByName(source)
    dealt = [*within, *key]
    if within:
        tasks = int(target.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.withColumn("share", F.pmod(F.xxhash64(*key), F.lit(max(1, -(-4 * tasks // GROUPS)))))
        dealt = [*within, "share"]
    rest = [c for c in target.columns if c not in (*key, *newest_by, *within)]
    grouped = list(dict.fromkeys([*dealt, *key]))
    kept = rows.repartition(*dealt).groupBy(*grouped).agg(F.max(F.struct(*newest_by, *rest)).alias("newest"))
    return kept.select(*[F.col(c) if c in grouped else F.col("newest")[c].alias(c) for c in target.columns])


def upsert(target: DataFrame, source: DataFrame, key: Sequence[str], newest_by: Sequence[str]) -> DataFrame:
    """Target with the source rows merged in.

    The newest row wins on both sides, so a late batch with an older copy changes nothing and a
    replayed batch has no effect. One shuffle on the key serves the match and the remainder.
    """
    return latest_per_key(target.unionByName(source), key, newest_by)
