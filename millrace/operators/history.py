"""SCD2 history: building, increments, late arrivals and snapshot comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.rules import time_box, version_key
from millrace.operators.dedup import latest_per_key


def scd2(
    changes: DataFrame,
    entity: str,
    at: str,
    tracked: Sequence[str],
    tie: Sequence[str] = (),
    open_first: str | None = None,
    box_minutes: int | None = None,
) -> DataFrame:
    """Versions ``[valid_from, valid_to)`` of each entity from its observations.

    Observations are first collapsed to one per entity and instant (map-side combine). With a date
    in ``at`` an entity is then left with one row per calendar day at most, which bounds its window
    however many rows it had. With a timestamp there is no such bound: set ``box_minutes`` and the
    windows run per entity and box of that many minutes, joined up through one edge row per box.
    ``open_first`` moves the start of the first version back to that date.
    """
    tracked = list(tracked)
    newest_by = list(dict.fromkeys([*tie, *tracked]))
    observed = latest_per_key(changes.select(entity, at, *newest_by), [entity, at], newest_by)
    observed = observed.select(entity, F.col(at).alias("valid_from"), F.struct(*tracked).alias("state"))

    before = shift(observed, entity, "valid_from", F.col("state"), "previous", -1, box_minutes)
    changed = before.where(~F.col("previous").eqNullSafe(F.col("state"))).select(
        entity, "valid_from", "state", F.col("previous").isNull().alias("is_first")
    )
    versions = shift(changed, entity, "valid_from", F.col("valid_from"), "valid_to", 1, box_minutes)
    start = F.col("valid_from")
    if open_first is not None:
        opened = F.lit(open_first).cast(changes.schema[at].dataType)
        start = F.when(F.col("is_first"), opened).otherwise(start)
    return versions.select(
        entity,
        *[F.col("state")[c].alias(c) for c in tracked],
        start.alias("valid_from"),
        "valid_to",
        F.col("valid_to").isNull().alias("is_current"),
        version_key(F.col(entity), start).alias("version_key"),
    )


def shift(
    df: DataFrame, entity: str, at: str, value: Column, name: str, step: int, box_minutes: int | None = None
) -> DataFrame:
    """Add ``value`` of the previous (-1) or next (1) row of the entity in the order of ``at``.

    With ``box_minutes`` only the rows of one entity and time box meet in a window, not all rows of
    the entity. The value that crosses a box comes from that box's edge row; edges, one per entity and
    box, are the only rows that meet in a window over the whole entity.
    """
    if step not in (-1, 1):
        raise ValueError("step is -1 or 1")
    near = F.lag if step == -1 else F.lead
    if box_minutes is None:
        return df.withColumn(name, near(value).over(Window.partitionBy(entity).orderBy(at)))

    boxed = df.withColumn("box_no", time_box(F.col(at), box_minutes)).withColumn("boxed", F.struct(value.alias("v")))
    inside = Window.partitionBy(entity, "box_no").orderBy(at)
    edge = F.max_by if step == -1 else F.min_by
    edges = boxed.groupBy(entity, "box_no").agg(edge("boxed", at).alias("edge"))
    across = edges.select(
        entity, "box_no", near("edge").over(Window.partitionBy(entity).orderBy("box_no")).alias("across")
    )
    joined = boxed.withColumn("inside", near("boxed").over(inside)).join(across, [entity, "box_no"], "left")
    found = F.coalesce("inside", "across")["v"].alias(name)
    return joined.select(*df.columns, found)


def scd2_merge(history: DataFrame, rebuilt: DataFrame, affected: DataFrame, entity: str) -> DataFrame:
    """History in which the affected entities carry their rebuilt versions.

    ``rebuilt`` is :func:`scd2` over all retained observations of the affected entities, so a
    version that arrives late splits the interval it falls into exactly as a full rebuild would.
    """
    return history.join(affected.select(entity), entity, "left_anti").unionByName(rebuilt)


def affected_observations(observations: DataFrame, affected: DataFrame, entity: str) -> DataFrame:
    return observations.join(affected.select(entity), entity, "left_semi")


def snapshot_diff(before: DataFrame, after: DataFrame, entity: str, tracked: Sequence[str]) -> DataFrame:
    """ADDED, REMOVED, CHANGED or UNCHANGED per entity; null equals null."""
    old = before.select(entity, F.struct(*tracked).alias("old"))
    new = after.select(entity, F.struct(*tracked).alias("new"))
    change = (
        F.when(F.col("old").isNull(), "ADDED")
        .when(F.col("new").isNull(), "REMOVED")
        .when(F.col("old").eqNullSafe(F.col("new")), "UNCHANGED")
        .otherwise("CHANGED")
    )
    return old.join(new, entity, "full_outer").select(
        entity,
        change.alias("change"),
        *[F.col("old")[c].alias(f"old_{c}") for c in tracked],
        *[F.col("new")[c].alias(f"new_{c}") for c in tracked],
    )
