"""As-of join: every fact row meets the dimension version valid on its business date."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.rules import time_box


def asof_join(
    facts: DataFrame,
    history: DataFrame,
    entity: str,
    at: str,
    take: dict[str, str],
    box_minutes: int | None = None,
) -> DataFrame:
    """Left join ``facts`` to ``history`` on the entity and the interval ``[valid_from, valid_to)``.

    ``take`` maps history columns to output names. The interval is resolved for the distinct pairs
    of entity and date only, by merging them with the version starts in time order; no fact row is
    compared with every version of its entity. The facts then join on the exact pair, an equi-join
    that adaptive execution can split when one pair is hot. With dates a pair set holds one row per
    entity and day at most; for timestamps set ``box_minutes`` to keep windows to one entity and time box.
    """
    probes = facts.select(entity, at).where(F.col(entity).isNotNull() & F.col(at).isNotNull()).distinct()
    resolved = resolve(probes, history, entity, at, list(take), box_minutes)
    renamed = resolved.select(entity, at, *[F.col("version")[c].alias(out) for c, out in take.items()])
    return facts.join(renamed, [entity, at], "left")


#: Versions of one entity that a fact may be compared with.
FEW_VERSIONS = 31


@dataclass(frozen=True)
class Dimension:
    """How a fact meets one history: its key column, the date that picks the version, what to take.

    ``period`` is the time that deals versions and facts out. A month suits few entities with versions on most days. For many
    entities with few versions each, a month gives far more rows than there are versions; a year keeps their number near it.
    None deals by entity alone: for histories in which no entity has many versions, see :func:`period_for`.
    """

    history: DataFrame
    entity: str
    take: dict[str, str]
    at: str = "order_date"
    period: str | None = "month"


def period_for(history: DataFrame, entity: str) -> str | None:
    """Period for a history of unknown shape: None if a fact then meets no more versions than a month has days, else a year."""
    most = history.groupBy(entity).agg(F.count(F.lit(1)).alias("versions")).agg(F.max("versions")).first()[0]
    return None if (most or 0) <= FEW_VERSIONS else "year"


def date_range(dates: DataFrame, at: str) -> tuple[Column, Column]:
    """First and last month with a date, as scalar subqueries: the range versions have to cover."""
    month = F.trunc(F.col(at).cast("date"), "MM")
    return dates.agg(F.min(month)).scalar(), dates.agg(F.max(month)).scalar()


def by_month(
    history: DataFrame, entity: str, take: Sequence[str], months: tuple[Column, Column], period: str | None = "month"
) -> DataFrame:
    """Each version once per month (or year, by ``period``) it covers within the range, open ends cut at it.

    An entity has a row per period, plus one per version that starts within it: for dates 31 at most, or 366.
    """
    if period is None:
        return history.select(*dict.fromkeys([entity, "valid_from", "valid_to", *take]))
    first, last = (F.trunc(bound, period) for bound in months)
    final_day = F.date_sub(F.col("valid_to"), 1)
    start = F.greatest(F.trunc("valid_from", period), first)
    stop = F.least(F.coalesce(F.trunc(final_day, period), last), last)
    covered = F.when(start <= stop, F.sequence(start, stop, F.expr(f"interval 1 {period}"))).otherwise(F.array().cast("array<date>"))
    return history.select(entity, "valid_from", "valid_to", *[c for c in take if c not in (entity, "valid_from", "valid_to")], F.explode(covered).alias("month"))


def asof_join_all(facts: DataFrame, dimensions: Sequence[Dimension], months: tuple[Column, Column]) -> DataFrame:
    """Left join to several histories at once, the facts read a single time.

    A fact meets only the versions that cover its month (or year, see ``Dimension``): an equi-join on entity and month with the interval as the rest of the
    condition. Nothing is resolved beforehand, so no distinct dates are taken from the facts. Months split an entity's rows, and
    adaptive execution can split a hot entity's month further. ``months`` must contain the facts' dates; facts outside
    find no version. Rows without entity or date are kept without one.
    """
    for number, d in enumerate(dimensions):
        spread = by_month(d.history, d.entity, list(d.take), months, d.period)
        names = {c: f"version_{number}_{c}" for c in spread.columns}
        versions = spread.select(*[F.col(c).alias(name) for c, name in names.items()])
        at = F.col(d.at)
        valid = (at >= F.col(names["valid_from"])) & (F.col(names["valid_to"]).isNull() | (at < F.col(names["valid_to"])))
        same = F.col(d.entity) == F.col(names[d.entity])
        if d.period is not None:
            same = same & (F.trunc(at, d.period) == F.col(names["month"]))
        columns = facts.columns
        facts = facts.join(versions, same & valid, "left").select(*columns, *[F.col(names[c]).alias(out) for c, out in d.take.items()])
    return facts


def resolve(
    probes: DataFrame, history: DataFrame, entity: str, at: str, take: Sequence[str], box_minutes: int | None = None
) -> DataFrame:
    """Version struct (``valid_to`` and ``take``) for each distinct pair of entity and date."""
    extra = [c for c in take if c not in ("valid_from", "valid_to")]
    version = F.struct("valid_from", "valid_to", *extra)
    starts = history.select(entity, F.col("valid_from").alias(at), version.alias("started"), F.lit(0).alias("probe"))
    asked = probes.select(entity, at, F.lit(None).cast(starts.schema["started"].dataType).alias("started"), F.lit(1).alias("probe"))
    merged = asked.unionByName(starts)
    if box_minutes is not None:
        filled = _carry_by_box(merged, entity, at, box_minutes)
    else:
        so_far = Window.partitionBy(entity).orderBy(at, "probe").rowsBetween(Window.unboundedPreceding, 0)
        filled = merged.withColumn("version", F.last("started", ignorenulls=True).over(so_far))
    still_open = F.col("version.valid_to").isNull() | (F.col(at) < F.col("version.valid_to"))
    return filled.where((F.col("probe") == 1) & F.col("version").isNotNull() & still_open).select(entity, at, "version")


def _carry_by_box(merged: DataFrame, entity: str, at: str, box_minutes: int) -> DataFrame:
    """Last version so far, with windows over one entity and time box plus one summary row per box."""
    timed = merged.withColumn("box_no", time_box(F.col(at), box_minutes))
    inside = (
        Window.partitionBy(entity, "box_no").orderBy(at, "probe").rowsBetween(Window.unboundedPreceding, 0)
    )
    ends = timed.groupBy(entity, "box_no").agg(
        F.max_by("started", F.when(F.col("started").isNotNull(), F.col(at))).alias("end")
    )
    earlier = Window.partitionBy(entity).orderBy("box_no").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(entity, "box_no", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    local = timed.withColumn("local", F.last("started", ignorenulls=True).over(inside))
    return local.join(carried, [entity, "box_no"], "left").select(
        entity, at, "probe", F.coalesce("local", "carried").alias("version")
    )
