"""Reference enrichment that can never multiply or drop fact rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.asof import resolve
from millrace.operators.history import scd2


def unique_by(reference: DataFrame, on: Sequence[str]) -> DataFrame:
    """The reference itself; the job that reads it fails if its key repeats.

    The check is a scalar subquery, so the reference reaches a join straight from its own exchange.
    Only then can adaptive execution split a hot key of the other side.
    """
    per_key = reference.groupBy(*on).agg(F.count(F.lit(1)).alias("copies"))
    repeated = per_key.where("copies > 1").agg(F.count(F.lit(1)).alias("repeated")).scalar()
    refuse = F.raise_error(F.lit(f"duplicate reference key: {', '.join(on)}")).cast("boolean")
    return reference.where(F.when(repeated > 0, refuse).otherwise(F.lit(True)))


def enrich(facts: DataFrame, reference: DataFrame, on: str | Sequence[str], take: Sequence[str]) -> DataFrame:
    """Left join to a reference whose key must be unique; a duplicate key fails the job.

    Whether the reference is broadcast is left to its measured size against
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    on = [on] if isinstance(on, str) else list(on)
    joined = facts.join(unique_by(reference.select(*on, *take), on), on, "left")
    return joined.select(*facts.columns, *take)


def with_presence(facts: DataFrame, keys: DataFrame, on: str, flag: str) -> DataFrame:
    """Add a boolean telling whether the key occurs in ``keys``, a unique one; a null key does not."""
    known = unique_by(keys.select(on), [on]).withColumn(flag, F.lit(True))
    joined = facts.join(known, on, "left")
    return joined.withColumn(flag, F.coalesce(flag, F.lit(False)))


def missing_references(facts: DataFrame, keys: DataFrame, on: str, rule: str) -> DataFrame:
    """Rows without a match, null keys included, labelled with the rule they fail."""
    return facts.join(keys.select(on), on, "left_anti").withColumn("failed_rule", F.lit(rule))


def latest_reference_as_of(
    snapshots: DataFrame, days: DataFrame, files: Sequence[str], file: str, as_of: str, snapshot: str, at: str
) -> DataFrame:
    """For each day and configured reference file the newest snapshot dated on or before that day.

    Files arrive independently; taking each one as of the same day gives a coherent set. A file
    without a snapshot yet gives no row. One row per file and day at most reaches a window.
    """
    history = scd2(snapshots, file, as_of, [snapshot], tie=[snapshot])
    asked = days.select(F.col(at)).distinct()
    probes = asked.select(at, F.explode(F.array(*[F.lit(f) for f in files])).alias(file))
    resolved = resolve(probes, history, file, at, [snapshot])
    return resolved.select(at, file, F.col("version")[snapshot].alias(snapshot))


def days_between(facts: DataFrame, at: str) -> DataFrame:
    """All days from the first to the last date of the facts; these two are read to the driver."""
    first, last = facts.agg(F.min(at), F.max(at)).first()
    every = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))
    return facts.sparkSession.range(1).select(F.explode(every).alias(at))


def snapshot_enrich(
    facts: DataFrame,
    snapshots: DataFrame,
    on: str,
    as_of: str,
    at: str,
    take: Sequence[str],
    initial_history: str | None = None,
    days: DataFrame | None = None,
) -> DataFrame:
    """Enrich from the newest snapshot dated on or before each fact's date.

    The snapshot is chosen per date, which involves a handful of rows; facts then join on key and
    snapshot date. A key missing from that snapshot stays empty even if an older one had it.
    ``days`` holds all dates of the facts, once each, see :func:`days_between`. Without it they are taken from the facts, whose size then hides
    that there are few of them: Spark moves all facts by date instead of broadcasting the dates.
    """
    dated = snapshots.select(F.lit("reference").alias("file"), F.col(as_of).alias("known_on"), F.col(as_of).alias("snapshot"))
    history = scd2(dated, "file", "known_on", ["snapshot"], open_first=initial_history)
    if days is None:
        days = facts.select(at).where(F.col(at).isNotNull()).distinct()
    days = days.withColumn("file", F.lit("reference"))
    chosen = resolve(days, history, "file", at, ["snapshot"]).select(at, F.col("version.snapshot").alias("snapshot"))
    rows = snapshots.withColumnRenamed(as_of, "snapshot")
    dated_facts = facts.join(chosen, at, "left")
    return enrich(dated_facts, rows, [on, "snapshot"], take).drop("snapshot")
