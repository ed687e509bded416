"""Sales and order facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import rules as R
from millrace.operators.asof import Dimension, asof_join, asof_join_all
from millrace.operators.classify import with_class


def attach_versions(facts: DataFrame, dimensions: Sequence[Dimension], months: tuple[Column, Column] | None = None) -> DataFrame:
    """Versions valid on the fact's date. With the range of months the facts are read once; without it, as in an increment whose
    range is unknown, each history is resolved for the distinct pairs of entity and date."""
    if months is not None:
        return asof_join_all(facts, dimensions, months)
    for d in dimensions:
        facts = asof_join(facts, d.history, d.entity, d.at, d.take)
    return facts


def apply_line_rules(
    lines: DataFrame, hard: dict[str, Column], tolerance: str = "0.00", check_amount: bool = True
) -> DataFrame:
    """Soft flags, failed hard rules, class and eligibility of sales lines."""
    late_columns = [F.col(c) for c in ("ship_date", "due_date") if c in lines.columns]
    soft_date = R.soft_date_defect(F.col("order_date"), *late_columns)
    soft_amount = (
        R.soft_amount_defect(F.col("amount"), F.col("quantity"), F.col("price"), tolerance)
        if check_amount
        else F.lit(False)
    )
    flagged = lines.withColumns(
        {"soft_date": soft_date, "soft_amount": soft_amount, "failed_rules": R.failed_rules(hard)}
    )
    eligible = R.line_eligible([F.col("soft_date"), F.col("soft_amount")], F.col("failed_rules"))
    return with_class(flagged).withColumn("line_eligible", eligible)


def order_totals(sales: DataFrame, **extra: Column) -> DataFrame:
    """Lines rolled up to one row per order before anything is joined, so an order counts once."""
    eligible_amount = F.when(F.col("line_eligible"), F.col("amount"))
    return sales.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.count_if("line_eligible").alias("eligible_lines"),
        F.coalesce(F.sum(eligible_amount), F.lit(0).cast("decimal(28,2)")).alias("booked"),
        *[c.alias(name) for name, c in extra.items()],
    )


def order_flags(orders: DataFrame, customer_known: Column) -> DataFrame:
    """Order and delivery eligibility from ``order_date``, ``delivered_date`` and ``due_date``."""
    eligible = R.order_eligible(F.col("order_id"), customer_known, F.col("order_date"))
    delivered, due = F.col("delivered_date"), F.col("due_date")
    return (
        orders.withColumn("order_eligible", eligible)
        .withColumn("ship_eligible", R.ship_eligible(F.col("order_eligible"), F.col("order_date"), delivered, due))
        .withColumn("on_time", F.col("ship_eligible") & R.on_time(delivered, due))
        .withColumn("delivery_days", R.delivery_days(delivered, F.col("order_date")))
    )
