"""The eighteen measures as aggregates under a filter context.

Both facts are first reduced to one row per date and context; everything after that, including the
shift to the prior year, works on those few rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import rules as R

MEASURES = [
    "gross_booked_sales",
    "units_sold",
    "sales_lines",
    "average_selling_price",
    "prior_year_gross_booked_sales",
    "gross_booked_sales_yoy",
    "eligible_orders",
    "eligible_order_gross_booked_sales",
    "average_order_value",
    "cancelled_orders",
    "cancellation_rate",
    "returned_orders",
    "return_rate",
    "sla_eligible_deliveries",
    "on_time_deliveries",
    "on_time_delivery_rate",
    "paid_orders",
    "paid_order_share",
]

_SUMS = {
    "amount": "decimal(38,2)",
    "units": "bigint",
    "lines": "bigint",
    "prior_amount": "decimal(38,2)",
    "orders": "bigint",
    "booked": "decimal(38,2)",
    "cancelled": "bigint",
    "returned": "bigint",
    "sla": "bigint",
    "punctual": "bigint",
    "paid": "bigint",
}


def calendar(df: DataFrame, day: str) -> DataFrame:
    """Every date of the whole years spanned by ``day``."""
    span = df.agg(F.trunc(F.min(day), "YEAR").alias("lo"), F.last_day(F.add_months(F.trunc(F.max(day), "YEAR"), 11)).alias("hi"))
    return span.where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("order_date"))


def prior_year_dates(dates: DataFrame) -> DataFrame:
    """Equivalent dates one year earlier; 29 February falls on the 28th and is counted once."""
    return dates.withColumn("order_date", F.add_months("order_date", -12)).distinct()


def measures(
    sales: DataFrame, orders: DataFrame, by: Sequence[str] = (), dates: DataFrame | None = None
) -> DataFrame:
    """One row of all measures per context.

    ``by`` names columns both facts have. ``dates`` is the date filter: distinct ``order_date``
    rows, further columns of it (such as a year) becoming part of the context. Without it the
    prior-year measures are null.
    """
    by = list(by)
    sold = (
        sales.where("line_eligible")
        .groupBy("order_date", *by)
        .agg(F.sum("amount").alias("amount"), F.sum("quantity").alias("units"), F.count(F.lit(1)).alias("lines"))
    )
    ordered = (
        orders.where("order_eligible")
        .groupBy("order_date", *by)
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("booked").alias("booked"),
            F.count_if(F.col("order_status") == R.ORDER_CANCELLED).alias("cancelled"),
            F.count_if(F.col("order_status") == R.ORDER_RETURNED).alias("returned"),
            F.count_if("ship_eligible").alias("sla"),
            F.count_if("on_time").alias("punctual"),
            F.count_if(F.col("payment_status") == R.PAYMENT_PAID).alias("paid"),
        )
    )
    if dates is None:
        parts, context = [sold, ordered], by
    else:
        context = [c for c in dates.columns if c != "order_date"] + by
        prior = sold.withColumnRenamed("amount", "prior_amount").drop("units", "lines")
        parts = [
            sold.join(dates, "order_date"),
            ordered.join(dates, "order_date"),
            prior.join(prior_year_dates(dates), "order_date"),
        ]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_padded(p, context) for p in parts])
    summed = together.groupBy(*context).agg(*[F.sum(name).cast(kind).alias(name) for name, kind in _SUMS.items()])
    return _present(summed, context)


def _padded(part: DataFrame, context: list[str]) -> DataFrame:
    known = [F.col(n).cast(k).alias(n) if n in part.columns else F.lit(None).cast(k).alias(n) for n, k in _SUMS.items()]
    return part.select(*context, *known)


def _present(s: DataFrame, context: list[str]) -> DataFrame:
    def count(name: str):
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint")

    amount, prior, booked = (F.col(c).cast("double") for c in ("amount", "prior_amount", "booked"))
    orders = count("orders")
    values = {
        "gross_booked_sales": amount,
        "units_sold": F.col("units"),
        "sales_lines": count("lines"),
        "average_selling_price": R.ratio(amount, F.col("units")),
        "prior_year_gross_booked_sales": prior,
        "gross_booked_sales_yoy": R.ratio(amount - prior, prior),
        "eligible_orders": orders,
        "eligible_order_gross_booked_sales": booked,
        "average_order_value": R.ratio(booked, orders),
        "cancelled_orders": count("cancelled"),
        "cancellation_rate": R.ratio(count("cancelled"), orders),
        "returned_orders": count("returned"),
        "return_rate": R.ratio(count("returned"), orders),
        "sla_eligible_deliveries": count("sla"),
        "on_time_deliveries": count("punctual"),
        "on_time_delivery_rate": R.ratio(count("punctual"), count("sla")),
        "paid_orders": count("paid"),
        "paid_order_share": R.ratio(count("paid"), orders),
    }
    return s.select(*context, *[values[m].alias(m) for m in MEASURES])
