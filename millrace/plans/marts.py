"""The eleven marts over ``fact_sales`` and ``fact_order``.

Rollups use stable entity keys, never version keys, and every denominator comes from
``fact_order``; sampled events are never counted as orders. Money is summed as decimal and shown
as double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import rules as R


def _sales() -> Column:
    return F.sum("amount").cast("double")


def _units() -> Column:
    return F.sum("quantity").cast("bigint")


def _eligible(sales: DataFrame) -> DataFrame:
    return sales.where("line_eligible")


def _sales_columns() -> list[Column]:
    return [
        _sales().alias("sales"),
        _units().alias("units"),
        F.count(F.lit(1)).alias("lines"),
        R.ratio(_sales(), _units()).alias("average_price"),
    ]


def mart_daily_sales(sales: DataFrame) -> DataFrame:
    return _eligible(sales).groupBy(F.col("order_date").alias("sale_date")).agg(*_sales_columns())


def mart_monthly_sales(sales: DataFrame) -> DataFrame:
    return _eligible(sales).groupBy(F.trunc("order_date", "MM").alias("sale_month")).agg(*_sales_columns())


def mart_customer_spend(sales: DataFrame) -> DataFrame:
    return _eligible(sales).groupBy("customer_id").agg(
        _sales().alias("spend"),
        _units().alias("units"),
        F.min("order_date").alias("first_sale"),
        F.max("order_date").alias("latest_sale"),
    )


def mart_product_performance(sales: DataFrame) -> DataFrame:
    return _eligible(sales).groupBy("product_id").agg(*_sales_columns())


def mart_category_performance(sales: DataFrame) -> DataFrame:
    """By the category the product had on the sale date."""
    return _eligible(sales).groupBy("category").agg(*_sales_columns())


def mart_geography_sales(sales: DataFrame) -> DataFrame:
    """By location and the service tier it had on the sale date."""
    return _eligible(sales).groupBy("location_id", "location_tier").agg(
        _sales().alias("sales"), _units().alias("units"), F.count(F.lit(1)).alias("lines")
    )


def mart_sales_yoy(sales: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Full years against the year before; partial years are left out.

    Each yearly total is handed to its own and to the following year, so one grouping over a
    handful of rows replaces an unpartitioned window.
    """
    in_range = _eligible(sales).where(R.full_year(F.col("order_date"), first_year, last_year))
    yearly = in_range.groupBy(F.year("order_date").alias("y")).agg(F.sum("amount").alias("amount"))
    handed = yearly.select(
        F.explode(
            F.array(
                F.struct(F.col("y").alias("sale_year"), F.col("amount").alias("own"), F.lit(None).cast("decimal(28,2)").alias("prior")),
                F.struct((F.col("y") + 1).alias("sale_year"), F.lit(None).cast("decimal(28,2)").alias("own"), F.col("amount").alias("prior")),
            )
        ).alias("h")
    ).select("h.*")
    paired = handed.groupBy("sale_year").agg(
        F.max("own").cast("double").alias("sales"), F.max("prior").cast("double").alias("prior_sales")
    )
    return paired.where(F.col("sales").isNotNull()).select(
        "sale_year",
        "sales",
        "prior_sales",
        R.ratio(F.col("sales") - F.col("prior_sales"), F.col("prior_sales")).alias("yoy"),
    )


def mart_order_lifecycle(orders: DataFrame) -> DataFrame:
    """Counts and order value per current status, and a row ``ALL`` that carries the overall rates."""
    count = F.count(F.lit(1))
    cancelled = F.count_if(F.col("order_status") == R.ORDER_CANCELLED)
    returned = F.count_if(F.col("order_status") == R.ORDER_RETURNED)
    booked = F.sum("booked").cast("double")
    per_status = orders.where("order_eligible").rollup("order_status").agg(
        F.grouping("order_status").alias("is_total"),
        count.alias("orders"),
        booked.alias("booked_sales"),
        R.ratio(booked, count).alias("average_order_value"),
        R.ratio(cancelled, count).alias("cancellation_rate"),
        R.ratio(returned, count).alias("return_rate"),
    )
    label = F.when(F.col("is_total") == 1, "ALL").otherwise(F.col("order_status"))
    return per_status.withColumn("order_status", label).drop("is_total")


def mart_shipping_sla(orders: DataFrame) -> DataFrame:
    """Deliveries by zone; calendar days from order to delivery."""
    deliveries = F.count(F.lit(1))
    punctual = F.count_if("on_time")
    return orders.where("ship_eligible").groupBy("zone").agg(
        deliveries.alias("deliveries"),
        punctual.alias("on_time_deliveries"),
        (deliveries - punctual).alias("late_deliveries"),
        R.ratio(punctual, deliveries).alias("on_time_rate"),
        R.ratio(F.sum("delivery_days"), deliveries).alias("average_days"),
    )


def mart_payment_status(orders: DataFrame) -> DataFrame:
    return orders.where("order_eligible").groupBy("payment_status").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("booked").cast("double").alias("booked_sales")
    )


def mart_customer_order_frequency(orders: DataFrame) -> DataFrame:
    count = F.count(F.lit(1))
    return orders.where("order_eligible").groupBy("customer_id").agg(
        count.alias("orders"),
        F.min("order_date").alias("first_order"),
        F.max("order_date").alias("latest_order"),
        (count >= 2).alias("is_repeat"),
    )
