"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from millrace.plans.registry import queries
from millrace.session import build_session

HEADLINE = [
    "dedup_lines",
    "scd2_customer",
    "scd2_product",
    "scd2_status",
    "asof_customer",
    "asof_product",
    "asof_status",
    "fact_sales",
    "fact_order",
    "mart_daily_sales",
    "mart_monthly_sales",
    "mart_customer_spend",
    "mart_product_performance",
    "mart_category_performance",
    "mart_geography_sales",
    "mart_sales_yoy",
    "mart_order_lifecycle",
    "mart_shipping_sla",
    "mart_payment_status",
    "mart_customer_order_frequency",
    "measures_all",
    "measures_by_year",
    "secret_scan",
    "link_integrity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    registered["mart_daily_sales"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": scale}))


if __name__ == "__main__":
    main()
