"""The golden acceptance fixture: source rows, batches and the runs over them."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Row

from millrace.plans.gold import publish_gold
from millrace.plans.retail import conform
from millrace.sources import bronze
from millrace.sources.tables import TableStore
from millrace.streaming.silver import run_silver

CUSTOMER = "customer_id bigint, name string, region string, postal_key string, dwh_load_ts timestamp_ntz"
PRODUCT = "product_id bigint, name string, category string, price decimal(18,2), dwh_load_ts timestamp_ntz"
SALES = (
    "sales_id bigint, order_id bigint, customer_id bigint, product_id bigint, order_date date, ship_date date, due_date date, "
    "quantity int, price decimal(18,2), amount decimal(18,2), dwh_load_ts timestamp_ntz"
)
EVENT = "event_id bigint, order_id bigint, status string, event_ts timestamp_ntz, dwh_load_ts timestamp_ntz"
GEOGRAPHY = "postal_key string, city string, country string, as_of date, dwh_load_ts timestamp_ntz"
ZONES = "postal_key string, zone string, as_of date, dwh_load_ts timestamp_ntz"

SCHEMAS = {
    "customer_master": (CUSTOMER, bronze.SNAPSHOT),
    "product_master": (PRODUCT, bronze.SNAPSHOT),
    "sales_order_line": (SALES, bronze.WATERMARK),
    "order_status_event": (EVENT, bronze.WATERMARK),
    "shipment_status_event": (EVENT, bronze.WATERMARK),
    "payment_status_event": (EVENT, bronze.WATERMARK),
    "geography": (GEOGRAPHY, bronze.SNAPSHOT),
    "delivery_zones": (ZONES, bronze.SNAPSHOT),
}


def day(month: int, d: int) -> date:
    return date(2026, month, d)


def at(month: int, d: int, hour: int = 12) -> datetime:
    return datetime(2026, month, d, hour)


def line(key, order, customer, ordered, qty, price, amount, loaded, ship=None, due=None, product=1):
    return (key, order, customer, product, ordered, ship, due, qty, Decimal(price), Decimal(amount), loaded)


class Lakehouse:
    def __init__(self, spark, root: str):
        self.spark = spark
        self.root = root
        self.silver = TableStore(spark, f"{root}/silver")
        self.gold = TableStore(spark, f"{root}/gold")

    def arrive(self, object_name: str, rows: list[tuple]) -> str | None:
        """One copy of an object into Bronze."""
        schema, strategy = SCHEMAS[object_name]
        obj = Row(object_name=object_name, strategy=strategy, stamp="dwh_load_ts")
        return bronze.ingest(self.spark, self.root, obj, self.spark.createDataFrame(rows, schema))

    def run(self, transform=conform, **options) -> int:
        return run_silver(self.spark, self.root, self.silver, transform, **options)

    def publish(self, **options) -> int:
        return publish_gold(self.silver, self.gold, (2020, 2025), **options)

    def classified(self) -> dict[int, Row]:
        rows = self.silver.read("sales_classified").collect()
        assert len({r.sales_id for r in rows}) == len(rows)
        return {r.sales_id: r for r in rows}

    def accepted(self) -> dict[int, Row]:
        return {k: r for k, r in self.classified().items() if r.dq_class == "ACCEPTED"}

    def rejected(self) -> dict[int, Row]:
        return {k: r for k, r in self.classified().items() if r.dq_class == "REJECTED"}


CUSTOMER_JAN = (1, "Ada", "north", "P1", at(1, 1))
CUSTOMER_MAR = (1, "Ada", "south", "P2", at(3, 1))
PRODUCT_JAN = (1, "widget", "tools", Decimal("100.00"), at(1, 1))
PRODUCT_MAR = (1, "widget", "garden", Decimal("100.00"), at(3, 1))

BASELINE_LINES = [
    line(1, 1, 1, day(1, 10), 1, "100.00", "100.00", at(1, 10), day(1, 12), day(1, 20)),
    line(2, 1, 1, day(1, 10), 1, "50.00", "50.00", at(1, 10), day(1, 12), day(1, 20)),
]
MARCH_LINES = [
    line(1, 1, 1, day(1, 10), 1, "110.00", "110.00", at(3, 12), day(1, 12), day(1, 20)),
    line(3, 2, 1, day(1, 20), 1, "30.00", "30.00", at(3, 12), day(1, 22), day(1, 30)),
    line(4, 3, 1, day(3, 10), 1, "40.00", "40.00", at(3, 12), day(3, 11), day(3, 20)),
    line(4, 3, 1, day(3, 10), 1, "40.00", "40.00", at(3, 12), day(3, 11), day(3, 20)),
    line(5, 4, 1, day(3, 11), 2, "10.00", "25.00", at(3, 12), day(3, 1), day(3, 2)),
    line(6, 5, 999, day(3, 12), 1, "5.00", "5.00", at(3, 12), day(3, 13), day(3, 20)),
]


def load_baseline(house: Lakehouse) -> None:
    house.arrive("customer_master", [CUSTOMER_JAN])
    house.arrive("product_master", [PRODUCT_JAN])
    house.arrive("sales_order_line", BASELINE_LINES)


def load_march(house: Lakehouse) -> None:
    house.arrive("customer_master", [CUSTOMER_MAR])
    house.arrive("product_master", [PRODUCT_MAR])
    house.arrive("sales_order_line", MARCH_LINES)
    house.arrive("order_status_event", [(11, 1, "completed", at(1, 15), at(1, 15)), (12, 1, "returned", at(2, 1), at(3, 12)), (13, 1, "shipped", at(1, 12), at(3, 12)), (14, 3, "cancelled", at(3, 11), at(3, 12))])
    house.arrive("shipment_status_event", [(21, 1, "delivered", at(1, 15), at(3, 12)), (22, 2, "delivered", at(2, 5), at(3, 12))])
    house.arrive("payment_status_event", [(31, 1, "paid", at(1, 11), at(3, 12)), (32, 2, "open", at(1, 21), at(3, 12))])
    house.arrive("geography", [("P1", "York", "UK", day(1, 1), at(1, 1)), ("P2", "Bath", "UK", day(1, 1), at(1, 1))])
    house.arrive("delivery_zones", [("P1", "Z1", day(1, 1), at(1, 1)), ("P2", "Z2", day(1, 1), at(1, 1))])
