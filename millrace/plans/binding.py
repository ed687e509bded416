"""The given tables read as the source objects of the retail domain.

Nothing is dropped here: a customer with a negative balance counts as not registered, which gives
the facts their rejected lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import rules as R
from millrace.operators.asof import Dimension, date_range
from millrace.operators.classify import accepted
from millrace.operators.dedup import latest_per_key
from millrace.operators.enrich import enrich, with_presence
from millrace.operators.history import scd2
from millrace.plans.facts import apply_line_rules, attach_versions, order_flags, order_totals

LINE_KEY = ["order_id", "line_no"]
HISTORY_START = "1900-01-01"


class Source:
    """Given tables of one scale, each read lazily and pruned by its consumer."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- source objects ---------------------------------------------------------------------

    def raw_lines(self) -> DataFrame:
        return self.table("lineitem").withColumnsRenamed({"l_orderkey": "order_id", "l_linenumber": "line_no"})

    def lines(self) -> DataFrame:
        """Sales lines, one per key; the newest copy by ship date is the accepted one."""
        return latest_per_key(self.raw_lines(), LINE_KEY, ["l_shipdate"])

    def line_columns(self) -> DataFrame:
        return self.lines().select(
            *LINE_KEY,
            F.col("l_partkey").alias("product_id"),
            F.to_date("l_shipdate").alias("ship_date"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            R.money(F.col("l_extendedprice")).alias("amount"),
            (F.col("l_returnflag") == "R").alias("returned"),
        )

    def customers(self) -> DataFrame:
        """All customers; ``registered`` says which of them a line may refer to."""
        return self.table("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("location_id"),
            F.coalesce(F.col("c_acctbal") >= 0, F.lit(False)).alias("registered"),
        )

    def orders(self) -> DataFrame:
        order_date = F.to_date("o_orderdate")
        promised = F.left("o_orderpriority", F.lit(1)).cast("int") * 365
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            order_date.alias("order_date"),
            F.date_add(order_date, promised).alias("due_date"),
            F.col("o_orderstatus").alias("source_status"),
        )

    def headers(self) -> DataFrame:
        """Order headers with their customer's location; unknown customers are kept and flagged."""
        joined = self.orders().join(self.customers(), "customer_id", "left")
        return joined.withColumn("registered", F.coalesce("registered", F.lit(False)))

    def products(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("product_id"))

    def zones(self) -> DataFrame:
        """Location reference: nation with the region it is delivered from."""
        nation = self.table("nation").select(
            F.col("n_nationkey").alias("location_id"), F.col("n_name").alias("location"), F.col("n_regionkey").alias("r_regionkey")
        )
        region = self.table("region").withColumnRenamed("r_name", "zone")
        return enrich(nation, region, "r_regionkey", ["zone"]).drop("r_regionkey")

    def status_events(self) -> DataFrame:
        """Lifecycle events; ``value`` minutes pass until one arrives, so many arrive out of order."""
        minutes = F.make_dt_interval(mins=F.floor("value").cast("int"))
        return self.table("events").select(
            "event_id",
            F.col("user_id").alias("entity_id"),
            F.col("event_type").alias("status"),
            F.col("ts").alias("event_ts"),
            (F.col("ts") + minutes).alias("arrival_ts"),
        )

    # -- histories --------------------------------------------------------------------------

    def customer_changes(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("customer_id"),
            F.to_date("o_orderdate").alias("changed_on"),
            "o_orderkey",
            F.col("o_orderpriority").alias("tier"),
        )

    def customer_history(self) -> DataFrame:
        return scd2(self.customer_changes(), "customer_id", "changed_on", ["tier"], tie=["o_orderkey"])

    def product_history(self) -> DataFrame:
        """Supplier of a product over time; the first version is open to the past."""
        lines = self.table("lineitem")
        tie = [c for c in lines.columns if c not in ("l_partkey", "l_shipdate", "l_suppkey")]
        changes = lines.select(
            F.col("l_partkey").alias("product_id"),
            F.to_date("l_shipdate").alias("changed_on"),
            F.col("l_suppkey").alias("supplier_id"),
            *tie,
        )
        return scd2(changes, "product_id", "changed_on", ["supplier_id"], tie=tie, open_first=HISTORY_START)

    def location_changes(self) -> DataFrame:
        located = self.table("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("location_id"))
        return self.customer_changes().join(located, "customer_id").drop("customer_id")

    def location_history(self) -> DataFrame:
        """Service tier of a location: that of its last order of the day."""
        return scd2(
            self.location_changes(), "location_id", "changed_on", ["tier"], tie=["o_orderkey"], open_first=HISTORY_START
        )

    def status_history(self) -> DataFrame:
        return scd2(self.status_events(), "entity_id", "event_ts", ["status"], tie=["event_id"], box_minutes=60)

    def supplier_categories(self) -> DataFrame:
        """Category of a supplier: the nation it supplies from."""
        supplier = self.table("supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_nationkey").alias("n_nationkey"))
        nation = self.table("nation").select("n_nationkey", F.col("n_name").alias("category"))
        return enrich(supplier, nation, "n_nationkey", ["category"]).drop("n_nationkey")

    # -- facts ------------------------------------------------------------------------------

    def classified_lines(self, headers: DataFrame | None = None) -> DataFrame:
        headers = self.headers() if headers is None else headers
        lines = self.line_columns().join(headers.withColumn("order_known", F.lit(True)), "order_id", "left")
        lines = lines.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("order_known", "registered")})
        known = with_presence(lines, self.products(), "product_id", "product_known")
        hard = {
            "unknown_order": ~F.col("order_known"),
            "unknown_customer": F.col("order_known") & ~F.col("registered"),
            "unknown_product": ~F.col("product_known"),
        }
        # The promised date of an order is no attribute of its lines, so only ship dates are tested.
        return apply_line_rules(known.drop("due_date"), hard, check_amount=False)

    def sales(self, headers: DataFrame | None = None) -> DataFrame:
        """Accepted lines with flags, before any version is attached."""
        return accepted(self.classified_lines(headers)).drop("source_status", "registered", "order_known", "product_known")

    def order_months(self) -> tuple[Column, Column]:
        """Range of the order dates, from that one column."""
        return date_range(self.table("orders").select("o_orderdate"), "o_orderdate")

    def fact_sales(self, customer: bool = True, product: bool = True, location: bool = True) -> DataFrame:
        """Accepted lines with the versions valid on the order date.

        Customer and location versions depend on the order alone, so they are attached at order
        grain; only the product version is attached per line. Lines are read once.
        """
        on_order, on_line = [], []
        if customer:
            on_order.append(Dimension(self.customer_history(), "customer_id", {"tier": "customer_tier", "version_key": "customer_version"}, period="year"))
        if location:
            on_order.append(Dimension(self.location_history(), "location_id", {"tier": "location_tier", "version_key": "location_version"}))
        if product:
            on_line.append(Dimension(self.product_history(), "product_id", {"supplier_id": "supplier_id", "version_key": "product_version"}, period="year"))
        months = self.order_months()
        headers = attach_versions(self.headers(), on_order, months)
        facts = attach_versions(self.sales(headers), on_line, months)
        return enrich(facts, self.supplier_categories(), "supplier_id", ["category"]) if product else facts

    def fact_order(self) -> DataFrame:
        """One row per order, orders without lines included."""
        per_order = order_totals(
            self.sales(), delivered_date=F.max("ship_date"), any_returned=F.bool_or("returned")
        )
        joined = self.headers().join(per_order, "order_id", "left")
        status = (
            F.when(F.col("source_status") == "P", R.ORDER_CANCELLED)
            .when(F.coalesce("any_returned", F.lit(False)), R.ORDER_RETURNED)
            .otherwise("COMPLETED")
        )
        filled = joined.withColumns(
            {
                "order_status": status,
                "payment_status": F.when(F.col("source_status") == "F", R.PAYMENT_PAID).otherwise("OPEN"),
                "line_count": F.coalesce("line_count", F.lit(0)),
                "eligible_lines": F.coalesce("eligible_lines", F.lit(0)),
                "booked": F.coalesce("booked", F.lit(0)).cast("decimal(28,2)"),
            }
        )
        flagged = order_flags(filled, F.col("registered"))
        return enrich(flagged, self.zones(), "location_id", ["zone"]).drop("source_status", "registered", "any_returned")
