"""Candidate build, audit and publication of facts, marts and the KPI audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.classify import accepted
from millrace.operators.enrich import days_between, snapshot_enrich
from millrace.operators.status import current_status
from millrace.plans import audit, marts
from millrace.plans.facts import order_flags, order_totals
from millrace.plans.retail import CLASSIFIED_SCHEMA, EVENT_OBJECTS, EVENT_SCHEMA, REFERENCES, reference
from millrace.sources.tables import Snapshot, TableStore

LINE_KEY = ["sales_id"]


class AuditFailed(RuntimeError):
    pass


class SchemaMismatch(RuntimeError):
    pass


def fact_sales(silver: Snapshot, initial_history: str | None = None) -> DataFrame:
    """Accepted lines enriched from every reference as of the order date.

    Each file is taken at its own newest snapshot on or before that date, so files may arrive on
    different days. ``initial_history`` opens the first snapshot of a file back to that date.
    """
    classified = silver.read("sales_classified", CLASSIFIED_SCHEMA)
    facts = accepted(classified).drop("failed_rules", "dq_class", "silver_version")
    days = days_between(classified, "order_date")
    for name, attributes in REFERENCES.items():
        facts = snapshot_enrich(facts, reference(silver, name), "postal_key", "as_of", "order_date", attributes, initial_history, days)
    return facts.withColumns({"location_id": F.col("postal_key"), "location_tier": F.col("region")})


def fact_order(sales: DataFrame, silver: Snapshot) -> DataFrame:
    """One row per order of accepted lines, with current statuses by event time."""
    orders = order_totals(
        sales,
        customer_id=F.min("customer_id"),
        order_date=F.min("order_date"),
        due_date=F.max("due_date"),
        location_id=F.min("location_id"),
        zone=F.min("zone"),
    )
    families = dict(zip(("order_status", "shipment_status", "payment_status"), EVENT_OBJECTS))
    for column, name in families.items():
        extra = {}
        if column == "shipment_status":
            extra["delivered_date"] = F.to_date(F.max(F.when(F.col("status") == "DELIVERED", F.col("event_ts"))))
        latest = current_status(silver.read(name, EVENT_SCHEMA), "order_id", **extra)
        orders = orders.join(latest.select("order_id", F.col("status").alias(column), *extra), "order_id", "left")
    return order_flags(orders, F.col("customer_id").isNotNull())


def mart_plans(full_years: tuple[int, int]) -> dict[str, tuple[str, Callable[[DataFrame], DataFrame]]]:
    """The eleven marts with the fact each is built from."""
    return {
        "mart_daily_sales": ("fact_sales", marts.mart_daily_sales),
        "mart_monthly_sales": ("fact_sales", marts.mart_monthly_sales),
        "mart_customer_spend": ("fact_sales", marts.mart_customer_spend),
        "mart_product_performance": ("fact_sales", marts.mart_product_performance),
        "mart_category_performance": ("fact_sales", marts.mart_category_performance),
        "mart_geography_sales": ("fact_sales", marts.mart_geography_sales),
        "mart_sales_yoy": ("fact_sales", lambda sales: marts.mart_sales_yoy(sales, *full_years)),
        "mart_order_lifecycle": ("fact_order", marts.mart_order_lifecycle),
        "mart_shipping_sla": ("fact_order", marts.mart_shipping_sla),
        "mart_payment_status": ("fact_order", marts.mart_payment_status),
        "mart_customer_order_frequency": ("fact_order", marts.mart_customer_order_frequency),
    }


# Marts whose grouping covers every row of their population, so their totals must equal the fact's.
COMPLETE_SALES_MARTS = [
    "mart_daily_sales",
    "mart_monthly_sales",
    "mart_customer_spend",
    "mart_product_performance",
    "mart_category_performance",
    "mart_geography_sales",
]
COMPLETE_ORDER_MARTS = ["mart_shipping_sla", "mart_payment_status", "mart_customer_order_frequency"]


def audit_candidate(gold: TableStore, silver: Snapshot, version: int) -> None:
    """Grain, Silver against Gold, marts against facts. Any finding refuses the candidate."""
    sales, orders = gold.candidate("fact_sales", version), gold.candidate("fact_order", version)
    grain = audit.audit_grain(sales, orders, LINE_KEY).where("repeated_keys > 0 or null_keys > 0")
    silver_lines = accepted(silver.read("sales_classified", CLASSIFIED_SCHEMA))
    moved = audit.reconcile_totals(audit.sales_totals(silver_lines, "fact_sales"), audit.sales_totals(sales, "fact_sales"))
    totals = audit.audit_totals(
        sales,
        orders,
        {m: gold.candidate(m, version) for m in COMPLETE_SALES_MARTS},
        {m: gold.candidate(m, version) for m in COMPLETE_ORDER_MARTS},
    )
    findings = [str(r.asDict()) for check in (grain, moved.where("not matches"), totals.where("not matches")) for r in check.collect()]
    if findings:
        raise AuditFailed("; ".join(findings))


def guard_schemas(gold: TableStore, served: Snapshot, version: int, tables: list[str]) -> None:
    """Refuse a candidate whose table differs in names or types from the one being served."""
    for table in tables:
        serving = served.read(table)
        if serving is not None:
            new = {f.name: f.dataType for f in gold.candidate(table, version).schema}
            old = {f.name: f.dataType for f in serving.schema}
            if new != old:
                raise SchemaMismatch(f"{table}: candidate {new}, serving {old}")


def publish_gold(
    silver_store: TableStore,
    gold: TableStore,
    full_years: tuple[int, int],
    initial_history: str | None = None,
) -> int:
    """Build every table under the next version, audit it, and flip all of them at once.

    An exception at any point leaves the served version as it was.
    """
    served, silver = gold.snapshot(), silver_store.snapshot()
    version = served.version + 1
    parts = gold.write_whole("fact_sales", fact_sales(silver, initial_history), version)
    parts.extend(gold.write_whole("fact_order", fact_order(gold.candidate("fact_sales", version), silver), version))
    plans = mart_plans(full_years)
    for mart, (fact, plan) in plans.items():
        parts.extend(gold.write_whole(mart, plan(gold.candidate(fact, version)), version))
    kpi = audit.kpi_audit(gold.candidate("fact_sales", version), gold.candidate("fact_order", version))
    parts.extend(gold.write_whole("kpi_audit", kpi, version))

    audit_candidate(gold, silver, version)
    guard_schemas(gold, served, version, ["fact_sales", "fact_order", *plans, "kpi_audit"])
    candidate_kpi = gold.candidate("kpi_audit", version).first()
    gold.publish(version, parts)
    if gold.read("kpi_audit").first() != candidate_kpi:
        raise AuditFailed("published audit differs from the candidate's")
    return version
