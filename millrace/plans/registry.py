"""Queries over the given tables, one per operator or group of operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import patterns as P
from millrace.functions import rules as R
from millrace.operators import checks, textscan
from millrace.operators.asof import Dimension, asof_join, asof_join_all, date_range
from millrace.operators.classify import accepted, reconcile_classes, to_reprocess, transitions, with_class
from millrace.operators.dedup import latest_per_key, upsert
from millrace.operators.enrich import enrich, latest_reference_as_of, missing_references
from millrace.operators.history import affected_observations, scd2, scd2_merge, snapshot_diff
from millrace.operators.status import current_status, event_fact
from millrace.plans import audit, marts
from millrace.plans.binding import LINE_KEY, Source
from millrace.plans.measures import calendar, measures
from millrace.plans.pipeline import baseline_evidence, replay_evidence, run_in_shared_dir
from millrace.session import tune
from millrace.sources.bronze import watermark_slice
from millrace.sources.contracts import field_drift
from millrace.sources.tables import written

Query = Callable[[Source], DataFrame]

FULL_YEARS = (1995, 2000)
BOUNDARY = "1999-01-01"
SECOND_BOUNDARY = "2000-07-01"


# -- rows and rules ------------------------------------------------------------------------------


def dedup_lines(s: Source) -> DataFrame:
    return s.lines()


def standardise_customer(s: Source) -> DataFrame:
    c = s.table("customer")
    number = F.regexp_extract("c_name", r"#(\d+)$", 1)
    return c.select(
        F.col("c_custkey").alias("customer_id"),
        R.clean_code(F.col("c_name")).alias("customer_name"),
        R.clean_label(F.col("c_mktsegment")).alias("segment"),
        R.typed(number, "bigint").alias("customer_number"),
        R.typed(F.col("c_mktsegment"), "bigint").alias("segment_number"),
        R.money(F.col("c_acctbal")).cast("double").alias("balance"),
    )


def soft_dq(s: Source) -> DataFrame:
    lines = s.line_columns().join(s.headers().select("order_id", "order_date"), "order_id", "left")
    late = R.soft_date_defect(F.col("order_date"), F.col("ship_date"))
    return lines.select(*LINE_KEY, "order_date", "ship_date", late.alias("soft_date"))


def eligibility(s: Source) -> DataFrame:
    return s.classified_lines().select(
        *LINE_KEY, "customer_id", "soft_date", "dq_class", "line_eligible", F.concat_ws(",", "failed_rules").alias("failed_rules")
    )


def soft_amount(s: Source) -> DataFrame:
    """Lines whose amount is more than 20,000 away from quantity times list price."""
    price = s.table("part").select(F.col("p_partkey").alias("product_id"), F.col("p_retailprice").alias("price"))
    priced = s.line_columns().join(price, "product_id", "left")
    odd = R.soft_amount_defect(F.col("amount"), F.col("quantity"), F.col("price"), tolerance="20000.00")
    return priced.select(*LINE_KEY, "product_id", odd.alias("soft_amount"))


def version_keys(s: Source) -> DataFrame:
    """Versions and distinct version keys of each history; a difference would be a collision."""
    histories = {
        "customer": s.customer_history(),
        "product": s.product_history(),
        "location": s.location_history(),
        "status": s.status_history(),
    }
    counts = [
        h.agg(F.count(F.lit(1)).alias("versions"), F.count_distinct("version_key").alias("version_keys")).select(
            F.lit(name).alias("history"), "versions", "version_keys"
        )
        for name, h in histories.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def event_delay(s: Source) -> DataFrame:
    return event_fact(s.status_events()).select(
        "event_id", "entity_id", "status", "delay_seconds", (F.col("delay_seconds") >= 3600).alias("is_late")
    )


def delivery_days(s: Source) -> DataFrame:
    return s.fact_order().select("order_id", "order_date", "delivered_date", "due_date", "delivery_days", "ship_eligible", "on_time")


def hard_dq_anti(s: Source) -> DataFrame:
    orders = s.headers().select("order_id", "customer_id")
    bare = s.line_columns().select(*LINE_KEY, "product_id")
    lines = bare.join(orders, "order_id")
    orphans = missing_references(bare, orders, "order_id", "unknown_order").withColumn("customer_id", F.lit(None).cast("bigint"))
    customers = missing_references(lines, s.customers().where("registered"), "customer_id", "unknown_customer")
    products = missing_references(lines, s.products(), "product_id", "unknown_product")
    columns = [*LINE_KEY, "customer_id", "product_id", "failed_rule"]
    return orphans.select(*columns).unionByName(customers.select(*columns)).unionByName(products.select(*columns))


# -- history -------------------------------------------------------------------------------------

_VERSION = ["valid_from", "valid_to", "is_current"]


def snapshot_diff_customers(s: Source) -> DataFrame:
    changes = s.customer_changes()

    def state(rows: DataFrame) -> DataFrame:
        last = F.max(F.struct("changed_on", "o_orderkey", "tier")).alias("last")
        return rows.groupBy("customer_id").agg(last).select("customer_id", "last.tier")

    cut = F.lit(BOUNDARY).cast("date")
    before, after = changes.where(F.col("changed_on") < cut), changes.where(F.col("changed_on") >= cut)
    return snapshot_diff(state(before), state(after), "customer_id", ["tier"])


def scd2_customer(s: Source) -> DataFrame:
    return s.customer_history().select("customer_id", "tier", *_VERSION)


def scd2_product(s: Source) -> DataFrame:
    return s.product_history().select("product_id", "supplier_id", *_VERSION)


def scd2_location(s: Source) -> DataFrame:
    return s.location_history().select("location_id", "tier", *_VERSION)


def scd2_status(s: Source) -> DataFrame:
    return s.status_history().select("entity_id", "status", *_VERSION)


def scd2_late_insert(s: Source) -> DataFrame:
    """Finished orders arrive after the history was built from the others."""
    observations = s.customer_changes().join(s.table("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    late = observations.where("o_orderstatus = 'F'")
    history = scd2(observations.where("o_orderstatus <> 'F'"), "customer_id", "changed_on", ["tier"], tie=["o_orderkey"])
    relevant = affected_observations(observations, late, "customer_id")
    rebuilt = scd2(relevant, "customer_id", "changed_on", ["tier"], tie=["o_orderkey"])
    return scd2_merge(history, rebuilt, late, "customer_id").select("customer_id", "tier", *_VERSION)


def reference_asof(s: Source) -> DataFrame:
    """Each event refreshes the reference file of its kind; event days ask for the coherent set."""
    snapshots = s.table("events").select(
        F.col("event_type").alias("file"), F.to_date("ts").alias("as_of"), F.col("event_id").alias("snapshot_id")
    )
    files = sorted(r[0] for r in snapshots.select("file").distinct().collect())  # kinds of files, a handful
    days = s.table("events").select(F.to_date("ts").alias("day"))
    return latest_reference_as_of(snapshots, days, files, "file", "as_of", "snapshot_id", "day")


def geo_enrichment(s: Source) -> DataFrame:
    customers = s.table("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("location_id"))
    return enrich(customers, s.zones(), "location_id", ["location", "zone"])


def asof_customer(s: Source) -> DataFrame:
    """Every delivery with the customer tier valid on the ship date, not today's."""
    lines = s.line_columns().select(*LINE_KEY, "ship_date")
    orders = s.table("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))
    months = date_range(s.table("lineitem").select("l_shipdate"), "l_shipdate")
    tier = Dimension(s.customer_history(), "customer_id", {"tier": "tier", "valid_from": "valid_from"}, at="ship_date", period="year")
    return asof_join_all(lines.join(orders, "order_id", "left"), [tier], months)


def asof_product(s: Source) -> DataFrame:
    orders = s.table("orders").select(F.col("o_orderkey").alias("order_id"), F.to_date("o_orderdate").alias("order_date"))
    facts = s.line_columns().select(*LINE_KEY, "product_id").join(orders, "order_id", "left")
    supplier = Dimension(s.product_history(), "product_id", {"supplier_id": "supplier_id", "valid_from": "valid_from"}, period="year")
    return asof_join_all(facts, [supplier], s.order_months())


def asof_status(s: Source) -> DataFrame:
    """Status an entity had when each of its events arrived, by event time."""
    facts = s.status_events().select("event_id", "entity_id", "arrival_ts")
    history = s.status_history()
    return asof_join(facts, history, "entity_id", "arrival_ts", {"status": "status_then", "valid_from": "status_since"}, box_minutes=60)


def current_status_by_entity(s: Source) -> DataFrame:
    return current_status(s.status_events(), "entity_id")


# -- facts ---------------------------------------------------------------------------------------


def fact_sales(s: Source) -> DataFrame:
    return s.fact_sales().select(
        *LINE_KEY,
        "customer_id",
        "product_id",
        "location_id",
        "order_date",
        "ship_date",
        "quantity",
        F.col("amount").cast("double").alias("amount"),
        "customer_tier",
        "location_tier",
        "supplier_id",
        "category",
        "soft_date",
        "line_eligible",
    )


def fact_order(s: Source) -> DataFrame:
    return s.fact_order().select(
        "order_id",
        "customer_id",
        "location_id",
        "zone",
        "order_date",
        "due_date",
        "delivered_date",
        "order_status",
        "payment_status",
        F.col("line_count").cast("bigint").alias("line_count"),
        F.col("eligible_lines").cast("bigint").alias("eligible_lines"),
        F.col("booked").cast("double").alias("booked"),
        "order_eligible",
        "ship_eligible",
        "on_time",
        "delivery_days",
    )


# -- marts and measures --------------------------------------------------------------------------


def mart_daily_sales(s: Source) -> DataFrame:
    return marts.mart_daily_sales(s.sales())


def mart_monthly_sales(s: Source) -> DataFrame:
    return marts.mart_monthly_sales(s.sales())


def mart_customer_spend(s: Source) -> DataFrame:
    return marts.mart_customer_spend(s.sales())


def mart_product_performance(s: Source) -> DataFrame:
    return marts.mart_product_performance(s.sales())


def mart_category_performance(s: Source) -> DataFrame:
    return marts.mart_category_performance(s.fact_sales(customer=False, location=False))


def mart_geography_sales(s: Source) -> DataFrame:
    return marts.mart_geography_sales(s.fact_sales(customer=False, product=False))


def mart_sales_yoy(s: Source) -> DataFrame:
    return marts.mart_sales_yoy(s.sales(), *FULL_YEARS)


def mart_order_lifecycle(s: Source) -> DataFrame:
    return marts.mart_order_lifecycle(s.fact_order())


def mart_shipping_sla(s: Source) -> DataFrame:
    return marts.mart_shipping_sla(s.fact_order())


def mart_payment_status(s: Source) -> DataFrame:
    return marts.mart_payment_status(s.fact_order())


def mart_customer_order_frequency(s: Source) -> DataFrame:
    return marts.mart_customer_order_frequency(s.fact_order())


def measures_all(s: Source) -> DataFrame:
    return measures(s.sales(), s.fact_order())


def _years(s: Source) -> DataFrame:
    days = calendar(s.table("orders").select(F.to_date("o_orderdate").alias("day")), "day")
    return days.withColumn("sale_year", F.year("order_date"))


def measures_by_year(s: Source) -> DataFrame:
    return measures(s.sales(), s.fact_order(), dates=_years(s))


def measures_by_location(s: Source) -> DataFrame:
    return measures(s.sales(), s.fact_order(), by=["location_id"])


def prior_year(s: Source) -> DataFrame:
    """Prior-year sales of every month, by equivalent dates."""
    days = _years(s).withColumn("sale_month", F.trunc("order_date", "MM")).drop("sale_year")
    return measures(s.sales(), s.fact_order(), dates=days).select(
        "sale_month", "gross_booked_sales", "prior_year_gross_booked_sales", "gross_booked_sales_yoy"
    )


# -- increments ----------------------------------------------------------------------------------


def increment_slice(s: Source) -> DataFrame:
    """Rows above the committed bound and up to the newest source stamp, fixed before copying."""
    return watermark_slice(s.raw_lines(), "l_shipdate", BOUNDARY)


def upsert_correction(s: Source) -> DataFrame:
    """An early state of the lines, corrected by what was loaded later."""
    raw = s.raw_lines()
    cut = F.lit(BOUNDARY).cast("timestamp_ntz")
    current = latest_per_key(raw.where(F.col("l_shipdate") <= cut), LINE_KEY, ["l_shipdate"])
    return upsert(current, raw.where(F.col("l_shipdate") > cut), LINE_KEY, ["l_shipdate"])


def _order_classes(s: Source, known: DataFrame, stamp: int) -> DataFrame:
    orders = s.table("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))
    flagged = orders.join(known.select("customer_id").withColumn("known", F.lit(True)), "customer_id", "left")
    failures = R.failed_rules({"unknown_customer": F.col("known").isNull()})
    return with_class(flagged.select("order_id", "customer_id", failures.alias("failed_rules"))).withColumn("load_no", F.lit(stamp))


def _customer_states(s: Source) -> tuple[DataFrame, DataFrame]:
    base = s.table("customer").select(F.col("c_custkey").alias("customer_id"), "c_acctbal", "c_mktsegment")
    return base.where("c_acctbal >= 0"), base.where("c_acctbal >= 0 and c_mktsegment <> 'MACHINERY' or c_mktsegment = 'BUILDING'")


def classify_transition(s: Source) -> DataFrame:
    """Two classifications of each order; the customer master gains one segment and loses another."""
    first, second = _customer_states(s)
    before = _order_classes(s, first, 1)
    after = reconcile_classes(before, _order_classes(s, second, 2), ["order_id"], ["load_no"])
    return transitions(before, after, ["order_id"]).select(
        "order_id", "from_class", "to_class", F.concat_ws(",", "failed_rules").alias("failed_rules")
    )


def reject_reprocess(s: Source) -> DataFrame:
    """Orders rejected at first and accepted once their customer has arrived."""
    first, second = _customer_states(s)
    current = _order_classes(s, first, 1)
    arrived = second.join(first, "customer_id", "left_anti")
    again = to_reprocess(current, arrived, "customer_id").select("order_id", "customer_id")
    known = again.join(second.select("customer_id").withColumn("known", F.lit(True)), "customer_id", "left")
    failures = R.failed_rules({"unknown_customer": F.col("known").isNull()})
    retried = with_class(known.select("order_id", "customer_id", failures.alias("failed_rules"))).withColumn("load_no", F.lit(2))
    final = reconcile_classes(current, retried, ["order_id"], ["load_no"])
    return final.groupBy("dq_class", "load_no").agg(F.count(F.lit(1)).alias("orders"))


def copy_counts(s: Source) -> DataFrame:
    """Source rows against the rows of all increments cut at the committed bound."""
    stamps = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("object_name"), "value")

    source, landed = [], []
    for name, stamp in stamps.items():
        table = s.table(name).select(stamp)
        cut = F.lit(BOUNDARY).cast("timestamp_ntz")
        source.append(count(table, name))
        landed.append(count(table.where(F.col(stamp) <= cut).unionAll(watermark_slice(table, stamp, BOUNDARY)), name))
    return checks.copy_validation(checks.stack_all(source), checks.stack_all(landed)).select(
        "object_name", F.col("expected").alias("source_rows"), F.col("actual").alias("landed_rows"), "matches"
    )


def quality_history(s: Source) -> DataFrame:
    lines = s.classified_lines()
    rules = {
        "soft_date": F.col("soft_date"),
        "unknown_customer": F.array_contains("failed_rules", "unknown_customer"),
        "unknown_product": F.array_contains("failed_rules", "unknown_product"),
        "not_eligible": ~F.col("line_eligible"),
    }
    return checks.rule_counts(lines, rules, stage="silver", object_name="sales_order_line")


def contract_drift(s: Source) -> DataFrame:
    """Fields found in the event payloads against a contract that expects ``k`` and ``source``."""
    return field_drift(s.table("events"), "props", {"k": "bigint", "source": "string"})


# -- audits --------------------------------------------------------------------------------------


def audit_grain(s: Source) -> DataFrame:
    raw = checks.grain_violations(s.raw_lines().select(*LINE_KEY), LINE_KEY, "bronze_lines")
    return raw.unionByName(audit.audit_grain(s.sales(), s.fact_order(), LINE_KEY))


def audit_denominators(s: Source) -> DataFrame:
    """Order populations: line-derived, fact flags and the lifecycle mart must agree."""
    orders = written(s.spark, s.fact_order())
    base = orders.agg(
        F.count_if("order_eligible").alias("eligible"), F.count_if("ship_eligible").alias("deliveries")
    ).unpivot([], ["eligible", "deliveries"], "measure", "value")
    lifecycle = marts.mart_order_lifecycle(orders).where("order_status <> 'ALL'")
    derived = checks.stack_all(
        [
            lifecycle.agg(F.sum("orders").alias("value")).select(F.lit("eligible").alias("measure"), "value"),
            marts.mart_shipping_sla(orders).agg(F.sum("deliveries").alias("value")).select(F.lit("deliveries").alias("measure"), "value"),
        ]
    )
    return checks.reconcile(base, derived, ["measure"])


def audit_reconcile(s: Source) -> DataFrame:
    """Every mart without a version attribute against the facts."""
    sales, orders = written(s.spark, s.sales()), written(s.spark, s.fact_order())
    found = audit.audit_totals(
        sales,
        orders,
        {
            "mart_daily_sales": marts.mart_daily_sales(sales),
            "mart_monthly_sales": marts.mart_monthly_sales(sales),
            "mart_customer_spend": marts.mart_customer_spend(sales),
            "mart_product_performance": marts.mart_product_performance(sales),
        },
        {
            "mart_payment_status": marts.mart_payment_status(orders),
            "mart_shipping_sla": marts.mart_shipping_sla(orders),
            "mart_customer_order_frequency": marts.mart_customer_order_frequency(orders),
        },
    )
    return found.select("table_name", "measure", F.col("expected").cast("double").alias("expected"), F.col("actual").cast("double").alias("actual"), "matches")


def kpi_audit(s: Source) -> DataFrame:
    found = audit.kpi_audit(s.sales(), s.fact_order())
    return found.withColumn("eligible_amount", F.col("eligible_amount").cast("double"))


def health_check(s: Source) -> DataFrame:
    sales, orders = written(s.spark, s.sales()), written(s.spark, s.fact_order())
    found = audit.health_check(audit.kpi_audit(sales, orders), measures(sales, orders))
    return found.select("measure", F.col("expected").cast("double").alias("expected"), F.col("actual").cast("double").alias("actual"), "matches")


def increment_diagnostics(s: Source) -> DataFrame:
    """Rows changed since the committed bound, their broken references and dirty values."""
    changed = watermark_slice(s.raw_lines(), "l_shipdate", BOUNDARY).select(
        *LINE_KEY, F.col("l_partkey").alias("product_id"), F.to_date("l_shipdate").alias("ship_date"), "l_quantity"
    )
    flagged = changed.join(s.headers().select("order_id", "customer_id", "order_date", "registered"), "order_id", "left")
    products = s.products().withColumn("product_known", F.lit(True))
    rules = {
        "unknown_order": F.col("order_date").isNull(),
        "unknown_customer": F.col("registered").isNotNull() & ~F.col("registered"),
        "unknown_product": F.col("product_known").isNull(),
        "ship_before_order": R.soft_date_defect(F.col("order_date"), F.col("ship_date")),
        "no_quantity": F.col("l_quantity") <= 0,
    }
    return checks.rule_counts(flagged.join(products, "product_id", "left"), rules, object_name="sales_order_line")


def order_identity(s: Source) -> DataFrame:
    """Orders whose raw lines disagree; product and ship date stand in for the customer and order date
    that the given lines do not carry."""
    lines = s.raw_lines().select("order_id", F.col("l_partkey").alias("product_id"), F.to_date("l_shipdate").alias("ship_date"))
    return checks.inconsistent_orders(lines, "order_id", ["product_id", "ship_date"])


# -- the whole path ------------------------------------------------------------------------------


def published_daily_sales(s: Source) -> DataFrame:
    """Two Bronze loads, two Silver increments, one audited publication; the served daily mart."""
    return run_in_shared_dir(s, [BOUNDARY, None], FULL_YEARS).read("mart_daily_sales")


def published_shipping_sla(s: Source) -> DataFrame:
    return run_in_shared_dir(s, [None], FULL_YEARS).read("mart_shipping_sla")


def published_fact_sales(s: Source) -> DataFrame:
    """Lines of the served fact after three increments, each of which rewrites only the months it touches."""
    facts = run_in_shared_dir(s, [BOUNDARY, SECOND_BOUNDARY, None], FULL_YEARS).read("fact_sales")
    return facts.select(
        "sales_id", "order_id", "customer_id", "product_id", "order_date", "ship_date", "due_date", "quantity",
        F.col("amount").cast("double").alias("amount"), "region", "category", "zone", "soft_date", "line_eligible",
    )


def replay_idempotence(s: Source) -> DataFrame:
    return replay_evidence(s, [BOUNDARY, None])


def baseline_equals_increments(s: Source) -> DataFrame:
    return baseline_evidence(s, [BOUNDARY, SECOND_BOUNDARY, None])


# -- text and files ------------------------------------------------------------------------------


def secret_scan(s: Source) -> DataFrame:
    return textscan.secret_scan(s.table("documents"), "doc_id", "text", [*P.SECRET_RULES, P.HEX_TOKEN_RULE])


def link_integrity(s: Source) -> DataFrame:
    """Local links, seen from their page, that lead to none of the pages."""
    pages = s.table("pages").select("page_id", "html", textscan.url_path(F.col("url")).alias("path"))
    links = textscan.local_links(pages.withColumn("page", F.struct("page_id", "path")), "page", "html", P.HTML_LINK)
    linked = links.select("page.page_id", "link", "target", textscan.address(F.col("page.path"), F.col("target")).alias("address"))
    known = pages.select(textscan.address(F.col("path"), F.col("path")).alias("address"))
    return textscan.dead_links(linked, known, "address").select("page_id", "link", "target")


def link_targets(s: Source) -> DataFrame:
    """Local links that do resolve, by first path element of the pages they could mean."""
    pages = s.table("pages")
    links = textscan.local_links(pages, "page_id", "html", P.HTML_LINK)
    sections = pages.select(F.concat(F.lit("/"), F.split(textscan.url_path(F.col("url")), "/")[1]).alias("target"))
    dead = textscan.dead_links(links, sections)
    return links.groupBy("target").agg(F.count(F.lit(1)).alias("links")).join(
        dead.groupBy("target").agg(F.count(F.lit(1)).alias("dead")), "target", "left"
    ).select("target", "links", F.coalesce("dead", F.lit(0)).alias("dead"))


def file_rules(s: Source) -> DataFrame:
    """Pages as a file inventory under a policy that some of them break."""
    inventory = s.table("pages").select(
        "page_id", textscan.url_path(F.col("url")).alias("path"), F.octet_length("html").cast("bigint").alias("length")
    )
    return textscan.file_rules(inventory, P.FilePolicy(["es"], [".html"], 10_000))


QUERIES: dict[str, Query] = {
    "dedup_lines": dedup_lines,
    "standardise_customer": standardise_customer,
    "soft_dq": soft_dq,
    "eligibility": eligibility,
    "soft_amount": soft_amount,
    "version_keys": version_keys,
    "event_delay": event_delay,
    "delivery_days": delivery_days,
    "hard_dq_anti": hard_dq_anti,
    "snapshot_diff": snapshot_diff_customers,
    "scd2_customer": scd2_customer,
    "scd2_product": scd2_product,
    "scd2_location": scd2_location,
    "scd2_status": scd2_status,
    "scd2_late_insert": scd2_late_insert,
    "reference_asof": reference_asof,
    "geo_enrichment": geo_enrichment,
    "asof_customer": asof_customer,
    "asof_product": asof_product,
    "asof_status": asof_status,
    "current_status": current_status_by_entity,
    "fact_sales": fact_sales,
    "fact_order": fact_order,
    "mart_daily_sales": mart_daily_sales,
    "mart_monthly_sales": mart_monthly_sales,
    "mart_customer_spend": mart_customer_spend,
    "mart_product_performance": mart_product_performance,
    "mart_category_performance": mart_category_performance,
    "mart_geography_sales": mart_geography_sales,
    "mart_sales_yoy": mart_sales_yoy,
    "mart_order_lifecycle": mart_order_lifecycle,
    "mart_shipping_sla": mart_shipping_sla,
    "mart_payment_status": mart_payment_status,
    "mart_customer_order_frequency": mart_customer_order_frequency,
    "measures_all": measures_all,
    "measures_by_year": measures_by_year,
    "measures_by_location": measures_by_location,
    "prior_year": prior_year,
    "watermark_slice": increment_slice,
    "upsert_correction": upsert_correction,
    "classify_transition": classify_transition,
    "reject_reprocess": reject_reprocess,
    "copy_counts": copy_counts,
    "quality_history": quality_history,
    "contract_drift": contract_drift,
    "audit_grain": audit_grain,
    "audit_denominators": audit_denominators,
    "audit_reconcile": audit_reconcile,
    "kpi_audit": kpi_audit,
    "health_check": health_check,
    "increment_diagnostics": increment_diagnostics,
    "order_identity": order_identity,
    "secret_scan": secret_scan,
    "link_integrity": link_integrity,
    "link_targets": link_targets,
    "file_rules": file_rules,
    "published_daily_sales": published_daily_sales,
    "published_shipping_sla": published_shipping_sla,
    "published_fact_sales": published_fact_sales,
    "replay_idempotence": replay_idempotence,
    "baseline_equals_increments": baseline_equals_increments,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query(Source(tune(spark), sf_dir))

    return {name: bind(query) for name, query in QUERIES.items()}
