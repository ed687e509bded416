"""Golden end-to-end acceptance: twelve named checks over Silver, then Gold and serving."""

from decimal import Decimal

import pytest

from millrace.plans import audit
from millrace.plans.measures import measures
from tests.lakehouse import Lakehouse, load_baseline, load_march

CHECKS = {
    "baseline",
    "correction",
    "late_line",
    "customer_history",
    "product_history",
    "asof_customer",
    "asof_product",
    "duplicate_arrival",
    "soft_dq",
    "hard_dq",
    "late_event",
    "replay",
}


@pytest.fixture(scope="module")
def house(spark, few_partitions, tmp_path_factory):
    return Lakehouse(spark, str(tmp_path_factory.mktemp("house")))


@pytest.fixture(scope="module")
def silver_checks(house):
    """Evidence of each check; a check that did not run is missing, not passed."""
    done = {}
    load_baseline(house)
    house.run()
    first = house.accepted()
    done["baseline"] = (len(first), sum(r.amount for r in first.values()), {r.order_id for r in first.values()}) == (2, Decimal("150.00"), {1})

    load_march(house)
    version = house.run()
    lines = house.accepted()
    done["correction"] = lines[1].amount == Decimal("110.00")
    done["late_line"] = 3 in lines and lines[3].customer_version == lines[2].customer_version
    customers = sorted(house.silver.read("customer_history").collect(), key=lambda r: r.valid_from)
    done["customer_history"] = [(r.region, r.is_current) for r in customers] == [("north", False), ("south", True)] and customers[0].valid_to == customers[1].valid_from
    products = sorted(house.silver.read("product_history").collect(), key=lambda r: r.valid_from)
    done["product_history"] = [r.category for r in products] == ["tools", "garden"]
    done["asof_customer"] = lines[3].region == "north" and lines[4].region == "south" and lines[4].customer_version == customers[1].version_key
    done["asof_product"] = lines[3].category == "tools" and lines[4].category == "garden"
    done["duplicate_arrival"] = lines[4].amount == Decimal("40.00")
    done["soft_dq"] = lines[5].soft_date and lines[5].soft_amount and not lines[5].line_eligible
    done["hard_dq"] = set(house.rejected()) == {6} and house.rejected()[6].failed_rules == ["unknown_customer"] and 6 not in lines
    events = {r.event_id: r for r in house.silver.read("order_status_event").collect()}
    done["late_event"] = events[12].event_ts < events[12].arrival_ts and events[12].delay_seconds == 39 * 86400
    before = house.classified()
    again = house.run(checkpoint=f"{house.root}/control/other_stream")
    done["replay"] = again == version and house.classified() == before
    return done


@pytest.mark.parametrize("check", sorted(CHECKS))
def test_silver_check(silver_checks, check):
    assert silver_checks[check] is True


def test_no_check_is_missing(silver_checks):
    assert set(silver_checks) == CHECKS


@pytest.fixture(scope="module")
def published(house, silver_checks):
    return house.publish()


def test_gold_totals(house, published):
    kpi = house.gold.read("kpi_audit").first()
    assert (kpi.fact_lines, kpi.fact_orders, kpi.eligible_lines) == (5, 4, 4)
    assert kpi.eligible_amount == Decimal("230.00")
    assert (kpi.eligible_orders, kpi.sla_deliveries) == (4, 2)


def test_measures_match_the_audit(house, published):
    row = measures(house.gold.read("fact_sales"), house.gold.read("fact_order"))
    m = row.first()
    assert (m.gross_booked_sales, m.sales_lines, m.eligible_orders, m.sla_eligible_deliveries) == (230.0, 4, 4, 2)
    assert (m.on_time_deliveries, m.returned_orders, m.cancelled_orders, m.paid_orders) == (1, 1, 1, 1)
    assert m.prior_year_gross_booked_sales is None
    health = audit.health_check(house.gold.read("kpi_audit"), row).collect()
    assert len(health) == 4 and all(r.matches for r in health)


def test_every_mart_is_published(house, published):
    for mart in (
        "mart_daily_sales mart_monthly_sales mart_customer_spend mart_product_performance mart_category_performance "
        "mart_geography_sales mart_sales_yoy mart_order_lifecycle mart_shipping_sla mart_payment_status mart_customer_order_frequency"
    ).split():
        assert house.gold.read(mart) is not None
    zones = {r.zone: r for r in house.gold.read("mart_shipping_sla").collect()}
    assert (zones["Z1"].deliveries, zones["Z1"].on_time_deliveries) == (2, 1)
    spend = house.gold.read("mart_customer_spend").collect()
    assert [(r.customer_id, r.spend) for r in spend] == [(1, 230.0)]
    by_category = {r.category: r.sales for r in house.gold.read("mart_category_performance").collect()}
    assert by_category == {"tools": 190.0, "garden": 40.0}


def test_rebuild_equals_increments(house, published):
    before = house.classified()
    house.run(mode="baseline")
    after = house.classified()
    assert {k: r.asDict() | {"silver_version": 0} for k, r in after.items()} == {
        k: r.asDict() | {"silver_version": 0} for k, r in before.items()
    }
