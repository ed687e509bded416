"""Cases the golden fixture does not reach: transitions, staggered files, crashes and overlaps."""

import random
from decimal import Decimal
from functools import partial

import pytest
from pyspark.sql import functions as F

from millrace.operators.dedup import merge_unique, upsert
from millrace.plans import gold
from millrace.plans.binding import Source
from millrace.plans.gold import AuditFailed, SchemaMismatch
from millrace.plans.measures import measures, prior_year_dates
from millrace.plans.pipeline import source_object
from millrace.plans.retail import SALES_COLUMNS, conform
from millrace.sources import bronze
from millrace.streaming import monthly
from millrace.streaming.monthly import merge_by_month
from tests.lakehouse import (
    BASELINE_LINES,
    CUSTOMER,
    CUSTOMER_JAN,
    CUSTOMER_MAR,
    PRODUCT_MAR,
    SALES,
    SCHEMAS,
    Lakehouse,
    at,
    day,
    line,
    load_baseline,
)

pytestmark = pytest.mark.usefixtures("few_partitions")


@pytest.fixture
def house(spark, tmp_path):
    return Lakehouse(spark, str(tmp_path))


def test_classification_transitions(house):
    """Reject to accept when the customer arrives, accept to reject by a correction, and a stale copy."""
    load_baseline(house)
    house.arrive("sales_order_line", [line(6, 5, 999, day(3, 12), 1, "5.00", "5.00", at(3, 12))])
    house.run()
    assert set(house.rejected()) == {6}

    house.arrive("customer_master", [CUSTOMER_JAN, (999, "Bob", "east", "P1", at(3, 1))])
    house.arrive("sales_order_line", [line(2, 1, 998, day(1, 10), 1, "50.00", "50.00", at(3, 13))])
    house.run()
    assert set(house.accepted()) == {1, 6}
    assert set(house.rejected()) == {2}
    assert house.accepted()[6].region == "east"

    moves = {(r.sales_id, r.from_class, r.to_class) for r in house.silver.read("classification_history").collect()}
    assert moves == {
        (1, None, "ACCEPTED"),
        (2, None, "ACCEPTED"),
        (6, None, "REJECTED"),
        (6, "REJECTED", "ACCEPTED"),
        (2, "ACCEPTED", "REJECTED"),
    }

    # A batch committed late carries an older copy of line 1; the newer one stays.
    stale = house.spark.createDataFrame([line(1, 1, 1, day(1, 10), 1, "99.00", "99.00", at(1, 5))], SALES)
    commit_by_hand(house, "late", stale, "2026-01-05 12:00:00")
    house.run()
    assert house.accepted()[1].amount == Decimal("100.00")


def commit_by_hand(house, batch, rows, upper):
    landed = bronze.land(house.spark, house.root, "sales_order_line", batch, rows)
    bronze.commit(house.spark, house.root, batch, "sales_order_line", bronze.WATERMARK, None, upper, landed)


def test_late_dimension_version_moves_existing_facts(house):
    load_baseline(house)
    house.arrive("sales_order_line", [line(3, 2, 1, day(2, 20), 1, "30.00", "30.00", at(3, 12))])
    house.run()
    assert house.accepted()[3].region == "north"
    snapshot = house.spark.createDataFrame([(1, "Ada", "west", "P3", at(2, 1))], CUSTOMER)
    landed = bronze.land(house.spark, house.root, "customer_master", "february", snapshot)
    bronze.commit(house.spark, house.root, "february", "customer_master", bronze.SNAPSHOT, None, "2026-02-01 12:00:00", landed)
    house.run()
    lines = house.accepted()
    assert (lines[1].region, lines[3].region) == ("north", "west")
    versions = sorted((r.valid_from, r.valid_to) for r in house.silver.read("customer_history").collect())
    assert versions == [(day(1, 1), day(2, 1)), (day(2, 1), None)]


def lines_only(inc):
    """The smallest transform: current lines by key."""
    arrived = inc.arrived("sales_order_line").select(*SALES_COLUMNS)
    return merge_by_month(inc, "lines", SALES, "sales_id", "order_date", arrived, ["dwh_load_ts"])[2]


def stored(house):
    return sorted(r.sales_id for r in house.silver.read("lines").collect())


def test_interrupted_run_and_overlapping_commit(house):
    """A crash after the state was published replays to the same state; later commits wait their turn."""
    house.arrive("sales_order_line", BASELINE_LINES)
    publish = house.silver.publish

    def crash(*args, **kwargs):
        publish(*args, **kwargs)
        raise RuntimeError("lost driver")

    house.silver.publish = crash
    with pytest.raises(Exception, match="lost driver"):
        house.run(lines_only)
    house.silver.publish = publish
    assert house.silver.version() == 1
    assert house.run(lines_only) == 1
    assert stored(house) == [1, 2]

    def overlapped(inc):
        # Committed while the run is under way, with a stamp older than anything taken in so far.
        early = house.spark.createDataFrame([line(8, 8, 1, day(1, 9), 1, "8.00", "8.00", at(1, 2))], SALES)
        commit_by_hand(house, "overlap", early, "2026-01-02 12:00:00")
        return lines_only(inc)

    house.arrive("sales_order_line", [line(7, 7, 1, day(1, 11), 1, "7.00", "7.00", at(1, 11))])
    house.run(overlapped)
    assert stored(house) == [1, 2, 7]
    house.run(lines_only)
    assert stored(house) == [1, 2, 7, 8]


def months_of(house, table="lines"):
    return house.silver.snapshot().parts[table]


def test_an_increment_leaves_other_months_unwritten(house):
    house.arrive("sales_order_line", [line(i, i, 1, day(m, 10), 1, "9.00", "9.00", at(4, 1)) for i, m in ((1, 1), (2, 1), (3, 2), (4, 3))])
    house.run(lines_only)
    assert months_of(house) == {"2026-01": 1, "2026-02": 1, "2026-03": 1}

    # A new line in March and one without a date: nothing else is written.
    house.arrive("sales_order_line", [line(5, 5, 1, day(3, 11), 1, "9.00", "9.00", at(4, 2)), line(6, 6, 1, None, 1, "9.00", "9.00", at(4, 2))])
    house.run(lines_only)
    assert months_of(house) == {"2026-01": 1, "2026-02": 1, "2026-03": 2, "undated": 2}

    # The only line of February moves to January, and the undated one gets a date: their old months are gone.
    house.arrive("sales_order_line", [line(3, 3, 1, day(1, 30), 1, "9.00", "9.00", at(4, 3)), line(6, 6, 1, day(3, 1), 1, "9.00", "9.00", at(4, 3))])
    house.run(lines_only)
    assert months_of(house) == {"2026-01": 3, "2026-03": 3}
    assert stored(house) == [1, 2, 3, 4, 5, 6]
    assert {r.sales_id for r in house.silver.read("lines", as_of=2).where("order_date IS NULL OR month(order_date) = 2").collect()} == {3, 6}

    # An older copy that names another month changes no row and leaves the line where it is.
    stale = house.spark.createDataFrame([line(3, 3, 1, day(5, 5), 1, "1.00", "1.00", at(1, 1))], SALES)
    commit_by_hand(house, "stale", stale, "2026-01-01 12:00:00")
    house.run(lines_only)
    assert stored(house) == [1, 2, 3, 4, 5, 6] and "2026-05" not in months_of(house)
    places = {r.sales_id: r.month for r in monthly._newest(house.silver.read("lines_places"), "sales_id").collect()}
    assert places == {1: "2026-01", 2: "2026-01", 3: "2026-01", 4: "2026-03", 5: "2026-03", 6: "2026-03"}


def test_places_are_written_as_one_after_many_increments(house, monkeypatch):
    monkeypatch.setattr(monthly, "PLACE_PARTS", 2)
    for i in range(1, 5):
        moving = line(1, 1, 1, day(i, 1), 1, "9.00", "9.00", at(6, i))
        house.arrive("sales_order_line", [moving, line(10 + i, 1, 1, day(i, 2), 1, "9.00", "9.00", at(6, i))])
        house.run(lines_only)
        assert stored(house) == [1, *range(11, 11 + i)]
        assert len(months_of(house, "lines_places")) <= 2
    assert {r.sales_id: r.month for r in monthly._newest(house.silver.read("lines_places"), "sales_id").collect()}[1] == "2026-04"


def test_rows_with_new_keys_are_not_matched(house, monkeypatch):
    """A first load, an increment of new keys and a rebuild only deal rows to their months; a known key is matched."""
    matched = []
    merge = monthly.merge_unique
    monkeypatch.setattr(monthly, "merge_unique", lambda *a: matched.append(1) or merge(*a))
    house.arrive("sales_order_line", [line(i, i, 1, day(1, i), 1, "9.00", "9.00", at(6, 1)) for i in (1, 2)])
    house.run(lines_only)
    house.arrive("sales_order_line", [line(3, 3, 1, day(1, 3), 1, "9.00", "9.00", at(6, 2))])
    house.run(lines_only)
    assert matched == [] and stored(house) == [1, 2, 3]
    house.arrive("sales_order_line", [line(3, 3, 1, day(2, 3), 1, "9.00", "9.00", at(6, 3))])
    house.run(lines_only)
    assert matched == [1] and stored(house) == [1, 2, 3]
    house.run(lines_only, mode="baseline")
    assert matched == [1] and stored(house) == [1, 2, 3] and set(months_of(house)) == {"2026-01", "2026-02"}


def test_merge_of_unique_sides_equals_the_upsert(spark):
    rnd = random.Random(7)

    def side(keys):
        rows = [(k, rnd.choice([None, 1, 2]), rnd.choice([None, "a", "b"]), rnd.choice([None, [], ["x"], ["x", "y"]])) for k in keys]
        return spark.createDataFrame(rows, "k bigint, at int, name string, rules array<string>")

    target, source = side([None, *range(60)]), side([None, *range(30, 90)])
    merged, want = (f(target, source, ["k"], ["at"]) for f in (merge_unique, upsert))
    assert merged.columns == want.columns
    assert sorted(map(str, merged.collect())) == sorted(map(str, want.collect()))


def test_lines_without_a_key_count_as_one(house):
    house.arrive("sales_order_line", [line(None, 1, 1, day(1, 1), 1, "9.00", "9.00", at(6, 1)), line(1, 1, 1, day(1, 1), 1, "9.00", "9.00", at(6, 1))])
    house.run(lines_only)
    house.arrive("sales_order_line", [line(None, 1, 1, day(2, 1), 1, "8.00", "8.00", at(6, 2))])
    house.run(lines_only)
    assert {(r.sales_id, r.order_date) for r in house.silver.read("lines").collect()} == {(None, day(2, 1)), (1, day(1, 1))}


def test_failing_transform_changes_nothing(house):
    house.arrive("sales_order_line", BASELINE_LINES)

    def failing(inc):
        lines_only(inc)
        inc.spark.sql("SELECT 1/0").collect()

    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        house.run(failing)
    assert house.silver.version() == 0
    house.run(lines_only)
    assert house.silver.version() == 1 and stored(house) == [1, 2]


def test_reference_loaded_again_for_the_same_date(house):
    """The newer load counts, and a rebuild gives what the increments gave."""
    load_baseline(house)
    house.arrive("geography", [("P1", "York", "UK", day(1, 1), at(1, 1))])
    house.run()
    house.arrive("geography", [("P1", "Bath", "UK", day(1, 1), at(1, 2))])
    house.run()
    assert house.publish() == 1
    cities = {r.city for r in house.gold.read("fact_sales").collect()}
    house.run(mode="baseline")
    house.publish()
    assert cities == {r.city for r in house.gold.read("fact_sales").collect()} == {"Bath"}


def test_masters_that_start_after_the_first_orders(house):
    house.arrive("customer_master", [CUSTOMER_MAR])
    house.arrive("product_master", [PRODUCT_MAR])
    house.arrive("sales_order_line", BASELINE_LINES)
    house.run(partial(conform, open_first="1900-01-01"))
    assert {r.region for r in house.accepted().values()} == {"south"} and len(house.accepted()) == 2


def test_gold_is_refused_or_published_whole(house, monkeypatch):
    """A failed audit or a changed schema leaves the served version in place."""
    load_baseline(house)
    house.arrive("geography", [("P1", "York", "UK", day(1, 1), at(1, 1))])
    # Zones arrive later than the orders they would describe.
    house.arrive("delivery_zones", [("P1", "Z1", day(1, 11), at(1, 11))])
    house.arrive("sales_order_line", [line(9, 9, 1, day(1, 12), 1, "9.00", "9.00", at(1, 12))])
    house.run()
    assert house.publish() == 1
    facts = {r.sales_id: (r.city, r.zone) for r in house.gold.read("fact_sales").collect()}
    assert facts == {1: ("York", None), 2: ("York", None), 9: ("York", "Z1")}
    served = house.gold.read("kpi_audit").first()

    with monkeypatch.context() as m:
        build = gold.fact_order
        m.setattr(gold, "fact_order", lambda sales, silver: build(sales, silver).unionAll(build(sales, silver)))
        with pytest.raises(AuditFailed, match="fact_order"):
            house.publish()
    with monkeypatch.context() as m:
        build = gold.fact_sales
        m.setattr(gold, "fact_sales", lambda *a: build(*a).withColumn("extra", F.lit(1)))
        with pytest.raises(SchemaMismatch, match="fact_sales"):
            house.publish()
    assert house.gold.version() == 1
    assert house.gold.read("kpi_audit").first() == served

    assert house.publish(initial_history="1900-01-01") == 2
    facts = {r.sales_id: (r.city, r.zone) for r in house.gold.read("fact_sales").collect()}
    assert facts == {1: ("York", "Z1"), 2: ("York", "Z1"), 9: ("York", "Z1")}
    assert {r.zone for r in house.gold.read("fact_sales", as_of=1).collect()} == {None, "Z1"}


def test_leap_day_counts_once(spark):
    sales = spark.sql(
        "SELECT date'2019-02-28' AS order_date, 10.00BD AS amount, 1L AS quantity, true AS line_eligible"
        " UNION ALL SELECT date'2020-02-29', 5.00BD, 1L, true"
    )
    orders = spark.sql(
        "SELECT date'2020-02-29' AS order_date, true AS order_eligible, 5.00BD AS booked, 'X' AS order_status,"
        " true AS ship_eligible, true AS on_time, 'PAID' AS payment_status"
    )
    dates = spark.sql("SELECT explode(sequence(date'2020-02-28', date'2020-02-29')) AS order_date")
    assert prior_year_dates(dates).count() == 1
    row = measures(sales, orders, dates=dates).first()
    assert (row.gross_booked_sales, row.prior_year_gross_booked_sales, row.gross_booked_sales_yoy) == (5.0, 10.0, -0.5)
    assert measures(sales, orders).first().prior_year_gross_booked_sales is None


def test_all_customers_are_landed_and_the_flag_rejects(house, sf_small, monkeypatch):
    given = Source(house.spark, sf_small)
    landed = source_object(given, "customer_master")
    assert landed.count() == given.table("customer").count()
    want = {r.customer_id for r in given.customers().where("not registered").collect()}
    assert want == {r.customer_id for r in landed.where("not registered").collect()} and want

    load_baseline(house)  # a source without the column states nothing
    house.arrive("sales_order_line", [line(7, 6, 2, day(1, 10), 1, "5.00", "5.00", at(3, 1)), line(8, 7, 2, day(3, 10), 1, "6.00", "6.00", at(3, 10))])
    monkeypatch.setitem(SCHEMAS, "customer_master", (f"{CUSTOMER}, registered boolean", bronze.SNAPSHOT))
    house.arrive("customer_master", [(1, "Ada", "north", "P1", at(1, 1), True), (2, "Cy", "east", "P1", at(1, 1), False)])
    house.run()
    assert set(house.accepted()) == {1, 2}
    assert {k: r.failed_rules for k, r in house.rejected().items()} == {7: ["unknown_customer"], 8: ["unknown_customer"]}

    house.arrive("customer_master", [(1, "Ada", "north", "P1", at(3, 1), True), (2, "Cy", "east", "P1", at(3, 1), True)])
    house.run()
    assert set(house.accepted()) == {1, 2, 8} and set(house.rejected()) == {7}
