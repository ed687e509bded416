"""The as-of join by month: results of the resolved join and of plain Python, one read of the facts, hot entities."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from millrace.operators.asof import Dimension, asof_join, asof_join_all, by_month, date_range
from millrace.operators.history import scd2

START = date(2024, 1, 1)


def history_of(spark, seed, entities, name):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(entities), START + timedelta(rnd.randrange(400)), rnd.choice("abc")) for _ in range(entities * 6)]
    changes = spark.createDataFrame(rows, f"{name} bigint, changed_on date, state string")
    return scd2(changes, name, "changed_on", ["state"], tie=["state"], open_first="1900-01-01" if seed % 2 else None)


def facts_of(spark, seed, count=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(count):
        customer = 3 if i % 3 == 0 else rnd.choice([None, *range(12)])  # a third of the rows has one customer
        rows.append((i, customer, rnd.randrange(9), rnd.choice([None, *[START + timedelta(rnd.randrange(-40, 460)) for _ in range(9)]])))
    return spark.createDataFrame(rows, "id bigint, customer_id bigint, product_id bigint, order_date date")


def expected(facts, history, entity, column):
    versions = [r.asDict() for r in history.collect()]
    found = {}
    for f in facts.collect():
        own = [
            v["state"] for v in versions
            if f[entity] is not None and f.order_date is not None and v[entity] == f[entity]
            and v["valid_from"] <= f.order_date and (v["valid_to"] is None or f.order_date < v["valid_to"])
        ]
        assert len(own) <= 1
        found[f.id] = own[0] if own else None
    return found


def test_equals_plain_python_and_the_resolved_join(spark, few_partitions):
    facts = facts_of(spark, 1)
    customers, products = history_of(spark, 2, 12, "customer_id"), history_of(spark, 3, 9, "product_id")
    dimensions = [Dimension(customers, "customer_id", {"state": "tier", "valid_from": "since"}), Dimension(products, "product_id", {"state": "kind"})]
    joined = asof_join_all(facts, dimensions, date_range(facts, "order_date"))
    assert joined.columns == [*facts.columns, "tier", "since", "kind"]
    rows = joined.collect()
    assert len(rows) == facts.count()
    assert {r.id: r.tier for r in rows} == expected(facts, customers, "customer_id", "tier")
    assert {r.id: r.kind for r in rows} == expected(facts, products, "product_id", "kind")
    resolved = asof_join(facts, customers, "customer_id", "order_date", {"state": "tier"}).collect()
    assert {r.id: r.tier for r in rows} == {r.id: r.tier for r in resolved}


def test_facts_are_read_once_for_three_dimensions(spark, tmp_path, few_partitions):
    facts_of(spark, 5).withColumn("location_id", F.col("product_id")).write.parquet(f"{tmp_path}/facts")
    facts = spark.read.parquet(f"{tmp_path}/facts")
    dimensions = []
    for name, seed in (("customer_id", 2), ("product_id", 3), ("location_id", 4)):
        history_of(spark, seed, 12, name).write.parquet(f"{tmp_path}/{name}")
        dimensions.append(Dimension(spark.read.parquet(f"{tmp_path}/{name}"), name, {"state": f"{name}_state"}))
    spark.range(1).select(F.lit(START).alias("order_date")).write.parquet(f"{tmp_path}/days")
    months = date_range(spark.read.parquet(f"{tmp_path}/days"), "order_date")
    joined = asof_join_all(facts, dimensions, months)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    reads = [line for line in plan.splitlines() if "Relation" in line and "location_id" in line and "customer_id" in line]
    assert len(reads) == 1
    physical = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical
    assert joined.count() == facts.count()


def test_a_version_has_a_row_per_month_it_covers(spark, few_partitions):
    history = spark.createDataFrame(
        [(1, date(1900, 1, 1), date(2024, 2, 1)), (1, date(2024, 2, 1), date(2024, 2, 20)), (1, date(2024, 2, 20), None), (2, date(2030, 1, 1), None), (3, date(1990, 1, 1), date(1990, 2, 1))],
        "e bigint, valid_from date, valid_to date",
    )
    range_of = spark.createDataFrame([(date(2024, 1, 5),), (date(2024, 3, 9),)], "d date")
    rows = sorted((r.e, r.valid_from, r.month) for r in by_month(history, "e", [], date_range(range_of, "d")).collect())
    assert [(e, m.month) for e, _, m in rows] == [(1, 1), (1, 2), (1, 2), (1, 3)]


def test_years_pick_the_same_versions_with_fewer_rows(spark, few_partitions):
    facts, products = facts_of(spark, 1), history_of(spark, 3, 9, "product_id")
    months = date_range(facts, "order_date")
    take = {"state": "kind", "valid_from": "since"}
    by = {p: asof_join_all(facts, [Dimension(products, "product_id", take, period=p)], months) for p in ("month", "year")}
    assert sorted(map(str, by["year"].collect())) == sorted(map(str, by["month"].collect()))
    assert {r.id: r.kind for r in by["year"].collect()} == expected(facts, products, "product_id", "kind")
    spread = {p: by_month(products, "product_id", [], months, p).count() for p in ("month", "year")}
    assert products.count() <= spread["year"] <= products.count() + 2 * 9 < spread["month"]


def test_no_facts_and_no_versions(spark, few_partitions):
    none = facts_of(spark, 1, 0)
    some = facts_of(spark, 1, 20)
    history = history_of(spark, 2, 12, "customer_id")
    take = {"state": "tier"}
    assert asof_join_all(none, [Dimension(history, "customer_id", take)], date_range(none, "order_date")).count() == 0
    kept = asof_join_all(some, [Dimension(history.limit(0), "customer_id", take)], date_range(some, "order_date"))
    assert kept.where("tier is null").count() == 20
