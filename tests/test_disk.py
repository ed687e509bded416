"""What a run leaves on disk and how often it moves or computes its rows."""

import os
import random
from datetime import date, datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from millrace.operators.asof import Dimension, asof_join_all, date_range, period_for
from millrace.operators.dedup import merge_unique, upsert
from millrace.operators.enrich import days_between, snapshot_enrich
from millrace.plans.binding import Source
from millrace.plans.pipeline import digests, source_object
from millrace.session import shared_dir
from millrace.sources import bronze
from tests.lakehouse import Lakehouse, at, day, line
from tests.test_incremental import lines_only

pytestmark = pytest.mark.usefixtures("few_partitions")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffle_files_go_with_their_execution(spark, tmp_path):
    held = shuffle_files(spark)
    counted = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    counted.write.parquet(str(tmp_path / "out"))
    assert shuffle_files(spark) <= held
    assert counted.count() == counted.count() == 10


def test_an_increment_leaves_no_scratch(spark, tmp_path):
    house = Lakehouse(spark, str(tmp_path))

    def staged():
        return {name for name in os.listdir(shared_dir(spark)) if name.startswith("stage-")}

    before = staged()
    for loaded in (1, 2):
        house.arrive("sales_order_line", [line(1, 1, 1, day(loaded, 1), 1, "9.00", "9.00", at(6, loaded))])
        house.run(lines_only)
    assert staged() <= before
    assert [r.order_date for r in house.silver.read("lines").collect()] == [day(2, 1)]


def test_a_source_is_computed_once_per_bound_and_copy(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(row):
        seen.add(1)
        return row

    rows = spark.sparkContext.parallelize([(i, datetime(2026, 1, 1)) for i in range(5)], 1).map(count)
    source = spark.createDataFrame(rows, "id bigint, stamp timestamp_ntz")
    fact = Row(object_name="fact", strategy=bronze.WATERMARK, stamp="stamp")
    assert bronze.ingest(spark, str(tmp_path), fact, source)
    assert seen.value == 10
    assert [r.row_count for r in bronze.manifests(spark, str(tmp_path)).collect()] == [5]


def test_lines_are_landed_without_the_customers(spark, sf_small):
    read = {path.rsplit("/", 1)[1] for path in source_object(Source(spark, sf_small), "sales_order_line").inputFiles()}
    assert read == {"lineitem.parquet", "orders.parquet"}


def test_a_merge_within_months_moves_each_row_once(spark):
    rnd = random.Random(3)
    homes = [rnd.choice(["2026-01", "2026-02", "undated"]) for _ in range(90)]

    def side(keys):
        rows = [(k, rnd.choice([None, 1, 2]), rnd.choice([None, "a", "b"]), homes[k or 0]) for k in keys]
        return spark.createDataFrame(rows, "k bigint, at int, name string, home string")

    target, source = side([None, *range(1, 60)]), side([None, *range(30, 90)])
    merged, want = merge_unique(target, source, ["k"], ["at"], ["home"]), upsert(target, source, ["k"], ["at"])
    assert plan_of(merged).count("Exchange hashpartitioning") == 1
    assert merged.columns == want.columns
    assert sorted(map(str, merged.collect())) == sorted(map(str, want.collect()))


def test_facts_are_not_moved_by_date(spark):
    facts = spark.createDataFrame([(1, date(2026, 1, 5), "P1"), (2, date(2026, 3, 1), "P1"), (3, None, "P1"), (4, date(2025, 1, 1), "P1")], "id int, order_date date, postal_key string")
    zones = spark.sql("SELECT * FROM VALUES ('P1', date'2026-01-01', 'Z1'), ('P1', date'2026-02-01', 'Z2') AS z (postal_key, as_of, zone)")
    args = zones, "postal_key", "as_of", "order_date", ["zone"]
    plain, dated = snapshot_enrich(facts, *args), snapshot_enrich(facts, *args, days=days_between(facts, "order_date"))
    assert {r.id: r.zone for r in dated.collect()} == {1: "Z1", 2: "Z2", 3: None, 4: None}
    assert sorted(map(str, plain.collect())) == sorted(map(str, dated.collect()))
    assert "hashpartitioning(order_date" in plan_of(plain) and "hashpartitioning(order_date" not in plan_of(dated)
    none = facts.where("false")
    assert snapshot_enrich(none, *args, days=days_between(none, "order_date")).count() == 0


def test_few_versions_are_not_spread_over_years(spark):
    history = spark.sql("SELECT * FROM VALUES (1L, date'1990-01-01', date'2001-05-01', 'a'), (1L, date'2001-05-01', null, 'b'), (2L, date'1995-01-01', null, 'c') AS h (e, valid_from, valid_to, v)")
    facts = spark.sql("SELECT e, date_add(date'1994-06-01', cast(d AS int) * 97) AS order_date FROM range(40) r (d) CROSS JOIN (SELECT explode(array(1L, 2L, 3L, null)) AS e)")
    months = date_range(facts, "order_date")
    take = {"v": "v", "valid_from": "since"}
    alone, yearly = (sorted(map(str, asof_join_all(facts, [Dimension(history, "e", take, period=p)], months).collect())) for p in (None, "year"))
    assert alone == yearly and len(alone) == 160
    many = spark.sql("SELECT 1L AS e, date_add(date'2000-01-01', cast(id AS int)) AS valid_from FROM range(32)")
    assert (period_for(history, "e"), period_for(many, "e"), period_for(history.limit(0), "e")) == (None, "year", None)


def test_digests_tell_nulls_and_values_apart(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, null, array('a')), (null, 1, array('a')), (1, null, array('b')), (1, null, array('a')), (1, null, null) AS t (a, b, c)")
    assert digests(rows).distinct().count() == 4
