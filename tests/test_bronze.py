"""Landing, bounds, contracts, readers and the publish log."""

from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import sized_for
from millrace.sources import bronze
from millrace.sources.contracts import ContractError, check_contract
from millrace.sources.files import file_inventory
from millrace.sources.readers import CORRUPT, jdbc_options, read_csv, read_reference_csv
from millrace.sources.tables import TableStore

pytestmark = pytest.mark.usefixtures("few_partitions")

SCHEMA = "id bigint, value string, stamp timestamp_ntz"
FACT = Row(object_name="fact", strategy=bronze.WATERMARK, stamp="stamp")


def rows(spark, *pairs):
    return spark.createDataFrame([(i, f"v{i}", datetime(2026, 1, d)) for i, d in pairs], SCHEMA)


def test_increments_commit_and_prune(spark, tmp_path):
    root = str(tmp_path)
    assert bronze.ingest(spark, root, FACT, rows(spark)) is None
    first = bronze.ingest(spark, root, FACT, rows(spark, (1, 1), (2, 2)))
    assert bronze.ingest(spark, root, FACT, rows(spark, (1, 1), (2, 2))) is None
    second = bronze.ingest(spark, root, FACT, rows(spark, (1, 1), (2, 2), (3, 3)))
    assert first != second
    log = {r.batch_id: r for r in bronze.manifests(spark, root).collect()}
    assert (log[first].row_count, log[second].row_count) == (2, 1)
    assert bronze.committed_bound(spark, root, "fact") == "2026-01-03 00:00:00"

    landed = bronze.committed_batches(spark, root, "fact", [second])
    assert [(r.id, r.batch_id, r.source_object) for r in landed.collect()] == [(3, second, "fact")]
    assert set(bronze.LINEAGE) <= set(landed.columns)
    assert bronze.committed_batches(spark, root, "fact", ["unknown"]) is None


def test_rows_that_show_up_late_are_landed_once(spark, tmp_path):
    """On the bound itself without an overlap, below it with one, and also when nothing newer came."""
    root = str(tmp_path)
    bronze.ingest(spark, root, FACT, rows(spark, (1, 1), (2, 2)))
    late = bronze.ingest(spark, root, FACT, rows(spark, (1, 1), (2, 2), (3, 2), (4, 1)))
    assert [r.id for r in bronze.committed_batches(spark, root, "fact", [late]).collect()] == [3]
    assert bronze.ingest(spark, root, FACT, rows(spark, (1, 1), (2, 2), (3, 2))) is None
    window = bronze.ingest(spark, root, FACT, rows(spark, (1, 1), (2, 2), (3, 2), (3, 2), (4, 1)), overlap_seconds=5 * 86400)
    assert sorted(r.id for r in bronze.committed_batches(spark, root, "fact", [window]).collect()) == [3, 4]
    newer = bronze.ingest(spark, root, FACT, rows(spark, (2, 2), (5, 2), (6, 3)), overlap_seconds=86400)
    assert sorted(r.id for r in bronze.committed_batches(spark, root, "fact", [newer]).collect()) == [5, 6]
    assert len({late, window, newer}) == 3


def test_changed_snapshot_with_the_same_stamp_is_loaded(spark, tmp_path):
    root = str(tmp_path)
    master = Row(object_name="master", strategy=bronze.SNAPSHOT, stamp="stamp")
    batches = [bronze.ingest(spark, root, master, rows(spark, *state)) for state in ([(1, 1), (2, 1)], [(1, 1)], [(2, 1), (1, 1)])]
    assert len(set(batches)) == 3 and None not in batches
    assert bronze.ingest(spark, root, master, rows(spark, (1, 1), (2, 1))) is None
    assert [bronze.committed_batches(spark, root, "master", [b]).count() for b in batches] == [2, 1, 2]


def test_failed_copy_keeps_the_checkpoint_and_retry_replaces_the_batch(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    bronze.ingest(spark, root, FACT, rows(spark, (1, 1)))
    source = rows(spark, (1, 1), (2, 2), (3, 3))
    with monkeypatch.context() as m:
        m.setattr(bronze, "land", lambda *a: _partial(*a))
        with pytest.raises(bronze.CopyMismatch):
            bronze.ingest(spark, root, FACT, source)
    assert bronze.committed_bound(spark, root, "fact") == "2026-01-01 00:00:00"
    assert bronze.manifests(spark, root).count() == 1

    # The retry sees a newer upper bound, yet lands on the same batch because its lower bound is the same.
    batch = bronze.ingest(spark, root, FACT, source.unionByName(rows(spark, (4, 4))))
    landed = bronze.committed_batches(spark, root, "fact", [batch])
    assert sorted(r.id for r in landed.collect()) == [2, 3, 4]
    assert spark.read.parquet(f"{root}/bronze/fact").count() == 4


_land = bronze.land


def _partial(spark, root, name, batch, data):
    return _land(spark, root, name, batch, data.where("id < 3"))


def test_snapshots_are_kept_side_by_side(spark, tmp_path):
    root = str(tmp_path)
    master = Row(object_name="master", strategy=bronze.SNAPSHOT, stamp="stamp")
    first = bronze.ingest(spark, root, master, rows(spark, (1, 1), (2, 1)))
    assert bronze.ingest(spark, root, master, rows(spark, (1, 1), (2, 1))) is None
    second = bronze.ingest(spark, root, master, rows(spark, (1, 2)))
    both = bronze.committed_batches(spark, root, "master", [first, second])
    assert both.groupBy("batch_id").count().count() == 2 and both.count() == 3


def test_configured_objects_are_routed_by_kind_and_strategy(spark, tmp_path):
    root = str(tmp_path / "lake")
    rows(spark, (1, 1), (2, 2)).write.parquet(str(tmp_path / "facts"))
    (tmp_path / "ref.csv").write_text("id,value,stamp\n7,seven,2026-01-05 00:00:00\n")
    config = spark.createDataFrame(
        [
            (1003, "fact", "parquet", str(tmp_path / "facts"), bronze.WATERMARK, "stamp", {}, True),
            (2001, "reference", "csv", str(tmp_path / "ref.csv"), bronze.SNAPSHOT, "stamp", {"schema": SCHEMA}, True),
            (9999, "retired", "parquet", "nowhere", bronze.SNAPSHOT, "stamp", {}, False),
        ],
        bronze.CONFIG_SCHEMA,
    )
    readers = {
        "parquet": lambda s, o: s.read.parquet(o.location),
        "csv": lambda s, o: read_csv(s, o.location, o.options["schema"]).drop(CORRUPT),
    }
    done = bronze.run_objects(spark, root, config, readers)
    assert set(done) == {"fact", "reference"} and all(done.values())
    assert bronze.committed_batches(spark, root, "reference", [done["reference"]]).first().value == "seven"


def test_bounds_reach_the_scan(spark, sf_small):
    lines = spark.read.parquet(f"{sf_small}/lineitem.parquet").select("l_orderkey", "l_shipdate")
    plan = bronze.watermark_slice(lines, "l_shipdate", "1999-01-01")._jdf.queryExecution().toString()
    pushed = plan[plan.rindex("PushedFilters") :]
    assert "GreaterThan(l_shipdate,1999" in pushed and "LessThanOrEqual(l_shipdate" in pushed
    overlap = bronze.watermark_slice(lines, "l_shipdate", "1999-01-01", overlap_seconds=86400)
    assert overlap.agg(F.min("l_shipdate")).first()[0] <= datetime(1999, 1, 1)


def test_contract(spark, tmp_path):
    contract = T.StructType.fromDDL("id bigint, value string, stamp timestamp_ntz")
    observed = T.StructType.fromDDL("id int, value string, extra double")
    drift = {r.field: r.drift for r in check_contract(spark, observed, contract).collect()}
    assert drift == {"id": "CHANGED", "value": "SAME", "stamp": "MISSING", "extra": "ADDED"}

    root = str(tmp_path)
    wider = rows(spark, (1, 1)).withColumn("extra", F.lit(1.0))
    assert bronze.ingest(spark, root, FACT, wider, contract)
    with pytest.raises(ContractError, match="value: MISSING"):
        bronze.ingest(spark, root, FACT, rows(spark, (2, 2)).drop("value"), contract)
    events = spark.read.json(f"{root}/control/drift").collect()
    assert sorted((r.field, r.drift) for r in events) == [("extra", "ADDED"), ("value", "MISSING")]
    assert bronze.committed_bound(spark, root, "fact") == "2026-01-01 00:00:00"


def test_csv_keeps_bad_rows(spark, tmp_path):
    path = tmp_path / "cust_info.csv"
    path.write_text("id,name\n1,Ada\nx,Bob\n")
    found = {r.name: r for r in read_csv(spark, str(path), "id bigint, name string").collect()}
    assert found["Ada"][CORRUPT] is None and found["Bob"].id is None and found["Bob"][CORRUPT] == "x,Bob"
    stamped = read_reference_csv(spark, str(path), "id bigint, name string").first()
    assert stamped.source_file.endswith("cust_info.csv") and stamped.file_changed_at is not None


def test_inventory_does_not_read_content(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xff" * 10)
    files = file_inventory(spark, str(tmp_path))
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in files.collect()] == [("a.txt", 10)]
    assert "content" not in files.columns


def test_partition_sizes_follow_the_data():
    conf = sized_for(100 * 1024**4)
    assert conf["spark.sql.shuffle.partitions"] == str(400 * 1024)
    assert sized_for(1)["spark.sql.shuffle.partitions"] == "1"


def test_jdbc_options_split_the_read():
    options = jdbc_options("jdbc:postgresql://h/db", "sales", "dwh_load_ts", ("2026-01-01", "2026-02-01"), 16)
    assert options["numPartitions"] == "16" and options["partitionColumn"] == "dwh_load_ts"
    assert "numPartitions" not in jdbc_options("jdbc:postgresql://h/db", "sales")


def test_store_publishes_all_tables_at_once(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    dated = spark.range(100).withColumn("at", F.expr("date_add(date'2026-01-01', cast(id AS int))"))
    assert store.version() == 0 and store.read("t") is None and store.read("t", "id bigint").count() == 0
    one = store.write_months("t", dated, "at", 1) + store.write_whole("u", spark.range(3), 1)
    assert store.read("t") is None
    store.publish(1, one, ["b1"])
    assert (store.version(), store.read("t").count(), store.read("u").count()) == (1, 100, 3)
    assert store.snapshot().months("t") == ["2026-01", "2026-02", "2026-03", "2026-04"]

    kept = store.snapshot().read("t", months=["2026-01"]).where("id <> 0")
    two = store.write_months("t", kept, "at", 2, ["2026-01"])
    assert two == [(2, "part", "t", "2026-01")] and store.read("t").count() == 100
    store.publish(2, two, ["b2"])
    assert (store.read("t").count(), store.read("t", as_of=1).count()) == (99, 100)
    assert store.snapshot().batches == {"b1", "b2"}

    # A month that lost all its rows is gone, and may come back.
    gone = store.write_months("t", dated.where("false"), "at", 3, ["2026-02"])
    assert gone == [(3, "gone", "t", "2026-02")] and store.candidate("t", 3, "id bigint, at date").count() == 0
    store.publish(3, gone)
    assert store.read("t").where("month(at) = 2").count() == 0 and store.read("t").count() == 99 - 28
    store.publish(4, store.write_months("t", dated.where("id = 40"), "at", 4, ["2026-02"]))
    assert store.read("t").where("month(at) = 2").count() == 1

    store.publish(5, store.write_months("t", dated.limit(5), "at", 5), ["b3"], reset=True)
    assert (store.read("t").count(), store.read("u"), store.snapshot().batches) == (5, None, {"b3"})


@pytest.mark.parametrize("upper,lower,expected", [("2024-01-01 00:00:00", "2024-01-01", True), ("2024-01-01 00:00:00.5", "2024-01-01 00:00:00", False), ("2023-12-31", "2024-01-01 00:00:01", True)])
def test_bounds_are_compared_as_times(upper, lower, expected):
    assert bronze._not_after(upper, lower) is expected
