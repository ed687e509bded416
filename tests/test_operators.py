"""Operators against brute force in plain Python, on random and on skewed input."""

import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import patterns as P
from millrace.functions import rules as R
from millrace.operators import checks, textscan
from millrace.operators.asof import asof_join
from millrace.operators.dedup import latest_per_key
from millrace.operators.enrich import enrich, missing_references, with_presence
from millrace.operators.history import scd2, scd2_merge, snapshot_diff
from millrace.operators.status import current_status, event_fact
from millrace.plans import registry
from millrace.plans.binding import Source

pytestmark = pytest.mark.usefixtures("few_partitions")


def brute_scd2(changes):
    """changes: (entity, at, tie, value) -> (entity, value, from, to)."""
    newest = {}
    for entity, at, tie, value in changes:
        if (entity, at) not in newest or newest[entity, at] < (tie, value):
            newest[entity, at] = (tie, value)
    found = []
    for entity in {e for e, _ in newest}:
        versions = []
        for at in sorted(a for e, a in newest if e == entity):
            value = newest[entity, at][1]
            if not versions or versions[-1][0] != value:
                versions.append((value, at))
        for i, (value, at) in enumerate(versions):
            found.append((entity, value, at, versions[i + 1][1] if i + 1 < len(versions) else None))
    return set(found)


def random_changes(seed, instants, n=300):
    rnd = random.Random(seed)
    # One entity holds half of all rows.
    return [(0 if rnd.random() < 0.5 else rnd.randint(1, 6), rnd.choice(instants), i, rnd.choice("abc")) for i in range(n)]


DAYS = [date(2026, 1, 1) + timedelta(days=d) for d in range(60)]
MOMENTS = [datetime(2026, 1, 1) + timedelta(minutes=17 * m) for m in range(400)]


def test_scd2_by_day(spark):
    changes = random_changes(1, DAYS)
    df = spark.createDataFrame(changes, "e int, at date, tie int, v string")
    got = {(r.e, r.v, r.valid_from, r.valid_to) for r in scd2(df, "e", "at", ["v"], tie=["tie"]).collect()}
    assert got == brute_scd2(changes)
    opened = scd2(df, "e", "at", ["v"], tie=["tie"], open_first="1900-01-01")
    assert opened.where("valid_from = '1900-01-01'").count() == len({c[0] for c in changes})


def test_scd2_by_moment_runs_per_box_and_agrees(spark):
    changes = random_changes(2, MOMENTS, 600)
    df = spark.createDataFrame(changes, "e int, at timestamp_ntz, tie int, v string")
    for box in (60, 7, None):
        rows = scd2(df, "e", "at", ["v"], tie=["tie"], box_minutes=box).collect()
        assert {(r.e, r.v, r.valid_from, r.valid_to) for r in rows} == brute_scd2(changes)
        assert len(rows) == len({(r.e, r.version_key) for r in rows})


def test_null_states_are_versions_too(spark):
    df = spark.createDataFrame([(1, date(2026, 1, 1), None), (1, date(2026, 1, 2), None), (1, date(2026, 1, 3), "x")], "e int, at date, v string")
    rows = scd2(df, "e", "at", ["v"]).orderBy("valid_from").collect()
    assert [(r.v, r.valid_to) for r in rows] == [(None, date(2026, 1, 3)), ("x", None)]


@pytest.mark.parametrize("box", [None, 60])
def test_asof_join(spark, box):
    instants = MOMENTS if box else DAYS
    kind = "timestamp_ntz" if box else "date"
    changes = random_changes(3, instants[20:], 120)
    df = spark.createDataFrame(changes, f"e int, at {kind}, tie int, v string")
    history = scd2(df, "e", "at", ["v"], tie=["tie"], box_minutes=box)
    rnd = random.Random(4)
    facts = [(i, rnd.choice([0, 0, 0, 1, 2, 3, 77, None]), rnd.choice([*instants, None])) for i in range(400)]
    joined = asof_join(spark.createDataFrame(facts, f"id int, e int, at {kind}"), history, "e", "at", {"v": "v"}, box)
    got = {r.id: r.v for r in joined.collect()}
    assert len(got) == len(facts)
    versions = brute_scd2(changes)
    for i, e, at in facts:
        want = [v for ve, v, a, b in versions if ve == e and at is not None and a <= at and (b is None or at < b)]
        assert got[i] == (want[0] if want else None)


def test_asof_plan_has_no_nested_loop(spark):
    facts = spark.range(10).select("id", F.lit(date(2026, 1, 1)).alias("at"))
    history = scd2(facts.withColumn("v", F.lit("x")), "id", "at", ["v"])
    plan = asof_join(facts, history, "id", "at", {"v": "v"})._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_late_version_equals_full_rebuild(spark):
    changes = random_changes(5, DAYS)
    late = [c for c in changes if c[2] % 7 == 0]
    schema = "e int, at date, tie int, v string"
    early = spark.createDataFrame([c for c in changes if c not in late], schema)
    late_df = spark.createDataFrame(late, schema)
    everything = early.unionByName(late_df)
    rebuilt = scd2(everything.join(late_df.select("e").distinct(), "e", "left_semi"), "e", "at", ["v"], tie=["tie"])
    merged = scd2_merge(scd2(early, "e", "at", ["v"], tie=["tie"]), rebuilt, late_df, "e")
    assert {(r.e, r.v, r.valid_from, r.valid_to) for r in merged.collect()} == brute_scd2(changes)


def test_latest_per_key_is_total_and_combines_before_the_shuffle(spark):
    rows = [(1, 5, "a", None), (1, 5, "b", 1.0), (1, 4, "z", 2.0), (2, None, "n", 3.0)]
    df = spark.createDataFrame(rows, "k int, stamp int, v string, w double")
    for shuffled in (df, df.orderBy(F.desc("v"))):
        got = sorted(tuple(r) for r in latest_per_key(shuffled, ["k"], ["stamp"]).collect())
        assert got == [(1, 5, "b", 1.0), (2, None, "n", 3.0)]
    plan = latest_per_key(df, ["k"], ["stamp"])._jdf.queryExecution().toString()
    assert "partial_max" in plan


def test_enrich_refuses_a_duplicate_key(spark):
    facts = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    ref = spark.createDataFrame([(1, "a"), (3, "c")], "k int, name string")
    assert sorted((str(r.k), r.name) for r in enrich(facts, ref, "k", ["name"]).collect()) == [("1", "a"), ("2", None), ("None", None)]
    with pytest.raises(Exception, match="duplicate reference key"):
        enrich(facts, ref.unionAll(spark.createDataFrame([(1, "b")], "k int, name string")), "k", ["name"]).collect()
    assert missing_references(facts, ref, "k", "r").count() == 2


def test_snapshot_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, None), (4, "d")], "k int, v string")
    assert {r.k: r.change for r in snapshot_diff(old, new, "k", ["v"]).collect()} == {1: "REMOVED", 2: "CHANGED", 3: "UNCHANGED", 4: "ADDED"}


def test_status_follows_event_time(spark):
    d = datetime(2026, 1, 1)
    rows = [(1, 7, "new", d, d), (2, 7, "done", d + timedelta(hours=2), d + timedelta(hours=2)), (3, 7, "open", d + timedelta(hours=1), d + timedelta(days=3))]
    events = spark.createDataFrame(rows + rows[:1], "event_id int, e int, status string, event_ts timestamp_ntz, arrival_ts timestamp_ntz")
    assert current_status(events, "e").first().status == "done"
    delays = {r.event_id: r.delay_seconds for r in event_fact(events).collect()}
    assert delays == {1: 0, 2: 0, 3: 71 * 3600}


def test_soft_rules_and_failed_rules(spark):
    df = spark.sql("SELECT 25.00BD AS amount, 2L AS quantity, 10.00BD AS price, date'2026-03-11' AS o, date'2026-03-01' AS s, CAST(NULL AS DATE) AS d")
    r = df.select(
        R.soft_amount_defect(F.col("amount"), F.col("quantity"), F.col("price")).alias("a"),
        R.soft_amount_defect(F.col("amount"), F.col("quantity"), F.col("price"), "5.00").alias("b"),
        R.soft_date_defect(F.col("o"), F.col("s"), F.col("d")).alias("c"),
        R.soft_date_defect(F.col("o"), F.col("d")).alias("e"),
        R.failed_rules({"x": F.lit(True), "y": F.lit(None).cast("boolean")}).alias("f"),
        R.ratio(F.lit(1), F.lit(0)).alias("g"),
        R.clean_text(F.lit("  a \n b ")).alias("h"),
        R.clean_text(F.lit("   ")).alias("i"),
        R.typed(F.lit("12x"), "int").alias("j"),
    ).first()
    assert tuple(r) == (True, False, True, False, ["x"], None, "a b", None, None)


def test_grain_and_reconciliation(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    row = checks.grain_violations(df, ["k", "v"], "t").first()
    assert (row.row_count, row.key_count, row.repeated_keys, row.null_keys) == (3, 2, 1, 1)
    left = spark.createDataFrame([("a", 1), ("b", 2)], "m string, value int")
    right = spark.createDataFrame([("a", 1), ("c", 3)], "m string, value int")
    assert {r.m: r.matches for r in checks.reconcile(left, right, ["m"]).collect()} == {"a": True, "b": False, "c": False}
    lines = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "o int, c int")
    assert [r.o for r in checks.inconsistent_orders(lines, "o", ["c"]).collect()] == [1]


SECRET_TEXTS = [
    "a\nAKIA" + "A1" * 8 + " and ASIA" + "B2" * 8,
    "x\n-----BEGIN RSA PRIVATE KEY-----\r-----BEGIN PRIVATE KEY-----\n-----BEGIN PRIVATE KEY-----",
    "url postgresql://me:secret@h\nPOSTGRES://me:${PW}@h postgres://me:<pw>@h",
    "ghp_" + "a" * 30 + "\n\n github_pat_" + "b" * 40,
    "eyJ" + "a" * 20 + "." + "b" * 20 + "." + "c" * 20,
    "password\n=\n'longvalue1' pwd: short client_secret=${VALUE_HERE}\nPWD = <placeholder> aws_secret_access_key=abcdefgh1",
    "pwd=abcd efghij pwd=\u001cabcdefghij",
    "nothing here\n\n",
    "",
]


def test_secret_scan_equals_a_plain_search(spark):
    df = spark.createDataFrame(list(enumerate(SECRET_TEXTS)), "id int, text string")
    got = sorted(tuple(r) for r in textscan.secret_scan(df, "id", "text").collect())
    want = []
    for i, text in enumerate(SECRET_TEXTS):
        for name, pattern in P.SECRET_PATTERNS.items():
            flags = (re.I if name in P.IGNORE_CASE_RULES else 0) | (re.M if name in P.MULTILINE_RULES else 0)
            for m in re.finditer(pattern, text, flags):
                if name in P.PLACEHOLDER_RULES and any(mark in m.group(1) for mark in P.PLACEHOLDER_MARKS):
                    continue
                want.append((i, name, text.count("\n", 0, m.start()) + 1))
    assert got == sorted(want) and {w[1] for w in want} == set(P.SECRET_PATTERNS)


def test_secret_scan_shuffles_nothing(spark):
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    assert "Exchange" not in textscan.secret_scan(df, "id", "text")._jdf.queryExecution().toString()


def test_file_rules(spark):
    cases = {
        "a/datasets/x.py": "forbidden path",
        "a/b.csv": "forbidden path",
        "a/.csv": None,
        "a/b.tar.key": "forbidden path",
        "secrets.txt": "forbidden path",
        "infra/main.tfstate.backup": "forbidden path",
        ".env": "forbidden path",
        ".env.local": "forbidden path",
        ".env.example": None,
        "my.env": None,
        "big.bin": "oversized",
        "a/outputs/b.md": None,
    }
    rows = [(p, 5_000_001 if p == "big.bin" else 5_000_000) for p in cases]
    got = {r.path: r.verdict for r in textscan.file_rules(spark.createDataFrame(rows, "path string, length bigint")).collect()}
    assert got == cases
    files = spark.createDataFrame([("a.bin", b"\xff\xfe"), ("a.png", b"\xff\xfe"), ("b.txt", "ü".encode())], "path string, content binary")
    assert [r.path for r in textscan.undecodable(files).collect()] == ["a.bin"]


def test_links(spark):
    text = "[a](x.md) ![img](y.png) [b](https://e.org) [c](#top) [d](dir/z%20w.md#part) [e](a+b%zz.md) [f](mailto:x@y) [g](gone.md)"
    links = textscan.local_links(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")
    assert [r.target for r in links.collect()] == ["x.md", "dir/z w.md", "a+b%zz.md", "gone.md"]
    known = spark.createDataFrame([("x.md",), ("dir/z w.md",), ("a+b%zz.md",)], "target string")
    assert [r.link for r in textscan.dead_links(links, known).collect()] == ["gone.md"]


def test_relative_links(spark):
    pages = [("docs/a.md", "[x](b.md) [y](../README.md) [z](./sub/../c.md) [r](/d.md) [o](../../out.md)"), ("README.md", "[x](docs/a.md) [n](a.md)")]
    links = textscan.local_links(spark.createDataFrame(pages, "path string, text string"), "path", "text")
    links = links.withColumn("target", textscan.from_page(F.col("path"), F.col("target")))
    assert [r.target for r in links.collect()] == ["docs/b.md", "README.md", "docs/c.md", "d.md", "../out.md", "docs/a.md", "a.md"]
    known = spark.createDataFrame([("docs/a.md",), ("docs/b.md",), ("README.md",), ("docs/c.md",), ("d.md",)], "target string")
    assert sorted(r.link for r in textscan.dead_links(links, known).collect()) == ["../../out.md", "a.md"]


def test_link_integrity_sees_links_from_their_page(spark, tmp_path):
    html = "".join(f'<a href="{t}">x</a>' for t in ("b.html", "../c.html", "./d/", "/a/b.html", "gone.html", "../../out.html", "d", "/", "../c%2Ehtml#top"))
    pages = [(1, "https://e.org/a/a.html", html), (2, "https://e.org/a/b.html", ""), (3, "https://e.org/c.html?q", '<a href="b.html">x</a><a href="a/b.html">x</a>'), (4, "https://e.org/a/d/", ""), (5, "https://e.org", "")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = registry.link_integrity(Source(spark, str(tmp_path))).collect()
    assert sorted((r.page_id, r.link, r.target) for r in found) == [(1, t, t) for t in ("../../out.html", "d", "gone.html")] + [(3, "b.html", "b.html")]


@pytest.fixture
def eager_skew_handling(spark):
    """Thresholds low enough for a small hot key, and no broadcast that would hide it."""
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_facts(spark):
    """Half of all rows share one entity and date."""
    hot = F.col("id") % 2 == 0
    day = F.date_add(F.lit(date(2026, 1, 5)), F.when(hot, 0).otherwise((F.col("id") % 7).cast("int")))
    return spark.range(0, 400_000, numPartitions=8).select(
        "id",
        F.when(hot, 0).otherwise(F.col("id") % 1000).alias("e"),
        day.alias("at"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )


def masters(spark):
    return spark.range(1000).select(F.col("id").alias("e"), F.lit(date(2026, 1, 1)).alias("at"), F.lit("x").alias("v"))


def split_by_skew(joined, group, rows=400_000):
    totals = joined.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.max("payload").alias("greatest"))
    assert sum(r.n for r in totals.collect()) == rows
    return "skew=true" in totals._jdf.queryExecution().executedPlan().toString()


def test_a_hot_pair_is_split_in_the_asof_join(spark, eager_skew_handling):
    history = scd2(masters(spark), "e", "at", ["v"])
    assert split_by_skew(asof_join(hot_facts(spark), history, "e", "at", {"v": "v"}), "v")


def test_a_hot_key_is_split_in_reference_joins(spark, eager_skew_handling):
    facts, ref = hot_facts(spark), masters(spark)
    assert split_by_skew(enrich(facts, ref, "e", ["v"]), "v")
    assert split_by_skew(with_presence(facts, ref, "e", "known"), "known")
    assert split_by_skew(missing_references(facts, ref.where("e >= 500"), "e", "rule"), "failed_rule", 300_000)
