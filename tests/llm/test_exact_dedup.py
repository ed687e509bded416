import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from millrace.llm import exact_dedup as d


def brute(rows):
    """Sorted (doc_id, keep_id, group_size, digest) for rows (doc_id, text)."""
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    groups = {}
    for doc, text in rows:
        groups.setdefault(digest(text), []).append(doc)
    keep = {h: max((x for x in docs if x is not None), default=None) for h, docs in groups.items()}
    return sorted(((doc, keep[digest(t)], len(groups[digest(t)]), digest(t)) for doc, t in rows), key=str)


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).withColumns({"digest": F.lit(1), "kept": F.lit("x")})
    found = d.exact_groups(docs, **options).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in found), key=str) == brute(rows)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.digest for r in found}) and all(r.doc_id == r.keep_id for r in kept)
    left = d.drop_copies(docs, **options)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted((str(r.doc_id), dict_text(rows, r)) for r in kept)


def dict_text(rows, row):
    return next(t or "" for doc, t in rows if hashlib.sha256((t or "").encode()).digest() == bytes(row.digest))


def test_equals_brute_force(spark, few_partitions):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["hot"] * 30 + ["warm"] * 6 + [f"t{j}" for j in range(60)])) for i in range(400)]
    for counters in (4, 16, 1024):
        check(spark, rows, counters=counters)


def test_defined_cases(spark, few_partitions):
    long = "x" * 1_000_000
    check(spark, [(1, None), (2, ""), (3, " "), (None, "a"), (None, "a"), (5, "a"), (7, "b"), (7, "b"), (7, "c"), (None, "d"), (8, long), (9, long)])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert d.exact_groups(docs).count() == 0 and d.drop_copies(docs).count() == 0


def test_misra_gries_finds_every_frequent_digest(spark, few_partitions):
    rnd = random.Random(2)
    values = [bytes([rnd.choice([1, 1, 1, 2, 2, *range(3, 120)])]) for _ in range(3000)]
    rows = spark.createDataFrame([(bytearray(v),) for v in values], "digest binary").repartition(5)
    found = {bytes(r.digest) for r in d.misra_gries(rows, 40).collect()}
    assert {v for v, n in Counter(values).items() if n > len(values) * 2 / 40} <= found and len(found) < 40


def test_frequent_copies_are_decided_without_a_shuffle_of_texts(spark, few_partitions):
    docs = spark.createDataFrame([(i, "hot" if i % 2 else f"t{i}") for i in range(100)], "doc_id bigint, text string")
    rows = d.digested(docs)
    assert set(rows.columns) == {"doc_id", "digest", "row_tag"}
    winners = d.winners_of(rows).collect()
    assert [(r.winner.doc_id, r.group_size) for r in winners] == [(99, 50)]
