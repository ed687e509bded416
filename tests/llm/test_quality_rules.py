import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs):
    rows = q.with_statistics(docs).withColumn("base_failed", q.base_failed())
    return {r.doc_id: tuple(r[c] for c in [*COLUMNS, "base_failed"]) for r in rows.collect()}


def texts():
    rnd = random.Random(7)
    made = [None, "", "   ", "\n\n\t", "a", "a b", "a b c", "a b c a b c", "x x x x x", "a\n a\na\n\n a", "é è ß\x1cb #*$|<>%&", "A" * 5000]
    for _ in range(60):
        made.append("".join(rnd.choice(["a", "b", "c", " ", " ", "\n", "|", "#", "é", "\x0b", " "]) for _ in range(rnd.randrange(0, 400))))
    made.append(" ".join(rnd.choice("ab") for _ in range(20_000)))
    return made


def test_statistics_equal_brute_force(spark, few_partitions):
    made = texts()
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string").withColumn("n_words", F.lit("clash"))
    assert measured(docs) == {i: brute(t) for i, t in enumerate(made)}


def test_statistics_of_the_given_documents(spark, sf_check):
    docs = spark.read.parquet(f"{sf_check}/documents.parquet")
    assert measured(docs) == {r.doc_id: brute(r.text) for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(900):
        bad = i % 3 == 0
        symbols = rnd.uniform(0.2, 0.5) if bad and i % 2 else rnd.uniform(0, 0.1)
        upper = rnd.uniform(0.6, 0.9) if bad and not i % 2 else rnd.uniform(0, 0.3)
        rows.append({"bad": bad, "growing": i % 5 != 0, **dict.fromkeys(q.FEATURES, 0.0), "symbol_share": symbols, "upper_share": upper, "mean_word": rnd.uniform(3, 7)})
    return spark.createDataFrame(rows, "bad boolean, growing boolean, " + ", ".join(f"{f} double" for f in q.FEATURES))


def test_list_describes_two_kinds_of_bad_rows(spark, few_partitions, labelled):
    rules = q.learn(labelled)
    assert {c.feature for rule in rules for c in rule} >= {"symbol_share", "upper_share"}
    judged = labelled.withColumn("hit", q.rejected_by(rules).isNotNull())
    assert judged.filter("hit AND NOT bad").count() == 0
    assert judged.filter("NOT hit AND bad").count() <= 30  # thresholds are quantiles, and a rule covers ten rows at least


def test_first_rule_wins_and_empty_lists(spark):
    rules = [(q.Condition("mean_word", True, 5.0),), (q.Condition("mean_word", True, 3.0), q.Condition("upper_share", False, 0.5))]
    rows = spark.createDataFrame([(6.0, 0.0), (4.0, 0.4), (4.0, 0.6), (1.0, 0.0)], "mean_word double, upper_share double")
    assert [r[0] for r in rows.select(q.rejected_by(rules)).collect()] == [1, 2, None, None]
    assert [r[0] for r in rows.select(q.rejected_by([])).collect()] == [None] * 4
    none = spark.createDataFrame([], "bad boolean, growing boolean, " + ", ".join(f"{f} double" for f in q.FEATURES))
    assert q.learn(none) == []


def test_filter_keeps_columns_and_plan_is_native(spark, sf_small, few_partitions):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").withColumn("kept", F.lit(1))
    labels = spark.createDataFrame([(0, None), (None, 1), (3, 1), (3, 1)], "doc_id bigint, quality int")
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in docs.collect() if not brute(r.text)[-1]}
    assert {r.doc_id for r in kept.collect()} == want
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_empty_table(spark, few_partitions):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert q.judge(docs, spark.createDataFrame([], "doc_id bigint, quality int")).count() == 0


def test_held_out_precision(spark, sf_check):
    docs, labels = (spark.read.parquet(f"{sf_check}/{t}.parquet") for t in ("documents", "labels"))
    learned = labels.filter("doc_id % 2 = 0")
    judged = q.verdicts(q.with_statistics(docs), q.learn(q.labelled_statistics(q.with_statistics(docs), learned)))
    rows = judged.join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("NOT base_failed").select("kept", "quality").collect()
    assert sum(not r.kept and r.quality == 1 for r in rows) <= 0.02 * len(rows)
    assert sum(not r.kept for r in rows if r.quality == 0) >= 0.5 * sum(r.quality == 0 for r in rows)


def brute_list(rows, thresholds):
    """Sequential covering in plain Python over (bad, growing, features) rows."""

    def holds(rule, row):
        return all((row[c.feature] > c.threshold) == c.above for c in rule)

    rules, left = [], rows
    while len(rules) < q.MOST_RULES:
        rule, within = (), [r for r in left if r["growing"]]
        while len(rule) < q.MOST_CONDITIONS:
            p0, n0 = sum(r["bad"] for r in within), sum(not r["bad"] for r in within)
            if not p0 or not n0:
                break
            best, gain = None, 0.0
            for feature in q.FEATURES:
                for t in thresholds[feature]:
                    for above in (True, False):
                        hit = [r for r in within if (r[feature] > t) == above]
                        gained = q._gain(p0, n0, sum(r["bad"] for r in hit), sum(not r["bad"] for r in hit))
                        if gained > gain:
                            best, gain = q.Condition(feature, above, t), gained
            if best is None:
                break
            rule += (best,)
            within = [r for r in within if holds((best,), r)]

        def worth(prefix):
            hit = [r for r in left if not r["growing"] and holds(prefix, r)]
            p = sum(r["bad"] for r in hit)
            n = len(hit) - p
            return ((p - n) / max(1, p + n), p, -len(prefix)), p, n

        prefixes = [rule[:i] for i in range(1, len(rule) + 1)]
        if not prefixes:
            break
        best = max(prefixes, key=lambda x: worth(x)[0])
        _, p, n = worth(best)
        covered = sum(holds(best, r) for r in left)
        if covered < max(q.LEAST_COVER, q.LEAST_SHARE * len(left)) or not p or p < q.LEAST_PRECISION * (p + n):
            break
        rules.append(best)
        left = [r for r in left if not holds(best, r)]
    return rules


def test_learned_verdicts_equal_brute_force(spark, sf_check):
    """The whole query: the list is learned again in plain Python from brute-force checked statistics, and each verdict compared."""
    docs, labels = (spark.read.parquet(f"{sf_check}/{t}.parquet") for t in ("documents", "labels"))
    statistics = [r.asDict() for r in q.with_statistics(docs).collect()]
    quality = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    assert len(quality) < q.TRAINING_LABELS
    rows = []
    for r in statistics:
        failed = r["n_words"] < q.LEAST_WORDS or 100 * r["n_repeat_words"] > q.MOST_REPEATED_PERCENT * r["n_words"]
        if r["doc_id"] in quality and not failed:
            rows.append({**r, "bad": quality[r["doc_id"]] == 0, "growing": zlib.crc32(str(r["doc_id"]).encode()) % 3 != 0})
    thresholds = {}
    for feature in q.FEATURES:
        values = sorted(r[feature] for r in rows)
        quantiles = sorted({values[max(0, math.ceil(i / q.THRESHOLDS * len(values)) - 1)] for i in range(q.THRESHOLDS + 1)})
        thresholds[feature] = [(a + b) / 2 for a, b in itertools.pairwise(quantiles)]
    rules = brute_list(rows, thresholds)
    assert rules

    def number(row):
        return next((i for i, rule in enumerate(rules, 1) if all((row[c.feature] > c.threshold) == c.above for c in rule)), None)

    got = {r.doc_id: (r.rule, r.base_failed, r.kept) for r in q.judge(docs, labels).collect()}
    for r in statistics:
        failed = r["n_words"] < q.LEAST_WORDS or 100 * r["n_repeat_words"] > q.MOST_REPEATED_PERCENT * r["n_words"]
        assert got[r["doc_id"]] == (number(r), failed, not failed and number(r) is None)


def test_filters_do_not_repeat_the_statistics(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    plan = q.with_statistics(docs).filter(~q.base_failed())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") <= 1
