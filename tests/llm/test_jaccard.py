import random

import numpy as np
import pytest

from millrace.llm import jaccard
from millrace.llm.components import components


def words_of(text):
    return (text or "").encode().lower().split()


def shingles(text):
    words = words_of(text)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """Expected (doc_id, n_shingles, component_id) for unique ids."""
    sets = {doc: shingles(text) for doc, text in rows}
    label = {doc: doc for doc in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return sorted((doc, len(sets[doc]), root(doc)) for doc in docs)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = jaccard.linked_components(docs, **options)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(tuple(r) for r in found.collect())


def corpus(seed, groups=12):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(40)]
    texts = ["", "  ", "one", "ONE", "one two", "a b c d e", "a b c d e"]
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice((3, 6, 9, 14, 25, 60, 150, 400)))]
        for _ in range(rnd.randrange(1, 9)):
            words = list(base)
            for _ in range(rnd.randrange(0, max(2, len(base) // 12))):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                words = words[: max(1, int(len(words) * rnd.uniform(0.7, 1)))]
            if rnd.random() < 0.2:
                words += passage
            texts.append(" ".join(words))
    rnd.shuffle(texts)
    return [(i * 3, text) for i, text in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, few_partitions, seed):
    rows = corpus(seed)
    assert run(spark, rows, bucket_signatures=500) == brute(rows)


def test_given_documents(spark, sf_check):
    docs = spark.read.parquet(f"{sf_check}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(tuple(r) for r in jaccard.linked_components(docs).collect()) == brute(rows)


def test_frequent_signatures_and_blocks(spark, few_partitions):
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(rnd.randrange(1, 6)):
            words[rnd.randrange(60)] = f"x{rnd.randrange(1000)}"
        rows.append((i, " ".join(words)))
    assert run(spark, rows, frequent=5, unit_docs=10, broadcast_ids=0) == brute(rows)


def test_defined_cases(spark, few_partitions):
    rows = [(1, None), (2, ""), (None, "a b c d e"), (7, "a b c d e"), (5, "A b\tc d  e"), (7, "q r s t u v"), (9, "Q r s t u v"), (None, "only here so far")]
    assert sorted(run(spark, [r for r in rows if r[0] is not None])) == [
        (1, 0, 1), (2, 0, 2), (5, 1, 5), (7, 1, 5), (7, 2, 5), (9, 2, 5)
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS component_id", "2 AS unit")
    nameless = [tuple(r) for r in jaccard.linked_components(docs).filter("doc_id IS NULL").collect()]
    assert sorted(nameless, key=str) == sorted([(None, 1, 5), (None, 1, None)], key=str)
    kept = jaccard.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 5]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_signatures_meet_at_the_threshold():
    """Pairs at exactly the largest tolerated difference share a signature."""
    rnd = np.random.default_rng(4)
    for a in [*range(1, 60), 100, 171, 300, 420, 1000]:
        for b in {a, a + 1, a * 4 // 3}:
            differ = (a + b) // 7
            if b < a or 3 * b > 4 * a or (a + b - differ) % 2 and differ == 0:
                continue
            shared = (a + b - differ + 1) // 2
            if shared > a or 7 * shared < 3 * (a + b):
                continue
            pool = rnd.integers(1, 1 << 62, size=a + b, dtype=np.uint64)
            left, right = pool[:a], np.concatenate([pool[:shared], pool[a : a + b - shared]])
            signed = [np.concatenate([jaccard.signatures(x, i) for i in jaccard.instances_of(len(x))]) for x in (left, right)]
            assert np.intersect1d(*signed).size, (a, b)


def test_long_chain_is_one_component(spark, few_partitions):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    found = {r.vertex: r.component for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_subsets_are_enumerated_for_all_sizes():
    """Beyond three differences two of every three second-level partitions are signed, and the bound on bad partitions holds."""
    for i in range(4, len(jaccard.bands()) - 2):
        s = jaccard.scheme(i)
        k = (s.own_top + s.top) // 7
        assert s.n1 * (s.k2 + 1) > k
        assert (s.n2, s.k2) == (3, 1) if k > 3 else (s.n1, s.n2) == (1, k + 2 if k else 1)


def test_large_clusters_are_split_by_size_of_their_sets(spark, few_partitions):
    rows = corpus(3, groups=6)
    assert run(spark, rows, unit_shingles=300) == brute(rows)
    assert run(spark, rows, unit_shingles=1) == brute(rows)


def test_copies_stand_for_each_other(spark, few_partitions):
    rows = corpus(6, groups=5)
    copies = [(1000 + 50 * n + i, text) for n in range(12) for i, (_, text) in enumerate(rows[:40])]
    docs = spark.createDataFrame(rows + copies, "doc_id bigint, text string").repartition(6)
    assert sorted(tuple(r) for r in jaccard.linked_components(docs, frequent=8).collect()) == brute(rows + copies)


def test_very_long_texts(spark, few_partitions):
    rnd = random.Random(9)
    words = [f"v{rnd.randrange(10**6)}" for _ in range(300_000)]
    other = list(words)
    for i in range(0, 8_000):
        other[i * 30] = "changed"
    far = [f"u{i}" for i in range(200_000)]
    rows = [(4, " ".join(words)), (2, " ".join(other)), (9, " ".join(far)), (1, "short text of its own here")]
    assert run(spark, rows) == brute(rows)
