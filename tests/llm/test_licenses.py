import random
import re
from collections import Counter

from pyspark.sql import functions as F

from millrace.llm import licenses as lic

READY = lic.prepared(lic.TEMPLATES)
VOCABULARY = frozenset(w for t in READY for w in t.marks)


def brute_align(a, b):
    """Patience alignment, written recursively with a quadratic subsequence search."""
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + brute_align(a[1:], b[1:])
    if a[-1] == b[-1]:
        return 1 + brute_align(a[:-1], b[:-1])
    pairs = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    if not pairs:
        return 0
    best = []
    for k, (_, j) in enumerate(pairs):
        before = max((best[i] for i in range(k) if pairs[i][1] < j), key=len, default=[])
        best.append([*before, pairs[k]])
    chain = max(best, key=len)
    total, at, to = len(chain), 0, 0
    for i, j in [*chain, (len(a), len(b))]:
        total += brute_align(a[at:i], b[to:j])
        at, to = i + 1, j + 1
    return total


def test_alignment_is_in_order_and_as_long_as_brute_force():
    rnd = random.Random(1)
    for _ in range(400):
        words = [f"w{rnd.randrange(25)}" for _ in range(rnd.randrange(0, 25))]
        other = [w for w in words if rnd.random() < 0.8] + [f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(0, 6))]
        pairs = lic.align(words, other)
        assert all(words[i] == other[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        # several longest subsequences may leave different gaps, so only the unique anchors of equal chains are compared
        if len(set(words)) == len(words) and len(set(other)) == len(other):
            assert len(pairs) == brute_align(words, other)


def test_increasing_subsequence_is_longest():
    rnd = random.Random(2)
    for _ in range(100):
        values = rnd.sample(range(40), 12)
        lengths = []
        for i, v in enumerate(values):
            lengths.append(1 + max((lengths[j] for j in range(i) if values[j] < v), default=0))
        chain = lic._increasing(list(enumerate(values)))
        assert len(chain) == max(lengths) and [v for _, v in chain] == sorted(v for _, v in chain)


def scan(text):
    return lic.scan_words(lic.words_of(text), READY, VOCABULARY)


def test_every_template_is_found_twice_and_with_edits():
    rnd = random.Random(3)
    for name, text in lic.TEMPLATES.items():
        found = scan(f"Some prose. {text} More of it, and the {text.upper()} end")
        assert [(m.name, m.coverage) for m in found] == [(name, 1.0)] * 2
        words = text.split()
        if len(words) > 30:
            for i in rnd.sample(range(len(words)), len(words) // 12):
                words[i] = "zzz"
            (match,) = scan("a b c " + " ".join(words) + " d e f")
            assert match.name == name and 0.75 <= match.coverage < 1 and match.start >= 3


def test_prose_has_no_license():
    assert scan("The license of this software is discussed in version two of the general notes on public distribution.") == []
    assert scan("") == []


def test_whole_scan_equals_brute_force(spark, sf_check, few_partitions):
    """In the given documents notices are whole lines, so a search for them is the brute force."""
    lines = {name: text for name, text in lic.TEMPLATES.items() if name.endswith("-line")}
    docs = spark.read.parquet(f"{sf_check}/documents.parquet").withColumn("matches", F.lit("clash"))
    want = {}
    for r in docs.collect():
        want[r.doc_id] = Counter({n: len(re.findall(re.escape(t), r.text)) for n, t in lines.items() if t in r.text})
    got = {r.doc_id: Counter(m.license for m in r.matches) for r in lic.scan(docs).collect()}
    assert got == want and sum(map(len, want.values())) > 5


def test_defined_cases(spark, few_partitions):
    text = lic.TEMPLATES["mit-line"]
    rows = [(1, None), (2, ""), (None, text), (3, text), (3, text), (4, (text + " ") * 3000), (5, "word " * 200_000 + text)]
    got = sorted(((r.doc_id, r.n_words, len(r.matches)) for r in lic.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted([(1, 0, 0), (2, 0, 0), (None, 5, 1), (3, 5, 1), (3, 5, 1), (4, 15_000, 3000), (5, 200_005, 1)], key=str)
    assert lic.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_what_stands_before_a_notice_does_not_cut_it():
    before = [
        "Copyright (c) 2020 Jane Doe",
        "Copyright (c) 2020, Jane Doe. All rights reserved.",
        "Apache License.",
        "MIT License.",
        "The ISC License (ISC)",
        "BSD 2-Clause License",
        "GNU General Public License, version 3",
        "All copies of this software keep the copyright notice, the license and the disclaimer, and this permission notice.",
    ]
    for name, text in lic.TEMPLATES.items():
        size = len(lic.words_of(text))
        for line in before:
            at = len(lic.words_of(line))
            assert scan(f"{line} {text}") == [(name, 1.0, at, at + size)], (name, line)
        for line in before[:2]:
            assert [m.name for m in scan(f"{line} {text} {line} {text}")] == [name] * 2, (name, line)


def test_every_range_that_reaches_the_coverage_holds_a_place():
    rnd = random.Random(4)
    (isc,) = (t for t in READY if t.name == "isc")
    need, reached = 26, 0
    for _ in range(60):
        kept = [w if rnd.random() < 0.85 else rnd.choice(isc.words) for w in isc.words]
        words = [*rnd.choices(isc.words, k=5), *kept, *rnd.choices(isc.words, k=5)]
        hits = [(i, w) for i, w in enumerate(words) if w in isc.marks]
        found = list(lic.places(isc, hits, words, need))
        for start in range(len(words)):
            for end in range(start + need, len(words) + 1):
                if len(lic.align(isc.words, words[start:end])) >= need:
                    reached += 1
                    assert any(start <= s and e <= end for s, e in found)
    assert reached > 1000


def test_related_notices_are_named_alone():
    titles = ["", "Copyright (c) 2020 Jane Doe", "GNU General Public License", "This file is part of Foo, version 1.1 of 2019.", "BSD License"]
    for name, text in lic.TEMPLATES.items():
        for title in titles:
            found = scan(f"{title} {text} 3 more words of 2 files")
            assert [(m.name, m.coverage) for m in found] == [(name, 1.0)], (name, title)


def test_right_license_or_none():
    gpl, apache, bsd = (lic.TEMPLATES[n] for n in ("gpl-3.0-notice", "apache-2.0-notice", "bsd-3-clause"))
    wrong = [
        gpl.replace("version 3", "version 4"),
        gpl.replace("GNU General", "GNU Library General"),
        lic.TEMPLATES["lgpl-2.1-notice"].replace("2.1", "2.2"),
        apache.replace("Version 2.0", "Version 1.0").replace("LICENSE-2.0", "LICENSE-1.0"),
        lic.TEMPLATES["mpl-2.0-notice"].replace("2.0", "1.1"),
        "Licensed under the Apache License, Version 1.0.",
        "Licensed under CC BY 3.0.",
        "Released under the BSD License.",
        "Released under the Foo License.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 1.",
    ]
    for text in wrong:
        assert scan(text) == [], text
    right = [
        ("apache-2.0-line", "Licensed under the Apache License, Version 2."),
        ("gpl-2.0-notice", lic.TEMPLATES["gpl-2.0-notice"].replace("version 2", "version 2.0")),
        ("gpl-3.0-notice", gpl.replace("This program", "Foo").replace("MERCHANTABILITY", "SALE")),
        ("bsd-3-clause", bsd.replace("copyright holder", "University of Somewhere and Elsewhere")),
        ("lgpl-3.0-notice", lic.TEMPLATES["lgpl-3.0-notice"].replace("This program", "This library")),
    ]
    for name, text in right:
        assert [m.name for m in scan(text)] == [name], text
