import hashlib
import random
import re

from pyspark.sql import functions as F

from millrace.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ORDER = list(PLAIN)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def base_spans(text):
    found = []
    for number, (kind, pattern) in enumerate(PLAIN.items()):
        found += [(m.start(), number, m.end()) for m in re.finditer(pattern, text or "") if valid(kind, m.group())]
    return sorted(found)


def found_in(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("kind", F.lit("clash"))
    rows = pii.spans(docs).collect()
    assert len(rows) == len(texts)
    return {r.doc_id: [(s["start"], s["kind"], s["end"]) for s in r.found if s["base"]] for r in rows}


def noise(seed, count):
    rnd = random.Random(seed)
    parts = ["a", "b@", "@", ".", "c.d", "-", "+", "1", "22", "255.1", ".3.4", "4111 1111 1111 1111", "+49 (170) 123-4567", " ", "x_y", "é", "%", "(", ")", "\n", "999.1.1.1", "0001.2.3.4", "a.b@c-d.e"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 40))) for _ in range(count)]


def test_base_spans_equal_brute_force(spark, few_partitions):
    texts = [None, "", *noise(1, 400), "a@b.c_x@d.e", "a@b.c.@d.e.f", "1.2.3.4.5.6.7.8", "12345678901234567890 4111111111111111"]
    got = found_in(spark, texts)
    assert got == {i: base_spans(t) for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 100


RUNS = ["a", "1", "1 ", "+1(", "a@", "1.", "a@b.c ", "Dr ", "1-"]


def test_long_runs(spark, few_partitions):
    """The plain patterns are quadratic on such runs, so only short ones are compared; long ones must finish."""
    short = [run * 400 for run in RUNS]
    assert found_in(spark, short) == {i: base_spans(t) for i, t in enumerate(short)}
    counts = {i: len(spans) for i, spans in found_in(spark, [run * 60_000 for run in RUNS]).items()}
    assert counts == {i: {"1.": 15_000, "a@b.c ": 60_000}.get(run, 0) for i, run in enumerate(RUNS)}


def test_query_equals_brute_force(spark, sf_check):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_check}/documents.parquet").collect()}
    rows = queries.op3_pii(spark, sf_check).collect()
    assert len(rows) == len(texts)
    hits = 0
    for r in rows:
        spans = base_spans(texts[r.doc_id])
        hits += len(spans)
        joined = ",".join(f"{ORDER[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert hits > 20


def test_labelers_teach_the_classifier(spark, few_partitions):
    """Signed and titled names with cues are kept; the same digits after a counter-cue are not."""
    good = [f"please call 555-0{i}-77 or mail to jane{i}@site.org dear Dr. Anna Smith, thanks" for i in range(10, 60)]
    good += [f"contact phone: 415 555 {1000 + i}, thanks" for i in range(60)]
    bad = [f"see part 999 666 {1000 + i}x and version 999.300.{i}.4" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, text string")
    names = {r.doc_id: {pii.KINDS[s["kind"]].name for s in r.found} for r in pii.spans(docs).collect()}
    assert sum("phone_local" in names[i] for i in range(50, 110)) >= 55
    assert all("phone_local" not in names[i] and "ip" not in names[i] for i in range(110, 170))


def test_expectation_maximisation_finds_the_noisy_labeler():
    rnd, counts = random.Random(3), {}
    for _ in range(4000):
        truth = 1 if rnd.random() < 0.5 else -1
        pattern = tuple(truth if rnd.random() < p else -truth for p in (0.95, 0.9, 0.9, 0.85, 0.8, 0.5))
        counts[pattern] = counts.get(pattern, 0) + 1
    fitted = pii.expectation_maximisation(counts)
    strength = [r[1] - r[-1] for r in fitted.ratios]
    assert strength[0] == max(strength) and abs(strength[5]) < 0.5


def test_redaction_removes_all_base_spans(spark, few_partitions):
    texts = [None, "", "nothing here", "mail a.b@c.org now, host 10.0.0.1; card 4111 1111 1111 1111, phone +1 (988) 555-2485 end", *noise(2, 150)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, matches string")
    redacted = pii.redact(docs)
    assert redacted.columns == docs.columns
    rows = {r.doc_id: r.text for r in redacted.collect()}
    assert rows[0] is None and rows[1] == "" and rows[2] == "nothing here"
    assert rows[3] == "mail [EMAIL] now, host [IP]; card [CARD], phone [PHONE] end"
    # Without a base span a text changes only by spans the method adds; none of these texts holds one: a part of a longer
    # number, whether it starts at a bracket or behind it, is no local phone number.
    for i, text in enumerate(texts):
        if not base_spans(text):
            assert rows[i] == text


def test_a_local_number_is_no_part_of_a_longer_one():
    pattern = re.compile(pii.KINDS[5].pattern.replace("(?<![0-9A-Za-z+][ .-]?)", "(?<![0-9A-Za-z+])(?<![0-9A-Za-z+][ .-])"))
    for text in ("+49 (170) 123-4567-999", "+49 (170) 123-4567", "1 (170) 123-4567", "a.170 123-4567"):
        assert not pattern.search(text), text
    assert pattern.search("call (170) 123-4567 now".replace("call ", ": ")).group() == "(170) 123-4567"
    assert pattern.search("so: 170.123.4567").group() == "170.123.4567"


def test_redaction_replaces_overlapping_spans_as_one(spark, few_partitions):
    far = "\U0001f600 " * 3000
    cases = {
        "4111 1111 1111 1111@example.com": "[EMAIL]",
        "+49 170 1234567@example.com": "[EMAIL]",
        "call +49 170 1234567@example.com, or 10.0.0.1@e.org and 4111 1111 1111 1111": "call [EMAIL], or [EMAIL] and [CARD]",
        f"{far}4111 1111 1111 1111@example.com{far}a@b.org": f"{far}[EMAIL]{far}[EMAIL]",
        "a@b.org c@d.org": "[EMAIL] [EMAIL]",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()} == dict(enumerate(cases.values()))


def test_redaction_leaves_nothing_of_a_base_span(spark, few_partitions):
    texts = noise(7, 200)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for i, text in enumerate(texts):
        kept, at = "", 0
        for start, _, end in base_spans(text):
            kept, at = kept + text[at:max(at, start)], max(at, end)
        rest = re.sub(r"\[[A-Z_]+\]", "", rows[i])
        letters = iter(kept + text[at:])
        assert all(c in letters for c in rest), (text, rows[i])


def test_plans_are_native_and_empty_tables_work(spark, few_partitions):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.spans(empty).count() == 0 and pii.redact(empty).count() == 0
    docs = spark.createDataFrame([(None, "a@b.de"), (None, "a@b.de"), (1, "x")], "doc_id bigint, text string")
    found = pii.spans(docs)
    assert sorted(len(r.found) for r in found.collect()) == [0, 1, 1]
    plan = found._jdf.queryExecution().executedPlan().toString() + pii.redact(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
