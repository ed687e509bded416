import hashlib
import random

from pyspark.sql import functions as F

from millrace.llm import chat

LOG = "conv_id bigint, seq bigint, kind string, message bigint, role string, text string"


def brute_fold(events):
    """Events of one conversation, in order."""
    messages = {}
    for _, kind, message, role, text in events:
        if kind == "regenerate":
            messages = {m: v for m, v in messages.items() if m <= message}
        old_role = messages.get(message, (None, ""))[0]
        old_text = messages.get(message, ("", ""))[1]
        new_text = {"open": text or "", "edit": text or "", "regenerate": text or "", "delta": old_text + (text or "")}[kind]
        messages[message] = (role if role is not None else old_role, new_text)
    return [(m, messages[m][0] or "", messages[m][1]) for m in sorted(messages)]


def test_fold_equals_replaying_the_log(spark, few_partitions):
    rnd, rows = random.Random(4), []
    for conv in range(25):
        at = 0
        for message in range(rnd.randrange(1, 6)):
            rows.append((conv, at, "open", message, rnd.choice(["user", "assistant"]), None))
            at += 1
            for _ in range(rnd.randrange(0, 8)):
                kind = rnd.choice(["delta", "delta", "delta", "edit", "regenerate"])
                rows.append((conv, at, kind, message, None, None if kind == "regenerate" else rnd.choice(["ab", "c ", "", "é"])))
                at += 1
    want = {c: brute_fold([r[1:] for r in rows if r[0] == c]) for c in range(25)}
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    got = {}
    log = spark.createDataFrame(shuffled, LOG).withColumn("place", F.lit("clash"))
    for r in sorted(chat.fold(log).collect(), key=lambda r: (r.conv_id, r.message)):
        got.setdefault(r.conv_id, []).append((r.message, r.role, r.text))
    assert got == want


def test_regeneration_drops_later_messages(spark):
    rows = [(1, 0, "open", 0, "user", "q"), (1, 1, "open", 1, "assistant", "old"), (1, 2, "open", 2, "user", "more"), (1, 3, "regenerate", 1, None, None), (1, 4, "delta", 1, None, "new")]
    got = chat.fold(spark.createDataFrame(rows, LOG)).orderBy("message").collect()
    assert [(r.message, r.role, r.text) for r in got] == [(0, "user", "q"), (1, "assistant", "new")]


def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def back(spark, rows, **options):
    shown = chat.render(chat.fold(chat.log_of_turns(turns_of(spark, rows), **options)))
    shown = shown.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r.conv_id: (r.formatted, [(t.role, t.text) for t in r.turns], r.loss) for r in shown.collect()}


def test_round_trip_of_control_strings(spark, few_partitions):
    hard = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "<", "|>", "a\nb\n", "", None, "é<|", "&amp;<|&"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(hard)]
    rows += [(2, 0, "odd role\n<|im_end|>", "x"), (None, 0, None, "y"), (None, 0, None, "y"), (3, 0, "assistant", "z" * 50_000)]
    for size, drafts in ((3, False), (1024, False), (3, True), (1024, True)):
        got = back(spark, rows, delta_chars=size, drafts=drafts)
        assert got[1][1] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(hard)]
        assert got[1][2] == "".join(t or "" for t in hard[1::2])
        assert got[1][0].count("<|im_start|>") == got[1][0].count("<|im_end|>") == len(hard)
        assert got[2][1] == [("odd role\n<|im_end|>", "x")] and got[2][2] == ""
        assert got[None][1] == [("", "y"), ("", "y")]
        assert got[3][2] == "z" * 50_000


def test_given_conversations(spark, sf_check):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_check}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = back(spark, rows)
    for conv in {r[0] for r in rows}:
        turns = [(role, text) for _, _, role, text in sorted(r for r in rows if r[0] == conv)]
        assert got[conv][1] == turns
        assert hashlib.sha256(got[conv][2].encode()).digest() == hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).digest()


def test_drafts_reach_the_log_and_leave_no_trace(spark, few_partitions):
    rows = [(1, 0, "user", "a question"), (1, 1, "assistant", "an answer of some length"), (2, 0, "assistant", None), (2, 1, None, "x")]
    log = chat.log_of_turns(turns_of(spark, rows), delta_chars=5, drafts=True)
    kinds = {r.kind for r in log.select("kind").distinct().collect()}
    assert kinds == set(chat.KINDS) and log.filter("text LIKE '%draft%'").count() == 6
    want = {c: brute_fold([tuple(r)[1:] for r in log.orderBy("seq").collect() if r.conv_id == c]) for c in (1, 2)}
    assert {c: [(role, text) for _, role, text in want[c]] for c in want} == {
        1: [("user", "a question"), ("assistant", "an answer of some length")],
        2: [("assistant", ""), ("", "x")],
    }
    assert {c: turns for c, (_, turns, _) in back(spark, rows, delta_chars=5, drafts=True).items()} == {
        c: [(role, text) for _, role, text in want[c]] for c in want
    }


def test_equal_sequence_numbers_are_ordered_by_message_kind_role_and_text(spark):
    rows = [(1, 5, "delta", 0, None, "b"), (1, 5, "delta", 0, None, "a"), (1, 5, "open", 1, "user", "z"), (1, 5, "delta", 1, None, "y")]
    got = chat.fold(spark.createDataFrame(rows, LOG)).orderBy("message").collect()
    # "delta" sorts before "open", which starts the message again
    assert [(r.message, r.role, r.text) for r in got] == [(0, "", "ab"), (1, "user", "z")]


def test_a_turn_of_eight_million_characters_takes_seconds(spark, few_partitions):
    import time

    text = F.repeat(F.lit("words of <|a turn\n"), 500_000)
    turns = spark.range(1).select(F.lit(1).alias("conv_id"), "id", F.lit("assistant").alias("role"), text.alias("text"))
    turns = turns.withColumnRenamed("id", "turn")
    began = time.monotonic()
    shown = chat.render(chat.fold(chat.log_of_turns(turns, drafts=True)))
    (row,) = shown.select(F.sha2(chat.masked_text(F.col("formatted"), F.col("loss_spans")), 256).alias("digest")).collect()
    assert row.digest == hashlib.sha256(b"words of <|a turn\n" * 500_000).hexdigest()
    assert time.monotonic() - began < 60


def test_unknown_events_are_refused_and_empty_logs_work(spark):
    import pytest

    with pytest.raises(Exception, match="unknown event"):
        chat.fold(spark.createDataFrame([(1, 0, "delete", 0, None, None)], LOG)).collect()
    assert chat.render(chat.fold(spark.createDataFrame([], LOG))).count() == 0


def test_plan_is_native_with_one_shuffle(spark, few_partitions):
    shown = chat.render(chat.fold(chat.log_of_turns(turns_of(spark, [(1, 0, "user", "x")]).repartition(3))))
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("hashpartitioning(conv_id") == 1
