"""The pipeline against plain Python over a small fixture and over the given documents."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import quality_rules
from tests.llm.test_jaccard import brute as near_groups
from tests.llm.test_pii import base_spans
from tests.llm.test_quality_rules import brute as statistics


def test_stages_equal_plain_python(spark, sf_check, few_partitions):
    docs = spark.read.parquet(f"{sf_check}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    state = docs
    after = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = corpus_pipeline.materialise(stage(spark, state, sf_check))
        assert state.columns == docs.columns
        after.append({r.doc_id: r.text for r in state.collect()})
    ruled, exact, near, clean = after
    # rules: whatever fails the base rules goes, and what else goes is named by the learned list
    judged = quality_rules.judge(docs, spark.read.parquet(f"{sf_check}/labels.parquet"))
    want = {r.doc_id for r in judged.filter("kept").collect()}
    assert set(ruled) == want and all(not statistics(texts[i])[-1] for i in want)
    # exact copies: the largest id of each text
    largest = {}
    for i, t in ruled.items():
        largest[t] = max(i, largest.get(t, i))
    assert set(exact) == set(largest.values())
    # near copies: the smallest id of each group
    assert set(near) == {component for _, _, component in near_groups(sorted(exact.items()))}
    # personal data: gone, and nothing else is touched
    assert set(clean) == set(near)
    for i, t in clean.items():
        assert not base_spans(t)
        assert base_spans(near[i]) or t == near[i]
    # packing: the ids of the cleaned texts
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    pieces = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, state, sf_check).orderBy("doc_id", "start").collect():
        pieces[r.doc_id] = pieces.get(r.doc_id, b"") + bytes(r.ids)
    for i, t in clean.items():
        assert np.frombuffer(pieces[i], "<u4").tolist() == [*library.encode(t, add_special_tokens=False).ids, 1]
    ran = corpus_pipeline.run(spark, sf_check)
    assert ran.agg(F.sum("length")).first()[0] == sum(len(p) // 4 for p in pieces.values())


def test_stages_take_nulls_repeats_and_empty_tables(spark, sf_check, few_partitions):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, words, None, None, None), (3, words, "en", "s", 1), (3, words, "en", "s", 1)]
    for kept in (rows, []):
        state = spark.createDataFrame(kept, schema).withColumn("kind", F.lit("clash"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            state = corpus_pipeline.materialise(stage(spark, state, sf_check))
        assert [r.doc_id for r in state.collect()] == ([3] if kept else [])
        assert corpus_pipeline.STAGES[-1][1](spark, state, sf_check).select("doc_id").distinct().count() == bool(kept)
