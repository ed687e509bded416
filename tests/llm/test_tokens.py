import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import byte_bpe, packing

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PATTERN = public_tokenizers.PATTERN
ODD = [None, "", " ", "\n\n", "don't <|endoftext|> DON'T", "é è́ ß İ ǅ Σας", "a\x1cb\x1dc d\x85e f g", "\U0001f600\U0001f468‍\U0001f469 x", "1234567890 " * 9, "a" * 4000, "x\t\t  y   \n\n z"]


def noise(seed, count):
    rnd = random.Random(seed)
    letters = ["a", "B", "é", "ß", "1", "2", " ", "  ", "\n", "'", "s", "'ll", "!", "-", "ǃ", "中", "́", "_", "\t", "ſ", "K"]
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 120))) for _ in range(count)]


@pytest.fixture(scope="module")
def given(spark, sf_check):
    return [r.text for r in spark.read.parquet(f"{sf_check}/documents.parquet").select("text").collect()]


def table(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    return docs.unionByName(spark.createDataFrame([(None, "no id"), (None, "no id")], docs.schema)).withColumn("ids", F.lit(1))


def test_byte_bpe_equals_the_library(spark, few_partitions, given):
    texts = [*ODD, *noise(1, 200), *given[:300]]
    library = byte_bpe.encoding_of(RANKS, PATTERN)
    rows = byte_bpe.encode_documents(table(spark, texts), RANKS, PATTERN, part_chars=50)
    got = {r.doc_id: r for r in rows.collect() if r.doc_id is not None}
    assert rows.count() == len(texts) + 2 and isinstance(library, tiktoken.Encoding)
    for i, text in enumerate(texts):
        want = library.encode_ordinary(text or "")
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want and got[i].n_tokens == len(want)
        assert bytes(got[i].decoded).decode() == (text or "")
    texts_back = byte_bpe.decode_documents(rows, RANKS, PATTERN).filter("doc_id IS NOT NULL").collect()
    assert {r.doc_id: r.text for r in texts_back} == {i: t or "" for i, t in enumerate(texts)}


def test_runs_the_matcher_cannot_take(spark):
    library = byte_bpe.encoding_of(RANKS, PATTERN)
    for text in ("\n" * 1_200_000 + "x", " " * 300_000 + "ab", "é1" * 150_000):
        assert library.decode(byte_bpe.encode(library, text, PATTERN)) == text
    for text in ("\n" * 9000 + "x", " " * 9000, "ab" * 5000):  # the library takes these, so both ways can be compared
        assert byte_bpe.encode(library, text, PATTERN, part_chars=100) == library.encode_ordinary(text)


def test_vocabulary_merges_alike_in_both_libraries():
    packing.word_tokens(WORDS).check_vocabulary()


def test_packing_equals_the_tokenizers_library(spark, few_partitions, given):
    texts = [*ODD, *noise(2, 200), *given[:250], "word " * 5000]
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    rows = packing.pack(table(spark, texts), WORDS).collect()
    pieces = {}
    for r in sorted((r for r in rows if r.doc_id is not None), key=lambda r: (r.doc_id, r.start)):
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(range(len(texts)))
    for i, text in enumerate(texts):
        want = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(b"".join(r.ids for r in pieces[i]), "<u4").tolist() == want
        assert [r.start for r in pieces[i]] == np.cumsum([0, *[r.length for r in pieces[i]]])[:-1].tolist()
        assert all(r.doc_tokens == len(want) for r in pieces[i])
    assert sum(r.doc_id is None for r in rows) == 2 * len(packing.piece_lengths(3))


def test_sequences_are_full_and_bucketed(spark, few_partitions):
    rows = packing.pack(table(spark, noise(3, 100) + ["w " * 9000]), WORDS).select("*", F.crc32("ids").alias("crc")).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 and len(r.ids) == 4 * r.length for r in rows)
    assert all(r.sequence_id >> 55 == r.length.bit_length() - 1 for r in rows)
    assert all(r.crc == zlib.crc32(bytes(r.ids)) for r in rows)


@pytest.mark.parametrize("tokens", [1, 2, 3, 2047, 2048, 2049, 6145, 100_000])
def test_piece_lengths(tokens):
    lengths = packing.piece_lengths(tokens)
    assert sum(lengths) == tokens and sorted(lengths, reverse=True) == lengths
    assert all(n == 2048 or lengths.count(n) == 1 for n in lengths)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(docs, WORDS).count() == 0
    assert byte_bpe.encode_documents(docs, RANKS, PATTERN).count() == 0
