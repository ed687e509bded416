import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import alignment, queries

A_PATH, B_PATH = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def whole():
    """Both tokenizers on whole texts: ids and their bytes, by the libraries alone."""
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    characters = {chr(x): x for x in plain}
    characters |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode()

    def encode(text):
        a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        return a_ids, [bytes(characters[c] for c in a.id_to_token(i)) for i in a_ids], b_ids, [piece(i) for i in b_ids]

    return encode


def one(text, encode):
    a_ids, a_bytes, b_ids, b_bytes = encode(text) if text else ([], [], [], [])
    whole = b" " + (text or "").encode()
    if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return None
    a_end, b_end = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
    links = []
    j = 0
    for i, end in enumerate(a_end):
        start = end - len(a_bytes[i])
        while b_end[j] <= start:
            j += 1
        k = j
        while k < len(b_ids) and b_end[k] - len(b_bytes[k]) < end:
            links.append((a_ids[i], b_ids[k]))
            k += 1
    cuts = sorted(set(a_end) & set(b_end))
    groups, x, y, shared = [], 0, 0, 0
    for cut in cuts:
        x2, y2 = a_end.index(cut, x) + 1, b_end.index(cut, y) + 1
        groups.append(f"{','.join(map(str, a_ids[x:x2]))}|{','.join(map(str, b_ids[y:y2]))}")
        shared += (x2 - x) * (y2 - y)
        x, y = x2, y2
    return len(a_ids), len(b_ids), links, groups, shared


def brute(rows, encode):
    found = [(doc, one(text, encode)) for doc, text in rows]
    counts = Counter(p for _, f in found if f for p in set(f[2]))
    highest = {}
    for (a, _), n in counts.items():
        highest[a] = max(n, highest.get(a, 0))
    out = []
    for doc, f in found:
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, groups, shared = f
            best = sum(counts[p] == highest[p[0]] for p in links)
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
            out.append((doc, n_a, n_b, len(groups), len(links), shared, best, sum(counts[p] for p in links), digest))
    return out


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"pair": F.lit(1), "row": F.lit("r")})
    found = alignment.aligned_documents(docs, A_PATH, B_PATH)
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=str)


def texts():
    rnd = random.Random(12)
    parts = ["word", "Words", " ", "  ", "\n", "\t", "été", "中文", "\U0001f600", "123", ",", ".", "'s", "<|endoftext|>", "<s>", "▁", " ", "\x1c", "a" * 30, "-", "ﬁ", "Ǻ", "́", "\r\n", "　", "</s>"]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for _ in range(250)]
    made += ["".join(rnd.choice(parts[:5] + ["tail", "x"]) for _ in range(60)) for _ in range(60)]
    return [None, "", " ", "   ", "a", "a ", " a", "\n", "a\n b", "a \n b", "<|endoftext|>", "a▁b", *made, "word " * 30_000, "longtextwithoutspaces" * 500]


def test_equals_brute_force(spark, few_partitions, whole):
    rows = [*enumerate(texts()), (None, "a word"), (3, "a word"), (3, "a word")]
    assert run(spark, rows) == sorted(brute(rows, whole), key=str)


def test_pairs_outside_the_table(spark, few_partitions, whole, monkeypatch):
    """With a table of few pairs, and one that forgets its segments, most counts take the way by the join."""
    for name, value in {"TABLE_PAIRS": 3, "CACHED_SEGMENTS": 20, "FIRST_SEGMENTS": 5, "CACHED_CHARS": 6, "BATCH_CHARS": 200, "COUNTED": 50}.items():
        monkeypatch.setattr(alignment, name, value)
    rows = list(enumerate(texts()[:150]))
    assert run(spark, rows) == sorted(brute(rows, whole), key=str)


def test_query_equals_brute_force(spark, sf_small, whole):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    found = sorted((tuple(r) for r in queries.op13_alignment(spark, sf_small).collect()), key=str)
    assert found == sorted(brute(rows, whole), key=str)
    assert sum(r[4] for r in found) > 1000


def test_empty_table(spark, few_partitions):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, 0, "")]


def test_gustavson_equals_dense_product():
    rng = np.random.default_rng(6)
    for rows, inner, columns in ((5, 7, 4), (1, 1, 1), (12, 3, 9), (0, 4, 2)):
        dense = [rng.integers(0, 3, shape) * (rng.random(shape) < 0.5) for shape in ((rows, inner), (inner, columns))]
        a, b = (
            alignment.CSR(np.concatenate([[0], np.cumsum((m != 0).sum(axis=1))]).astype(int), np.nonzero(m)[1], m[np.nonzero(m)], m.shape[1]) for m in dense
        )
        made = np.zeros((rows, columns), dtype=int)
        product = alignment.gustavson(a, b)
        for i in range(rows):
            part = slice(product.starts[i], product.starts[i + 1])
            made[i, product.columns[part]] = product.values[part]
        assert np.array_equal(made, dense[0] @ dense[1])
        assert np.array_equal(alignment.transposed(alignment.transposed(a)).columns, a.columns)
