"""Byte-level BPE encoding and decoding with a local rank file.

The library splits a text by a pattern and merges bytes inside each match. Long texts are cut first, where
white space follows another character: the pattern never matches across such a place, and nothing in it looks
back, so the parts encode exactly as the whole does. A stretch without such a place is matched here and encoded
match by match, because the library's matcher recurses over long runs of white space.

Defined cases: a null text counts as empty and has no ids; a row without id is encoded like any other; repeated
rows give repeated results; other columns are not read; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_of

#: Characters after which a long text is cut at the next safe place.
PART_CHARS = 50_000

_SAFE = regex.compile(r"\S(?=\s)")

SCHEMA = "doc_id bigint, n_tokens bigint, ids binary, decoded binary"
DIGEST_SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=4)
def encoding_of(rank_path: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, part_chars: int = PART_CHARS) -> Iterator[str]:
    """Parts that end at a safe place, each the shortest one above ``part_chars``."""
    start = 0
    while len(text) - start > part_chars:
        cut = _SAFE.search(text, start + part_chars)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def encode(encoding: tiktoken.Encoding, text: str, pattern: str, part_chars: int = PART_CHARS) -> list[int]:
    ids: list[int] = []
    for part in safe_parts(text, part_chars):
        if len(part) <= 4 * part_chars:
            ids += encoding.encode_ordinary(part)
        else:
            for match in regex.finditer(pattern, part):
                ids += encoding._encode_single_piece(match.group())
    return ids


def encode_documents(
    docs: DataFrame,
    rank_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_chars: int = PART_CHARS,
    digests: bool = False,
) -> DataFrame:
    """Ids (little-endian unsigned 32-bit) and the bytes decoded from them; with ``digests``, their SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(rank_path, pattern)
        for batch in batches:
            counts, packed, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode(encoding, text, pattern, part_chars)
                counts.append(len(ids))
                packed.append(np.asarray(ids, dtype="<u4").tobytes())
                decoded.append(encoding.decode_bytes(ids))
            if digests:
                packed = [hashlib.sha256(x).hexdigest() for x in packed]
                decoded = [hashlib.sha256(x).hexdigest() for x in decoded]
            kind = pa.string() if digests else pa.binary()
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(packed, kind), pa.array(decoded, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = DIGEST_SCHEMA if digests else SCHEMA
    names = [field.split()[0] for field in schema.split(", ")]
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return source.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and the text of rows with ``ids``; bytes that are no UTF-8 become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(rank_path, pattern)
        for batch in batches:
            texts = [
                encoding.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist()).decode("utf-8", "replace")
                for ids in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
