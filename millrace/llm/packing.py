"""Packing by power-of-two decomposition.

Each document is tokenised, ended with one id and split into pieces whose lengths are powers of two: whole
sequences first, then the binary digits of the rest, the longest first. Every piece is a sequence of its own, so
no sequence crosses documents and none is padded. Sequence ids start with the exponent of the length, so
sequences of equal length form one bucket, which a training job reads batch by batch.

Tokenising follows the given vocabulary file. Its splitter drops white space, so a text is the sum of its blank-separated
words, and each distinct word is encoded once per task. Words of plain Latin characters are merged by tiktoken over ranks
that are derived from the file: the library's merging of such a word is the same because every token of the
file has one merge and is reached by its own merges (``check_vocabulary`` asserts it), and the end of a word, which
the file marks with ``</w>``, is one more byte, a line feed, that no word contains. All other words go to the tokenizers library.

Defined cases: a null text counts as empty and is one piece of length 1; rows without id and repeated rows are packed like
any others; an empty table gives no pieces; other columns are not read; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_of

SEQUENCE_TOKENS = 2048
END_ID = 1
#: Distinct words a task remembers before it starts over.
WORDS_HELD = 1_000_000
#: Ids a task holds before it passes their pieces on, in bytes.
IDS_HELD = 4 << 20

# Fixed values of the vocabulary's pipeline: how a word is split, and the mark of a word's end.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_END = "</w>"
# Characters that are their own composed form and have one lower-case character.
_PLAIN = regex.compile(r"[!-~¡-įı-ǃ]+")
_PIECES = regex.compile(_SPLIT)
_SEPARATORS = re.compile(r"[\x1c-\x1f]")

SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def byte_of() -> dict[str, int]:
    """The byte behind each printable stand-in of a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordTokens:
    """Ids of words, remembered up to a bound."""

    def __init__(self, path: str, held: int = WORDS_HELD):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.held, self.known, self.byte = held, {}, byte_of()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {token["content"] for token in model["added_tokens"]}
        self.ranks = {self.raw(t): number for t, number in model["model"]["vocab"].items() if t not in special}
        pairs = (pair if isinstance(pair, list) else pair.split(" ") for pair in model["model"]["merges"])
        self.merges = {(self.raw(a), self.raw(b)): self.ranks[self.raw(a + b)] for a, b in pairs}
        self.merger = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=self.ranks, special_tokens={})

    def raw(self, token: str) -> bytes:
        body = token.removesuffix(_WORD_END)
        return bytes(self.byte[c] for c in body) + (b"\n" if body != token else b"")

    def check_vocabulary(self) -> None:
        """Assert what makes both libraries merge alike: ids in merge order, and each token reached by its own merges."""
        for token in self.ranks:
            ends = len(token) > 1 and token.endswith(b"\n")
            symbols = [token[i : i + 1] for i in range(len(token))]
            if ends:
                symbols[-2:] = [token[-2:]]
            while len(symbols) > 1:
                pairs = [(self.merges.get(pair, len(self.ranks) + 1), i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False))]
                rank, i = min(pairs)
                assert rank == self.ranks[symbols[i] + symbols[i + 1]], token
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    def encode(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word):
            pieces = _PIECES.findall(word.lower())
            ids = self.merger.encode_ordinary("\n".join(pieces) + "\n")
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def document(self, text: str) -> bytes:
        # str.split() also splits at the separators 28 to 31, which the vocabulary's splitter keeps
        words = re.split(r"[\t-\r ]+", text) if _SEPARATORS.search(text) else text.split()
        known, parts = self.known, []
        for word in words:
            ids = known.get(word)
            if ids is None:
                if len(known) >= self.held:
                    known.clear()
                ids = known[word] = self.encode(word)
            parts.append(ids)
        return b"".join(parts)


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def piece_lengths(tokens: int, longest: int = SEQUENCE_TOKENS) -> list[int]:
    """Powers of two that add up to ``tokens``, the longest first."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = SEQUENCE_TOKENS,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece with its ids (little-endian unsigned 32-bit).

    ``sequence_id`` holds the exponent of the length, the task and a counter: 8, 23 and 32 bits.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task, made = word_tokens(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for row, text in enumerate(batch.column("text")):
                ids = tokens.document(text.as_py()) + end
                held += len(ids)
                total, start = len(ids) // 4, 0
                for length in piece_lengths(total, longest):
                    sequence = length.bit_length() - 1 << 55 | task << 32 | made
                    rows.append((row, start, length, ids[4 * start : 4 * (start + length)], total, sequence, 0))
                    start, made = start + length, made + 1
                if held >= IDS_HELD:
                    yield batch_of(batch.column("doc_id"), rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(batch.column("doc_id"), rows)

    def batch_of(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        types = [None, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [doc_ids.take(pa.array(columns[0]))]
        arrays += [pa.array(values, type=kind) for values, kind in zip(columns[1:], types[1:], strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    names = [field.split()[0] for field in SCHEMA.split(", ")]
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return source.mapInArrow(run, SCHEMA)
