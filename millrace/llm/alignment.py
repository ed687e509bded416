"""Alignment of two tokenizers by token-byte incidence matrices in compressed sparse rows.

Tokenizer A is byte-level BPE and encodes a space and the text; tokenizer B is a sentencepiece model that adds that space itself. Each
token covers a range of the bytes of space and text. With rows for tokens and columns for bytes, the incidence matrices A and B
have a one where a token covers a byte; the product A * B' counts the bytes two tokens share, so its entries are the overlap links.
Offsets at which tokens of both end cut the tokens into groups; the product of the token-group incidence matrices holds the
links within groups. Matrices and products are built by hand: Gustavson's row products, all rows of a batch at once.

Both tokenizers never join bytes across a space that follows a character other than white space: A splits there first, and no
piece of B has a space behind another character, which is checked when the model is loaded. Texts are therefore cut there into
*segments*; everything the alignment counts is a sum over segments, and a segment seen before is looked up. Distinct segments of a
task are tokenised and multiplied in batches.

1. One pass aligns the texts and writes, per document, its sums, the digest of its groups, and its distinct linked id pairs with the
   number of links of each.
2. Aggregations over the written pairs count the documents of each pair and find the highest count of each A id.
3. The ``TABLE_PAIRS`` most frequent pairs with their counts, and the highest counts, are broadcast: bounded by that parameter and by
   the size of the vocabulary. A second pass, over the written pairs alone, sums counts per document. Links whose pair is not in the
   table leave it as rows (document, pair, times), are joined with the counts by pair, and summed.

Defined cases: texts that are null or empty, or whose joined token bytes of A or B differ from space and text (B writes U+2581 as a
space), have no tokens: zeros and an empty string; a very long text is aligned whole, segment by segment, and a segment longer than
``CACHED_CHARS`` is not remembered; strings of special tokens are plain text; repeated rows and equal ids count as documents of their
own; ties for the highest count are all best; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, text_of

#: Pairs whose counts every task gets.
TABLE_PAIRS = 500_000
#: Longest segment remembered, and how many of them and of their pairs, before a task forgets all but those it met first.
CACHED_CHARS, CACHED_SEGMENTS, CACHED_PAIRS, FIRST_SEGMENTS = 64, 400_000, 4_000_000, 200_000
#: Characters of texts or of new segments handled at once, and distinct pairs a task counts before it passes them on.
BATCH_CHARS, COUNTED = 1_000_000, 1_000_000


# -- sparse matrices ------------------------------------------------------------------------------


class CSR(NamedTuple):
    """Compressed sparse rows: row i has ``columns[starts[i]:starts[i + 1]]`` with ``values`` alike."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def rows(self) -> int:
        return len(self.starts) - 1


def token_bytes(ends: np.ndarray, size: int) -> CSR:
    """Incidence of tokens that cover the bytes 0 to ``size`` without gaps, given where each ends."""
    return CSR(np.concatenate([[0], ends]), np.arange(size), np.ones(size, dtype=np.int64), size)


def token_groups(ends: np.ndarray, cuts: np.ndarray) -> CSR:
    """Incidence of tokens and groups: one entry per token."""
    group = np.searchsorted(cuts, ends, side="left")
    return CSR(np.arange(len(ends) + 1), group, np.ones(len(ends), dtype=np.int64), len(cuts))


def transposed(m: CSR) -> CSR:
    order = np.argsort(m.columns, kind="stable")
    rows = np.repeat(np.arange(m.rows), np.diff(m.starts))
    starts = np.concatenate([[0], np.cumsum(np.bincount(m.columns, minlength=m.width))])
    return CSR(starts, rows[order], m.values[order], m.rows)


def gustavson(a: CSR, b: CSR) -> CSR:
    """The product: row i is the sum of the rows k of ``b``, each weighted by the entry (i, k) of ``a``.

    The rows of b that all entries of a call for are laid out one after the other, then entries of equal row and column are added.
    """
    sizes = np.diff(b.starts)[a.columns]
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    taken = np.repeat(b.starts[:-1][a.columns], sizes) + within
    row = np.repeat(np.repeat(np.arange(a.rows), np.diff(a.starts)), sizes)
    key = row * b.width + b.columns[taken]
    value = np.repeat(a.values, sizes) * b.values[taken]
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    summed = np.add.reduceat(value, first) if len(first) else value
    key = key[first]
    starts = np.concatenate([[0], np.cumsum(np.bincount(key // max(1, b.width), minlength=a.rows))])
    return CSR(starts, key % max(1, b.width), summed, b.width)


# -- tokenizers -----------------------------------------------------------------------------------


def _byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers(NamedTuple):
    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    a_sizes: np.ndarray
    b_sizes: np.ndarray
    space: int


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark fills the cores
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    characters, size = _byte_characters(), a.get_vocab_size()
    a_bytes = [bytes(characters[c] for c in token) if all(c in characters for c in token) else token.encode() for token in map(a.id_to_token, range(size))]
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    if any("▁" in piece.lstrip("▁") for piece in pieces):
        raise ValueError("a piece joins a space to the character before it, so texts cannot be cut at spaces")
    byte = re.compile("<0x([0-9A-F]{2})>")
    b_bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
    sizes = (np.array([len(x) for x in table], dtype=np.int64) for table in (a_bytes, b_bytes))
    return Tokenizers(a, b, a_bytes, b_bytes, *sizes, b.piece_to_id("▁"))


#: A space behind white space, where texts are not cut.
_LOOSE = re.compile(r"\s ")


def segments_of(text: str) -> list[str]:
    """Pieces whose concatenation, each behind a space, is space and text."""
    parts = text.split(" ")
    if not _LOOSE.search(" " + text):
        return parts
    made, held = [], []
    for part in parts[:-1]:
        held.append(part)
        if part and not part[-1].isspace():
            made.append(" ".join(held))
            held = []
    made.append(" ".join([*held, parts[-1]]))
    return made


class Batch(NamedTuple):
    """Alignments of several segments. ``sums`` has a row (tokens of A, of B, groups, links, links within groups) per segment;
    ``pairs`` from ``starts[i]`` on are the linked ids of segment i, each once, with how many links have them."""

    sums: np.ndarray
    starts: np.ndarray
    pairs: np.ndarray
    times: np.ndarray
    groups: list[str]


def align(segments: list[str], t: Tokenizers) -> tuple[list[int], Batch]:
    """Alignments of segments, each taken behind a space, and which of them have one: those whose tokens have their bytes."""
    a_ids = [e.ids for e in t.a.encode_batch([" " + s for s in segments], add_special_tokens=False)]
    b_ids = [ids if s else [t.space] for s, ids in zip(segments, t.b.encode(segments, num_threads=1), strict=True)]
    good = _faithful(segments, a_ids, b_ids, t)
    if len(good) < len(segments):
        a_ids, b_ids = [a_ids[i] for i in good], [b_ids[i] for i in good]
    a, b = _flat(a_ids), _flat(b_ids)
    a_ends, b_ends = np.cumsum(t.a_sizes[a]), np.cumsum(t.b_sizes[b])
    size = int(a_ends[-1]) if good else 0
    links = gustavson(token_bytes(a_ends, size), transposed(token_bytes(b_ends, size)))
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    a_groups, b_groups = token_groups(a_ends, cuts), token_groups(b_ends, cuts)
    shared = gustavson(a_groups, transposed(b_groups))
    # Segments end where tokens of both do, so rows, links and groups of a segment stand together.
    a_cut, b_cut = (np.cumsum([0, *map(len, ids)]) for ids in (a_ids, b_ids))
    group_cut = np.searchsorted(a_groups.columns, np.arange(len(cuts) + 1))  # first A token of each group
    group_cut = np.searchsorted(group_cut, a_cut)
    sums = np.diff(np.stack([a_cut, b_cut, group_cut, links.starts[a_cut], shared.starts[a_cut]], axis=1), axis=0)
    owner = np.repeat(np.arange(len(good)), sums[:, 3])
    pair = np.repeat(a, np.diff(links.starts)) * len(t.b_bytes) + b[links.columns]
    order = np.lexsort((pair, owner))
    owner, pair = owner[order], pair[order]
    first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(pair, prepend=-1) != 0))
    starts = np.searchsorted(owner[first], np.arange(len(good) + 1))
    groups = group_texts(a, b, a_groups.columns, b_groups.columns, group_cut)
    return good, Batch(sums, starts, pair[first], np.diff(np.append(first, len(pair))), groups)


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int64)


def _faithful(segments: list[str], a_ids: list[list[int]], b_ids: list[list[int]], t: Tokenizers) -> list[int]:
    """Segments whose tokens of A and of B have exactly their bytes. Usually all, which one comparison of everything shows."""
    wholes = [b" " + s.encode() for s in segments]
    sizes, joined = np.fromiter(map(len, wholes), dtype=np.int64, count=len(wholes)), b"".join(wholes)
    all_fine = True
    for ids, table, lengths in ((a_ids, t.a_bytes, t.a_sizes), (b_ids, t.b_bytes, t.b_sizes)):
        flat = _flat(ids)
        running = np.concatenate([[0], np.cumsum(lengths[flat])])
        cuts = np.cumsum([0, *map(len, ids)])
        same_sizes = np.array_equal(running[cuts[1:]] - running[cuts[:-1]], sizes)
        all_fine = all_fine and same_sizes and b"".join(map(table.__getitem__, flat.tolist())) == joined
    if all_fine:
        return list(range(len(segments)))

    def same(i: int) -> bool:
        return all(b"".join([table[x] for x in ids[i]]) == wholes[i] for ids, table in ((a_ids, t.a_bytes), (b_ids, t.b_bytes)))

    return [i for i in range(len(segments)) if same(i)]


def group_texts(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, cuts: np.ndarray) -> list[str]:
    """Groups written out, for each run of groups between two cuts."""
    group, side = np.concatenate([a_group, b_group]), np.repeat([0, 1], [len(a), len(b)])
    order = np.lexsort((side, group))
    group, side = group[order], side[order]
    ids = np.concatenate([a, b])[order].tolist()
    ends_group = np.append(np.diff(group) != 0, True)
    ends_side = np.append(np.diff(side) != 0, True)
    marks = np.where(ends_group, 2, np.where(ends_side, 1, 0)).tolist()
    written = [f"{x}{',|;'[m]}" for x, m in zip(ids, marks, strict=True)]
    at = np.searchsorted(group, cuts).tolist()
    return ["".join(written[i:j])[:-1] for i, j in zip(at, at[1:])]


class Aligner:
    """Alignments by segment, remembered within a task, as arrays that grow."""

    def __init__(self, a_path: str, b_path: str):
        self.tokenizers = tokenizers(a_path, b_path)
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.sums, self.starts = np.zeros((0, 5), dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.pairs = self.times = np.zeros(0, dtype=np.int64)

    def forget(self) -> None:
        """Keep the segments met first, among which are the frequent ones."""
        self.known = dict(itertools.islice(self.known.items(), FIRST_SEGMENTS))
        n = max(self.known.values(), default=-1) + 1
        self.groups, self.sums, self.starts = self.groups[:n], self.sums[:n].copy(), self.starts[: n + 1].copy()
        self.pairs, self.times = self.pairs[: self.starts[-1]].copy(), self.times[: self.starts[-1]].copy()

    def _learn(self, segments: list[str]) -> None:
        good, batch = align(segments, self.tokenizers)
        self.known.update(dict.fromkeys(segments, -1))
        self.known.update(zip([segments[i] for i in good], range(len(self.sums), len(self.sums) + len(good))))
        self.groups += batch.groups
        self.sums = np.concatenate([self.sums, batch.sums])
        self.starts = np.concatenate([self.starts, batch.starts[1:] + self.starts[-1]])
        self.pairs, self.times = np.concatenate([self.pairs, batch.pairs]), np.concatenate([self.times, batch.times])

    def documents(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts, the numbers of their segments one text after the other, and where each text ends; a text without
        tokens has none."""
        for chunk in _chunks(texts):
            if len(self.known) > CACHED_SEGMENTS or len(self.pairs) > CACHED_PAIRS:
                self.forget()
            cut = [segments_of(text) if text else [] for text in chunk]
            wanted = set().union(*cut).difference(self.known)
            for part in _chunks(sorted(wanted)):
                self._learn(part)
            rows, ends, total = [], [], 0
            for segments in cut:
                row = np.fromiter(map(self.known.__getitem__, segments), dtype=np.int64, count=len(segments))
                if len(row) and row.min() >= 0:
                    rows.append(row)
                    total += len(row)
                ends.append(total)
            for s in wanted:
                if len(s) > CACHED_CHARS:
                    del self.known[s]
            yield np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64), np.array(ends, dtype=np.int64)

    def expanded(self, owner: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, pair and times of every pair of the given segments: a row product with the segment-pair matrix."""
        sizes = np.diff(self.starts)[segment]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.repeat(self.starts[:-1][segment], sizes) + within
        return np.repeat(owner, sizes), self.pairs[at], self.times[at]


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


# -- over Spark -----------------------------------------------------------------------------------


_NAMES = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "pairs", "times")
_ALIGNED_SCHEMA = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_shared bigint, groups_sha256 string, "
    "pairs array<bigint>, times array<int>"
)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def aligned(source: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document its sums, the digest of its groups, and its linked pairs: the id of A times the size of B's vocabulary plus the
    id of B, each once, with the number of its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        for batch in batches:
            first = 0
            for segment, ends in aligner.documents(batch.column("text").to_pylist()):
                sizes = np.diff(ends, prepend=0)
                running = np.concatenate([np.zeros((1, 5), dtype=np.int64), np.cumsum(aligner.sums[segment], axis=0)])
                sums = running[ends] - running[ends - sizes]
                numbered, write = segment.tolist(), aligner.groups.__getitem__
                digests = [
                    hashlib.sha256(";".join(map(write, numbered[end - size : end])).encode()).hexdigest() if size else ""
                    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True)
                ]
                once, often = np.unique(np.repeat(np.arange(len(ends)), sizes) << 32 | segment, return_counts=True)
                owner, pair, times = aligner.expanded(np.arange(len(once)), once & 0xFFFFFFFF)
                key, times = (once >> 32)[owner] << 32 | pair, times * often[owner]
                order = np.argsort(key)
                key, times = key[order], times[order]
                starts = np.flatnonzero(np.diff(key, prepend=-1))
                times = np.add.reduceat(times, starts) if len(starts) else times
                key = key[starts]
                per_document = np.bincount(key >> 32, minlength=len(ends))
                made = [pa.array(sums[:, k]) for k in range(5)]
                made += [pa.array(digests, pa.string()), _lists(key & 0xFFFFFFFF, per_document, pa.int64()), _lists(times, per_document, pa.int32())]
                own = batch.slice(first, len(ends))
                first += len(ends)
                yield pa.RecordBatch.from_arrays([own.column("row"), own.column("doc_id"), *made], names=list(_NAMES))

    return materialise(source.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, _ALIGNED_SCHEMA))


def _flat_list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy(zero_copy_only=False)


def pair_counts(documents: DataFrame) -> DataFrame:
    """``pair`` and ``docs``: in how many documents it is linked. Tasks count their own pairs first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = docs = np.zeros(0, dtype=np.int64)
        for batch in batches:
            pairs, at = np.unique(np.concatenate([pairs, _flat_list(batch.column(0))[0]]), return_inverse=True)
            docs = np.bincount(at, weights=np.concatenate([docs, np.ones(len(at) - len(docs), dtype=np.int64)]), minlength=len(pairs)).astype(np.int64)
            if len(pairs) >= COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(docs)], names=["pair", "docs"])
                pairs = docs = np.zeros(0, dtype=np.int64)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(docs)], names=["pair", "docs"])

    partial = documents.select("pairs").mapInArrow(run, "pair bigint, docs bigint")
    return materialise(partial.groupBy("pair").agg(F.sum("docs").alias("docs")))


def aligned_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: tokens, groups, links, links whose count is the highest of their A id, and the sum of counts."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    documents = aligned(source, a_path, b_path)
    counts = pair_counts(documents)
    width = len(tokenizers(a_path, b_path).b_bytes)
    a_id = F.floor(F.col("pair") / width).cast("int")
    highest = materialise(counts.groupBy(a_id.alias("a")).agg(F.max("docs").alias("highest")))
    best = highest.toArrow()  # one row per id of A's vocabulary at most
    table = counts.orderBy(F.desc("docs"), "pair").limit(TABLE_PAIRS).toArrow()
    pairs, numbers = (table.column(c).to_numpy() for c in ("pair", "docs"))
    order = np.argsort(pairs)
    top = np.zeros(int(max(best.column("a").to_pylist(), default=0)) + 1, dtype=np.int64)
    top[best.column("a").to_numpy()] = best.column("highest").to_numpy()
    # A last entry beyond all pairs ends the search.
    shared = spark.sparkContext.broadcast((np.append(pairs[order], 1 << 62), np.append(numbers[order], 0), top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, numbers, top = shared.value
        for batch in batches:
            pair, sizes = _flat_list(batch.column("pairs"))
            times, _ = _flat_list(batch.column("times"))
            at = np.searchsorted(pairs, pair)
            inside = pairs[at] == pair
            docs = np.where(inside, numbers[at], 0)
            is_best = inside & (docs == top[np.minimum(pair // width, len(top) - 1)])
            ends = np.cumsum(sizes)
            found = []
            for value in (is_best * times, docs * times):
                running = np.concatenate([[0], np.cumsum(value)])
                found.append(pa.array(running[ends] - running[ends - sizes], pa.int64()))
            outside = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~inside], minlength=len(sizes))
            rest = (_lists(x[~inside], outside, pa.int64()) for x in (pair, times))
            kept = [batch.column(c) for c in _NAMES[:8]]
            yield pa.RecordBatch.from_arrays([*kept, *found, *rest], names=[*_NAMES[:8], "n_best", "count_sum", "tail_pairs", "tail_times"])

    schema = _ALIGNED_SCHEMA.split(", pairs ")[0] + ", n_best bigint, count_sum bigint, tail_pairs array<bigint>, tail_times array<bigint>"
    rows = materialise(documents.mapInArrow(run, schema))
    rest = rows.select("row", F.explode(F.arrays_zip("tail_pairs", "tail_times")).alias("t"))
    tail = rest.select("row", F.col("t.tail_pairs").alias("pair"), F.col("t.tail_times").alias("times")).join(counts, "pair")
    is_best = F.col("docs") == F.col("highest")
    met = tail.join(highest, F.floor(F.col("pair") / width).cast("int") == F.col("a")).groupBy("row").agg(
        F.sum(F.when(is_best, F.col("times")).otherwise(0)).alias("tail_best"), F.sum(F.col("docs") * F.col("times")).alias("tail_sum")
    )
    return rows.drop("tail_pairs", "tail_times").join(met, "row", "left").select(
        "doc_id",
        *[c for c in ("n_a", "n_b", "n_groups", "n_links", "n_shared")],
        (F.col("n_best") + F.coalesce("tail_best", F.lit(0))).cast("long").alias("n_best"),
        (F.col("count_sum") + F.coalesce("tail_sum", F.lit(0))).cast("long").alias("count_sum"),
        "groups_sha256",
    )
