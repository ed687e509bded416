"""Exact n-gram Jaccard join with PartEnum signatures.

Two texts link when the Jaccard similarity of their shingle sets is at least 3/4. Such sets of sizes a and b differ in at most
(a + b) / 7 members and neither is more than 4/3 of the other. Sizes are split into bands with that ratio; instance i of
the scheme serves the bands i and i + 1, so every linking pair meets in one instance, which has a fixed bound k on the
difference. The instance hashes the domain of shingles into first-level and second-level partitions and signs subsets of
them: of ``n1`` first-level partitions one at least holds at most ``k2`` of the k differences, as ``n1 * (k2 + 1) > k``, and in it all
subsets of ``n2 - k2`` of its ``n2`` second-level partitions are signed, one of which is free of them. Sets that link share a
signature; nothing is missed. With k up to three there is one first-level partition; beyond, two of every three second-level ones are signed.

1. One pass writes, per document, the size and a digest of its set and, for its two instances, the counts of its members per cell.
2. A second pass emits signatures, packed per bucket, and finds in each bucket those that several documents share. The
   members of a signature become rows of a *unit*, named by the smallest member: as many rows as members, never pairs.
   A signature frequent within one batch is dealt over several buckets and is a unit of its own. The smallest document of each set
   stands for all its copies; the others are not signed, so a group of copies is one member however many tasks hold it.
3. A unit's members are compared by cell counts, whose differences bound that of the sets from below; who is close to nobody leaves.
4. The sets of the few remaining documents are computed again and compared exactly. Members that are close to each other in any unit
   form a cluster; a cluster of up to ``unit_docs`` documents and ``unit_shingles`` members of their sets is compared as a whole, so each
   set is sent once. Larger clusters are compared unit by unit, and units above these sizes are split into blocks of which every two are
   compared in a task of their own.
   Each comparison gives the edges of a forest.
5. Components over those edges and those between equal sets, by distributed star contraction.

A first-level partition is strong if none of its subsets is empty. At most
``D // (k2 + 1)`` partitions hold more than ``k2`` of a set's D possible differences, so a set with more strong partitions than that
meets its partners in one of them. A set with fewer also signs under the next draw of the hash, as its partner then does unless it
has enough itself; after ``DRAWS`` of them, which hardly a set needs, empty subsets are signed too.

Defined cases: a null text has no words, hence an empty set, and links with nothing, as does any text without words; texts of one
to four words have their whole sequence as one shingle; a very long text is hashed in segments and its set, of any size, takes part
like others, in blocks of its own where it exceeds ``unit_shingles``; rows of equal id are one vertex; a row without id links with nothing and
takes the component of an equal set, or null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, text_of
from millrace.llm.components import components
from millrace.llm.shingles import U64, mix, shingle_sets

#: Signatures of one bucket, roughly; the number of buckets follows from the corpus.
BUCKET_SIGNATURES = 400_000
#: Buckets are dealt over so many partitions at most; a partition takes its buckets one after the other.
MOST_PARTITIONS = 20_000
#: Documents of one cluster or unit compared in one task, and members of their sets, of 8 bytes.
UNIT_DOCS = 10_000
UNIT_SHINGLES = 8_000_000
#: So many document ids, of 8 bytes, may be broadcast; above that they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Signatures a task holds before it packs them; members of one signature among them that make it frequent.
SIGNATURES_HELD, FREQUENT = 1_500_000, 500
#: Hashes of the domain tried for a set with few strong partitions.
DRAWS = 5
#: Sets remembered by a task so that repeated rows are signed once.
SETS_HELD = 500_000

_LARGEST = 1 << 32
_INSTANCE_BITS = 7
_SIGNATURE_BYTES = 6


@lru_cache(maxsize=1)
def bands() -> np.ndarray:
    """Smallest set size of each band."""
    limits = [1]
    while limits[-1] < _LARGEST:
        limits.append(max(limits[-1] + 1, limits[-1] * 4 // 3))
    return np.array(limits, dtype=np.int64)


class Scheme(NamedTuple):
    """Signature scheme of an instance: partitions, tolerated differences and the cells of the counts."""

    n1: int
    n2: int
    k2: int
    cells: int
    top: int  # largest set of the band above
    own_top: int  # largest set of the own band


@lru_cache(maxsize=None)
def scheme(instance: int) -> Scheme:
    limits = bands()
    own_top = int(limits[instance + 1]) - 1
    top = min(own_top * 4 // 3, int(limits[instance + 2]) - 1)
    k = (own_top + top) // 7
    if k <= 3:  # all subsets of a single first-level partition
        return Scheme(1, k + 2 if k else 1, k, 16, top, own_top)
    # Two of three second-level partitions; some more first-level ones than needed, so that most sets have enough strong ones.
    n = math.ceil(1.07 * (k // 2 + 1) + 1.2 * math.sqrt(k // 2))
    return Scheme(n, 3, 1, 2 * n, top, own_top)


def most_differences(size: np.ndarray, s: Scheme) -> np.ndarray:
    """Largest difference a set of that size may have to a partner within the instance."""
    partner = np.minimum(np.where(size <= s.own_top, s.top, s.own_top), size * 4 // 3)
    return (size + partner) // 7


def _place(members: np.ndarray, instance: int, parts: int, draw: int = 0) -> np.ndarray:
    return (mix(members + U64(instance + 1 + (draw << _INSTANCE_BITS))) >> U64(32)).astype(np.int64) * parts >> 32


def instances_of(size: int) -> list[int]:
    band = int(np.searchsorted(bands(), size, side="right")) - 1
    return [band] if band == 0 or size > scheme(band - 1).top else [band, band - 1]


def cell_counts(members: np.ndarray, instance: int) -> bytes:
    s = scheme(instance)
    counts = np.bincount(_place(members, instance, s.cells), minlength=s.cells)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def signatures(members: np.ndarray, instance: int) -> np.ndarray:
    """The set's signatures in an instance; the lowest bits of each name the instance."""
    s = scheme(instance)
    parts = s.n1 * s.n2
    bad = int(most_differences(np.int64(len(members)), s)) // (s.k2 + 1)
    subsets = np.array(list(itertools.combinations(range(s.n2), s.n2 - s.k2)))
    number = np.arange(1, s.n1 * len(subsets) + 1, dtype=U64)
    signed = []
    for draw in range(DRAWS):
        place = _place(members, instance, parts, draw)
        content = np.zeros(parts, dtype=U64)
        np.add.at(content, place, mix(members ^ U64(0x5851F42D4C957F2D)))
        content = mix(content + np.arange(1, parts + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).reshape(s.n1, s.n2)
        filled = np.zeros(parts, dtype=bool)
        filled[place] = True
        filled = filled.reshape(s.n1, s.n2)
        enough = int((filled.sum(axis=1) > s.k2).sum()) > bad
        chosen = mix(content[:, subsets].sum(axis=2, dtype=U64).reshape(-1) + number)
        if enough or draw + 1 < DRAWS:
            chosen = chosen[filled[:, subsets].any(axis=2).reshape(-1)]
        signed.append(mix(chosen + U64(instance + 1 + (draw << _INSTANCE_BITS))))
        if enough:
            break
    return np.concatenate(signed) & ~U64((1 << _INSTANCE_BITS) - 1) | U64(instance)


PROFILE_SCHEMA = (
    "doc_id bigint, n_shingles bigint, digest binary, instance_a int, cells_a binary, instance_b int, cells_b binary"
)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def _digest(members: np.ndarray) -> bytes:
    sums = (mix(members + U64(c)).sum(dtype=U64) for c in (11, 13))
    return b"".join(int(x).to_bytes(8, "little") for x in sums)


def _sets_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for row, sizes, members in shingle_sets(batch.column("text")):
        at = 0
        for i, size in enumerate(sizes.tolist()):
            yield row + i, members[at : at + size]
            at += size


def profiles(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for _, members in _sets_of(batch):
                size = len(members)
                own = [(i, cell_counts(members, i)) for i in instances_of(size)] if size else []
                own += [(None, None)] * (2 - len(own))
                rows.append((size, _digest(members) if size else None, *own[0], *own[1]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
            arrays = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [field.split()[0] for field in PROFILE_SCHEMA.split(", ")]
    return materialise(_source(docs, id_col, text_col).mapInArrow(run, PROFILE_SCHEMA))


PACKED_SCHEMA = "bucket int, kind int, base bigint, wide boolean, signatures binary, docs binary"
UNIT_SCHEMA = "unit bigint, instance int, frequent boolean, doc_id bigint"
_SHARED, _FREQUENT_MEMBERS, _FREQUENT_NAMES = 0, 1, 2


def _bucket(signature: np.ndarray, buckets: int) -> np.ndarray:
    return ((signature >> U64(32)).astype(np.int64) * buckets) >> 32


def _packed(signature: np.ndarray) -> bytes:
    return signature.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_SIGNATURE_BYTES].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    full = np.zeros((len(data) // _SIGNATURE_BYTES, 8), dtype=np.uint8)
    full[:, :_SIGNATURE_BYTES] = np.frombuffer(data, dtype=np.uint8).reshape(-1, _SIGNATURE_BYTES)
    return full.view("<u8").reshape(-1)


def without(docs: DataFrame, column: Column, ids: DataFrame, broadcast_ids: int) -> DataFrame:
    """Rows of ``docs`` whose id is not in the written one-column table ``ids``; that is broadcast only up to a bound."""
    name = ids.columns[0]
    if ids.count() <= broadcast_ids:
        ids = F.broadcast(ids)
    return docs.join(ids, column == ids[name], "left_anti")


def signed_buckets(source: DataFrame, buckets: int, frequent: int) -> DataFrame:
    """Signatures and their documents, packed into one row per bucket for every ``SIGNATURES_HELD`` of a task."""

    def rows_of(signature: np.ndarray, doc: np.ndarray) -> Iterator[tuple]:
        runs = np.sort(signature)
        first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
        hot = runs[first][np.diff(np.append(first, len(runs))) >= frequent]
        if len(hot):
            for name in hot:
                bucket, own = int(_bucket(np.array([name]), buckets)[0]), doc[signature == name]
                yield bucket, _FREQUENT_NAMES, 0, False, _packed(np.array([name])), b""
                salted = (bucket + int(own[0])) % buckets
                yield salted, _FREQUENT_MEMBERS, 0, True, _packed(np.array([name])), own.astype("<i8").tobytes()
            rest = ~np.isin(signature, hot)
            signature, doc = signature[rest], doc[rest]
        if not len(signature):
            return
        place = _bucket(signature, buckets)
        order = np.argsort(place.astype(np.uint16) if buckets <= 1 << 16 else place, kind="stable")
        place, signature, doc = place[order], signature[order], doc[order]
        cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
        for start, stop in itertools.pairwise(cuts.tolist()):
            own = doc[start:stop]
            base = int(own.min())
            wide = int(own.max()) - base >= 1 << 32
            packed = own.astype("<i8") if wide else (own - base).astype("<u4")
            yield int(place[start]), _SHARED, base, wide, _packed(signature[start:stop]), packed.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        found: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []
        held = 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for row, members in _sets_of(batch):
                if not len(members) or ids[row] is None:
                    continue
                digest = _digest(members)
                if digest in seen:
                    continue
                if len(seen) >= SETS_HELD:
                    seen.clear()
                seen.add(digest)
                own = [signatures(members, i) for i in instances_of(len(members))]
                found += own
                owners.append((ids[row], sum(map(len, own))))
                held += owners[-1][1]
                if held >= SIGNATURES_HELD:
                    yield packed_rows(found, owners)
                    found, owners, held = [], [], 0
        if found:
            yield packed_rows(found, owners)

    def packed_rows(found: list[np.ndarray], owners: list[tuple[int, int]]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        doc = np.repeat(*(np.array(x, dtype=np.int64) for x in zip(*owners, strict=True)))
        rows = zip(*rows_of(np.concatenate(found), doc), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)

    names = [field.split()[0] for field in PACKED_SCHEMA.split(", ")]
    return source.mapInArrow(run, PACKED_SCHEMA)


def by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Complete groups of rows that are sorted by their first ``keys`` columns."""
    current, held = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if row[:keys] != current:
                if held:
                    yield current, held
                current, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield current, held


def _shared_units(rows: list[tuple]) -> np.ndarray:
    """Units of one bucket: columns unit, instance, frequent, doc."""
    low = U64((1 << _INSTANCE_BITS) - 1)
    hot = {name for kind, _, _, packed, _ in rows if kind == _FREQUENT_NAMES for name in _unpacked(packed).tolist()}
    signature, doc, made = [], [], []
    for kind, base, wide, packed, docs in rows:
        if kind == _FREQUENT_MEMBERS:
            name, own = _unpacked(packed)[0], np.frombuffer(docs, dtype="<i8")
            made.append(np.stack([np.full(len(own), name.astype(np.int64)), np.full(len(own), int(name & low)), np.ones(len(own), np.int64), own]))
        elif kind == _SHARED:
            signature.append(_unpacked(packed))
            doc.append(np.frombuffer(docs, dtype="<i8") if wide else base + np.frombuffer(docs, dtype="<u4").astype(np.int64))
    if signature:
        signature, doc = np.concatenate(signature), np.concatenate(doc)
        order = np.lexsort((doc, signature))
        signature, doc = signature[order], doc[order]
        starts = np.concatenate([[True], signature[1:] != signature[:-1]])
        unit = doc[np.flatnonzero(starts)][np.cumsum(starts) - 1]
        is_hot = np.isin(signature, np.array(sorted(hot), dtype=U64)) if hot else np.zeros(len(doc), dtype=bool)
        several = ~starts | np.append(~starts[1:], False)
        keep = several | is_hot
        unit = np.where(is_hot, signature.astype(np.int64), unit)
        made.append(np.stack([unit, (signature & low).astype(np.int64), is_hot.astype(np.int64), doc])[:, keep])
    return np.unique(np.concatenate(made, axis=1), axis=1) if made else np.zeros((4, 0), dtype=np.int64)


def shared_units(packed: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, 1):
            unit, instance, frequent, doc = _shared_units(rows)
            columns = [pa.array(unit), pa.array(instance.astype(np.int32)), pa.array(frequent.astype(bool)), pa.array(doc)]
            yield pa.RecordBatch.from_arrays(columns, names=["unit", "instance", "frequent", "doc_id"])

    dealt = packed.repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, UNIT_SCHEMA).distinct()


def joined_units(units: DataFrame) -> DataFrame:
    """Units whose first member belongs to a smaller one go into that one as a whole.

    The signatures of a group of near copies have different smallest members, most of which are found in the unit
    of the smallest of all. A unit moves once and in one piece, so members stay together.
    """
    own = units.filter("NOT frequent")
    home = own.groupBy("instance", F.col("doc_id").alias("unit")).agg(F.min("unit").alias("home"))
    moved = own.join(home, ["unit", "instance"], "left").select(F.coalesce("home", "unit").alias("unit"), "instance", "frequent", "doc_id")
    return moved.distinct().unionByName(units.filter("frequent"))


_KEY = ["unit", "instance", "frequent", "block"]


def in_blocks(units: DataFrame, unit_docs: int, unit_shingles: int) -> DataFrame:
    """``block`` 0 for units of usual size; members of larger ones once for each pair of blocks they take part in.

    No set of an instance is larger than its scheme's largest, which bounds the sets of a block as well.
    """
    docs = F.count(F.lit(1))
    largest = F.get(F.array(*[F.lit(scheme(i).top) for i in range(len(bands()) - 2)]), F.col("instance"))
    blocks = F.least(docs, F.greatest(F.ceil(docs / unit_docs), F.ceil(docs * F.col("largest") / unit_shingles)))
    large = (
        units.groupBy("unit", "instance", "frequent", largest.alias("largest"))
        .agg(blocks.cast("int").alias("blocks"))
        .filter("blocks > 1")
        .drop("largest")
    )
    if large.isEmpty():
        return units.withColumn("block", F.lit(0).cast("long"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("long"))
    pair = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1),
        lambda other: F.least(other, F.col("own")) * F.col("blocks") + F.greatest(other, F.col("own")),
    )
    return (
        units.join(large, ["unit", "instance", "frequent"], "left")
        .withColumn("own", F.when(F.col("blocks").isNotNull(), own))
        .select("unit", "instance", "frequent", "doc_id", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pair)).alias("block"))
    )


def _reach(n: int, near) -> Iterator[list[tuple[int, int]]]:
    """Components of n members as lists of forest edges; ``near(i, others)`` masks those close to i."""
    left = np.arange(n)
    while len(left):
        queue, left, edges = [int(left[0])], left[1:], []
        while queue and len(left):
            member = queue.pop()
            hit = near(member, left)
            edges += [(member, int(other)) for other in left[hit]]
            queue += left[hit].tolist()
            left = left[~hit]
        yield edges


def close_members(units: DataFrame, profile: DataFrame, unit_docs: int, unit_shingles: int) -> DataFrame:
    """Members that may link with another one of their unit, with the number of their part of it."""

    def near_of(sizes: np.ndarray, cells: np.ndarray):
        def near(member: int, others: np.ndarray) -> np.ndarray:
            a, b = sizes[member], sizes[others]
            apart = np.abs(cells[others] - cells[member]).sum(axis=1, dtype=np.int64)
            return (apart <= (a + b) // 7) & (3 * np.maximum(a, b) <= 4 * np.minimum(a, b))

        return near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, rows in by_key(batches, len(_KEY)):
            docs, sizes, cells = zip(*rows, strict=True)
            counts = np.frombuffer(b"".join(cells), dtype=np.uint8).reshape(len(docs), -1).astype(np.int16)
            for part, edges in enumerate(_reach(len(docs), near_of(np.array(sizes), counts))):
                members = {docs[i] for edge in edges for i in edge}
                out += [(*key, part, min(members), doc) for doc in members]
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        columns = zip(zip(*rows, strict=True), kinds, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=[*_KEY, "part", "hub", "doc_id"])

    both = [
        profile.filter("doc_id IS NOT NULL").select("doc_id", F.col(f"instance_{x}").alias("instance"), "n_shingles", F.col(f"cells_{x}").alias("cells"))
        for x in "ab"
    ]
    cells = both[0].unionByName(both[1]).filter("instance IS NOT NULL")
    rows = in_blocks(units, unit_docs, unit_shingles).join(cells, ["doc_id", "instance"]).select(*_KEY, "doc_id", "n_shingles", "cells")
    dealt = rows.repartition(*_KEY).sortWithinPartitions(*_KEY)
    return materialise(dealt.mapInArrow(run, "unit bigint, instance int, frequent boolean, block bigint, part int, hub bigint, doc_id bigint"))


def _exact_near(sets: list[np.ndarray]):
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    starts = np.searchsorted(column[order], np.arange(column.max() + 2))
    by_column, ends = owner[order], np.cumsum(sizes)

    def near(member: int, others: np.ndarray) -> np.ndarray:
        own = column[ends[member] - sizes[member] : ends[member]]
        shared = np.bincount(np.concatenate([by_column[starts[c] : starts[c + 1]] for c in own]), minlength=len(sets))[others]
        return 100 * shared >= 75 * (sizes[member] + sizes[others] - shared)

    return near


def in_clusters(members: DataFrame, profile: DataFrame, unit_docs: int, unit_shingles: int) -> DataFrame:
    """Members by cluster, with ``unit`` its number; those of larger clusters stay in their units."""
    key = [*_KEY, "part"]
    cluster = components(members.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")))
    sizes = profile.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("n_shingles").alias("size"))
    sized = materialise(cluster.join(sizes, cluster["vertex"] == sizes["doc_id"]).select("vertex", "component", "size"))
    large = (
        sized.groupBy("component").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("shingles"))
        .filter((F.col("docs") > unit_docs) | (F.col("shingles") > unit_shingles)).select("component")
    )
    whole = sized.join(large, "component", "left_anti").select(
        F.col("component").alias("unit"),
        F.lit(-1).alias("instance"),
        F.lit(False).alias("frequent"),
        F.lit(0).cast("long").alias("block"),
        F.lit(0).alias("part"),
        F.col("vertex").alias("doc_id"),
    )
    if large.isEmpty():
        return whole
    apart = sized.join(large, "component", "left_semi").select(F.col("vertex").alias("doc_id"))
    return whole.unionByName(members.select(*key, "doc_id").join(apart, "doc_id", "left_semi"))


def links(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, broadcast_ids: int) -> DataFrame:
    """Edges of a forest over each cluster or part of a unit, by exact comparison of the members' sets."""
    key = [*_KEY, "part"]

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([members.tobytes() for _, members in _sets_of(batch)], pa.binary())
            yield batch.drop_columns(["text"]).append_column("members", sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, len(key)):
            docs = [doc for doc, _ in rows]
            if len(docs) < 2:
                continue
            near = _exact_near([np.frombuffer(raw, dtype=U64) for _, raw in rows])
            edges = [(docs[i], docs[j]) for found in _reach(len(docs), near) for i, j in found]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], names=["a", "b"])

    source, places = _source(docs, id_col, text_col), members.select(*key, "doc_id")
    kinds = "unit bigint, instance int, frequent boolean, block bigint, part int"
    if places.count() <= broadcast_ids:
        sets = source.join(F.broadcast(places), "doc_id").select(*key, "doc_id", "text").mapInArrow(to_sets, f"{kinds}, doc_id bigint, members binary")
    else:
        wanted = source.join(places.select("doc_id").distinct(), "doc_id", "left_semi")
        sets = places.join(wanted.mapInArrow(to_sets, "doc_id bigint, members binary"), "doc_id").select(*key, "doc_id", "members")
    dealt = sets.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "a bigint, b bigint")


def equal_sets(profile: DataFrame) -> DataFrame:
    """The smallest document of each set that several rows have."""
    return (
        profile.filter("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"))
        .filter("rows > 1")
        .select("digest", "first_id")
    )


def copies_of(profile: DataFrame, first: DataFrame) -> DataFrame:
    """The documents, as ``copy``, whose set a smaller document has. An id of several rows may have several sets;
    it then stays as it is, since only one of its sets has that representative."""
    single = profile.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("digest"), F.max("digest").alias("other"))
    same = single.filter("digest = other").join(first, "digest").filter("doc_id > first_id")
    return same.select(F.col("doc_id").alias("copy"))


def linked_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_signatures: int = BUCKET_SIGNATURES,
    unit_docs: int = UNIT_DOCS,
    unit_shingles: int = UNIT_SHINGLES,
    frequent: int = FREQUENT,
    broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, one row per document."""
    profile = profiles(docs, id_col, text_col)
    shingles = profile.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(shingles * 3 / 4 / bucket_signatures))
    first = materialise(equal_sets(profile))
    copies = materialise(copies_of(profile, first))
    source = _source(docs, id_col, text_col)
    packed = signed_buckets(without(source, source["doc_id"], copies, broadcast_ids), buckets, frequent)
    units = materialise(joined_units(materialise(shared_units(packed, buckets))))
    close = close_members(units, profile, unit_docs, unit_shingles)
    members = materialise(in_clusters(close, profile, unit_docs, unit_shingles))
    edges = links(members, docs, id_col, text_col, broadcast_ids)
    same = profile.filter("doc_id IS NOT NULL").join(first, "digest").select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))
    labels = components(edges.unionByName(same))
    named = (
        profile.filter("doc_id IS NOT NULL")
        .join(labels, F.col("doc_id") == F.col("vertex"), "left")
        .select("doc_id", "n_shingles", _or_self("component"))
    )
    nameless = (
        profile.filter("doc_id IS NULL")
        .join(first, "digest", "left")
        .join(labels, F.col("first_id") == F.col("vertex"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "first_id").alias("component_id"))
    )
    return named.unionByName(nameless)


def _or_self(label: str) -> Column:
    return F.coalesce(F.col(label), F.col("doc_id")).alias("component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest id stays, with its own columns.

    Rows without id stay.
    """
    found = linked_components(docs, id_col, text_col, **options)
    lost = materialise(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("lost_id")).distinct())
    return without(docs, docs[id_col].cast("long"), lost, options.get("broadcast_ids", BROADCAST_IDS))
