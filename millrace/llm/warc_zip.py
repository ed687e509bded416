"""WARC records in ZIP packages: written as stored members with an index, read back by ranges.

A package is a ZIP archive of stored members, as written ``archive/data.warc.gz`` and ``indexes/index.cdx``; all members below
``archive/`` are read by all indexes below ``indexes/``, whose lines name them, and one without an index is an error. Each record is a gzip
member of its own, so that any of them can be read alone. Sizes and offsets are always written in their ZIP64 form. The reader looks at the end of the file, follows the ZIP64 locator to the central directory, finds
the members and reads single records by the byte ranges of the index. Nothing is extracted or read whole.

Pages with equal payloads are stored once: the page with the largest id is the ``response``, the others are ``revisit`` records with the
headers of the response and no payload. Packages are named by a random id; only those that a finished task reports are
read, so a lost executor leaves at most an unused file.

Defined cases: a null payload is empty; a page without id loses against one with id and is written without a record id
number; pages that share the largest id of their payload are all responses; payloads below ``least_bytes`` are always
responses; control characters and blanks of an address are percent-encoded; an empty table writes and reads
nothing; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialise

ARCHIVES, INDEXES = "archive/", "indexes/"
WARC_MEMBER, INDEX_MEMBER = f"{ARCHIVES}data.warc.gz", f"{INDEXES}index.cdx"
#: Records of one reading task's unit of work.
RANGE_RECORDS = 256
GZIP_LEVEL = 6

# Fixed values of the ZIP format: signatures, and the sizes of the parts without names and extras.
LOCAL, CENTRAL, END, END64, LOCATOR64 = (0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50)
LOCAL_SIZE, CENTRAL_SIZE, END_SIZE, END64_SIZE, LOCATOR64_SIZE = 30, 46, 22, 56, 20
FULL16, FULL32, ZIP64_EXTRA, STORED = 0xFFFF, 0xFFFFFFFF, 1, 0


_CONTROLS = re.compile(r"[\x00-\x20\x7f]")


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header_offset: int


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class ZipWriter:
    """Writes stored members one after the other to an output stream that need not seek.

    A member's size and checksum follow its data, in a descriptor.
    """

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, chunks: Iterator[bytes]) -> None:
        start, raw, crc, size = self.at, name.encode(), 0, 0
        extra = struct.pack("<HHQQ", ZIP64_EXTRA, 16, 0, 0)
        self.put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 8, STORED, 0, 33, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)
        for chunk in chunks:
            self.put(chunk)
            crc, size = zlib.crc32(chunk, crc), size + len(chunk)
        self.put(struct.pack("<IIQQ", 0x08074B50, crc, size, size))
        self.members.append((raw, crc, size, start))

    def finish(self) -> None:
        start = self.at
        for raw, crc, size, offset in self.members:
            extra = struct.pack("<HHQQQ", ZIP64_EXTRA, 24, size, size, offset)
            fixed = struct.pack(
                "<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 8, STORED, 0, 33, crc, FULL32, FULL32, len(raw), len(extra), 0, 0, 0, 0, FULL32
            )
            self.put(fixed + raw + extra)
        size, count, end64 = self.at - start, len(self.members), self.at
        self.put(struct.pack("<IQHHIIQQQQ", END64, END64_SIZE - 12, 45, 45, 0, 0, count, count, size, start))
        self.put(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
        self.put(struct.pack("<IHHHHIIH", END, 0, 0, min(count, FULL16), min(count, FULL16), FULL32, FULL32, 0))


class ZipReader:
    """Finds members through the central directory and gives byte ranges of stored ones."""

    def __init__(self, file):
        self.file, self.length = file, file.size()
        self.members = {member.name: member for member in self.directory()}

    def range(self, start: int, size: int) -> bytes:
        if start < 0 or start + size > self.length:
            raise ValueError("the range leaves the archive")
        return self.file.read_at(size, start)

    def directory(self) -> list[Member]:
        tail_at = max(0, self.length - END_SIZE - FULL16)
        tail = self.range(tail_at, self.length - tail_at)
        at = tail.rfind(struct.pack("<I", END))
        while at >= 0 and (at + END_SIZE > len(tail) or at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(struct.pack("<I", END), 0, at)  # the signature inside a comment
        if at < 0:
            raise ValueError("no end of central directory")
        count, size, start = struct.unpack_from("<HII", tail, at + 10)
        if FULL16 == count or FULL32 in (size, start):
            locator = self.range(tail_at + at - LOCATOR64_SIZE, LOCATOR64_SIZE)
            if struct.unpack_from("<I", locator)[0] != LOCATOR64:
                raise ValueError("no ZIP64 locator")
            end64 = self.range(struct.unpack_from("<Q", locator, 8)[0], END64_SIZE)
            if struct.unpack_from("<I", end64)[0] != END64:
                raise ValueError("no ZIP64 end of central directory")
            count, size, start = struct.unpack_from("<QQQ", end64, 32)
        entries, found, at = self.range(start, size), [], 0
        for _ in range(count):
            found.append(self.entry(entries, at))
            at += CENTRAL_SIZE + sum(struct.unpack_from("<HHH", entries, at + 28))
        return found

    def entry(self, entries: bytes, at: int) -> Member:
        if struct.unpack_from("<I", entries, at)[0] != CENTRAL:
            raise ValueError("no central directory entry")
        method, packed, size = (struct.unpack_from(kind, entries, at + i)[0] for kind, i in (("<H", 10), ("<I", 20), ("<I", 24)))
        names, extras = struct.unpack_from("<HH", entries, at + 28)
        offset = struct.unpack_from("<I", entries, at + 42)[0]
        name = entries[at + CENTRAL_SIZE : at + CENTRAL_SIZE + names].decode()
        extra, i = entries[at + CENTRAL_SIZE + names : at + CENTRAL_SIZE + names + extras], 0
        while i + 4 <= len(extra):
            tag, length = struct.unpack_from("<HH", extra, i)
            if tag == ZIP64_EXTRA:  # holds, in this order, only the values that do not fit
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, i + 4))
                size = next(wide) if size == FULL32 else size
                packed = next(wide) if packed == FULL32 else packed
                offset = next(wide) if offset == FULL32 else offset
            i += 4 + length
        return Member(name, method, size, offset)

    def data_start(self, member: Member) -> int:
        if member.method != STORED:
            raise ValueError(f"{member.name} is compressed")
        header = self.range(member.header_offset, LOCAL_SIZE)
        if struct.unpack_from("<I", header)[0] != LOCAL:
            raise ValueError("no local header")
        return member.header_offset + LOCAL_SIZE + sum(struct.unpack_from("<HH", header, 26))

    def below(self, folder: str) -> list[Member]:
        return [m for m in self.members.values() if m.name.startswith(folder) and not m.name.endswith("/")]

    def records(self) -> list[tuple[int, int]]:
        """Places of all records, by every index; a line without a member's name means the only archive member."""
        starts = {m.name: self.data_start(m) for m in self.below(ARCHIVES)}
        found, indexed = [], set()
        for index in self.below(INDEXES):
            for line in self.range(self.data_start(index), index.size).decode().splitlines():
                _, offset, size, *named = line.split(" ", 3)
                if not named and len(starts) != 1:
                    raise ValueError(f"{index.name} does not say which archive member it means")
                name = named[0] if named else next(iter(starts))
                if name not in starts:
                    raise ValueError(f"{index.name} names {name}, which is not in the package")
                indexed.add(name)
                found.append((starts[name] + int(offset), int(size)))
        for name in starts:
            if self.members[name].size and name not in indexed:
                raise ValueError(f"{name} has no index")
        return found


def warc_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_CONTROLS.sub(lambda c: f'%{ord(c.group()):02X}', url)}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def headers_of(block: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in block.decode().split("\r\n")[1:])
    return {name.lower(): value.strip() for name, _, value in pairs}


def page_number(record_id: str | None) -> int | None:
    number = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse_record(record: bytes) -> dict:
    """Type, ids, digest and payload of a record; a response's payload is checked against its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    warc = headers_of(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = warc["warc-payload-digest"].removeprefix("sha1:")
    if warc["warc-type"] == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"payload of {warc['warc-record-id']} does not match its digest")
    return {
        "page_id": page_number(warc["warc-record-id"]),
        "url": warc["warc-target-uri"],
        "record_type": warc["warc-type"],
        "refers_to": page_number(warc.get("warc-refers-to")),
        "payload_digest": digest,
        "payload_bytes": int(headers_of(http)["content-length"]),
        "payload": payload if warc["warc-type"] == "response" else None,
    }


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_packages(pages: DataFrame, folder: str, least_bytes: int = 0, id_col="page_id", url_col="url", payload_col="html") -> DataFrame:
    """Write all pages and return the packages written: ``path``, ``records``.

    Payload digests are aggregated before anything is joined, and the join that carries the payloads is one that
    adaptive execution splits when a payload is frequent. Each of its tasks writes one package.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload")
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    first = (
        rows.filter(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("pages"))
        .filter("pages > 1")
    )
    marked = rows.join(first.select("digest", "response_id"), "digest", "left").select(
        "page_id",
        "url",
        "payload",
        F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id")).alias("refers_to"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        name = f"{base}/pages-{uuid.uuid4().hex}.wacz"
        index: list[str] = []

        def records() -> Iterator[bytes]:
            nonlocal batch
            at = 0
            while batch is not None:
                for row in batch.to_pylist():
                    digest = base32_sha1(row["payload"])
                    revisit = row["refers_to"] is not None
                    record = gzip.compress(
                        warc_record(row["page_id"], row["url"], row["payload"], digest, row["refers_to"], revisit), GZIP_LEVEL, mtime=0
                    )
                    index.append(f"{digest} {at} {len(record)} {WARC_MEMBER}\n")
                    at += len(record)
                    yield record
                batch = next(batches, None)

        with system.open_output_stream(name) as out:
            package = ZipWriter(out)
            package.member(WARC_MEMBER, records())
            package.member(INDEX_MEMBER, (line.encode() for line in index))
            package.finish()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([len(index)], pa.int64())], names=["path", "records"])

    return materialise(marked.mapInArrow(run, "path string, records bigint"))


RECORD_SCHEMA = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"
)


def read_packages(packages: DataFrame, range_records: int = RANGE_RECORDS, payloads: bool = True) -> DataFrame:
    """All records of the packages.

    One task reads the directory and the index of a package; the ranges found are then spread over the cluster, so
    large packages do not hold up the job.
    """

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = opened(path)
                with system.open_input_file(name) as file:
                    package = ZipReader(file)
                    places = package.records()
                for i in range(0, len(places), range_records):
                    offsets, sizes = zip(*places[i : i + range_records], strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([offsets], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64()))],
                        names=["path", "offsets", "sizes"],
                    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, name = opened(row["path"])
                with system.open_input_file(name) as file:
                    found = [
                        parse_record(gzip.decompress(file.read_at(size, offset))) for offset, size in zip(row["offsets"], row["sizes"], strict=True)
                    ]
                if not payloads:
                    found = [record | {"payload": None} for record in found]
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    arrow = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
         ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
    )
    spark: SparkSession = packages.sparkSession
    ranges = packages.select("path").mapInArrow(locate, "path string, offsets array<bigint>, sizes array<bigint>")
    spread = ranges.repartition(spark.sparkContext.defaultParallelism * 4)
    return spread.mapInArrow(read, RECORD_SCHEMA)
