import base64
import gzip
import hashlib
import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.llm import warc_zip as w

PAGES = "page_id bigint, url string, html string"


def written(spark, tmp_path, rows, **options):
    pages = spark.createDataFrame(rows, PAGES).withColumns({"digest": F.lit(1), "payload": F.lit("clash")})
    return w.write_packages(pages, f"file://{tmp_path}/warc", **options)


def brute(rows, least=0):
    found = []
    for page, _, html in rows:
        raw = (html or "").encode()
        best = max((p for p, _, h in rows if (h or "").encode() == raw and p is not None), default=None)
        revisit = len(raw) >= least and best is not None and page != best
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        found.append((page, len(raw), digest, "revisit" if revisit else "response", best if revisit else None))
    return sorted(found, key=str)


def shown(records):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records), key=str)


ROWS = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, "http://a/9", "same"), (4, None, None), (5, "http://a b\r\nx", ""), (6, "u", "é<|\r\n\r\nWARC/1.1"), (None, "n", "same"), (7, "u", "y" * 3_000_000), (8, "u", "dup"), (8, "u", "dup")]


@pytest.mark.parametrize("least", [0, 4, 100])
def test_round_trip(spark, few_partitions, tmp_path, least):
    packages = written(spark, tmp_path, ROWS, least_bytes=least)
    records = w.read_packages(packages, range_records=2).collect()
    assert shown(records) == brute(ROWS, least)
    texts = {r.page_id: bytes(r.payload).decode() for r in records if r.record_type == "response"}
    assert all(texts[page] == (html or "") for page, _, html in ROWS if page in texts)
    assert packages.agg(F.sum("records")).first()[0] == len(ROWS)


def test_packages_are_plain_zip_files(spark, few_partitions, tmp_path):
    for r in written(spark, tmp_path, ROWS).collect():
        with zipfile.ZipFile(r.path.removeprefix("file://")) as package:
            assert package.testzip() is None
            assert {i.filename for i in package.infolist()} == {w.WARC_MEMBER, w.INDEX_MEMBER}
            assert all(i.compress_type == zipfile.ZIP_STORED for i in package.infolist())
            assert gzip.decompress(package.read(w.WARC_MEMBER)).count(b"WARC/1.1\r\nWARC-Type") == r.records


class Ranges:
    """A file that counts what is read of it."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def size(self):
        return len(self.data)

    def read_at(self, size, offset):
        self.read += size
        return self.data[offset : offset + size]


@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 in a comment", b"c" * 65535])
def test_other_archives_and_comments(comment):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        package.writestr("big", b"x" * 2_000_000)
        package.writestr(w.INDEX_MEMBER, b"index")
        package.writestr("packed", b"y" * 1000, compress_type=zipfile.ZIP_DEFLATED)
        package.comment = comment
    file = Ranges(out.getvalue())
    reader = w.ZipReader(file)
    member = reader.members[w.INDEX_MEMBER]
    assert reader.range(reader.data_start(member), member.size) == b"index" and file.read < 300_000
    with pytest.raises(ValueError, match="compressed"):
        reader.data_start(reader.members["packed"])


def test_broken_archives_are_refused():
    for data in (b"", b"PK", b"x" * 100, struct.pack("<IHHHHIIH", w.END, 0, 0, 0xFFFF, 0xFFFF, 0, 0, 0)):
        with pytest.raises(ValueError):
            w.ZipReader(Ranges(data))


def test_damaged_payload_is_noticed():
    record = w.warc_record(1, "u", b"payload", w.base32_sha1(b"payload"), None, False)
    assert w.parse_record(record)["payload"] == b"payload"
    with pytest.raises(ValueError, match="digest"):
        w.parse_record(record.replace(b"payload\r\n", b"pAyload\r\n"))


def test_empty_table(spark, tmp_path):
    packages = written(spark, tmp_path, [])
    assert packages.count() == 0 and w.read_packages(packages).count() == 0


def test_all_archive_members_are_read_and_one_without_index_raises(spark, tmp_path, few_partitions):
    def package(name, indexes):
        records = {}
        for i, member in enumerate(("archive/data.warc.gz", "archive/part-2.warc.gz")):
            payload = f"page {i}".encode()
            records[member] = gzip.compress(w.warc_record(i, f"u{i}", payload, w.base32_sha1(payload), None, False))
        with open(tmp_path / name, "wb") as out:
            writer = w.ZipWriter(out)
            for member, record in records.items():
                writer.member(member, iter([record]))
            for index, member in indexes:
                writer.member(index, iter([f"x 0 {len(records[member])} {member}\n".encode()]))
            writer.finish()
        return spark.createDataFrame([(f"{tmp_path}/{name}",)], "path string")

    first, second = ("indexes/index.cdx", "archive/data.warc.gz"), ("indexes/part-2.cdx", "archive/part-2.warc.gz")
    rows = w.read_packages(package("two.wacz", [first, second])).collect()
    assert {r.page_id: bytes(r.payload) for r in rows} == {0: b"page 0", 1: b"page 1"}
    with pytest.raises(Exception, match="part-2.warc.gz has no index"):
        w.read_packages(package("lost.wacz", [first])).collect()
