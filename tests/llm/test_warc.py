"""Packages: round trips, plain and ZIP64 directories, range reads, messy rows."""

import hashlib
import io
import struct
import zipfile

import pytest

from pollgauge.llm.warc import (
    PackageWriter, build_record, locate_package, locate_records, parse_record, plan_records, read_directory, read_range, read_records,
    read_tasks, resolve_revisits, write_packages,
)
from pollgauge.session import work_path

PAGES = "page_id bigint, url string, html string, payload string, refers_to string"


def archive(spark, rows, **options):
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)
    folder = work_path(spark, "packages")
    manifest = write_packages(plan_records(pages), folder, **options)
    return manifest, read_records(locate_records(manifest, folder, range_bytes=2000), folder, read_tasks(manifest))


def package(records, **zip_options):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", **zip_options) as z:
        z.writestr("archive/data.warc.gz", b"".join(records))
        at, lines = 0, []
        for r in records:
            lines.append(f'key 1970 {{"offset": "{at}", "length": "{len(r)}", "filename": "data.warc.gz"}}')
            at += len(r)
        z.writestr("indexes/index.cdxj", "\n".join(lines), compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6 in the comment"
    return out.getvalue()


RECORDS = [build_record("response", f"<urn:page:{i}:x>", "http://a.example/é\r\nX: 1", (b"\r\n\r\n" + bytes([65 + i])) * i, None) for i in range(5)]


@pytest.mark.parametrize("limit", [None, 10])
def test_plain_and_zip64_directories(monkeypatch, limit):
    if limit is not None:  # the library then writes ZIP64 fields for these small members
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw = package(RECORDS)
    assert (b"PK\6\7" in raw) == (limit is not None)
    file = io.BytesIO(raw)
    found = list(locate_package(file, len(raw)))
    assert [parse_record(read_range(file, s, n))[1] for _, s, n in found] == [(b"\r\n\r\n" + bytes([65 + i])) * i for i in range(5)]


def test_own_packages_are_zip_files():
    out = io.BytesIO()
    writer = PackageWriter(out)
    for name in ("archive/data.warc.gz", "indexes/é.cdxj"):
        writer.begin(name)
        writer.write(b"one")
        writer.write(b"two")
        writer.end()
    size = writer.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        assert z.testzip() is None and [(i.filename, z.read(i)) for i in z.infolist()] == [("archive/data.warc.gz", b"onetwo"), ("indexes/é.cdxj", b"onetwo")]
    assert size == len(out.getvalue()) and [m["size"] for m in read_directory(out, size)] == [6, 6]


def test_compressed_archives_and_broken_files_are_refused():
    raw = package(RECORDS, compression=zipfile.ZIP_DEFLATED)
    with pytest.raises(ValueError, match="compressed"):
        list(locate_package(io.BytesIO(raw), len(raw)))
    with pytest.raises(ValueError, match="not a ZIP"):
        read_directory(io.BytesIO(b"x" * 100), 100)
    with pytest.raises(ValueError, match="outside"):
        read_range(io.BytesIO(b"abc"), 1, 5)
    broken = bytearray(package(RECORDS))
    at = broken.find(b"PK\1\2")
    broken[at:at + 4] = struct.pack("<4s", b"XX\1\2")
    with pytest.raises(ValueError, match="directory"):
        read_directory(io.BytesIO(bytes(broken)), len(broken))


def test_messy_pages(spark):
    big, long = "é" * 600, "word " * 200_000
    rows = [(1, "u", big), (5, None, big), (3, "u\r\nv", big), (None, "u", big), (5, "u", big), (7, "u", None), (8, "u", ""), (9, "u", "a\r\n\r\nb"), (10, "u", "a\r\n\r\nb"), (11, "u", long)]
    manifest, records = archive(spark, rows, package_bytes=500)
    assert manifest.count() > 1
    got = sorted((r.record_id.split(":")[2], r.record_type, r.refers_to and r.refers_to.split(":")[2], r.payload_bytes, r.payload_digest) for r in resolve_revisits(records).collect())
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [("1", "revisit", "5", 1200, sha(big)), ("5", "response", None, 1200, sha(big)), ("3", "revisit", "5", 1200, sha(big)), ("", "revisit", "5", 1200, sha(big)),
            ("5", "response", None, 1200, sha(big)), ("7", "response", None, 0, sha("")), ("8", "response", None, 0, sha("")), ("9", "response", None, 6, sha("a\r\n\r\nb")),
            ("10", "response", None, 6, sha("a\r\n\r\nb")), ("11", "response", None, 1_000_000, sha(long))]
    assert got == sorted(want)
    assert {r.payload.decode() for r in records.filter("record_type = 'response'").collect()} == {big, long, "", "a\r\n\r\nb"}


def test_empty_table(spark):
    manifest, records = archive(spark, [])
    assert manifest.count() == 0 and records.count() == 0 and resolve_revisits(records).count() == 0


def test_packages_outside_the_manifest_are_not_read(spark):
    pages = spark.createDataFrame([(1, "u", "a", "", "")], PAGES)
    folder = work_path(spark, "packages")
    write_packages(plan_records(pages), folder)  # as an attempt whose executor was lost
    manifest = write_packages(plan_records(pages), folder)
    assert read_records(locate_records(manifest, folder), folder, 2).count() == 1


def test_an_index_of_two_gzip_members_is_read_whole():
    import gzip

    lines = [f'key 1970 {{"offset": "{sum(map(len, RECORDS[:i]))}", "length": "{len(r)}", "filename": "data.warc.gz"}}\n'.encode() for i, r in enumerate(RECORDS)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/data.warc.gz", b"".join(RECORDS))
        z.writestr("indexes/index.cdx.gz", gzip.compress(b"".join(lines[:2])) + gzip.compress(b"".join(lines[2:])))
    raw = out.getvalue()
    assert len(list(locate_package(io.BytesIO(raw), len(raw)))) == len(RECORDS)
