"""Web archives in ZIP packages: write records, and read them by range without extracting anything.

A package is a ZIP file with stored (uncompressed) members: `archive/*.warc.gz`, where every record is a gzip member
of its own, and `indexes/*.cdxj`, one line of offset and length for each record. The reader parses the end record,
the ZIP64 end record and the central directory, finds where the data of a stored member starts, reads the index,
and then reads each record by its range. Directories are always written in ZIP64 form, so packages of any size work.

Files are reached through pyarrow's file systems on the shared folder, which every executor sees. A task may run
twice when an executor is lost: each attempt writes packages of its own, and only those in the manifest, which is
an ordinary Spark table, are ever read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollgauge.llm.registry import corpus_query, table
from pollgauge.session import materialise, work_path

PACKAGE_BYTES = 128 << 20  # a package is closed when its archive has this size
RANGE_BYTES = 1 << 20  # neighbouring records that one read fetches
TASK_BYTES = 64 << 20  # what one task reads
PACKAGES_PER_TASK = 4  # packages whose directory and index one task reads
MIN_REVISIT_BYTES = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FULL32 = 0xFFFFFFFF


# ---- ZIP packages


class PackageWriter:
    """Streams stored members into a ZIP64 file; nothing but the directory is held in memory."""

    def __init__(self, out):
        self.out, self.at, self.entries = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.offset, self.crc, self.size = name.encode(), self.at, 0, 0
        head = struct.pack("<4s5H3I2H", b"PK\3\4", 45, 0x0808, 0, 0, 0x21, 0, FULL32, FULL32, len(self.name), 20)
        self._put(head + self.name + struct.pack("<2H2Q", 1, 16, 0, 0))
        self.data_at = self.at

    def write(self, data: bytes) -> int:
        """Append to the open member; returns where in it the data starts."""
        start = self.size
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)
        self._put(data)
        return start

    def end(self) -> None:
        self._put(struct.pack("<4sI2Q", b"PK\7\x08", self.crc, self.size, self.size))
        self.entries.append((self.name, self.crc, self.size, self.offset))

    def close(self) -> int:
        start = self.at
        for name, crc, size, offset in self.entries:
            extra = struct.pack("<2H3Q", 1, 24, size, size, offset)
            self._put(struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 0x0808, 0, 0, 0x21, crc, FULL32, FULL32, len(name), len(extra), 0, 0, 0, 0, FULL32) + name + extra)
        size, end, n = self.at - start, self.at, len(self.entries)
        self._put(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self._put(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, FULL32, FULL32, 0))
        return self.at


def read_range(file, start: int, length: int) -> bytes:
    file.seek(start)
    data = file.read(length)
    if len(data) != length:
        raise ValueError(f"range {start}+{length} lies outside the file")
    return data


def read_directory(file, size: int) -> list[dict]:
    """Members of a ZIP file: name, method, stored size and offset, from the plain or the ZIP64 directory."""
    tail_at = max(0, size - 65_557)
    tail = read_range(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\5\6", 0, end)  # the signature may also stand in the comment
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    total, dir_size, dir_at = struct.unpack_from("<HII", tail, end + 10)
    if total == 0xFFFF or FULL32 in (dir_size, dir_at):
        locator_at = tail_at + end - 20
        mark, _, end64, _ = struct.unpack("<4sIQI", read_range(file, locator_at, 20))
        if mark != b"PK\6\7":
            raise ValueError("no ZIP64 locator before the end record")
        mark, *_, total, dir_size, dir_at = struct.unpack("<4sQ2H2I4Q", read_range(file, end64, 56))
        if mark != b"PK\6\6":
            raise ValueError("no ZIP64 end record where the locator points")
    directory, at, members = read_range(file, dir_at, dir_size), 0, []
    for _ in range(total):
        if directory[at:at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<II3H", directory, at + 20)
        offset, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46:at + 46 + n_name].decode("utf-8", "replace")
        extra = directory[at + 46 + n_name:at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<2H", extra)
            if kind == 1:  # holds only the fields that are full in the plain entry, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = next(wide) if full == FULL32 else full
                packed = next(wide) if packed == FULL32 else packed
                offset = next(wide) if offset == FULL32 else offset
            extra = extra[4 + n:]
        members.append({"name": name, "method": method, "size": packed, "offset": offset})
        at += 46 + n_name + n_extra + n_comment
    return members


def member_start(file, member: dict) -> int:
    """Where the data of a member starts; its local header may have other lengths than the directory."""
    head = read_range(file, member["offset"], 30)
    if head[:4] != b"PK\3\4":
        raise ValueError("no local header where the directory points")
    n_name, n_extra = struct.unpack_from("<2H", head, 26)
    return member["offset"] + 30 + n_name + n_extra


def locate_package(file, size: int) -> Iterator[tuple[str, int, int]]:
    """(archive member, absolute start, length) of every record that the package's indexes list."""
    members = read_directory(file, size)
    archives = {}
    for m in members:
        if m["name"].startswith("archive/") and not m["name"].endswith("/"):
            if m["method"] != 0:
                raise ValueError(f"{m['name']} is compressed in the package, so its records cannot be read by range")
            archives[m["name"].rpartition("/")[2]] = (m["name"], member_start(file, m), m["size"])
    for m in members:
        if m["name"].startswith("indexes/") and not m["name"].endswith("/"):
            raw = read_range(file, member_start(file, m), m["size"])
            if m["method"] == 8:
                raw = zlib.decompress(raw, -15)
            if m["name"].endswith(".gz"):
                raw = gzip.decompress(raw)  # all members: block-compressed indexes have one for each block
            for line in raw.split(b"\n"):
                if line.strip():
                    entry = json.loads(line[line.index(b"{"):])
                    name, base, total = archives[entry["filename"]]
                    start, length = int(entry["offset"]), int(entry["length"])
                    if start + length > total:
                        raise ValueError(f"index of {name} points behind its end")
                    yield name, base + start, length


# ---- records


def page_record_id(page_id, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def build_record(kind: str, record_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A WARC record as one gzip member. A revisit carries the response header but no payload."""
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(wbits=31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload, the part of the block behind the HTTP header."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record length does not fit its header")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


# ---- Spark


def plan_records(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """key, url, payload, refers_to (null: response) of each row.

    Of rows with equal payloads of `min_bytes` or more, those with the largest key are responses and the others
    refer to it. Null payloads are empty; null keys are smaller than any. Repeated rows each get a record.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    large = rows.filter(F.octet_length("payload") >= min_bytes).groupBy(F.sha2("payload", 256).alias("same"))
    repeated = materialise(large.agg(F.max("key").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n"), "repeated")
    found = rows.join(repeated, (F.sha2("payload", 256) == repeated["same"]) & (F.octet_length("payload") >= min_bytes), "left")
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("key").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return found.select("key", "url", "payload", refers.alias("refers_to"))


def write_packages(planned: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write the planned records; the manifest (path, bytes, records) as a written table."""

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        package = None
        for batch in batches:
            for row in batch.to_pylist():
                if package is None:
                    name = f"{base}/{uuid.uuid4().hex}.wacz"
                    out = system.open_output_stream(name, compression=None)
                    package, lines = PackageWriter(out), []
                    package.begin("archive/data.warc.gz")
                digest = hashlib.sha1(row["payload"]).hexdigest()
                refers = row["refers_to"]
                raw = build_record(
                    "response" if refers is None else "revisit", page_record_id(row["key"], digest), row["url"], row["payload"],
                    None if refers is None else page_record_id(refers, digest),
                )
                at = package.write(raw)
                entry = {"url": row["url"], "digest": digest, "offset": str(at), "length": str(len(raw)), "filename": "data.warc.gz"}
                lines.append(f"{digest} 19700101000000 {json.dumps(entry)}")
                if package.size >= package_bytes:
                    yield finish(package, lines, name, out)
                    package = None
        if package is not None:
            yield finish(package, lines, name, out)

    def finish(package, lines, name, out):
        package.end()
        package.begin("indexes/index.cdxj")
        package.write("".join(f"{line}\n" for line in lines).encode())
        package.end()
        size = package.close()
        out.close()
        return pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "records": [len(lines)]})

    return materialise(planned.mapInArrow(run, "path string, bytes bigint, records bigint"), "manifest")


def locate_records(manifest: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of neighbouring records: path, start of the range, start and length of each record in it."""

    def run(batches):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist()):
                with system.open_input_file(path) as file:
                    starts, lengths = [], []
                    for _, start, length in locate_package(file, size):
                        if starts and (start != starts[-1] + lengths[-1] or start + length - starts[0] > range_bytes):
                            yield one(path, starts, lengths)
                            starts, lengths = [], []
                        starts.append(start)
                        lengths.append(length)
                    if starts:
                        yield one(path, starts, lengths)

    def one(path, starts, lengths):
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([starts], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64()))], names=["path", "starts", "lengths"])

    # Explicit counts: rows of paths and offsets are tiny, but the reads behind them are not.
    packages = manifest.select("path", "bytes").repartition(max(1, manifest.count() // PACKAGES_PER_TASK), "path")
    return packages.mapInArrow(run, "path string, starts array<bigint>, lengths array<bigint>")


RECORD_SCHEMA = "path string, start bigint, record_id string, record_type string, refers_to string, target_uri string, payload binary"


def read_records(located: DataFrame, folder: str, tasks: int) -> DataFrame:
    """One row per located record, read in `tasks` tasks. A revisit has a null payload; see `resolve_revisits`."""

    def run(batches):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("path", pa.string()), ("start", pa.int64())] + [(n, pa.string()) for n in ("record_id", "record_type", "refers_to", "target_uri")] + [("payload", pa.binary())])
        for batch in batches:
            for path, starts, lengths in zip(*(batch.column(n).to_pylist() for n in ("path", "starts", "lengths"))):
                with system.open_input_file(path) as file:
                    block = read_range(file, starts[0], starts[-1] + lengths[-1] - starts[0])
                out = []
                for start, length in zip(starts, lengths):
                    fields, payload = parse_record(block[start - starts[0]:start - starts[0] + length])
                    kind = fields["warc-type"]
                    out.append({"path": path, "start": start, "record_id": fields["warc-record-id"], "record_type": kind, "refers_to": fields.get("warc-refers-to"),
                                "target_uri": fields.get("warc-target-uri"), "payload": None if kind == "revisit" else payload})
                yield pa.RecordBatch.from_pylist(out, schema)

    return located.repartition(tasks, F.col("path"), F.col("starts")[0]).mapInArrow(run, RECORD_SCHEMA)


def read_tasks(manifest: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Tasks for reading all packages: one for `task_bytes`, and one for each core at least."""
    size = manifest.agg(F.sum("bytes")).first()[0] or 0
    return max(manifest.sparkSession.sparkContext.defaultParallelism, -(-size // task_bytes))


def resolve_revisits(records: DataFrame, spark_name: str = "records") -> DataFrame:
    """record_id, record_type, refers_to, payload_bytes and payload_digest (hex SHA-1) of each record.

    Bytes and digest are taken from the payload that was read; for a revisit, from that of its response.
    The response of a hot payload may have a third of all records refer to it: the join is on the record id and
    both sides have a few bytes a row, so Spark can split it. A revisit whose response is missing keeps nulls.
    """
    short = materialise(records.select("record_id", "record_type", "refers_to", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")), spark_name)
    responses = short.filter("record_type = 'response'")
    named = responses.groupBy(F.col("record_id").alias("refers_to")).agg(F.min("payload_bytes").alias("payload_bytes"), F.min("payload_digest").alias("payload_digest"))
    revisits = short.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(named, "refers_to", "left")
    return responses.unionByName(revisits)


SQL = """
WITH keyed AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS payload
    FROM pages
), kept AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS keeper FROM keyed)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM kept
"""


@corpus_query("op1_warc_packages", SQL)
def warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page into packages and read the records back by range."""
    folder = work_path(spark, "packages")
    manifest = write_packages(plan_records(table(spark, sf_dir, "pages")), folder)
    records = resolve_revisits(read_records(locate_records(manifest, folder), folder, read_tasks(manifest)))
    page = lambda c: F.split(F.col(c), ":")[2].try_cast("bigint")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
