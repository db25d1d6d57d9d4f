"""The raw archive: snapshot files, acquisition log, station registry, and result tables."""

from __future__ import annotations

import bz2
import gzip
import json
import uuid
import zlib
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pollgauge.config import BIKES, DOCKS, FEED, SECOND_US, STATION, US
from pollgauge.session import fixed_table, materialise

STATION_STATUS = T.StructType(
    [
        T.StructField(STATION, T.StringType()),
        T.StructField(BIKES, T.IntegerType()),
        T.StructField(DOCKS, T.IntegerType()),
        T.StructField("last_reported", T.LongType()),
    ]
)
SNAPSHOT = T.StructType(
    [
        T.StructField("last_updated", T.LongType()),
        T.StructField("data", T.StructType([T.StructField("stations", T.ArrayType(STATION_STATUS))])),
    ]
)
REGISTRY = T.StructType(
    [
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField(
                        "stations",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField(STATION, T.StringType()),
                                    T.StructField("name", T.StringType()),
                                    T.StructField("capacity", T.IntegerType()),
                                ]
                            )
                        ),
                    )
                ]
            ),
        )
    ]
)
# Fixed format: the collector's log has no header.
LOG_SCHEMA = "ts string, status string, latency_ms int, bytes int, n_stations int, sha16 string"
BAD = "_corrupt_record"
# Fixed format: request time in file names.
REQUEST_NAME = r"(\d{8}T\d{6}Z)"
REQUEST_FORMAT = "yyyyMMdd'T'HHmmss'Z'"
# Fixed format: folder name of a null, as Spark writes it.
NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def _with(schema: T.StructType, *names: str) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, T.StringType()) for n in names]])


def _tasks(spark: SparkSession) -> int:
    """Tasks of a step on small files: four for each core, 32 at least, and no more than shuffle partitions.

    They stream their files, so a long task holds no more than a short one, while each Python task costs a fixed time.
    """
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(32, 4 * spark.sparkContext.defaultParallelism))


def _texts(spark: SparkSession, path: str, skip: bool, files: DataFrame | None = None) -> DataFrame:
    """`file_path`, `folder` (of its feed) and `value` (the whole text) of every archive file; tasks list and read them.

    One small file for each poll is more than a driver can list, and dearer to plan than to read. Files end in .gz, .bz2
    or are plain. A text that does not decode keeps its damage, and so is malformed JSON. Of a broken file what came out
    before the break is kept, marked `torn`, and a file that cannot be opened gives no row; both are errors unless `skip`.
    Files that hold nothing give no row. `files` is a listing of the archive that is at hand.
    """
    _, _, _, address = _root(spark, path)
    parts = _tasks(spark)

    def begun(data: bytes, opened) -> bytes:
        out = b""
        try:
            for i in range(0, len(data), 512):
                out += opened.decompress(data[i : i + 512])
        except (EOFError, OSError, zlib.error):
            pass
        return out

    def unpacked(store, at: str) -> tuple[bytes, bool]:
        with store.open_input_stream(at, compression=None) as raw:
            data = raw.read()
        if not at.endswith((".gz", ".bz2")):
            return data, False
        try:
            return (gzip if at.endswith(".gz") else bz2).decompress(data), False
        except (EOFError, OSError, ValueError, zlib.error):
            if not skip:
                raise
            return begun(data, zlib.decompressobj(31) if at.endswith(".gz") else bz2.BZ2Decompressor()), True

    def read(batches):
        store, base = fs.FileSystem.from_uri(address)
        columns, rows, held = ["file_path", "folder", "value", "torn"], [], 0
        for batch in batches:
            for name in batch["name"]:
                try:
                    data, torn = unpacked(store, f"{base}/{name}")
                except OSError:
                    if not skip:
                        raise
                    continue
                try:
                    text = data.decode(json.detect_encoding(data))
                except UnicodeDecodeError:
                    text = "\ufffd" + data.decode(errors="replace")
                if not text.strip():
                    continue
                feed = next((unquote(p[len(FEED) + 1:]) for p in name.split("/")[:-1] if p.startswith(f"{FEED}=")), None)
                rows.append((f"{address}/{quote(name, safe='/=:@!$&+,;~()')}", feed, text, torn))
                held += len(text)
                if held > 1 << 24 or len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    files = archive_files(spark, path) if files is None else files
    names = files.filter("length > 0").select("name").repartition(parts)
    return names.mapInPandas(read, "file_path string, folder string, value string, torn boolean")


def _documents(
    spark: SparkSession, path: str, schema: T.StructType, feed_column: bool, skip: bool, files: DataFrame | None = None
) -> DataFrame:
    """The files of an archive as rows of `schema`, with path, feed and `torn`; of a list, one row for each entry."""
    known = _with(schema, FEED) if feed_column else schema
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    one = F.array(F.from_json("value", known, options))
    many = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", T.ArrayType(known), options))
    texts = _texts(spark, path, skip, files)
    docs = texts.select("file_path", "folder", "torn", F.explode(F.coalesce(many, one)).alias("j"))
    docs = docs.select("j.*", "file_path", "torn", "folder")
    if feed_column:
        feed = F.nullif("folder", F.lit(NO_NAME))
        docs = docs.withColumn(FEED, F.when(F.col("folder").isNull(), F.col(FEED)).otherwise(feed))
    return docs.drop("folder")


def snapshot_files(spark: SparkSession, path: str, feed_column: bool = True, files: DataFrame | None = None) -> DataFrame:
    """One row per readable or malformed file: content, file path, request name.

    Files that cannot be decompressed are skipped here, unless the snapshot is whole before the break; `lost_files`
    names them. `files`: `archive_files` of the folder, if it is written already.
    """
    docs = _documents(spark, path, _with(SNAPSHOT, BAD), feed_column, skip=True, files=files)
    whole = F.col("last_updated").isNotNull() & F.col("data.stations").isNotNull()
    docs = docs.filter(~F.col("torn") | whole).drop("torn")
    return docs.withColumn("request", F.regexp_extract("file_path", REQUEST_NAME, 1))


def readable(docs: DataFrame) -> DataFrame:
    good = F.col("last_updated").isNotNull() & F.col("data.stations").isNotNull()
    return docs.filter(good)


def _root(spark: SparkSession, path: str):
    """Hadoop file system, qualified path and its address as pyarrow takes it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = system.makeQualified(folder).toUri()
    return system, folder, uri.getPath().rstrip("/"), f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getRawPath().rstrip('/')}"


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """`name` (path below the archive) and `length` of every file, empty ones too.

    Spark's readers leave empty files out of their listings, so each top folder (a feed) is listed by a task. Names
    that begin with a dot or an underscore are hidden, as for the readers. Spark takes the result to be as small as the
    list of folders, so a join with rows of files needs a hint that keeps them from being broadcast.
    """
    system, folder, _, address = _root(spark, path)
    tops = [(s.getPath().getName(), s.isDirectory()) for s in system.listStatus(folder)]
    folders = ["", *sorted(name for name, is_folder in tops if is_folder and name[0] not in "._")]

    def listed(batches):
        store, base = fs.FileSystem.from_uri(address)
        for batch in batches:
            for top in batch["top"]:
                found = store.get_file_info(fs.FileSelector(f"{base}/{top}" if top else base, recursive=bool(top)))
                names = [(f.path[len(base):].lstrip("/"), f.size) for f in found if f.type == fs.FileType.File]
                shown = [row for row in names if not any(part[0] in "._" for part in row[0].split("/"))]
                yield pd.DataFrame(shown, columns=["name", "length"]).astype({"name": "object", "length": "int64"})

    rows = fixed_table(spark, [(f,) for f in folders], "top string").repartition(min(len(folders), _tasks(spark)))
    return rows.mapInPandas(listed, "name string, length bigint")


def lost_files(spark: SparkSession, path: str, docs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """`name`, `length` and `reason` of every archive file that gave no usable snapshot.

    `docs` is `snapshot_files` of the same folder, `files` its listing, if it is written already. Reasons: `empty` (no
    bytes, or a gzip of none), `broken gzip`, `malformed` (read, but no snapshot) and `unread` (intact, yet the reader gave
    no row: a passing read error that `ignoreCorruptFiles` hid, or bytes that could not be read now). Only files without a
    usable snapshot are opened.
    """
    _, _, base, address = _root(spark, path)
    plain = F.url_decode(F.replace(F.regexp_replace("file_path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    good = F.col("last_updated").isNotNull() & F.col("data.stations").isNotNull()
    read = docs.groupBy(F.substr(plain, F.lit(len(base) + 2)).alias("name")).agg(F.max(good).alias("usable"))
    files = archive_files(spark, path) if files is None else files
    missed = files.join(read.hint("merge"), "name", "left").filter(~F.coalesce("usable", F.lit(False)))

    def opened(batches):
        store, root = fs.FileSystem.from_uri(address)

        def state(name: str, length: int) -> str:
            if length == 0:
                return "empty"
            if not name.endswith(".gz"):
                return "intact"
            try:
                with store.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as text:
                    size = 0
                    while part := text.read(1 << 20):
                        size += len(part)
                return "intact" if size else "empty"
            except (EOFError, gzip.BadGzipFile, zlib.error):
                return "broken gzip"
            except OSError:
                return "unread"

        for batch in batches:
            yield batch.assign(state=[state(n, size) for n, size in zip(batch["name"], batch["length"])])

    states = missed.select("name", "length", F.col("usable").isNotNull().alias("seen")).mapInPandas(
        opened, "name string, length bigint, seen boolean, state string"
    )
    reason = F.when(F.col("state") != "intact", F.col("state")).when(F.col("seen"), "malformed").otherwise("unread")
    return states.select("name", "length", reason.alias("reason"))


def require_read(lost: DataFrame) -> None:
    """Raise where a file was lost for no fault of its own. `lost` comes from `lost_files`, best as a written table."""
    unread = [r["name"] for r in lost.filter("reason = 'unread'").select("name").orderBy("name").limit(10).collect()]
    if unread:
        raise RuntimeError(f"intact snapshot files gave no row, first names: {', '.join(unread)}")


def corrupt_snapshot_report(spark: SparkSession, path: str, docs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: listed files, files with a usable snapshot, and the difference.

    The folder must hold snapshots only. A file lost to a passing read error is no corrupt file but an error.
    """
    files = materialise(archive_files(spark, path), "files") if files is None else files
    lost = materialise(lost_files(spark, path, docs, files), "lost")
    require_read(lost)
    listed = files.agg(F.count(F.lit(1)).alias("listed"))
    return listed.crossJoin(lost.agg(F.count(F.lit(1)).alias("corrupt"))).select(
        "listed", (F.col("listed") - F.col("corrupt")).alias("usable"), "corrupt"
    )


def feed_state_dedup(docs: DataFrame, order: str = "file_path", keys=(FEED, "last_updated")) -> DataFrame:
    """Keep the first file of each feed state.

    A stuck feed can repeat one state for very long, so the first file is found by
    an aggregate that shrinks each map task's rows to one per state.
    """
    rest = [c for c in docs.columns if c not in keys]
    first = docs.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return first.select(*keys, "_first.*")


def flatten_stations(docs: DataFrame, extra=(FEED,)) -> DataFrame:
    """One row per station and snapshot, timed by the feed's own clock."""
    rows = docs.select(
        *extra, (F.col("last_updated") * SECOND_US).alias(US), F.explode("data.stations").alias("s")
    )
    return rows.select(
        *extra, F.col(f"s.{STATION}").cast("string").alias(STATION), US, F.col(f"s.{BIKES}").alias(BIKES),
        F.col(f"s.{DOCKS}").alias(DOCKS),
    )


def load_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Archive folder to status rows: read, drop unreadable files and repeated states, flatten."""
    return flatten_stations(feed_state_dedup(readable(snapshot_files(spark, path))))


def acquisition_log_scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{LOG_SCHEMA}, {FEED} string").csv(path)


def poll_snapshot_join(log: DataFrame, docs: DataFrame) -> DataFrame:
    """Attach the feed's clock to log rows whose request time names a snapshot file."""
    named = docs.select(FEED, F.col("request").alias("ts"), "last_updated")
    return log.join(named.hint("merge"), [FEED, "ts"]).select(
        FEED,
        (F.unix_timestamp("ts", REQUEST_FORMAT) * SECOND_US).alias("request_us"),
        (F.col("last_updated") * SECOND_US).alias("last_updated_us"),
        F.when(F.col("status") == "200", F.col("sha16")).alias("payload_sha256"),
    )


def registry_scan(spark: SparkSession, path: str) -> DataFrame:
    docs = _documents(spark, path, REGISTRY, feed_column=True, skip=False)
    rows = docs.select(FEED, "file_path", F.explode("data.stations").alias("s"))
    return rows.select(FEED, "file_path", "s.*")


def registry_latest(rows: DataFrame) -> DataFrame:
    """Each station's latest entry; `in_latest_file` marks the stations of the feed's newest file."""
    per = rows.groupBy(FEED, STATION).agg(F.max_by(F.struct("name", "capacity"), "file_path").alias("e"), F.max("file_path").alias("_f"))
    newest = rows.groupBy(FEED).agg(F.max("file_path").alias("_newest"))
    return per.join(newest.hint("merge"), FEED).select(
        FEED, STATION, "e.name", "e.capacity", (F.col("_f") == F.col("_newest")).alias("in_latest_file")
    )


def weather_scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("hour_us bigint, temp_c double, precip_mm double").parquet(path)


PERIODS_SCHEMA = f"{FEED} string, period_id int, day date, start_us bigint, end_us bigint, duration_h double"


def write_periods(periods: DataFrame, path: str) -> None:
    """Freeze a period list."""
    periods.select(*[f.split()[0] for f in PERIODS_SCHEMA.split(", ")]).write.option("header", True).csv(path)


def certified_periods_scan(spark: SparkSession, path: str) -> DataFrame:
    """A frozen period list; it is read, never recomputed."""
    return spark.read.schema(PERIODS_SCHEMA).option("header", True).csv(path)


CONFIG_SCHEMA = "tau double, feature_cols array<string>, trained_on_rows bigint, train_end bigint, val_end bigint, test_end bigint"


def frozen_config_scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONFIG_SCHEMA).json(path)


ANSWERS_SCHEMA = (
    "model string, rep int, scenario_id string, condition string, config string, flip boolean, "
    "true_decision string, tool_output string, reply string"
)


def answers_scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANSWERS_SCHEMA).json(path)


def _part(value: str | None) -> str:
    """A feed or poll as part of a file name, as Spark writes a partition value."""
    return NO_NAME if value is None else quote(value, safe=" +,;()!@$&~")


def write_archive(docs: DataFrame, path: str) -> None:
    """Write snapshot texts (`feed_id`, `request`, `value`) as one gzip file per poll, in a folder for each feed.

    Texts of one feed and poll share a file, a line each. A file gets its name when it is whole, so a task that runs
    twice leaves one file. A folder for each poll and Spark's commit of each file took most of the time.
    """
    spark = docs.sparkSession
    system, folder, _, address = _root(spark, path)
    system.mkdirs(folder)
    parts = _tasks(spark)

    def put(batches):
        store, base = fs.FileSystem.from_uri(address)
        known, at, lines = set(), None, []

        def close():
            feed, poll = at
            home = f"{base}/{FEED}={_part(feed)}"
            if home not in known:
                store.create_dir(home, recursive=True)
                known.add(home)
            name = f"poll={_part(poll)}.json.gz"
            draft = f"{home}/.{uuid.uuid4().hex}"
            with store.open_output_stream(draft, compression=None) as out:
                out.write(gzip.compress("".join(f"{x or ''}\n" for x in lines).encode(), 6, mtime=0))
            store.move(draft, f"{home}/{name}")

        for batch in batches:
            for feed, poll, value in zip(batch[FEED], batch["poll"], batch["value"]):
                if (feed, poll) != at and lines:
                    close()
                    lines = []
                at = (feed, poll)
                lines.append(value)
        if lines:
            close()
        yield pd.DataFrame({"n": [len(known)]})

    name = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(name(FEED).alias(FEED), name("request").alias("poll"), "value").repartition(parts, FEED, "poll")
    rows = rows.sortWithinPartitions(FEED, "poll", "value")
    rows.mapInPandas(put, "n bigint").write.format("noop").mode("overwrite").save()


def write_broken(docs: DataFrame, path: str) -> None:
    """Add snapshots that cannot be read: `damage` is `torn` (a gzip cut in half) or `empty` (no bytes)."""
    _, _, _, address = _root(docs.sparkSession, path)

    def put(batches):
        store, base = fs.FileSystem.from_uri(address)
        for batch in batches:
            for feed, poll, value, damage in zip(batch[FEED], batch["request"], batch["value"], batch["damage"]):
                whole = gzip.compress(value.encode(), mtime=0)
                folder = f"{base}/{FEED}={feed}/poll={poll}"
                store.create_dir(folder, recursive=True)
                with store.open_output_stream(f"{folder}/part-broken.txt.gz", compression=None) as out:
                    out.write(whole[: len(whole) // 2] if damage == "torn" else b"")
            yield pd.DataFrame({"n": [len(batch)]})

    docs.select(FEED, "request", "value", "damage").mapInPandas(put, "n bigint").write.format("noop").mode("overwrite").save()
