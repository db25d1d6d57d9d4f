"""The poll loop as Structured Streaming: the batch rules, run continuously.

Batch twins live in `pollgauge.operators`.  Aggregations, sessions and dedup are
built-in streaming operators.  The previous-row rules (jump, stale) carry the
newest row of each series from batch to batch in a written table, of which a
batch reads and writes the parts that its series fall into.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from pollgauge.config import BIKES, DOCKS, FEED, SECOND_US, SERIES, STATION, US, FeedConfig
from pollgauge.functions.columns import critical, true_when
from pollgauge.operators.sequence import Blocks
from pollgauge.session import work_path
from pollgauge.sources.snapshots import SNAPSHOT, flatten_stations, readable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATUS_SCHEMA = f"{FEED} string, {STATION} string, {US} bigint, {BIKES} int, {DOCKS} int"
TAIL_BUCKETS = 256  # parts of the carried state
POLL_SCHEMA = f"{FEED} string, event_id bigint, request_us bigint, last_updated_us bigint, payload_sha256 string"


def configure_streams(spark: SparkSession) -> None:
    """State in RocksDB: it spills to disk, and its changes go to the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def snapshot_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Snapshot documents as they arrive: one JSON text per line, below `feed_id=` folders."""
    reader = spark.readStream.schema(T.StructType([*SNAPSHOT.fields, T.StructField(FEED, T.StringType())]))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def table_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input in append mode into files, and read them back.

    The files and the checkpoint lie in the shared folder, so a lost executor or a
    restart repeats a batch without duplicating its output.
    """
    spark = stream.sparkSession
    out, state = work_path(spark, name), work_path(spark, f"{name}-checkpoint")
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _event_time(df: DataFrame, us: str, delay: str) -> DataFrame:
    return df.withColumn("ts", F.timestamp_micros(us)).withWatermark("ts", delay)


def stream_ingest(docs: DataFrame) -> DataFrame:
    """Snapshot documents to status rows; cut-off documents are dropped."""
    return flatten_stations(readable(docs))


def stream_dedup(docs: DataFrame, delay: str) -> DataFrame:
    """The first arrived document of each feed state, within the watermark."""
    good = readable(docs).withColumn("ts", F.timestamp_seconds("last_updated"))
    return good.withWatermark("ts", delay).dropDuplicatesWithinWatermark([FEED, "last_updated"])


class SeriesTails:
    """The newest row of each series, in buckets of a hash of its key.

    A batch reads the buckets that its series fall into and writes those again, as a version named by the batch, so
    state read and written grows with the series that a batch touches. An index of at most `TAIL_BUCKETS` rows per
    batch names the version that holds each bucket. A repeated batch starts from the index before it and writes the
    same version again; what an index of two batches ago held and no later one does is removed.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], batch_id: int):
        self.spark, self.folder, self.batch_id = spark, folder, batch_id
        self.bucket = F.pmod(F.xxhash64(*keys), F.lit(TAIL_BUCKETS)).cast("int")
        self.held = self._index(batch_id - 1)

    def _file(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _index(self, batch_id: int) -> dict[int, int]:
        path = f"{self.folder}/index/batch={batch_id}"
        where, system = self._file(path)
        if batch_id < 0 or not system.exists(where):
            return {}
        return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version bigint").parquet(path).collect()}

    def _path(self, bucket: int, version: int) -> str:
        return f"{self.folder}/version={version}/series_bucket={bucket}"

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets of the batch's series, at most `TAIL_BUCKETS` numbers."""
        return sorted(r[0] for r in batch.select(self.bucket).distinct().collect())

    def read(self, buckets: Sequence[int], schema: T.StructType) -> DataFrame | None:
        """Rows of these buckets, or None where none was written before."""
        paths = [self._path(b, self.held[b]) for b in buckets if b in self.held]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def write(self, rows: DataFrame, buckets: Sequence[int]) -> None:
        """Write `rows`, the newest of all series in these buckets, and the index of this batch."""
        parted = rows.withColumn("series_bucket", self.bucket).repartition("series_bucket")
        parted.write.mode("overwrite").partitionBy("series_bucket").parquet(f"{self.folder}/version={self.batch_id}")
        now = {**self.held, **{b: self.batch_id for b in buckets}}
        index = self.spark.createDataFrame(sorted(now.items()), "bucket int, version bigint").coalesce(1)
        index.write.mode("overwrite").parquet(f"{self.folder}/index/batch={self.batch_id}")
        self._prune()

    def _prune(self) -> None:
        # The batch before this one is committed, so nothing starts from the index before it any more.
        before = self._index(self.batch_id - 2)
        gone = [self._path(b, v) for b, v in before.items() if self.held.get(b) != v]
        for path in [*gone, f"{self.folder}/index/batch={self.batch_id - 2}"] if before else []:
            where, system = self._file(path)
            system.delete(where, True)


def previous_row_writer(
    stream: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str],
    finish: Callable[[DataFrame], DataFrame], out: str, state: str, block_us: int,
) -> DataStreamWriter:
    """A sink for rules that look at the previous row of a series.

    Each micro-batch is joined by the newest row that its series had before
    (`SeriesTails`) and goes through the batch operator, so one busy series
    is still spread over time blocks.  Rows older than their series' newest row
    arrive too late to have a valid predecessor; they are kept, marked `late`,
    and take no part in the sequence.

    A batch writes its own folder and its own version of the buckets it touches,
    so repeating a batch after a failure gives the same result.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        store = SeriesTails(batch.sparkSession, f"{state}/tails", keys, batch_id)
        buckets = store.touched(batch)
        rows = batch.withColumn("_old", F.lit(False))
        tails = store.read(buckets, batch.schema)
        if tails is not None:
            newest = tails.select(*keys, F.col(order).alias("_newest"))
            rows = rows.join(newest, list(keys), "left").withColumn("late", true_when(F.col(order) <= F.col("_newest")))
            rows = rows.drop("_newest")
        else:
            rows = rows.withColumn("late", F.lit(False))
        fresh = rows.filter(~F.col("late"))
        if tails is not None:
            fresh = fresh.unionByName(tails.withColumn("_old", F.lit(True)).withColumn("late", F.lit(False)))
        seen = Blocks(fresh, keys, block_us, order, settle=False).previous("prev", fields).frame().filter(~F.col("_old"))
        apart = rows.filter("late").withColumn("prev", F.lit(None).cast(seen.schema["prev"].dataType))
        done = finish(seen.unionByName(apart).drop("_old")).drop("prev")
        done.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        names = [c for c in batch.columns if c not in keys]
        last = fresh.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("t")).select(*keys, "t.*")
        store.write(last.select(*batch.columns), buckets)

    def kept(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            process(batch, batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(kept).option("checkpointLocation", f"{state}/log")


def run_all(writer: DataStreamWriter, arrivals: Iterable[None] = (None,)) -> None:
    """Process what is there, once for each arrival; the checkpoint carries on from one to the next."""
    for _ in arrivals:
        writer.trigger(availableNow=True).start().awaitTermination()


def _run_previous(stream, keys, order, fields, finish, cfg: FeedConfig, name: str, extra: str, arrivals) -> DataFrame:
    spark = stream.sparkSession
    out, state = work_path(spark, name), work_path(spark, f"{name}-state")
    run_all(previous_row_writer(stream, keys, order, fields, finish, out, state, cfg.block_us), arrivals)
    schema = T.StructType([*stream.schema.fields, T.StructField("late", T.BooleanType()), T.StructField(extra, T.BooleanType())])
    return spark.read.schema(schema).parquet(out)


def run_stream_jump(status: DataFrame, cfg: FeedConfig, arrivals: Iterable[None] = (None,)) -> DataFrame:
    """Status rows with `jump_flag` against the station's previous row, for all available input."""

    def finish(rows: DataFrame) -> DataFrame:
        minutes = (F.col(US) - F.col("prev.us")) / F.lit(60.0 * SECOND_US)
        moved = F.abs(F.col(BIKES) - F.col(f"prev.{BIKES}"))
        return rows.withColumn("jump_flag", true_when(moved > F.lit(cfg.max_flow_per_min) * minutes))

    return _run_previous(status, SERIES, US, [US, BIKES], finish, cfg, "jump", "jump_flag", arrivals)


def run_stream_stale(polls: DataFrame, cfg: FeedConfig, arrivals: Iterable[None] = (None,)) -> DataFrame:
    """Polls with `stale`: old feed clock, or the same payload as the feed's previous poll."""

    def finish(rows: DataFrame) -> DataFrame:
        old = F.col("request_us") - F.col("last_updated_us") > cfg.stale_age_s * SECOND_US
        return rows.withColumn("stale", old | true_when(F.col("payload_sha256") == F.col("prev.payload_sha256")))

    return _run_previous(polls, [FEED], "request_us", ["payload_sha256"], finish, cfg, "stale", "stale", arrivals)


def stream_frozen(status: DataFrame, cfg: FeedConfig, delay: str, window: str, slide: str) -> DataFrame:
    """Per station and sliding window: are bikes and docks constant?"""
    rows = _event_time(status, US, delay)
    out = rows.groupBy(FEED, STATION, F.window("ts", window, slide)).agg(
        ((F.min(BIKES) == F.max(BIKES)) & (F.min(DOCKS) == F.max(DOCKS))).alias("frozen"), F.count(F.lit(1)).alias("n")
    )
    return out.select(FEED, STATION, F.unix_micros("window.end").alias("window_end_us"), "frozen", "n")


def stream_periods(status: DataFrame, cfg: FeedConfig, delay: str) -> DataFrame:
    """Continuous periods of each feed as session windows; the last open one is held back.

    A session ends one gap after its last row, so the gap is taken off again.
    """
    rows = _event_time(status, US, delay)
    session = F.session_window("ts", f"{cfg.max_gap_s} seconds")
    out = rows.groupBy(FEED, session).agg(F.count(F.lit(1)).alias("n"))
    return out.select(
        FEED, F.unix_micros("session_window.start").alias("start_us"),
        (F.unix_micros("session_window.end") - cfg.max_gap_us).alias("end_us"), "n",
    )


def stream_health(status: DataFrame, cfg: FeedConfig, delay: str, window: str) -> DataFrame:
    """Per feed and tumbling window: stations seen, rows, critical rows.

    Stations are counted exactly by two aggregations, one per station and one over stations.
    """
    rows = _event_time(status, US, delay).withColumn("critical", critical(at=cfg.critical_at))
    per = rows.groupBy(FEED, STATION, F.window("ts", window)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("critical").cast("int")).alias("c")
    )
    slot = F.window(F.window_time("window"), window)
    out = per.groupBy(FEED, slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("stations"), F.sum("n").alias("n_rows"), F.sum("c").alias("critical_rows")
    )
    return out.select(FEED, F.unix_micros("slot.start").alias("window_us"), "stations", "n_rows", "critical_rows")


def late_row_writer(stream: DataFrame, out: str, state: str, delay_us: int) -> DataStreamWriter:
    """A sink that marks rows which come too late, before anything is aggregated.

    A row is late if it is older than the newest row of all earlier batches by more than the delay. The newest time
    is a one-row table per batch, written beside the marked rows, so repeating a batch gives the same marks.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = None
        if batch_id > 0:
            mark = spark.read.schema("top bigint").parquet(f"{state}/marks/batch={batch_id - 1}").first()[0]
        late = F.lit(False) if mark is None else true_when(F.col(US) < F.lit(mark - delay_us))
        batch.withColumn("late", late).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        top = batch.agg(F.greatest(F.max(US), F.lit(mark).cast("bigint")).alias("top"))
        top.write.mode("overwrite").parquet(f"{state}/marks/batch={batch_id}")

    return stream.writeStream.foreachBatch(process).option("checkpointLocation", f"{state}/log")


def late_rows(marked: DataFrame) -> DataFrame:
    """Rows read and rows that came too late, per feed, over all batches."""
    return marked.groupBy(FEED).agg(F.count(F.lit(1)).alias("input_rows"), F.count_if("late").alias("late_rows"))
