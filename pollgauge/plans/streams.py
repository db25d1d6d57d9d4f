"""Registered queries: the streaming operators, run over files written from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pollgauge.config import BIKES, DOCKS, FEED, SERIES, STATION, US
from pollgauge.plans import common as K
from pollgauge.plans.catalog import query
from pollgauge.plans.windows import REPEAT_SQL
from pollgauge.session import work_path
from pollgauge.sources import adapters
from pollgauge.streaming import streams as X

DELAY = "30 minutes"
DELAY_US = 1_800_000_000
_MARK = f"(SELECT max(us) - {DELAY_US} FROM status)"


def doc_stream(spark, sf):
    path = work_path(spark, "docs")
    docs = adapters.snapshot_docs(spark, sf).select(FEED, "request", "value")
    # Compacted archive: a file per feed, and one more where a task's range of days ends; a file per feed and day is mostly listing.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs.repartitionByRange(parts, FEED, "request").select(FEED, "value").write.partitionBy(FEED).text(path)
    return X.snapshot_stream(spark, path)


PARTS = 3


def in_parts(rows, part, path):
    """Write the rows part by part, into a folder that is there; a stream that runs after each has a batch for each."""
    for k in range(PARTS):
        rows.filter(part == k).write.mode("append").parquet(path)
        yield


def empty_folder(spark, path, schema):
    """A stream needs its folder before the first part comes."""
    spark.createDataFrame([], schema).write.parquet(path)
    return X.table_stream(spark, path, schema)


def by_time(us):
    """Thirds of the driver's month: parts in the order of time."""
    day = F.dayofmonth(F.timestamp_micros(us))
    return F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2)


def status_stream(spark, sf, files_per_trigger=None):
    X.configure_streams(spark)
    path = work_path(spark, "status")
    K.status(spark, sf).select(*SERIES, US, BIKES, DOCKS).write.parquet(path)
    return X.table_stream(spark, path, X.STATUS_SCHEMA, files_per_trigger)


@query("stream_ingest", """
SELECT h.feed_id, h.station_id, d.last_updated * 1000000 AS us, h.num_bikes_available,
  20 - h.num_bikes_available AS num_docks_available FROM docs d JOIN hourly h USING (feed_id, us) WHERE NOT cut""")
def stream_ingest(spark, sf):
    return X.run_to_table(X.stream_ingest(doc_stream(spark, sf)), "ingest")


@query("stream_dedup", "SELECT feed_id, last_updated FROM first_docs")
def stream_dedup(spark, sf):
    X.configure_streams(spark)
    rows = X.stream_dedup(doc_stream(spark, sf), "2 hours").select(FEED, "last_updated")
    return X.run_to_table(rows, "dedup")


@query("stream_jump", """
SELECT feed_id, station_id, us, coalesce(abs(num_bikes_available - lag(num_bikes_available) OVER w)
  > (us - lag(us) OVER w) / 60000000.0::DOUBLE, false) AS jump_flag FROM status WINDOW w AS (PARTITION BY feed_id, station_id ORDER BY us)""")
def stream_jump(spark, sf):
    X.configure_streams(spark)
    path = work_path(spark, "status")
    rows = K.status(spark, sf).select(*SERIES, US, BIKES, DOCKS)
    stream = empty_folder(spark, path, X.STATUS_SCHEMA)
    return X.run_stream_jump(stream, K.CFG, in_parts(rows, by_time(F.col(US)), path)).select(*SERIES, US, "jump_flag")


@query("stream_frozen", f"""
SELECT feed_id, station_id, e AS window_end_us, min(num_bikes_available) = max(num_bikes_available)
  AND min(num_docks_available) = max(num_docks_available) AS frozen, count(*) AS n
FROM (SELECT s.*, (us // 900000000 + k) * 900000000 AS e FROM status s CROSS JOIN (VALUES (1), (2), (3), (4)) t(k))
WHERE e <= {_MARK} GROUP BY 1, 2, 3""")
def stream_frozen(spark, sf):
    rows = X.stream_frozen(status_stream(spark, sf), K.CFG, DELAY, "60 minutes", "15 minutes")
    return X.run_to_table(rows, "frozen")


@query("stream_periods", f"""
SELECT g.feed_id, g.start_us, g.end_us, count(*) AS n FROM segs g
JOIN status s ON s.feed_id = g.feed_id AND s.us BETWEEN g.start_us AND g.end_us
WHERE g.end_us + 1350000000 <= {_MARK} GROUP BY 1, 2, 3""")
def stream_periods(spark, sf):
    return X.run_to_table(X.stream_periods(status_stream(spark, sf), K.CFG, DELAY), "periods")


@query("stream_health", f"""
SELECT feed_id, (us // 3600000000) * 3600000000 AS window_us, count(DISTINCT station_id) AS stations, count(*) AS n_rows,
  count(*) FILTER (WHERE num_bikes_available <= 2 OR num_docks_available <= 2) AS critical_rows
FROM status GROUP BY 1, 2 HAVING window_us + 3600000000 <= {_MARK}""")
def stream_health(spark, sf):
    return X.run_to_table(X.stream_health(status_stream(spark, sf), K.CFG, DELAY, "1 hour"), "health")


@query("stream_stale", f"""
SELECT p.feed_id, p.event_id, p.request_us - p.last_updated_us > 180000000 OR r.repeat_hash AS stale
FROM feed_polls p JOIN ({REPEAT_SQL}) r USING (event_id)""")
def stream_stale(spark, sf):
    X.configure_streams(spark)
    path = work_path(spark, "polls")
    polls = empty_folder(spark, path, X.POLL_SCHEMA)
    arrivals = in_parts(adapters.feed_polls(spark, sf), by_time(F.col("request_us")), path)
    return X.run_stream_stale(polls, K.CFG, arrivals).select(FEED, "event_id", "stale")


@query("late_rows", f"""
SELECT s.feed_id, count(*) AS input_rows, count(*) FILTER (WHERE s.us < m.top - {DELAY_US}) AS late_rows
FROM (SELECT *, (us // 900000000) % {PARTS} AS part FROM status) s
LEFT JOIN (SELECT p.part, max(us) AS top FROM range({PARTS}) p(part) JOIN status ON (us // 900000000) % {PARTS} < p.part GROUP BY 1) m
  ON m.part = s.part GROUP BY 1""")
def late_rows(spark, sf):
    """Every third slot arrives together: the second and third part are late but for their newest rows."""
    path, out, state = (work_path(spark, name) for name in ("status", "late", "late-state"))
    rows = K.status(spark, sf).select(*SERIES, US, BIKES, DOCKS)
    stream = empty_folder(spark, path, X.STATUS_SCHEMA)
    X.run_all(X.late_row_writer(stream, out, state, DELAY_US), in_parts(rows, F.expr("us div 900000000 % 3"), path))
    return X.late_rows(spark.read.schema(f"{X.STATUS_SCHEMA}, late boolean").parquet(out))
