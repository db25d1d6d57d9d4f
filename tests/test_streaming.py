"""Streams fed in several micro-batches give the batch result."""

import time

import pytest
from pyspark.sql import functions as F

from pollgauge.config import FeedConfig
from pollgauge.operators.detect import detect_stale, jump_rows
from pollgauge.streaming import streams as X

CFG = FeedConfig(block_s=1800)


@pytest.fixture(scope="module")
def hours(spark, status_frame, tmp_path_factory):
    """Two stations over eight hours, one parquet file per hour, oldest file first."""
    path = str(tmp_path_factory.mktemp("status"))
    rows = [
        ("f", f"s{s}", m, (m * 7 + s * 3) % 20 if m % 17 == 0 else 10, 5) for s in range(2) for m in range(480) if not 200 <= m < 210
    ]
    df = status_frame(rows)
    for h in range(8):
        part = df.filter(f"us >= {status_frame.start + h * 3_600_000_000} AND us < {status_frame.start + (h + 1) * 3_600_000_000}")
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return df, path


def test_jump_over_batches(spark, hours):
    df, path = hours
    got = X.run_stream_jump(X.table_stream(spark, path, X.STATUS_SCHEMA, 1), CFG)
    want = jump_rows(df, CFG)
    cols = ["station_id", "us", "jump_flag"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    assert got.filter("jump_flag").count() > 0 and got.filter("late").count() == 0


def test_stale_over_batches(spark, tmp_path):
    rows = [("f", i, i * 60_000_000, i * 60_000_000 - 10_000_000, f"h{i // 3}") for i in range(30)]
    df = spark.createDataFrame(rows, X.POLL_SCHEMA)
    for a in range(0, 30, 10):
        df.filter(f"event_id >= {a} AND event_id < {a + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "polls"))
        time.sleep(0.05)
    got = X.run_stream_stale(X.table_stream(spark, str(tmp_path / "polls"), X.POLL_SCHEMA, 1), CFG)
    want = detect_stale(df, CFG)
    key = ["event_id", "stale"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_late_row_is_kept_and_marked(spark, status_frame, tmp_path):
    path = str(tmp_path / "status")
    for rows in ([("f", "s", 0, 5, 5), ("f", "s", 10, 5, 5)], [("f", "s", 5, 20, 0), ("f", "s", 11, 6, 4)]):
        status_frame(rows).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    got = X.run_stream_jump(X.table_stream(spark, path, X.STATUS_SCHEMA, 1), CFG).orderBy("us").collect()
    minutes = [(r["us"] - status_frame.start) // 60_000_000 for r in got]
    assert minutes == [0, 5, 10, 11]
    assert [r["late"] for r in got] == [False, True, False, False]
    assert not any(r["jump_flag"] for r in got)


def test_state_written_grows_with_touched_series(spark, status_frame, tmp_path):
    path, out, state = (str(tmp_path / name) for name in ("status", "out", "state"))
    batches = [
        [("f", f"s{i}", 0, 5, 5) for i in range(120)],
        [("f", "s3", 10, 6, 4)],
        [("f", "s3", 11, 20, 0), ("f", "new", 11, 1, 1)],
        [("f", "s7", 12, 5, 5)],
    ]
    for rows in batches:
        status_frame(rows).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    stream = X.table_stream(spark, path, X.STATUS_SCHEMA, 1)

    def finish(rows):
        return rows.withColumn("before", F.col("prev.num_bikes_available"))

    keys = ["feed_id", "station_id"]
    X.run_all(X.previous_row_writer(stream, keys, "us", ["num_bikes_available"], finish, out, state, CFG.block_us))
    got = {(r["station_id"], (r["us"] - status_frame.start) // 60_000_000): r["before"] for r in spark.read.parquet(out).collect()}
    assert (got["s3", 10], got["s3", 11], got["new", 11], got["s7", 12]) == (5, 6, None, 5)

    def buckets(version):
        return sorted(p.name for p in (tmp_path / "state" / "tails" / f"version={version}").glob("series_bucket=*"))

    assert len(buckets(0)) > 40
    # Batch 1 touches the bucket of s3 alone, batch 2 that one and the bucket of the new series.
    assert len(buckets(2)) == 2 and len(buckets(3)) == 1
    # The bucket of s3 in version 1 went when batch 3 began; that of version 0 went one batch before.
    assert buckets(1) == []
    store = X.SeriesTails(spark, f"{state}/tails", keys, 4)
    held = store.read(sorted(store.held), stream.schema)
    assert held.count() == 121
    assert {r["station_id"]: r["num_bikes_available"] for r in held.filter("station_id IN ('s3', 's7', 'new', 's9')").collect()} == {
        "s3": 20, "s7": 5, "new": 1, "s9": 5,
    }


def test_a_repeated_batch_writes_the_same_state(spark, status_frame, tmp_path):
    keys, folder = ["feed_id", "station_id"], str(tmp_path / "tails")
    first = status_frame([("f", f"s{i}", 0, i, 5) for i in range(5)])
    second = status_frame([("f", "s1", 1, 9, 9)])
    for batch_id, rows in ((0, first), (1, second), (1, second)):
        store = X.SeriesTails(spark, folder, keys, batch_id)
        touched = store.touched(rows)
        old = store.read(touched, rows.schema)
        assert (old is None) == (batch_id == 0)
        if old is not None:
            assert old.filter("station_id = 's1'").first()["num_bikes_available"] == 1
            rows = rows.unionByName(old.filter("station_id != 's1'"))
        store.write(rows, touched)
    store = X.SeriesTails(spark, folder, keys, 2)
    held = {r["station_id"]: r["num_bikes_available"] for r in store.read(sorted(store.held), first.schema).collect()}
    assert held == {"s0": 0, "s1": 9, "s2": 2, "s3": 3, "s4": 4}


def test_sessions_over_batches(spark, hours):
    df, path = hours
    X.configure_streams(spark)
    got = X.run_to_table(X.stream_periods(X.table_stream(spark, path, X.STATUS_SCHEMA, 1), CFG, "10 minutes"), "periods")
    rows = got.collect()
    # The session after the hole is still open.
    assert len(rows) == 1 and rows[0]["n"] == 400


def test_health_counts_stations(spark, hours):
    _, path = hours
    X.configure_streams(spark)
    got = X.run_to_table(X.stream_health(X.table_stream(spark, path, X.STATUS_SCHEMA, 1), CFG, "10 minutes", "1 hour"), "health")
    rows = got.orderBy("window_us").collect()
    assert len(rows) >= 6
    assert all(r["stations"] == 2 for r in rows)
    assert [r["n_rows"] for r in rows][:4] == [120, 120, 120, 100]


def late(spark, status_frame, tmp_path, files, delay_minutes):
    path, out, state = (str(tmp_path / name) for name in ("status", "late", "state"))
    for k, rows in enumerate(files):
        status_frame(rows).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01)
    stream = X.table_stream(spark, path, X.STATUS_SCHEMA, 1)
    X.run_all(X.late_row_writer(stream, out, state, delay_minutes * 60_000_000))
    marked = spark.read.schema(f"{X.STATUS_SCHEMA}, late boolean").parquet(out)
    return {r["feed_id"]: (r["input_rows"], r["late_rows"]) for r in X.late_rows(marked).collect()}


def test_ten_late_rows_of_one_window_count_as_ten(spark, status_frame, tmp_path):
    files = [[("f", "s", 600, 5, 5), ("g", "s", 600, 5, 5)], [("f", f"s{i}", i, 5, 5) for i in range(10)] + [("f", "s", 570, 5, 5), ("f", "s", 569, 5, 5)]]
    assert late(spark, status_frame, tmp_path, files, 30) == {"f": (13, 11), "g": (1, 0)}


def test_every_batch_counts(spark, status_frame, tmp_path):
    files = [[("f", "s", 600 if i == 0 else i, 5, 5)] for i in range(112)]
    assert late(spark, status_frame, tmp_path, files, 30) == {"f": (112, 111)}
