import gzip
import json

import pytest

from pollgauge.sources import snapshots as S


def poll(t, values):
    stations = [
        {"station_id": s, "num_bikes_available": b, "num_docks_available": d, "last_reported": t} for s, b, d in values
    ]
    return json.dumps({"last_updated": t, "data": {"stations": stations}, "ttl": 60})


def test_archive_with_broken_files(spark, tmp_path):
    day = tmp_path / "feed_id=f"
    day.mkdir()

    def put(name, data):
        (day / f"{name}.json.gz").write_bytes(data)

    put("20260101T000000Z", gzip.compress(poll(1_767_225_600, [(1, 5, 10), ("2", 7, 8)]).encode()))
    put("20260101T000100Z", gzip.compress(poll(1_767_225_660, [(1, 4, 11), ("2", 7, 8)]).encode()))
    put("20260101T000200Z", gzip.compress(poll(1_767_225_660, [(1, 9, 9), ("2", 9, 9)]).encode()))
    put("20260101T000300Z", gzip.compress(poll(1_767_225_720, [(1, 1, 1)]).encode() * 50)[:40])
    put("20260101T000400Z", gzip.compress(b'{"last_updated": 17'))
    put("20260101T000500Z", b"")

    rows = S.load_snapshots(spark, str(tmp_path)).orderBy("station_id", "us").collect()
    got = [(r["feed_id"], r["station_id"], r["us"] // 1_000_000, r["num_bikes_available"], r["num_docks_available"]) for r in rows]
    assert got == [
        ("f", "1", 1_767_225_600, 5, 10), ("f", "1", 1_767_225_660, 4, 11),
        ("f", "2", 1_767_225_600, 7, 8), ("f", "2", 1_767_225_660, 7, 8),
    ]
    report = S.corrupt_snapshot_report(spark, str(tmp_path), S.snapshot_files(spark, str(tmp_path))).first()
    assert (report["listed"], report["usable"], report["corrupt"]) == (6, 3, 3)
    docs = S.snapshot_files(spark, str(tmp_path))
    lost = {r["name"]: r["reason"] for r in S.lost_files(spark, str(tmp_path), docs).collect()}
    assert lost == {
        "feed_id=f/20260101T000300Z.json.gz": "broken gzip",
        "feed_id=f/20260101T000400Z.json.gz": "malformed",
        "feed_id=f/20260101T000500Z.json.gz": "empty",
    }


def test_an_intact_file_without_rows_is_an_error(spark, tmp_path):
    day = tmp_path / "feed_id=a +%b"
    day.mkdir()
    for minute in (0, 1):
        text = poll(1_767_225_600 + 60 * minute, [(1, 5, 10)])
        (day / f"20260101T00{minute:02}00Z.json.gz").write_bytes(gzip.compress(text.encode()))
    (day / "20260101T000200Z.json.gz").write_bytes(gzip.compress(b""))
    (day / "_hidden").write_bytes(b"")
    docs = S.snapshot_files(spark, str(tmp_path))
    lost = S.lost_files(spark, str(tmp_path), docs)
    assert [(r["name"], r["reason"]) for r in lost.collect()] == [("feed_id=a +%b/20260101T000200Z.json.gz", "empty")]
    S.require_read(lost)
    # As if the reader had passed over the second file.
    some = S.lost_files(spark, str(tmp_path), docs.filter("request != '20260101T000100Z'"))
    with pytest.raises(RuntimeError, match="20260101T000100Z"):
        S.require_read(some)


def test_an_empty_archive_loses_nothing(spark, tmp_path):
    assert S.archive_files(spark, str(tmp_path)).count() == 0
    assert S.lost_files(spark, str(tmp_path), S.snapshot_files(spark, str(tmp_path), feed_column=False)).count() == 0


def test_log_keeps_error_text_out_of_the_hash(spark, tmp_path):
    (tmp_path / "feed_id=f").mkdir()
    (tmp_path / "feed_id=f" / "log.csv").write_text(
        "20260101T000000Z,200,80,1000,320,abcd\n20260101T000100Z,ERROR,0,0,,Timeout: no answer\n"
    )
    from pollgauge.operators.profile import parse_log

    rows = parse_log(S.acquisition_log_scan(spark, str(tmp_path))).orderBy("ts").collect()
    assert [(r["payload"], r["error_kind"]) for r in rows] == [("abcd", None), (None, "Timeout")]


def test_an_archive_has_a_folder_for_each_feed_and_is_read_by_tasks(spark, tmp_path):
    at = 1_767_225_600
    docs = [("a +%b", f"20260101T00{m:02}00Z", poll(at + 60 * m, [(1, m, 10)])) for m in range(12)]
    docs += [(None, "20260101T000000Z", poll(at, [(1, 5, 5)])), ("c/d", None, poll(at, [(1, 6, 6)]))]
    docs += [("e", "20260101T000000Z", t) for t in (poll(at, [(1, 7, 7)]), poll(at + 1, [(1, 8, 8)]), None)]
    path = str(tmp_path / "archive")
    S.write_archive(spark.createDataFrame(docs, "feed_id string, request string, value string"), path)
    assert sorted(p.name for p in (tmp_path / "archive").iterdir()) == [
        "feed_id=__HIVE_DEFAULT_PARTITION__", "feed_id=a +%25b", "feed_id=c%2Fd", "feed_id=e",
    ]
    assert not [p for p in (tmp_path / "archive").glob("*/*") if p.is_dir()]
    files = S.snapshot_files(spark, path)
    # A Spark file index holds every file on the driver; here the files are rows.
    assert "FileScan json" not in files._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["feed_id"] or "", r["request"], r["last_updated"]) for r in files.collect())
    assert got == sorted(
        [("a +%b", f"20260101T00{m:02}00Z", at + 60 * m) for m in range(12)]
        + [("", "20260101T000000Z", at), ("c/d", "", at), ("e", "20260101T000000Z", at)]
    )
    assert S.lost_files(spark, path, files).count() == 0


def test_texts_that_do_not_decode_and_whole_texts_of_torn_files(spark, tmp_path):
    import bz2

    day = tmp_path / "feed_id=f"
    day.mkdir()
    text = poll(1_767_225_600, [(1, 5, 10)])
    (day / "20260101T000000Z.json.gz").write_bytes(gzip.compress(text.encode())[:-8])  # the sum at the end is gone
    (day / "20260101T000100Z.json").write_bytes(b"\xff" + text.encode())
    (day / "20260101T000200Z.json.bz2").write_bytes(bz2.compress(text.encode("utf-16")))
    (day / "20260101T000300Z.json").write_bytes(f"[{text}, {text}]".encode())
    files = S.snapshot_files(spark, str(tmp_path))
    got = sorted((r["request"], r["last_updated"]) for r in files.collect())
    at = 1_767_225_600
    assert got == [("20260101T000000Z", at), ("20260101T000100Z", None), ("20260101T000200Z", at), ("20260101T000300Z", at), ("20260101T000300Z", at)]
    lost = {r["name"]: r["reason"] for r in S.lost_files(spark, str(tmp_path), files).collect()}
    assert lost == {"feed_id=f/20260101T000100Z.json": "malformed"}


def test_a_broken_registry_file_is_an_error(spark, tmp_path):
    (tmp_path / "feed_id=f").mkdir()
    text = json.dumps({"data": {"stations": [{"station_id": "1", "name": "x", "capacity": 3}]}})
    (tmp_path / "feed_id=f" / "20260101.json.gz").write_bytes(gzip.compress(text.encode()))
    assert [tuple(r)[2:] for r in S.registry_scan(spark, str(tmp_path)).collect()] == [("1", "x", 3)]
    (tmp_path / "feed_id=f" / "20260102.json.gz").write_bytes(gzip.compress(text.encode())[:30])
    with pytest.raises(Exception, match="end-of-stream"):
        S.registry_scan(spark, str(tmp_path)).collect()


def small_archive(spark, tmp_path):
    at = 1_767_225_600
    docs = [(f, f"20260101T00{m:02}00Z", poll(at + 60 * m, [(1, m, 10)])) for f in ("a", "b", "c") for m in range(4)]
    docs.append(("c", "20260101T000900Z", '{"last_updated": 17'))
    path = str(tmp_path / "archive")
    S.write_archive(spark.createDataFrame(docs, "feed_id string, request string, value string"), path)
    return path


def test_rows_of_files_are_not_broadcast(spark, tmp_path):
    """The listing starts from a short list of folders, which is no measure of the rows of their files."""
    path = small_archive(spark, tmp_path)

    def run(df):
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "Broadcast" not in plan
        return rows

    docs = S.snapshot_files(spark, path)
    assert [tuple(r)[::2] for r in run(S.lost_files(spark, path, docs))] == [("feed_id=c/poll=20260101T000900Z.json.gz", "malformed")]
    log = spark.createDataFrame(
        [("a", "20260101T000100Z", "200", "x"), ("b", "20260101T000200Z", "ERROR", "y"), ("b", "20260101T000900Z", "200", "z")],
        "feed_id string, ts string, status string, sha16 string",
    )
    at = 1_767_225_600_000_000
    got = sorted(run(S.poll_snapshot_join(log, S.readable(docs))))
    assert got == [("a", at + 60_000_000, at + 60_000_000, "x"), ("b", at + 120_000_000, at + 120_000_000, None)]


def test_the_report_lists_the_archive_once(spark, tmp_path, monkeypatch):
    path = small_archive(spark, tmp_path)
    listed, plain = [], S.archive_files
    monkeypatch.setattr(S, "archive_files", lambda *args: listed.append(args) or plain(*args))
    files = S.materialise(S.archive_files(spark, path), "files")
    report = S.corrupt_snapshot_report(spark, path, S.snapshot_files(spark, path, files=files), files)
    assert [tuple(r) for r in report.collect()] == [(13, 12, 1)]
    assert len(listed) == 1


def test_small_files_do_not_get_a_task_for_each_shuffle_partition(spark, tmp_path):
    path = small_archive(spark, tmp_path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        docs = S.snapshot_files(spark, path)
        assert docs.rdd.getNumPartitions() == 32
        assert docs.count() == 13
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
