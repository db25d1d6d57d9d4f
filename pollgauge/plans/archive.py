"""Registered queries: sources and sinks, over an archive written from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pollgauge.config import BIKES, DOCKS, FEED, SERIES, US
from pollgauge.functions import columns as C
from pollgauge.operators import evaluate, model, profile
from pollgauge.plans import common as K
from pollgauge.plans.catalog import query, view
from pollgauge.session import materialise, work_path
from pollgauge.sources import adapters, snapshots as S

view("hourly", """
SELECT CAST(user_id // 60 AS VARCHAR) AS feed_id, CAST(user_id // 30 AS VARCHAR) AS station_id,
  (epoch_us(ts) // 3600000000) * 3600000000 AS us, CAST(least(20, floor(max(value) / 5)) AS INTEGER) AS num_bikes_available
FROM events GROUP BY 1, 2, 3""")
view("docs", f"""
SELECT *, strftime(make_timestamp(us + 7000000), '%Y%m%dT%H%M%SZ') AS request,
  us // 1000000 - CASE WHEN {K.hash_sql("'late|' || feed_id || '|' || us")} % 5 = 0 THEN 3600 ELSE 0 END AS last_updated,
  {K.hash_sql("'cut|' || feed_id || '|' || us")} % 50 = 0 AS cut
FROM (SELECT DISTINCT feed_id, us FROM hourly)""")
view("first_docs", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feed_id, last_updated ORDER BY request) AS rn FROM docs WHERE NOT cut)
WHERE rn = 1""")
SCAN_SQL = """
SELECT h.feed_id, h.station_id, d.last_updated * 1000000 AS us, h.num_bikes_available,
  20 - h.num_bikes_available AS num_docks_available FROM first_docs d JOIN hourly h USING (feed_id, us)"""
STATUS_COLS = (*SERIES, US, BIKES, DOCKS)


def archive(spark, sf) -> str:
    path = work_path(spark, "archive")
    S.write_archive(adapters.snapshot_docs(spark, sf), path)
    return path


@query("snapshot_scan", SCAN_SQL)
def snapshot_scan(spark, sf):
    return S.load_snapshots(spark, archive(spark, sf)).select(*STATUS_COLS)


@query("corrupt_snapshot_report", """
SELECT count(*) AS listed, count(*) FILTER (WHERE NOT cut) AS usable, count(*) FILTER (WHERE cut) AS corrupt FROM docs""")
def corrupt_snapshot_report(spark, sf):
    path = archive(spark, sf)
    files = materialise(S.archive_files(spark, path), "files")
    return S.corrupt_snapshot_report(spark, path, S.snapshot_files(spark, path, files=files), files)


@query("lost_snapshot_files", f"""
SELECT feed_id, request, CASE WHEN harm = 0 THEN 'broken gzip' WHEN harm = 1 THEN 'empty' ELSE 'malformed' END AS reason
FROM (SELECT *, {K.hash_sql("'harm|' || feed_id || '|' || us")} % 40 AS harm FROM docs) WHERE harm < 2 OR cut""")
def lost_snapshot_files(spark, sf):
    """Snapshots of an archive that hold no usable text, by name and reason: torn gzip, no bytes, JSON cut off."""
    docs = adapters.snapshot_docs(spark, sf)
    at = F.unix_timestamp("request", S.REQUEST_FORMAT) * 1_000_000 - 7_000_000
    harm = C.hash32("harm", F.col(FEED), at) % 40
    docs = materialise(docs.withColumn("damage", F.when(harm == 0, "torn").when(harm == 1, "empty")), "docs")
    path = work_path(spark, "archive")
    S.write_archive(docs.filter("damage IS NULL"), path)
    S.write_broken(docs.filter("damage IS NOT NULL"), path)
    files = materialise(S.archive_files(spark, path), "files")
    lost = materialise(S.lost_files(spark, path, S.snapshot_files(spark, path, files=files), files), "lost")
    S.require_read(lost)
    feed = F.regexp_extract("name", f"{FEED}=([^/]*)", 1).alias(FEED)
    return lost.select(feed, F.regexp_extract("name", S.REQUEST_NAME, 1).alias("request"), "reason")


def parsed_docs(spark, sf):
    """The snapshot texts parsed in place, without the file round trip."""
    docs = adapters.snapshot_docs(spark, sf).filter(~F.col("cut")).select(FEED, "request", "value")
    return docs.withColumn("j", F.from_json("value", S.SNAPSHOT)).select(FEED, "request", "j.*")


@query("feed_state_dedup", "SELECT feed_id, last_updated, request FROM first_docs")
def feed_state_dedup(spark, sf):
    return S.feed_state_dedup(parsed_docs(spark, sf), "request").select(FEED, "last_updated", "request")


@query("flatten_stations", """
SELECT h.feed_id, d.request, h.station_id, d.last_updated * 1000000 AS us, h.num_bikes_available,
  20 - h.num_bikes_available AS num_docks_available FROM docs d JOIN hourly h USING (feed_id, us) WHERE NOT cut""")
def flatten_stations(spark, sf):
    return S.flatten_stations(parsed_docs(spark, sf), (FEED, "request"))


@query("acquisition_log_scan", """
SELECT feed_id, strftime(make_timestamp(us), '%Y%m%dT%H%M%SZ') AS ts, CASE WHEN ok THEN '200' ELSE 'ERROR' END AS status,
  CAST(n_stations AS INTEGER) AS n_stations, coalesce(payload, error_kind || ': no answer') AS sha16 FROM acq_log""")
def acquisition_log_scan(spark, sf):
    path = work_path(spark, "log")
    cols = [c.split()[0] for c in S.LOG_SCHEMA.split(", ")]
    adapters.acquisition_log(spark, sf).select(*cols, FEED).write.partitionBy(FEED).csv(path)
    return S.acquisition_log_scan(spark, path).select(FEED, "ts", "status", "n_stations", "sha16")


@query("poll_snapshot_join", f"""
SELECT d.feed_id, d.us + 7000000 AS request_us, d.last_updated * 1000000 AS last_updated_us,
  CASE WHEN {K.hash_sql("'fail|' || d.feed_id || '|' || d.us")} % 10 <> 0 THEN substr(md5(CAST(n AS VARCHAR)), 1, 16) END AS payload_sha256
FROM docs d JOIN (SELECT CAST(user_id // 60 AS VARCHAR) AS feed_id, (epoch_us(ts) // 3600000000) * 3600000000 AS us, count(*) AS n
  FROM events GROUP BY 1, 2) USING (feed_id, us) WHERE NOT cut""")
def poll_snapshot_join(spark, sf):
    docs = S.readable(S.snapshot_files(spark, archive(spark, sf)))
    return S.poll_snapshot_join(adapters.poll_log(spark, sf), docs)


view("registry_days", """
SELECT DISTINCT CAST(user_id // 60 AS VARCHAR) AS feed_id, CAST(user_id // 30 AS VARCHAR) AS station_id,
  strftime(ts, '%Y%m%d') AS day FROM events""")


@query("registry_latest", """
SELECT feed_id, station_id, 'Station ' || station_id || ' ' || max(day) AS name, 20 AS capacity,
  max(day) = (SELECT max(day) FROM registry_days x WHERE x.feed_id = r.feed_id) AS in_latest_file
FROM registry_days r GROUP BY 1, 2""")
def registry_latest(spark, sf):
    path = work_path(spark, "registry")
    S.write_archive(adapters.registry_docs(spark, sf), path)
    return S.registry_latest(S.registry_scan(spark, path))


@query("weather_scan", "SELECT hour_us, round(temp_c, 6) AS temp_c, precip_mm FROM weather")
def weather_scan(spark, sf):
    path = work_path(spark, "weather")
    adapters.weather(spark, sf).write.parquet(path)
    return S.weather_scan(spark, path).withColumn("temp_c", C.rounded(F.col("temp_c")))


@query("certified_periods_scan", """
SELECT feed_id, period_id, strftime(day, '%Y-%m-%d') AS day, start_us, end_us, round(duration_h, 6) AS duration_h FROM periods""")
def certified_periods_scan(spark, sf):
    path = work_path(spark, "periods")
    S.write_periods(K.periods(spark, sf), path)
    out = S.certified_periods_scan(spark, path).withColumn("day", F.col("day").cast("string"))
    return out.withColumn("duration_h", C.rounded(F.col("duration_h")))


@query("frozen_config_scan", """
SELECT 0.4::DOUBLE AS tau, 12 AS n_features, (SELECT count(*) FROM usable, bounds WHERE us <= train_end) AS trained_on_rows,
  train_end, val_end, test_end FROM bounds""")
def frozen_config_scan(spark, sf):
    rows = materialise(K.features(spark, sf).dropna(subset=[*K.INPUTS, "label"]), "usable")
    bounds = model.split_bounds(rows)
    trained = model.assign_split(rows, bounds).agg(C.count_if(F.col("split") == "train").alias("trained_on_rows"))
    config = bounds.crossJoin(trained).select(
        F.lit(K.MODEL.tau).alias("tau"), F.array(*[F.lit(c) for c in K.INPUTS]).alias("feature_cols"),
        "trained_on_rows", "train_end", "val_end", "test_end",
    )
    path = work_path(spark, "config")
    config.write.json(path)
    return S.frozen_config_scan(spark, path).select(
        "tau", F.size("feature_cols").alias("n_features"), "trained_on_rows", "train_end", "val_end", "test_end"
    )


@query("result_sinks", """
SELECT 'csv' AS sink, class, intensity_idx, round(avg(delta_cost), 6) AS delta_cost, count(*) AS n FROM results GROUP BY 2, 3
UNION ALL SELECT 'json', class, intensity_idx, round(avg(delta_cost), 6), count(*) FROM results GROUP BY 2, 3""")
def result_sinks(spark, sf):
    from pollgauge.plans.faults import experiment_results

    results = evaluate.dose_response(experiment_results(spark, sf)).select("class", "intensity_idx", "delta_cost", "n")
    results = materialise(results, "results")
    schema = "class string, intensity_idx int, delta_cost double, n bigint"
    csv, json = work_path(spark, "csv"), work_path(spark, "json")
    results.write.option("header", True).csv(csv)
    results.write.json(json)
    back = spark.read.schema(schema).option("header", True).csv(csv).withColumn("sink", F.lit("csv"))
    both = back.unionByName(spark.read.schema(schema).json(json).withColumn("sink", F.lit("json")))
    return both.withColumn("delta_cost", C.rounded(F.col("delta_cost")))


@query("error_log_scan", "SELECT feed_id, error_kind, count(*) AS n FROM acq_log WHERE NOT ok GROUP BY 1, 2")
def error_log_scan(spark, sf):
    path = work_path(spark, "log")
    cols = [c.split()[0] for c in S.LOG_SCHEMA.split(", ")]
    adapters.acquisition_log(spark, sf).select(*cols, FEED).write.partitionBy(FEED).csv(path)
    rows = profile.parse_log(S.acquisition_log_scan(spark, path)).filter(~F.col("ok"))
    return rows.groupBy(FEED, "error_kind").agg(F.count(F.lit(1)).alias("n"))


