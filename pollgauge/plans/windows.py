"""Registered queries: predicates, windows, detectors, periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from pollgauge.config import BIKES, DOCKS, FEED, PERIOD, PERIOD_SERIES, SECOND_US, SERIES, STATION, US, FeedConfig
from pollgauge.functions import columns as C
from pollgauge.operators import detect, periods as P
from pollgauge.operators.features import build_features, forecastable, weather_join, with_lags
from pollgauge.operators.repair import carry_forward
from pollgauge.operators.sequence import Blocks, at_home, near_window, neighbourhood, shift_rows
from pollgauge.plans import common as K
from pollgauge.plans.catalog import query
from pollgauge.sources import adapters

KEY = [*SERIES, US]
PKEY = [*PERIOD_SERIES, US]
LAGS_SQL = "bikes_lag1, docks_lag1, bikes_lag2, docks_lag2, bikes_lag5, docks_lag5, bikes_lag15, docks_lag15"
K_SQL = "feed_id, station_id, us"
PK_SQL = "feed_id, period_id, station_id, us"
W_SERIES = "PARTITION BY feed_id, station_id ORDER BY us"
W_PERIOD = "PARTITION BY feed_id, period_id, station_id ORDER BY us"


# ---- predicates -----------------------------------------------------------------------


@query("critical_flag", f"""
SELECT {K_SQL}, num_bikes_available <= 2 OR num_docks_available <= 2 AS critical,
       num_bikes_available <= 1 OR num_docks_available <= 1 AS critical_1,
       num_bikes_available <= 3 OR num_docks_available <= 3 AS critical_3 FROM status""")
def critical_flag(spark, sf):
    return K.status(spark, sf).select(
        *KEY,
        C.critical(at=2).alias("critical"),
        C.critical(at=1).alias("critical_1"),
        C.critical(at=3).alias("critical_3"),
    )


@query("calendar_features", f"""
SELECT {K_SQL}, CAST(hour(make_timestamp(us)) AS INTEGER) AS hour,
       CAST(isodow(make_timestamp(us)) - 1 AS INTEGER) AS weekday FROM status""")
def calendar_features(spark, sf):
    return K.status(spark, sf).select(*KEY, C.utc_hour().alias("hour"), C.utc_weekday().alias("weekday"))


@query("local_calendar", f"""
SELECT {K_SQL}, CAST(hour(l) AS INTEGER) AS local_hour, strftime(l, '%Y-%m-%d') AS local_day
FROM (SELECT *, timezone('Europe/Rome', timezone('UTC', make_timestamp(us))) AS l FROM status)""")
def local_calendar(spark, sf):
    local = C.local_ts(US, K.CFG.local_tz)
    return K.status(spark, sf).select(
        *KEY, F.hour(local).alias("local_hour"), F.date_format(local, "yyyy-MM-dd").alias("local_day")
    )


@query("hour_floor", "SELECT event_id, (epoch_us(ts) // 3600000000) * 3600000000 AS hour_us FROM events")
def hour_floor(spark, sf):
    return adapters.table(spark, sf, "events").select("event_id", C.hour_us(C.micros("ts")).alias("hour_us"))


@query("forecastable_filter", f"""
SELECT {PK_SQL}, {LAGS_SQL}, label FROM features
WHERE {K.PRESENT} AND label IS NOT NULL""")
def forecastable_filter(spark, sf):
    cols = K.INPUTS
    return forecastable(K.features(spark, sf), cols).select(*PKEY, *K.CFG.feature_columns, "label")


@query("labelled_rows_only", f"SELECT {PK_SQL}, label FROM features WHERE label IS NOT NULL")
def labelled_rows_only(spark, sf):
    return build_features(K.certified(spark, sf), K.CFG).filter(F.col("label").isNotNull()).select(*PKEY, "label")


@query("test_period_filter", f"""
SELECT feed_id, period_id, start_us, end_us FROM periods
WHERE start_us > {K.VAL_END_US} AND start_us <= {K.TEST_END_US}""")
def test_period_filter(spark, sf):
    kept = P.in_test_window(K.periods(spark, sf), K.VAL_END_US, K.TEST_END_US)
    return kept.select(FEED, PERIOD, "start_us", "end_us")


@query("period_id_from_text", """
SELECT feed_id, CAST(regexp_extract(label, '(\\d+)', 1) AS INTEGER) AS period_id
FROM (SELECT feed_id, 'P' || lpad(CAST(period_id AS VARCHAR), 3, '0') AS label FROM periods)
WHERE CAST(regexp_extract(label, '(\\d+)', 1) AS INTEGER) >= 50""")
def period_id_from_text(spark, sf):
    text = F.concat(F.lit("P"), F.lpad(F.col(PERIOD).cast("string"), 3, "0")).alias("label")
    number = F.regexp_extract("label", r"(\d+)", 1).cast("int").alias(PERIOD)
    return K.periods(spark, sf).select(FEED, text).select(FEED, number).filter(F.col(PERIOD) >= 50)


@query("threshold_decision", f"SELECT {PK_SQL}, round(proba, 6) AS proba, decision FROM scored")
def threshold_decision(spark, sf):
    return K.scored(spark, sf).select(*PKEY, C.rounded(F.col("proba")).alias("proba"), "decision")


@query("true_critical", f"""
SELECT {K_SQL}, greatest(num_bikes_available - 2, 0) <= 2 OR num_docks_available <= 2 AS true_critical FROM status""")
def true_critical(spark, sf):
    rows = K.status(spark, sf).withColumn("true_available", F.greatest(F.col(BIKES) - 2, F.lit(0)))
    return rows.select(*KEY, C.critical("true_available").alias("true_critical"))


@query("exclude_flagged", f"SELECT {PK_SQL}, num_bikes_available, num_docks_available FROM certified")
def exclude_flagged(spark, sf):
    return K.certified(spark, sf).select(*PKEY, BIKES, DOCKS)


# ---- windows --------------------------------------------------------------------------


@query("gap_checked_lag", f"""
SELECT {K_SQL}, {LAGS_SQL}
FROM ({K.lag_sql("status", "feed_id, station_id")})""")
def gap_checked_lag(spark, sf):
    rows = build_features(K.status(spark, sf), K.CFG, keys=SERIES, label=False)
    return rows.select(*KEY, *K.CFG.feature_columns)


@query("horizon_label", f"SELECT {K_SQL}, critical, label FROM ({K.lag_sql('status', 'feed_id, station_id')})")
def horizon_label(spark, sf):
    return build_features(K.status(spark, sf), K.CFG, keys=SERIES).select(*KEY, "critical", "label")


@query("silent_label", f"""
SELECT {K_SQL}, lead(greatest(num_bikes_available - 2, 0) <= 2 OR num_docks_available <= 2, 4)
  OVER ({W_SERIES}) AS true_label FROM status""")
def silent_label(spark, sf):
    rows = K.status(spark, sf).withColumn(
        "true_critical", C.critical(F.greatest(F.col(BIKES) - 2, F.lit(0)))
    )
    out = shift_rows(rows, SERIES, K.CFG.horizon, "true_critical", "true_label", K.CFG.block_us)
    return out.select(*KEY, "true_label")


@query("step_change", f"""
SELECT {K_SQL}, abs(num_bikes_available - lag(num_bikes_available) OVER w) AS delta_bikes,
       round((us - lag(us) OVER w) / 60000000.0::DOUBLE, 6) AS elapsed_min FROM status WINDOW w AS ({W_SERIES})""")
def step_change(spark, sf):
    rows = detect.step_change(K.status(spark, sf), K.CFG)
    return rows.select(*KEY, "delta_bikes", C.rounded(F.col("elapsed_min")).alias("elapsed_min"))


FROZEN_SQL = f"""
SELECT {K_SQL}, min(num_bikes_available) OVER w = max(num_bikes_available) OVER w
  AND min(num_docks_available) OVER w = max(num_docks_available) OVER w AS frozen
FROM status WINDOW w AS ({W_SERIES} RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)"""


@query("detect_frozen", FROZEN_SQL)
def detect_frozen(spark, sf):
    return detect.frozen_rows(K.status(spark, sf), K.CFG.frozen_window_s, K.CFG).select(*KEY, "frozen")


@query("rolling_constant", f"""
SELECT {K_SQL}, min(num_bikes_available) OVER w = max(num_bikes_available) OVER w
  AND min(num_docks_available) OVER w = max(num_docks_available) OVER w AND count(*) OVER w >= 2 AS frozen
FROM status WINDOW w AS ({W_SERIES} RANGE BETWEEN 2699999999 PRECEDING AND CURRENT ROW)""")
def rolling_constant(spark, sf):
    return detect.frozen_rows(K.status(spark, sf), K.CFG.repair_window_s, K.CFG, min_rows=2).select(*KEY, "frozen")


REPEAT_SQL = """
SELECT feed_id, event_id, coalesce(payload_sha256 = lag(payload_sha256) OVER w, false) AS repeat_hash
FROM feed_polls WINDOW w AS (PARTITION BY feed_id ORDER BY request_us)"""


@query("repeat_of_previous", REPEAT_SQL)
def repeat_of_previous(spark, sf):
    return detect.repeat_of_previous(adapters.feed_polls(spark, sf), K.CFG).select(FEED, "event_id", "repeat_hash")


@query("continuity_segments", """
SELECT feed_id, start_us, end_us, polls, round(duration_h, 6) AS duration_h, strftime(day, '%Y-%m-%d') AS day, retained
FROM segs""")
def continuity_segments(spark, sf):
    return K.segments(spark, sf).select(
        FEED, "start_us", "end_us", "polls", C.rounded(F.col("duration_h")).alias("duration_h"),
        F.col("day").cast("string").alias("day"), "retained",
    )


@query("carry_forward", f"""
SELECT {PK_SQL},
  last_value(CASE WHEN NOT jump_flag THEN num_bikes_available END IGNORE NULLS) OVER w AS num_bikes_available,
  last_value(CASE WHEN NOT jump_flag THEN num_docks_available END IGNORE NULLS) OVER w AS num_docks_available
FROM flagged WINDOW w AS ({W_PERIOD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def carry_forward_query(spark, sf):
    return carry_forward(K.flagged(spark, sf), "jump_flag", K.CFG).select(*PKEY, BIKES, DOCKS)


@query("dispatch_episodes", f"""
SELECT feed_id, period_id, station_id, count(*) FILTER (WHERE decision) AS dispatch_rows,
       count(*) FILTER (WHERE decision AND NOT coalesce(before, false)) AS episodes
FROM (SELECT *, lag(decision) OVER w AND us - lag(us) OVER w <= 1350000000 AS before FROM scored WINDOW w AS ({W_PERIOD}))
GROUP BY 1, 2, 3""")
def dispatch_episodes(spark, sf):
    rows = P.episode_starts(K.scored(spark, sf), "decision", PERIOD_SERIES, K.CFG, gap=True)
    return rows.groupBy(*PERIOD_SERIES).agg(
        C.count_if(F.col("decision")).alias("dispatch_rows"), C.count_if(F.col("episode_start")).alias("episodes")
    )


@query("critical_episodes", f"""
SELECT feed_id, period_id, count(*) FILTER (WHERE critical AND NOT coalesce(before, false)) AS episodes
FROM (SELECT *, lag(critical) OVER w AS before FROM features WINDOW w AS ({W_PERIOD})) GROUP BY 1, 2""")
def critical_episodes(spark, sf):
    rows = P.critical_rows(K.certified(spark, sf), K.CFG)
    rows = P.episode_starts(rows, "critical", PERIOD_SERIES, K.CFG, gap=False)
    return rows.groupBy(FEED, PERIOD).agg(C.count_if(F.col("episode_start")).alias("episodes"))


@query("key_uniqueness_guard", """
WITH r AS (SELECT CAST(user_id // 60 AS VARCHAR) AS feed_id, CAST(user_id // 30 AS VARCHAR) AS station_id,
  (epoch_us(ts) // 900000000) * 900000000 AS us FROM events)
SELECT feed_id, station_id, us, count(*) AS copies FROM r GROUP BY 1, 2, 3 HAVING count(*) > 1
UNION ALL SELECT 'all', 'all', 0, (SELECT count(*) - count(DISTINCT (feed_id, station_id, us)) FROM r)
UNION ALL SELECT 'reduced', 'reduced', 0, (SELECT count(*) - count(DISTINCT (feed_id, station_id, us)) FROM status)
""".replace("WITH r AS", "SELECT * FROM (WITH r AS") + ")")
def key_uniqueness_guard(spark, sf):
    """Repeated keys among the raw readings, and how many are left once slots are reduced to one row."""

    def extra(found, name):
        copies = F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("copies")
        return found.agg(copies).select(F.lit(name).alias(FEED), F.lit(name).alias(STATION), F.lit(0).cast("bigint").alias(US), "copies")

    dup = repeated_keys(adapters.readings(spark, sf), KEY)
    return dup.unionByName(extra(dup, "all")).unionByName(extra(repeated_keys(K.status(spark, sf), KEY), "reduced"))


@query("boundary_probe", f"""
SELECT feed_id, period_id, count(*) FILTER (WHERE rn <= 1 AND bikes_lag1 IS NOT NULL) AS early_lag1,
  count(*) FILTER (WHERE rn <= 2 AND bikes_lag2 IS NOT NULL) AS early_lag2,
  count(*) FILTER (WHERE rn <= 5 AND bikes_lag5 IS NOT NULL) AS early_lag5,
  count(*) FILTER (WHERE rn <= 15 AND bikes_lag15 IS NOT NULL) AS early_lag15,
  count(*) FILTER (WHERE rd <= 4 AND label IS NOT NULL) AS late_labels, count(*) AS n
FROM (SELECT *, row_number() OVER ({W_PERIOD}) AS rn, row_number() OVER ({W_PERIOD} DESC) AS rd FROM features)
GROUP BY 1, 2""")
def boundary_probe(spark, sf):
    numbered = Blocks(build_features(K.certified(spark, sf), K.CFG), PERIOD_SERIES, K.CFG.block_us).running_sum("rn", F.lit(1)).frame()
    totals = numbered.groupBy(*PERIOD_SERIES).agg(F.max("rn").alias("_rows"))
    rows = numbered.join(totals, list(PERIOD_SERIES)).withColumn("rd", F.col("_rows") - F.col("rn") + 1)
    probes = [
        C.count_if((F.col("rn") <= k) & F.col(f"bikes_lag{k}").isNotNull()).alias(f"early_lag{k}") for k in K.CFG.lags
    ]
    late = C.count_if((F.col("rd") <= K.CFG.horizon) & F.col("label").isNotNull()).alias("late_labels")
    return rows.groupBy(FEED, PERIOD).agg(*probes, late, F.count(F.lit(1)).alias("n"))


def repeated_keys(rows, keys):
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


# ---- detectors ------------------------------------------------------------------------


@query("detect_dropout", """
SELECT r.feed_id, r.station_id, s.station_id IS NULL AS dropped FROM registry r
LEFT JOIN (SELECT DISTINCT feed_id, station_id FROM status) s USING (feed_id, station_id)""")
def detect_dropout(spark, sf):
    return detect.detect_dropout(K.status(spark, sf), adapters.registry(spark, sf))


@query("detect_dropout_windowed", """
WITH seen AS (SELECT DISTINCT feed_id, station_id, (us // 3600000000) * 3600000000 AS window_us FROM status)
SELECT r.feed_id, r.station_id, w.window_us FROM (SELECT DISTINCT feed_id, window_us FROM seen) w
JOIN registry r USING (feed_id) WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.feed_id = r.feed_id
  AND s.station_id = r.station_id AND s.window_us = w.window_us)""".replace("WITH seen AS", "SELECT * FROM (WITH seen AS") + ")")
def detect_dropout_windowed(spark, sf):
    return detect.detect_dropout_by_window(K.status(spark, sf), adapters.registry(spark, sf), 3600)


@query("detect_stale", f"""
SELECT p.feed_id, p.event_id, p.request_us - p.last_updated_us > 180000000 OR r.repeat_hash AS stale
FROM feed_polls p JOIN ({REPEAT_SQL}) r USING (event_id)""")
def detect_stale(spark, sf):
    return detect.detect_stale(adapters.feed_polls(spark, sf), K.CFG).select(FEED, "event_id", "stale")


@query("detect_type_mismatch", f"""
SELECT {K_SQL}, {K.hash_sql("'typed|' || station_id || '|' || us")} % 2 = 1 AS inconsistent FROM status""")
def detect_type_mismatch(spark, sf):
    rows = adapters.typed_counts(K.status(spark, sf))
    return detect.detect_type_mismatch(rows, ["bike", "ebike", "ebike_with_childseat"]).select(*KEY, "inconsistent")


@query("detect_capacity", f"""
SELECT {K_SQL}, num_bikes_available + 3 * ({K.hash_sql("'cap|' || station_id || '|' || us")} % 5 // 4)
  + num_docks_available <> capacity AS inconsistent FROM status JOIN registry USING (feed_id, station_id)""")
def detect_capacity(spark, sf):
    drift = (C.hash32("cap", F.col(STATION), F.col(US)) % 5 == 4).cast("int") * 3
    rows = K.status(spark, sf).withColumn(BIKES, F.col(BIKES) + drift)
    return detect.detect_capacity_mismatch(rows, adapters.registry(spark, sf)).select(*KEY, "inconsistent")


@query("detect_jump", f"""
SELECT {K_SQL}, coalesce(abs(num_bikes_available - lag(num_bikes_available) OVER w)
  > (us - lag(us) OVER w) / 60000000.0::DOUBLE, false) AS jump_flag FROM status WINDOW w AS ({W_SERIES})""")
def detect_jump(spark, sf):
    return detect.jump_rows(K.status(spark, sf), K.CFG).select(*KEY, "jump_flag")


LONGEST_SQL = f"""
WITH best AS (SELECT feed_id, arg_max(start_us, (end_us - start_us, -start_us)) AS s,
                     arg_max(end_us, (end_us - start_us, -start_us)) AS e FROM segs GROUP BY 1),
rows_in AS (SELECT t.* FROM status t JOIN best b ON t.feed_id = b.feed_id AND t.us BETWEEN b.s AND b.e),
jumps AS (SELECT *, coalesce(abs(num_bikes_available - lag(num_bikes_available) OVER w)
  > (us - lag(us) OVER w) / 60000000.0::DOUBLE, false) AS jump_flag FROM rows_in WINDOW w AS ({W_SERIES}))
SELECT {K_SQL}, min(num_bikes_available) OVER f = max(num_bikes_available) OVER f
  AND min(num_docks_available) OVER f = max(num_docks_available) OVER f AS frozen
FROM jumps WHERE NOT jump_flag WINDOW f AS ({W_SERIES} RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)"""


@query("certify_longest", LONGEST_SQL.replace("\nWITH best", "SELECT * FROM (WITH best", 1) + ")")
def certify_longest(spark, sf):
    return P.certify_longest(K.status(spark, sf), K.CFG).select(*KEY, "frozen")


@query("certify_longest_counts", LONGEST_SQL.replace("\nWITH best", "SELECT feed_id, count(*) AS rows_clean, count(*) FILTER (WHERE frozen) AS frozen_rows FROM (WITH best", 1) + ") GROUP BY 1")
def certify_longest_counts(spark, sf):
    rows = P.certify_longest(K.status(spark, sf), K.CFG)
    return rows.groupBy(FEED).agg(F.count(F.lit(1)).alias("rows_clean"), C.count_if(F.col("frozen")).alias("frozen_rows"))


@query("certify_periods", """
SELECT c.feed_id, c.period_id, count(*) AS rows_clean, any_value(f.n) AS jump_rows
FROM certified c JOIN (SELECT feed_id, period_id, count(*) FILTER (WHERE jump_flag) AS n FROM flagged GROUP BY 1, 2) f
USING (feed_id, period_id) GROUP BY 1, 2""")
def certify_periods(spark, sf):
    return K.flagged(spark, sf).groupBy(FEED, PERIOD).agg(
        C.count_if(~F.col("jump_flag")).alias("rows_clean"), C.count_if(F.col("jump_flag")).alias("jump_rows")
    )


# ---- joins on the status frame -----------------------------------------------------------


@query("weather_join", f"""
SELECT {K_SQL}, round(temp_c, 6) AS temp_c, precip_mm FROM status s
LEFT JOIN weather w ON (s.us // 3600000000) * 3600000000 = w.hour_us""")
def weather_join_query(spark, sf):
    rows = weather_join(K.status(spark, sf), adapters.weather(spark, sf))
    return rows.select(*KEY, C.rounded(F.col("temp_c")).alias("temp_c"), "precip_mm")


@query("assign_period", f"SELECT {PK_SQL} FROM in_periods")
def assign_period(spark, sf):
    return K.in_periods(spark, sf).select(*PKEY)


@query("registry_anti", """
SELECT feed_id, station_id, name, capacity FROM registry r WHERE NOT EXISTS (
  SELECT 1 FROM status s WHERE s.feed_id = r.feed_id AND s.station_id = r.station_id)""")
def registry_anti(spark, sf):
    return detect.registry_absent(K.status(spark, sf), adapters.registry(spark, sf))


@query("build_features", f"""
SELECT {PK_SQL}, critical, {LAGS_SQL}, hour, weekday,
       round(temp_c, 6) AS temp_c, precip_mm, label
FROM features""")
def build_features_query(spark, sf):
    rows = build_features(K.certified(spark, sf), K.CFG, adapters.weather(spark, sf))
    return rows.select(
        *PKEY, "critical", *K.CFG.feature_columns, "hour", "weekday",
        C.rounded(F.col("temp_c")).alias("temp_c"), "precip_mm", "label",
    )


@query("score", f"SELECT {PK_SQL}, round(proba, 6) AS proba FROM scored WHERE label IS NOT NULL")
def score_query(spark, sf):
    rows = K.scored(spark, sf).filter(F.col("label").isNotNull())
    return rows.select(*PKEY, C.rounded(F.col("proba")).alias("proba"))


# ---- the same windows on the large tables, at daily cadence --------------------------------

DAILY = FeedConfig(cadence_s=86_400, lags=(1, 2, 5), horizon=7, block_s=86_400 * 180)
DAY_US = 86_400 * SECOND_US


@query("supplier_daily_lags", """
SELECT l_suppkey, us, qty,
  CASE WHEN us - lag(us, 1) OVER w <= 129600000000 THEN lag(qty, 1) OVER w END AS qty_lag1,
  CASE WHEN us - lag(us, 2) OVER w <= 259200000000 THEN lag(qty, 2) OVER w END AS qty_lag2,
  CASE WHEN us - lag(us, 5) OVER w <= 648000000000 THEN lag(qty, 5) OVER w END AS qty_lag5
FROM (SELECT l_suppkey, (epoch_us(l_shipdate) // 86400000000) * 86400000000 AS us, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1, 2)
WINDOW w AS (PARTITION BY l_suppkey ORDER BY us)""")
def supplier_daily_lags(spark, sf):
    day = C.floor_to(C.micros("l_shipdate"), DAY_US).alias(US)
    daily = adapters.table(spark, sf, "lineitem").groupBy("l_suppkey", day).agg(F.round(F.sum("l_quantity"), 2).alias("qty"))
    near = neighbourhood(daily, DAILY.lag_reach_us, 0, DAILY.block_us)
    rows = at_home(with_lags(near, DAILY, near_window(["l_suppkey"]), "qty", "qty"))
    return rows.select("l_suppkey", US, "qty", *[F.col(f"bikes_lag{k}").alias(f"qty_lag{k}") for k in DAILY.lags])


@query("customer_order_steps", """
SELECT o_custkey, us, total, round(total - lag(total) OVER w, 2) AS delta, (us - lag(us) OVER w) // 86400000000 AS gap_days
FROM (SELECT o_custkey, (epoch_us(o_orderdate) // 86400000000) * 86400000000 AS us, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2)
WINDOW w AS (PARTITION BY o_custkey ORDER BY us)""")
def customer_order_steps(spark, sf):
    day = C.floor_to(C.micros("o_orderdate"), DAY_US).alias(US)
    daily = adapters.table(spark, sf, "orders").groupBy("o_custkey", day).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    rows = Blocks(daily, ["o_custkey"], DAILY.block_us).previous("prev", [US, "total"]).frame()
    return rows.select(
        "o_custkey", US, "total", F.round(F.col("total") - F.col("prev.total"), 2).alias("delta"),
        ((F.col(US) - F.col("prev.us")) / DAY_US).cast("bigint").alias("gap_days"),
    )
