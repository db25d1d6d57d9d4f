"""Shared parameters, frames and SQL sub-selects of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pollgauge.config import PERIOD_SERIES, QUARTER_HOURLY, CostModel, FaultGrid, FrozenModel
from pollgauge.operators.detect import jump_rows
from pollgauge.operators.features import build_features
from pollgauge.operators.inject import change_rows as inject_changes
from pollgauge.operators.inject import chosen_periods
from pollgauge.operators.model import score
from pollgauge.operators.periods import (
    assign_period, certify_periods, continuity_segments, in_test_window, retained_periods,
)
from pollgauge.plans.catalog import view
from pollgauge.session import materialise
from pollgauge.sources import adapters

CFG = QUARTER_HOURLY
COSTS = CostModel()
GRID = FaultGrid().scaled(15)
MODEL = FrozenModel(
    -0.4,
    {
        "bikes_lag1": -0.15, "bikes_lag2": -0.02, "bikes_lag5": -0.01, "bikes_lag15": -0.01,
        "docks_lag1": 0.02, "docks_lag2": 0.01, "docks_lag5": 0.01, "docks_lag15": 0.01,
        "hour": 0.02, "weekday": 0.04, "temp_c": 0.01, "precip_mm": 0.001,
    },
    0.4,
)
INPUTS = list(MODEL.coefficients)
# Frozen split bounds of the driver data: 2024-01-24 00:00 and 2024-01-31 00:00 UTC.
VAL_END_US = 1_706_054_400_000_000
TEST_END_US = 1_706_659_200_000_000
TWO_FACTORS = ("class", "intensity_idx")


def test_periods(spark, sf) -> DataFrame:
    return in_test_window(periods(spark, sf), VAL_END_US, TEST_END_US)


def test_rows(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Certified rows of the test periods as a written table, and the test periods.

    Only the test periods go into the period match, so other rows leave before the first shuffle.
    """
    kept = materialise(test_periods(spark, sf), "periods")
    return materialise(certify_periods(status(spark, sf), kept, CFG), "base"), kept


def change_rows(base: DataFrame, kept: DataFrame, classes=None) -> DataFrame:
    """Changed rows of the grid; the drawn periods are written first, as several classes read them."""
    chosen = materialise(chosen_periods(base, kept, GRID), "chosen")
    return inject_changes(base, kept, GRID, classes, chosen)


def status(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.status(spark, sf)


def segments(spark, sf) -> DataFrame:
    return continuity_segments(status(spark, sf), CFG)


def periods(spark, sf) -> DataFrame:
    return retained_periods(segments(spark, sf))


def in_periods(spark, sf) -> DataFrame:
    return assign_period(status(spark, sf), periods(spark, sf), CFG)


def flagged(spark, sf) -> DataFrame:
    return jump_rows(in_periods(spark, sf), CFG, PERIOD_SERIES)


def certified(spark, sf) -> DataFrame:
    return certify_periods(status(spark, sf), periods(spark, sf), CFG)


def features(spark, sf) -> DataFrame:
    return build_features(certified(spark, sf), CFG, adapters.weather(spark, sf))


def scored(spark, sf) -> DataFrame:
    return score(features(spark, sf), MODEL)


view("received", """
SELECT CAST(3 * (user_id // 240) + CASE WHEN s = 0 THEN 0 WHEN s < 4 THEN 1 ELSE 2 END AS VARCHAR) AS feed_id,
       CAST(s - CASE WHEN s = 0 THEN 0 WHEN s < 4 THEN 1 ELSE 4 END AS VARCHAR) AS station_id, ts, value
FROM (SELECT *, (event_id + k) % 8 AS s FROM events CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) t(k))""")

view("status", """
SELECT feed_id, station_id, (epoch_us(ts) // 900000000) * 900000000 AS us,
       CAST(least(20, floor(max(value) / 5)) AS INTEGER) AS num_bikes_available,
       20 - CAST(least(20, floor(max(value) / 5)) AS INTEGER) AS num_docks_available
FROM received GROUP BY 1, 2, 3""")

view("poll_flags", """
SELECT feed_id, us,
       CASE WHEN us - lag(us) OVER (PARTITION BY feed_id ORDER BY us) <= 1350000000 THEN 0 ELSE 1 END AS is_new
FROM (SELECT DISTINCT feed_id, us FROM status)""")

view("segs", """
SELECT feed_id, segment, min(us) AS start_us, max(us) AS end_us, count(*) AS polls,
       (max(us) - min(us)) / 3600000000.0::DOUBLE AS duration_h,
       CAST(make_timestamp(min(us)) AS DATE) AS day,
       max(us) - min(us) >= 6300000000 AS retained
FROM (SELECT feed_id, us, sum(is_new) OVER (PARTITION BY feed_id ORDER BY us) AS segment FROM poll_flags)
GROUP BY feed_id, segment""")

view("periods", """
SELECT feed_id, CAST(row_number() OVER (PARTITION BY feed_id ORDER BY start_us) - 1 AS INTEGER) AS period_id,
       start_us, end_us, polls, duration_h, day
FROM segs WHERE retained""")

view("in_periods", """
SELECT s.feed_id, p.period_id, s.station_id, s.us, s.num_bikes_available, s.num_docks_available
FROM status s JOIN periods p ON s.feed_id = p.feed_id AND s.us BETWEEN p.start_us AND p.end_us""")

view("flagged", """
SELECT *, coalesce(abs(num_bikes_available - lag(num_bikes_available) OVER w)
                   > (us - lag(us) OVER w) / 60000000.0::DOUBLE, false) AS jump_flag
FROM in_periods WINDOW w AS (PARTITION BY feed_id, period_id, station_id ORDER BY us)""")

view("certified", "SELECT * EXCLUDE (jump_flag) FROM flagged WHERE NOT jump_flag")


def lag_sql(source: str, keys: str, extra: str = "*") -> str:
    """Features, weather and label of `source` as a SELECT, for the four lags of the feed."""
    lags = ",\n  ".join(
        f"CASE WHEN us - lag(us, {k}) OVER w <= {k * 1_350_000_000} THEN lag(num_{n}_available, {k}) OVER w END AS {n}_lag{k}"
        for k in (1, 2, 5, 15) for n in ("bikes", "docks")
    )
    return f"""
SELECT {extra}, num_bikes_available <= 2 OR num_docks_available <= 2 AS critical,
  {lags},
  CAST(hour(make_timestamp(us)) AS INTEGER) AS hour, CAST(isodow(make_timestamp(us)) - 1 AS INTEGER) AS weekday,
  CASE WHEN (lead(us, 4) OVER w) - us <= 5400000000
       THEN lead(num_bikes_available <= 2 OR num_docks_available <= 2, 4) OVER w END AS label
FROM (SELECT s_.*, w_.temp_c, w_.precip_mm FROM {source} s_ LEFT JOIN weather w_ ON (s_.us // 3600000000) * 3600000000 = w_.hour_us)
WINDOW w AS (PARTITION BY {keys} ORDER BY us)"""


view("features", lag_sql("certified", "feed_id, period_id, station_id"))
_TERMS = " + ".join(f"({w})::DOUBLE * {name}" for name, w in MODEL.coefficients.items())
PROBA = f"1 / (1 + exp(-(({MODEL.intercept})::DOUBLE + {_TERMS})))"
# A row that lacks an input, weather too, is not scored.
PRESENT = " AND ".join(f"{c} IS NOT NULL" for c in INPUTS)
view("scored", f"SELECT *, {PROBA} AS proba, {PROBA} >= 0.4::DOUBLE AS decision FROM features WHERE {PRESENT}")
view("feed_polls", """
SELECT CAST(user_id // 60 AS VARCHAR) AS feed_id, event_id, epoch_us(ts) AS request_us,
       epoch_us(ts) - CAST(floor(value) AS BIGINT) * 1000000 AS last_updated_us, md5(event_type) AS payload_sha256
FROM events""")
view("registry", """
SELECT feed_id, station_id, 'Station ' || station_id AS name, 20 AS capacity
FROM (SELECT DISTINCT feed_id, station_id FROM received UNION SELECT DISTINCT feed_id, 'absent-' || feed_id FROM received)""")
view("weather", """
SELECT * FROM (
  SELECT (epoch_us(ts) // 3600000000) * 3600000000 AS hour_us, avg(value) AS temp_c,
         CAST(count(*) AS DOUBLE) AS precip_mm FROM events GROUP BY 1)
WHERE ('0x' || substr(md5('weather|' || hour_us), 1, 8))::BIGINT % 7 <> 0""")


def hash_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def uniform_sql(text: str) -> str:
    return f"({hash_sql(text)}::DOUBLE / 4294967296::DOUBLE)"
