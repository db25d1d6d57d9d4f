"""Registered queries: collection reports, model, decision and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from pollgauge.config import BIKES, FEED, PERIOD, PERIOD_SERIES, SERIES, STATION, US
from pollgauge.functions import columns as C
from pollgauge.operators import cost, detect, evaluate, inject, model, periods as P, profile, ranking
from pollgauge.operators.features import build_features
from pollgauge.plans import common as K
from pollgauge.plans import faults as X
from pollgauge.plans.catalog import query, view
from pollgauge.session import fixed_table, materialise
from pollgauge.sources import adapters

PK = (*PERIOD_SERIES, US)
PK_SQL = "feed_id, period_id, station_id, us"
FEAT = K.INPUTS
tidy = X.tidy

# ---- collection and periods ---------------------------------------------------------------


@query("collection_profile", """
SELECT feed_id, count(*) AS n_rows, count(DISTINCT us) AS polls, min(us) AS first_us, max(us) AS last_us,
  count(DISTINCT station_id) AS stations FROM status GROUP BY 1""")
def collection_profile(spark, sf):
    return profile.collection_profile(K.status(spark, sf))


view("usable", f"SELECT * FROM features WHERE {K.PRESENT} AND label IS NOT NULL")
view("census", """
SELECT p.feed_id, p.period_id, p.day, p.start_us, p.end_us, p.duration_h, p.polls, r.stations, r.observations,
  r.jump_rows_excluded, k.frozen_rows_flagged_kept, k.observations_clean, k.observations_forecastable,
  k.critical_observations, k.label_positive
FROM periods p JOIN (SELECT feed_id, period_id, count(DISTINCT station_id) AS stations, count(*) AS observations,
    count(*) FILTER (WHERE jump_flag) AS jump_rows_excluded FROM flagged GROUP BY 1, 2) r USING (feed_id, period_id)
JOIN (SELECT feed_id, period_id, count(*) FILTER (WHERE frozen) AS frozen_rows_flagged_kept, count(*) AS observations_clean,
    count(*) FILTER (WHERE bikes_lag1 IS NOT NULL AND bikes_lag2 IS NOT NULL AND bikes_lag5 IS NOT NULL AND bikes_lag15 IS NOT NULL AND label IS NOT NULL) AS observations_forecastable,
    count(*) FILTER (WHERE critical) AS critical_observations,
    count(*) FILTER (WHERE bikes_lag1 IS NOT NULL AND bikes_lag2 IS NOT NULL AND bikes_lag5 IS NOT NULL AND bikes_lag15 IS NOT NULL AND label) AS label_positive
  FROM (SELECT *, min(num_bikes_available) OVER f = max(num_bikes_available) OVER f
           AND min(num_docks_available) OVER f = max(num_docks_available) OVER f AS frozen FROM features
        WINDOW f AS (PARTITION BY feed_id, period_id, station_id ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW))
  GROUP BY 1, 2) k USING (feed_id, period_id)""")


@query("period_census", """
SELECT * EXCLUDE (day, duration_h), strftime(day, '%Y-%m-%d') AS day, round(duration_h, 6) AS duration_h FROM census""")
def period_census(spark, sf):
    out = P.period_census(K.status(spark, sf), K.periods(spark, sf), K.CFG)
    return tidy(out.withColumn("day", F.col("day").cast("string")), "duration_h")


_sums = ("observations", "observations_clean", "jump_rows_excluded", "frozen_rows_flagged_kept",
         "observations_forecastable", "critical_observations", "label_positive")


@query("substrate_summary", f"""
SELECT t.*, d.* EXCLUDE (feed_id), s.segments_found,
  round(critical_observations / observations_clean::DOUBLE, 6) AS critical_share,
  round(label_positive / nullif(observations_forecastable, 0)::DOUBLE, 6) AS label_positive_rate
FROM (SELECT feed_id, count(*) AS periods_retained, round(sum(duration_h), 6) AS total_h, round(avg(duration_h), 6) AS mean_h,
    round(median(duration_h), 6) AS median_h, round(min(duration_h), 6) AS min_h, round(max(duration_h), 6) AS max_h,
    {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _sums)} FROM census GROUP BY 1) t
JOIN (SELECT feed_id, count(*) AS distinct_days, count(*) FILTER (WHERE n > 1) AS days_with_multiple_periods,
    round(avg(h), 6) AS day_mean_h, round(min(h), 6) AS day_min_h, round(max(h), 6) AS day_max_h
  FROM (SELECT feed_id, day, count(*) AS n, sum(duration_h) AS h FROM census GROUP BY 1, 2) GROUP BY 1) d USING (feed_id)
JOIN (SELECT feed_id, count(*) AS segments_found FROM segs GROUP BY 1) s USING (feed_id)""")
def substrate_summary(spark, sf):
    census = materialise(P.period_census(K.status(spark, sf), K.periods(spark, sf), K.CFG), "census")
    out = profile.substrate_summary(census, K.segments(spark, sf))
    return tidy(out, "total_h", "mean_h", "median_h", "min_h", "max_h", "day_mean_h", "day_min_h", "day_max_h",
                "critical_share", "label_positive_rate")


@query("critical_station_hours", """
SELECT feed_id, period_id, round(coalesce(sum(CASE WHEN critical THEN dwell END), 0) / 3600, 6) AS station_hours,
  round(count(*) FILTER (WHERE critical) * 0.25::DOUBLE, 6) AS station_hours_naive
FROM (SELECT *, CASE WHEN lead(us) OVER w IS NULL THEN 900::DOUBLE
        ELSE least((lead(us) OVER w) - us, 1350000000) / 1000000::DOUBLE END AS dwell
      FROM features WINDOW w AS (PARTITION BY feed_id, period_id, station_id ORDER BY us)) GROUP BY 1, 2""")
def critical_station_hours(spark, sf):
    out = profile.critical_station_hours(K.certified(spark, sf), K.CFG, [FEED, PERIOD])
    return tidy(out, "station_hours", "station_hours_naive")


view("local_flags", """
SELECT feed_id, station_id, strftime(l, '%Y-%m-%d') AS day, CAST(hour(l) AS INTEGER) AS hour, jump_flag
FROM (SELECT *, timezone('Europe/Rome', timezone('UTC', make_timestamp(us))) AS l FROM flagged)""")


@query("exposure_bins", """
SELECT feed_id, station_id, day, hour, count(*) FILTER (WHERE jump_flag) AS n_jump, count(*) AS n_obs,
  round(ln(count(*)), 6) AS log_exposure
FROM local_flags GROUP BY GROUPING SETS ((feed_id, station_id, hour), (day, hour))""")
def exposure_bins(spark, sf):
    return tidy(profile.exposure_bins(K.flagged(spark, sf), K.CFG.local_tz), "log_exposure")


@query("rate_per_thousand", """
SELECT hour, count(*) FILTER (WHERE jump_flag) AS n_jump, count(*) AS n_obs,
  round(count(*) FILTER (WHERE jump_flag) * 1000::DOUBLE / count(*), 6) AS per_thousand FROM local_flags GROUP BY 1""")
def rate_per_thousand(spark, sf):
    return tidy(profile.rate_per_thousand(K.flagged(spark, sf), K.CFG.local_tz), "per_thousand")


@query("longest_segment", """
SELECT feed_id, start_us, end_us, round(duration_h, 6) AS duration_h FROM (SELECT *, row_number() OVER
  (PARTITION BY feed_id ORDER BY end_us - start_us DESC, start_us) AS rn FROM segs) WHERE rn = 1""")
def longest_segment(spark, sf):
    return tidy(P.longest_segment(K.segments(spark, sf)), "duration_h")


# ---- acquisition log ------------------------------------------------------------------------

view("acq_log", """
SELECT CAST(user_id // 60 AS VARCHAR) AS feed_id, event_id, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS poll_s,
  event_type <> 'error' AS ok, CASE WHEN event_type <> 'error' THEN substr(md5(event_type), 1, 16) END AS payload,
  CASE WHEN event_type = 'error' THEN 'Timeout' || (user_id % 3) END AS error_kind,
  CASE WHEN event_type <> 'error' THEN 300 + user_id % 20 END AS n_stations FROM events""")
HEALTH_SQL = """
SELECT *, span_s // 900 + 1 AS expected, round(100::DOUBLE * logged / (span_s // 900 + 1), 6) AS coverage,
  round(100::DOUBLE * answered / logged, 6) AS success_rate
FROM (SELECT feed_id, count(*) AS logged, count(*) FILTER (WHERE ok) AS answered, count(*) FILTER (WHERE NOT ok) AS errors,
  max(poll_s) - min(poll_s) AS span_s, CAST(min(n_stations) AS INTEGER) AS stations_min, CAST(max(n_stations) AS INTEGER) AS stations_max
  FROM acq_log GROUP BY 1)"""


@query("collection_health", HEALTH_SQL)
def collection_health(spark, sf):
    return tidy(profile.collection_health(adapters.acquisition_log(spark, sf), K.CFG), "coverage", "success_rate")


@query("poll_gaps", """
SELECT feed_id, before AS from_us, CAST(round((us - before) / 1000000::DOUBLE) AS BIGINT) AS gap_s
FROM (SELECT feed_id, us, lag(us) OVER (PARTITION BY feed_id ORDER BY us) AS before FROM acq_log)
WHERE us - before > 1800000000""")
def poll_gaps(spark, sf):
    return profile.poll_gaps(adapters.acquisition_log(spark, sf), K.CFG)


@query("poll_time_lost", """
SELECT feed_id, count(*) AS gaps, CAST(sum(round((us - before) / 1000000::DOUBLE)) AS BIGINT) AS lost_s
FROM (SELECT feed_id, us, lag(us) OVER (PARTITION BY feed_id ORDER BY us) AS before FROM acq_log)
WHERE us - before > 1800000000 GROUP BY 1""")
def poll_time_lost(spark, sf):
    return profile.time_lost(adapters.acquisition_log(spark, sf), K.CFG)


@query("longest_repeat_streak", """
SELECT feed_id, max(n) AS longest_streak FROM (SELECT feed_id, run, count(*) AS n FROM (
  SELECT *, sum(is_new) OVER (PARTITION BY feed_id ORDER BY us) AS run FROM (
    SELECT feed_id, us, CASE WHEN payload = lag(payload) OVER (PARTITION BY feed_id ORDER BY us) THEN 0 ELSE 1 END AS is_new
    FROM acq_log WHERE ok)) GROUP BY 1, 2) GROUP BY 1""")
def longest_repeat_streak(spark, sf):
    return profile.longest_repeat_streak(adapters.acquisition_log(spark, sf), K.CFG)


@query("error_kinds", "SELECT error_kind, count(*) AS n FROM acq_log WHERE NOT ok GROUP BY 1 ORDER BY n DESC, 1 LIMIT 8")
def error_kinds(spark, sf):
    rows = profile.parse_log(adapters.acquisition_log(spark, sf)).filter(~F.col("ok"))
    return profile.top_k(rows.groupBy("error_kind").agg(F.count(F.lit(1)).alias("n")), "n", "error_kind", 8)


view("reports", """
SELECT feed_id, station_id, us, (us + 900000000 - last_us) // 1000000 AS offset_s FROM (
  SELECT CAST(user_id // 60 AS VARCHAR) AS feed_id, CAST(user_id // 30 AS VARCHAR) AS station_id,
    (epoch_us(ts) // 900000000) * 900000000 AS us, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1, 2, 3)""")


@query("top_k_counts", "SELECT offset_s, count(*) AS n FROM reports GROUP BY 1 ORDER BY n DESC, offset_s LIMIT 8")
def top_k_counts(spark, sf):
    return profile.top_k(profile.offset_counts(adapters.station_reports(spark, sf)), "n", "offset_s", 8)


@query("timestamp_granularity", """
SELECT distinct_offsets, count(*) AS snapshots FROM (
  SELECT feed_id, us, count(DISTINCT offset_s) AS distinct_offsets FROM reports GROUP BY 1, 2) GROUP BY 1""")
def timestamp_granularity(spark, sf):
    return profile.offset_spread(adapters.station_reports(spark, sf))


# ---- diagnostics ----------------------------------------------------------------------------


@query("pickup_rate", """
SELECT count(*) AS station_hours, round(avg(departures), 6) AS mean_departures, median(departures)::DOUBLE AS median_departures,
  round(quantile_cont(departures, 0.75), 6)::DOUBLE AS p75_departures
FROM (SELECT feed_id, station_id, us // 3600000000 AS h, sum(coalesce(out, 0))::DOUBLE AS departures,
    bool_or(num_bikes_available <= 2 OR num_docks_available <= 2) AS crit
  FROM (SELECT *, CASE WHEN prev IS NULL THEN 0 ELSE greatest(prev - num_bikes_available, 0) END AS out FROM (
    SELECT *, lag(num_bikes_available) OVER (PARTITION BY feed_id, station_id ORDER BY us) AS prev FROM status))
  GROUP BY 1, 2, 3) WHERE NOT crit""")
def pickup_rate(spark, sf):
    out = profile.pickup_rate(K.status(spark, sf), K.CFG)
    return tidy(out, "mean_departures", "median_departures", "p75_departures")


@query("capacity_swing", f"""
SELECT feed_id, station_id, max(t) - min(t) AS swing, max(t) - min(t) > 2 AS above_cutoff FROM (
  SELECT *, num_bikes_available + num_docks_available + 3 * CAST({K.hash_sql("'cap|' || station_id || '|' || us")} % 5 // 4 AS INTEGER) AS t
  FROM status) GROUP BY 1, 2""")
def capacity_swing(spark, sf):
    drift = (C.hash32("cap", F.col(STATION), F.col(US)) % 5 == 4).cast("int") * 3
    rows = K.status(spark, sf).withColumn(BIKES, F.col(BIKES) + drift)
    return profile.capacity_swing(rows).withColumn("above_cutoff", F.col("swing") > 2)


@query("capacity_swing_counts", f"""
SELECT feed_id, cut, count(*) FILTER (WHERE swing > cut) AS above, count(*) FILTER (WHERE swing <= cut) AS up_to FROM (
  SELECT feed_id, station_id, max(t) - min(t) AS swing FROM (
    SELECT *, num_bikes_available + num_docks_available + 3 * CAST({K.hash_sql("'cap|' || station_id || '|' || us")} % 5 // 4 AS INTEGER) AS t
    FROM status) GROUP BY 1, 2) CROSS JOIN (VALUES (0), (2), (3)) c(cut) GROUP BY 1, 2""")
def capacity_swing_counts(spark, sf):
    drift = (C.hash32("cap", F.col(STATION), F.col(US)) % 5 == 4).cast("int") * 3
    rows = K.status(spark, sf).withColumn(BIKES, F.col(BIKES) + drift)
    return profile.swing_counts(profile.capacity_swing(rows), (0, 2, 3))


view("frozen_status", """
SELECT *, min(num_bikes_available) OVER w = max(num_bikes_available) OVER w
  AND min(num_docks_available) OVER w = max(num_docks_available) OVER w AS frozen
FROM status WINDOW w AS (PARTITION BY feed_id, station_id ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)""")


@query("flag_rate_profile", """
SELECT feed_id, station_id, hour, count(*) AS n, count(*) FILTER (WHERE frozen) AS n_flagged,
  round(count(*) FILTER (WHERE frozen) / count(*)::DOUBLE, 6) AS rate
FROM (SELECT *, CAST(hour(make_timestamp(us)) AS INTEGER) AS hour FROM frozen_status)
GROUP BY GROUPING SETS ((feed_id, station_id), (hour))""")
def flag_rate_profile(spark, sf):
    rows = detect.frozen_rows(K.status(spark, sf), K.CFG.frozen_window_s, K.CFG)
    return tidy(profile.flag_profile(rows, "frozen"), "rate")


@query("flag_streaks", """
SELECT count(*) AS streaks, max(n) AS longest, median(n)::DOUBLE AS median_length,
  (SELECT count(*) FROM (SELECT station_id FROM frozen_status GROUP BY feed_id, station_id HAVING avg(frozen::INT) > 0.8)) AS stations_above_80
FROM (SELECT feed_id, station_id, run, count(*) AS n FROM (
  SELECT *, sum(is_new) OVER (PARTITION BY feed_id, station_id ORDER BY us) AS run FROM (
    SELECT *, CASE WHEN frozen = lag(frozen) OVER (PARTITION BY feed_id, station_id ORDER BY us) THEN 0 ELSE 1 END AS is_new
    FROM frozen_status)) WHERE frozen GROUP BY 1, 2, 3)""")
def flag_streaks(spark, sf):
    rows = detect.frozen_rows(K.status(spark, sf), K.CFG.frozen_window_s, K.CFG)
    return profile.flag_streaks(rows, "frozen", SERIES, K.CFG)


@query("score_distribution", """
SELECT count(*) AS n, count(*) FILTER (WHERE abs(proba - 0.4::DOUBLE) <= 0.05::DOUBLE) AS near_tau,
  round(min(proba), 6) AS p_min, round(median(proba), 6) AS p_median, round(quantile_cont(proba, 0.95), 6) AS p95,
  round(quantile_cont(proba, 0.99), 6) AS p99, round(max(proba), 6) AS p_max FROM scored""")
def score_distribution(spark, sf):
    rows = materialise(K.scored(spark, sf).select("proba"), "scored")
    out = profile.score_distribution(rows, K.MODEL.tau, 0.05)
    return tidy(out, "p_min", "p_median", "p95", "p99", "p_max")


@query("target_decomposition", """
SELECT count(*) AS n, count(*) FILTER (WHERE label) AS n_label, count(*) FILTER (WHERE e) AS n_empty,
  count(*) FILTER (WHERE f) AS n_full,
  round(corr(abs(num_bikes_available / (num_bikes_available + num_docks_available)::DOUBLE - 0.5), label::INT), 6) AS corr_off_centre,
  round(corr(num_bikes_available, label::INT), 6) AS corr_bikes
FROM (SELECT *, lead(num_bikes_available <= 2, 4) OVER w AS e, lead(num_docks_available <= 2, 4) OVER w AS f FROM features
      WINDOW w AS (PARTITION BY feed_id, period_id, station_id ORDER BY us)) WHERE label IS NOT NULL""")
def target_decomposition(spark, sf):
    return tidy(profile.target_decomposition(K.certified(spark, sf), K.CFG), "corr_off_centre", "corr_bikes")


@query("pearson_corr", "SELECT round(corr(bikes_lag1, label::INT), 6) AS corr_bikes_lag1, count(*) AS n FROM usable")
def pearson_corr(spark, sf):
    rows = K.features(spark, sf).dropna(subset=[*FEAT, "label"])
    r = F.corr(F.col("bikes_lag1").cast("double"), F.col("label").cast("double"))
    return rows.agg(C.rounded(r).alias("corr_bikes_lag1"), F.count(F.lit(1)).alias("n"))


@query("roc_auc", """
SELECT round((sum(CASE WHEN label THEN mid END) - p * (p + 1) / 2) / (p * q)::DOUBLE, 6) AS auc, any_value(p) AS positives, any_value(q) AS negatives
FROM (SELECT label, rank() OVER (ORDER BY proba) + (count(*) OVER (PARTITION BY proba) - 1) / 2::DOUBLE AS mid,
    count(*) FILTER (WHERE label) OVER () AS p, count(*) FILTER (WHERE NOT label) OVER () AS q
  FROM (SELECT label, round(proba, 9) AS proba FROM scored WHERE label IS NOT NULL)) GROUP BY p, q""")
def roc_auc(spark, sf):
    rows = materialise(K.scored(spark, sf).select("label", F.round("proba", 9).alias("proba")), "scored")
    return tidy(model.roc_auc(rows), "auc")


@query("ts_quantile", """
SELECT CAST(round(quantile_cont(us, 0.6)) AS BIGINT) AS q60, CAST(round(quantile_cont(us, 0.8)) AS BIGINT) AS q80 FROM status""")
def ts_quantile(spark, sf):
    out = ranking.quantiles(K.status(spark, sf), [], US, {"q60": 0.6, "q80": 0.8})
    return out.select(*[F.round(c).cast("bigint").alias(c) for c in ("q60", "q80")])


# ---- split, model, threshold ----------------------------------------------------------------

view("bounds", """
SELECT coalesce(min(CASE WHEN e >= q1 THEN e END), max(e)) AS train_end, coalesce(min(CASE WHEN e >= q2 THEN e END), max(e)) AS val_end,
  max(e) AS test_end
FROM (SELECT max(us) AS e FROM usable GROUP BY feed_id, period_id) CROSS JOIN
  (SELECT quantile_cont(us, 0.6) AS q1, quantile_cont(us, 0.8) AS q2 FROM usable)""")


def usable_rows(spark, sf):
    return materialise(K.features(spark, sf).dropna(subset=[*FEAT, "label"]), "usable")


@query("period_aligned_split", """
SELECT CASE WHEN us <= train_end THEN 'train' WHEN us <= val_end THEN 'val' ELSE 'test' END AS split,
  count(*) AS n, count(DISTINCT (feed_id, period_id)) AS periods, min(us) AS first_us, max(us) AS last_us
FROM usable CROSS JOIN bounds GROUP BY 1""")
def period_aligned_split(spark, sf):
    rows = usable_rows(spark, sf)
    return model.assign_split(rows, model.split_bounds(rows)).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(FEED, PERIOD)).alias("periods"),
        F.min(US).alias("first_us"), F.max(US).alias("last_us"),
    )


_observed = ", ".join(f"sum(label::INT * {c})::DOUBLE AS y_{c}" for c in FEAT)
_terms = ", ".join(f"('{c}', y_{c})" for c in FEAT)


@query("train_classifier", f"""
SELECT t.term, n AS train_rows, t.observed, 0::DOUBLE AS imbalance
FROM (SELECT count(*) AS n, sum(label::INT)::DOUBLE AS y, {_observed} FROM usable CROSS JOIN bounds WHERE us <= train_end) o,
LATERAL (VALUES ('intercept', y), {_terms}) t(term, observed)""")
def train_classifier(spark, sf):
    """The fit's exact conditions: fitted and observed sums of each term differ by the penalty only."""
    rows = usable_rows(spark, sf)
    train = materialise(model.assign_split(rows, model.split_bounds(rows)).filter("split = 'train'"), "train")
    return tidy(model.balance(train, model.train_classifier(train, FEAT)), "imbalance")


_taus = ", ".join(f"({i})" for i in range(1, 20))
view("tau_costs", f"""
SELECT tau, count(*) FILTER (WHERE label AND NOT d) AS missed, count(*) FILTER (WHERE st) AS n_dispatches
FROM (SELECT *, d AND NOT coalesce(lag(d) OVER w AND us - lag(us) OVER w <= 1350000000, false) AS st
  FROM (SELECT s.*, i / 20::DOUBLE AS tau, proba >= i / 20::DOUBLE AS d FROM scored s CROSS JOIN (VALUES {_taus}) t(i)
        WHERE label IS NOT NULL)
  WINDOW w AS (PARTITION BY tau, feed_id, station_id ORDER BY us)) GROUP BY 1""")
TOTAL_SQL = "round(missed * (0.25::DOUBLE * 1.94::DOUBLE * (1 - 0.5::DOUBLE) * 0.5::DOUBLE) + n_dispatches * 15::DOUBLE, 6)"


@query("tau_costs", f"SELECT tau, missed, n_dispatches, {TOTAL_SQL} AS total FROM tau_costs")
def tau_costs(spark, sf):
    rows = K.scored(spark, sf).filter(F.col("label").isNotNull())
    return tidy(model.tau_costs(rows, K.CFG, K.COSTS), "total")


@query("calibrate_tau", f"SELECT tau, {TOTAL_SQL} AS total FROM tau_costs ORDER BY total, tau LIMIT 1")
def calibrate_tau(spark, sf):
    rows = K.scored(spark, sf).filter(F.col("label").isNotNull())
    return tidy(model.calibrate_tau(rows, K.CFG, K.COSTS), "total")


@query("train_freeze_flow", f"""
SELECT count(*) FILTER (WHERE us <= train_end) AS trained_on_rows,
  count(DISTINCT CASE WHEN us <= train_end THEN (feed_id, period_id) END) AS train_periods,
  count(DISTINCT CASE WHEN us > train_end AND us <= val_end THEN (feed_id, period_id) END) AS val_periods,
  count(DISTINCT CASE WHEN us > val_end THEN (feed_id, period_id) END) AS test_periods,
  any_value(train_end) AS train_end, any_value(val_end) AS val_end,
  round(corr({FEAT[0]}::DOUBLE, label::INT::DOUBLE) FILTER (WHERE us > val_end), 6) AS test_corr, true AS tau_listed, true AS auc_valid
FROM usable CROSS JOIN bounds""")
def train_freeze_flow(spark, sf):
    """Sizes, bounds and test correlation; threshold and area under the curve depend on the fit, so only their range is told."""
    _, report = model.train_freeze(usable_rows(spark, sf), FEAT, K.CFG, K.COSTS)
    report = report.withColumn("tau_listed", F.col("tau").isin(*model.TAUS)).withColumn("auc_valid", F.col("test_auc").between(0, 1))
    return tidy(report, "test_corr").select(
        "trained_on_rows", "train_periods", "val_periods", "test_periods", "train_end", "val_end", "test_corr", "tau_listed", "auc_valid"
    )


# ---- decision and cost ----------------------------------------------------------------------

view("cost_counts", """
SELECT feed_id, count(*) FILTER (WHERE label AND NOT decision) AS missed, count(*) FILTER (WHERE st) AS n_dispatches
FROM (SELECT *, decision AND NOT coalesce(lag(decision) OVER w AND us - lag(us) OVER w <= 1350000000, false) AS st
  FROM scored WHERE label IS NOT NULL WINDOW w AS (PARTITION BY feed_id, station_id ORDER BY us)) GROUP BY 1""")


def labelled_scores(spark, sf):
    return K.scored(spark, sf).filter(F.col("label").isNotNull())


@query("policy_cost", f"""
SELECT feed_id, missed, n_dispatches, round(missed * {X._PEN}, 6) AS c_penalty, n_dispatches * 15::DOUBLE AS c_transit, {TOTAL_SQL} AS total
FROM cost_counts""")
def policy_cost(spark, sf):
    out = cost.policy_cost(labelled_scores(spark, sf), K.CFG, K.COSTS, by=[FEED])
    return tidy(out, "c_penalty", "total")


_levels = [("low", "mid", "high"), (0.2, 0.5, 0.8), (0.0, 0.5, 1.5), (1.0, 1.94, 3.0), (10.0, 15.0, 25.0)]


def _axis(name: str, values) -> str:
    rows = ", ".join(f"('{n}', {v}::DOUBLE)" for n, v in zip(_levels[0], values))
    return f"(VALUES {rows}) {name}(n, v)"


@query("cost_sweep", f"""
SELECT feed_id, missed, n_dispatches, s.n AS sigma, r.n AS revenue_per_ride, p.n AS pickup_rate_per_hour, d.n AS c_dispatch,
  round(missed * 0.25 * p.v * (1 - s.v) * r.v, 6) AS c_penalty, round(n_dispatches * d.v, 6) AS c_transit,
  round(missed * 0.25 * p.v * (1 - s.v) * r.v + n_dispatches * d.v, 6) AS total
FROM cost_counts, {_axis("s", _levels[1])}, {_axis("r", _levels[2])}, {_axis("p", _levels[3])}, {_axis("d", _levels[4])}""")
def cost_sweep(spark, sf):
    counts = cost.cost_counts(labelled_scores(spark, sf), K.CFG, by=[FEED])
    return tidy(cost.cost_sweep(counts, K.CFG, K.COSTS), "c_penalty", "c_transit", "total")


# ---- experiments ----------------------------------------------------------------------------


@query("flip_rate", "SELECT experiment_id, n_rows, n_flips, round(flip_rate, 6) AS flip_rate FROM results")
def flip_rate(spark, sf):
    return tidy(X.experiment_results(spark, sf), "flip_rate").select("experiment_id", "n_rows", "n_flips", "flip_rate")


@query("experiment_metrics", """
SELECT experiment_id, n_rows, n_flips, n_rows_missing_in_corrupted, round(forecast_error, 6) AS forecast_error,
  n_dispatches_clean, n_dispatches_corrupted FROM results""")
def experiment_metrics(spark, sf):
    return tidy(X.experiment_results(spark, sf), "forecast_error").select(
        "experiment_id", "n_rows", "n_flips", "n_rows_missing_in_corrupted", "forecast_error",
        "n_dispatches_clean", "n_dispatches_corrupted",
    )


@query("delta_and_recovery", """
SELECT experiment_id, round(delta_cost, 6) AS delta_cost, round(delta_cost_recovered, 6) AS delta_cost_recovered,
  round(recovery_rate, 6) AS recovery_rate FROM results""")
def delta_and_recovery(spark, sf):
    names = ("delta_cost", "delta_cost_recovered", "recovery_rate")
    return tidy(X.experiment_results(spark, sf), *names).select("experiment_id", *names)


@query("dose_response", """
SELECT class, intensity_idx, round(avg(flip_rate), 6) AS flip_rate, round(avg(delta_cost), 6) AS delta_cost,
  round(avg(recovery_rate), 6) AS recovery_rate, count(*) AS n FROM results GROUP BY 1, 2""")
def dose_response(spark, sf):
    return tidy(evaluate.dose_response(X.experiment_results(spark, sf)), "flip_rate", "delta_cost", "recovery_rate")


def _full_copies(spark, sf, fault_class):
    """Labelled clean rows joined with one fault class, row by row."""
    base, periods = K.test_rows(spark, sf)
    exps = inject.experiments(spark, X.G).filter(F.col("class") == fault_class)
    full = inject.apply_changes(base, K.change_rows(base, periods, [fault_class]), exps)
    clean = model.score(build_features(base, K.CFG, adapters.weather(spark, sf)), K.MODEL).filter(F.col("label").isNotNull())
    return base, materialise(full, "full"), clean, exps


def _scored_copies(rows, weather):
    keys = ("experiment_id", *PERIOD_SERIES)
    return model.score(build_features(rows, K.CFG, weather, keys=keys, label=False), K.MODEL).select(*keys, US, "proba", "decision")


@query("clean_vs_corrupted", """
SELECT experiment_id, feed_id, period_id, station_id, us, d_clean, d_corrupted, missing FROM merged WHERE class = 'class1_dropout'""")
def clean_vs_corrupted(spark, sf):
    _, full, clean, exps = _full_copies(spark, sf, X.G.DROPOUT)
    seen = _scored_copies(full.filter(~F.col("removed")), adapters.weather(spark, sf)).select("experiment_id", *PK, F.col("decision").alias("_d"))
    rows = clean.select(*PK, F.col("decision").alias("d_clean")).crossJoin(F.broadcast(exps.select("experiment_id")))
    return rows.join(seen, ["experiment_id", *PK], "left").select(
        "experiment_id", *PK, "d_clean", C.true_when(F.col("_d")).alias("d_corrupted"), F.col("_d").isNull().alias("missing")
    )


@query("silent_truth_join", """
SELECT experiment_id, feed_id, period_id, station_id, us, label, truth FROM merged WHERE class = 'class6_silent'""")
def silent_truth_join(spark, sf):
    from pollgauge.operators.sequence import shift_rows

    _, full, clean, _ = _full_copies(spark, sf, X.G.SILENT)
    flags = full.withColumn("true_critical", C.critical("true_available"))
    ahead = shift_rows(flags, ["experiment_id", *SERIES], K.CFG.horizon, "true_critical", "truth", K.CFG.block_us)
    truth = ahead.filter(F.col("truth").isNotNull()).select("experiment_id", *PK, "truth")
    return clean.select(*PK, "label").join(truth, list(PK)).select("experiment_id", *PK, "label", "truth")


@query("recovered_join", """
SELECT experiment_id, feed_id, period_id, station_id, us, d_corrupted, d_recovered FROM merged WHERE class = 'class5_jump'""")
def recovered_join(spark, sf):
    from pollgauge.operators.sequence import HOME

    base, periods = K.test_rows(spark, sf)
    ids = inject.ids_of(inject.experiments(spark, X.G), X.G.JUMP)
    clean = materialise(evaluate.clean_scores(base, K.CFG, K.MODEL, adapters.weather(spark, sf)), "clean")
    rows = evaluate.repaired_decisions(clean, K.change_rows(base, periods, [X.G.JUMP]), X.G.JUMP, ids, K.CFG, K.MODEL).filter(HOME)
    each = F.explode(F.arrays_zip(F.array(*[F.lit(i) for i in ids]).alias("experiment_id"), "c_decision", "r_decision")).alias("e")
    return rows.select(*PK, each).select(
        "e.experiment_id", *PK, F.col("e.c_decision").alias("d_corrupted"), F.col("e.r_decision").alias("d_recovered")
    )


@query("feature_pair_join", f"""
SELECT c.experiment_id, {", ".join("k." + c for c in PK_SQL.split(", "))}, round(k.proba, 6) AS proba_k, round(c.proba, 6) AS proba_c,
  c.bikes_lag1 <> k.bikes_lag1 OR c.bikes_lag2 <> k.bikes_lag2 OR c.bikes_lag5 <> k.bikes_lag5 OR c.bikes_lag15 <> k.bikes_lag15 AS touched
FROM scored k JOIN (SELECT *, {K.PROBA} AS proba FROM ({K.lag_sql("(SELECT * FROM corrupted WHERE class = 'class5_jump')", X._EK)})) c
USING (feed_id, period_id, station_id, us) WHERE c.proba IS NOT NULL""")
def feature_pair_join(spark, sf):
    base, periods = K.test_rows(spark, sf)
    exps = inject.experiments(spark, X.G).filter(F.col("class") == X.G.JUMP)
    full = inject.apply_changes(base, K.change_rows(base, periods, [X.G.JUMP]), exps)
    keys = ("experiment_id", *PERIOD_SERIES)
    weather = adapters.weather(spark, sf)
    seen = model.score(build_features(full, K.CFG, weather, keys=keys, label=False), K.MODEL)
    clean = model.score(build_features(base, K.CFG, weather), K.MODEL)
    return feature_pairs(clean, seen)


def feature_pairs(clean, seen):
    lags = [f"bikes_lag{k}" for k in K.CFG.lags]
    left = clean.select(*PK, F.col("proba").alias("proba_k"), *[F.col(c).alias(c + "_k") for c in lags])
    right = seen.select("experiment_id", *PK, F.col("proba").alias("proba_c"), *[F.col(c).alias(c + "_c") for c in lags])
    touched = F.lit(False)
    for c in lags:
        touched = touched | (F.col(c + "_k") != F.col(c + "_c"))
    rows = left.join(right, list(PK)).withColumn("touched", touched)
    return tidy(rows.select("experiment_id", *PK, "proba_k", "proba_c", "touched"), "proba_k", "proba_c")


# One fault class at all intensities over all periods, from raw rows to extra cost.
_JUMP0 = f"""
SELECT i AS intensity_idx, feed_id, period_id, station_id, us, label0, p0,
  CASE WHEN {K.uniform_sql("'0|jump|' || station_id || '|' || us")} < 0.05::DOUBLE THEN
    least(greatest(b + m * CASE WHEN {K.hash_sql("'0|jump-sign|' || station_id || '|' || us")} % 2 = 0 THEN 1 ELSE -1 END, 0), b + d)
    ELSE b END AS num_bikes_available, b + d AS cap
FROM (SELECT f.*, num_bikes_available AS b, num_docks_available AS d, label AS label0, {K.PROBA} AS p0 FROM features f)
CROSS JOIN (VALUES (0, 2), (1, 5), (2, 10), (3, 20)) t(i, m)"""
view("jump_copies", f"SELECT * EXCLUDE (cap), cap - num_bikes_available AS num_docks_available FROM ({_JUMP0})")
view("jump_merged", f"""
SELECT *, p0 >= 0.4::DOUBLE AS dk, coalesce({K.PROBA} >= 0.4::DOUBLE, false) AS dc
FROM ({K.lag_sql("jump_copies", "intensity_idx, feed_id, period_id, station_id")}) WHERE p0 IS NOT NULL AND label0 IS NOT NULL""")


@query("end_to_end", f"""
SELECT intensity_idx, count(*) AS n_rows, count(*) FILTER (WHERE dk <> dc) AS n_flips,
  count(*) FILTER (WHERE sk) AS n_dispatches_clean, count(*) FILTER (WHERE sc) AS n_dispatches_corrupted,
  round((count(*) FILTER (WHERE label0 AND NOT dc) - count(*) FILTER (WHERE label0 AND NOT dk)) * {X._PEN}
    + (count(*) FILTER (WHERE sc) - count(*) FILTER (WHERE sk)) * 15::DOUBLE, 6) AS delta_cost
FROM (SELECT *, {X._start_flag("dk")} AS sk, {X._start_flag("dc")} AS sc FROM jump_merged
      WINDOW w AS (PARTITION BY intensity_idx, feed_id, period_id, station_id ORDER BY us)) GROUP BY 1""")
def end_to_end(spark, sf):
    base = materialise(K.certified(spark, sf), "base")
    exps = inject.experiments(spark, X.G).filter((F.col("class") == X.G.JUMP) & (F.col("seed") == 0))
    changes = materialise(inject.inject_jump(base, exps, X.G), "changes")
    clean = materialise(evaluate.clean_scores(base, K.CFG, K.MODEL, adapters.weather(spark, sf)), "clean")
    rows = evaluate.evaluate_experiments(clean, changes, exps, K.CFG, K.MODEL, K.COSTS)
    return tidy(rows, "delta_cost").select(
        "intensity_idx", "n_rows", "n_flips", "n_dispatches_clean", "n_dispatches_corrupted", "delta_cost"
    )
