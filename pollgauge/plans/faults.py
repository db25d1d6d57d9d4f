"""Registered queries: repair, fault injection, cost and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pollgauge.config import BIKES, DOCKS, FEED, PERIOD, PERIOD_SERIES, SERIES, STATION, US
from pollgauge.functions import columns as C
from pollgauge.operators import evaluate, inject
from pollgauge.operators.inject import EXPERIMENT
from pollgauge.operators.repair import safeguard_repair
from pollgauge.plans import common as K
from pollgauge.plans.catalog import query, view
from pollgauge.session import materialise, work_path
from pollgauge.sources import adapters
from pollgauge.sources import delta_store

PK = (*PERIOD_SERIES, US)
CHANGE_COLS = (*EXPERIMENT, *PK, "removed", BIKES, DOCKS, "true_available")
CHANGE_SQL = ", ".join(CHANGE_COLS)
G = K.GRID

_rows = ", ".join(
    f"('{c}__i{i}__seed{s}', '{c}', {i}, {s}, {k}, {w}::BIGINT, {m}, {r}::DOUBLE)" for c, i, s, k, w, m, r in G.rows()
)
view("exps", f"""
SELECT * FROM (VALUES {_rows})
  AS t(experiment_id, class, intensity_idx, seed, stations, window_s, magnitude, rate)""")
view("seeds", "SELECT DISTINCT seed FROM exps")
view("test_periods", f"SELECT * FROM periods WHERE start_us > {K.VAL_END_US} AND start_us <= {K.TEST_END_US}")
view("base", "SELECT c.* FROM certified c SEMI JOIN test_periods p USING (feed_id, period_id)")
view("chosen", f"""
SELECT q.feed_id, q.seed, q.period_id, q.start_us, q.end_us, b.t_min, b.t_max
FROM (SELECT p.*, seed, row_number() OVER (PARTITION BY feed_id, seed ORDER BY
        {K.hash_sql("seed || '|period|' || feed_id || '|' || period_id")}, period_id) AS rn
      FROM test_periods p CROSS JOIN seeds) q
JOIN (SELECT feed_id, period_id, min(us) AS t_min, max(us) AS t_max FROM base GROUP BY 1, 2) b USING (feed_id, period_id)
WHERE rn = 1""")


def _targets(purpose: str) -> str:
    return f"""
SELECT s.feed_id, s.period_id, s.station_id, s.s_min, s.s_max, c.seed, c.t_min, c.t_max, c.end_us,
  row_number() OVER (PARTITION BY s.feed_id, c.seed ORDER BY
    {K.hash_sql(f"c.seed || '|{purpose}|' || s.station_id")}, s.station_id) AS rank
FROM (SELECT feed_id, period_id, station_id, min(us) AS s_min, max(us) AS s_max FROM base GROUP BY 1, 2, 3) s
JOIN chosen c USING (feed_id, period_id)"""


def _start(purpose: str, low: str, high: str) -> str:
    room = f"({high} - window_s * 1000000 - {low})"
    u = K.uniform_sql(f"seed || '|{purpose}|' || station_id")
    return f"CASE WHEN {room} <= 0 THEN {low} ELSE {low} + CAST(floor({u} * {room}) AS BIGINT) END"


_ids = "e.experiment_id, e.class, e.intensity_idx, e.seed, b.feed_id, b.period_id, b.station_id, b.us"
view("changes_dropout", f"""
SELECT {_ids}, true AS removed, b.num_bikes_available, b.num_docks_available, NULL::INTEGER AS true_available
FROM (SELECT t.*, e2.experiment_id, e2.class, e2.intensity_idx, e2.window_s, {_start("dropout-start", "t_min", "t_max")} AS s0
      FROM ({_targets("dropout")}) t JOIN exps e2 USING (seed) WHERE class = 'class1_dropout' AND rank <= stations) e
JOIN base b USING (feed_id, period_id, station_id) WHERE b.us BETWEEN s0 AND s0 + window_s * 1000000""")
view("changes_frozen", f"""
SELECT * FROM (
  SELECT {_ids}, false AS removed, first_value(b.num_bikes_available) OVER w AS num_bikes_available,
    first_value(b.num_docks_available) OVER w AS num_docks_available, NULL::INTEGER AS true_available,
    b.num_bikes_available AS b0, b.num_docks_available AS d0
  FROM (SELECT t.*, e2.experiment_id, e2.class, e2.intensity_idx, e2.window_s, {_start("frozen-start", "s_min", "s_max")} AS s0
        FROM ({_targets("frozen")}) t JOIN exps e2 USING (seed) WHERE class = 'class2_frozen' AND rank = 1) e
  JOIN base b USING (feed_id, period_id, station_id) WHERE b.us BETWEEN s0 AND s0 + window_s * 1000000
  WINDOW w AS (PARTITION BY e.experiment_id, b.feed_id ORDER BY b.us))
WHERE num_bikes_available <> b0 OR num_docks_available <> d0""")
view("stale_from", f"""
SELECT experiment_id, class, intensity_idx, seed, window_s, feed_id, period_id, us AS from_us FROM (
  SELECT *, row_number() OVER (PARTITION BY experiment_id, feed_id ORDER BY
      {K.hash_sql("seed || '|stale|' || feed_id || '|' || us")}, us) AS rn
  FROM (SELECT p.feed_id, p.period_id, p.us, e.*, max(p.us) OVER (PARTITION BY e.experiment_id, p.feed_id) AS last_us
        FROM (SELECT DISTINCT feed_id, period_id, us FROM base) p JOIN chosen c USING (feed_id, period_id)
        JOIN exps e ON e.seed = c.seed AND e.class = 'class3_stale'
        WHERE p.us BETWEEN c.start_us AND c.end_us - e.window_s * 1000000)
  WHERE us < last_us) WHERE rn = 1""")
view("changes_stale", f"""
SELECT {_ids}, false AS removed, h.num_bikes_available, h.num_docks_available, NULL::INTEGER AS true_available
FROM stale_from e JOIN base b ON b.feed_id = e.feed_id AND b.period_id = e.period_id
  AND b.us > from_us AND b.us <= from_us + window_s * 1000000
LEFT JOIN base h ON h.feed_id = e.feed_id AND h.period_id = e.period_id AND h.us = from_us AND h.station_id = b.station_id
WHERE h.num_bikes_available IS DISTINCT FROM b.num_bikes_available OR h.num_docks_available IS DISTINCT FROM b.num_docks_available""")
view("drift_start", f"""
SELECT feed_id, period_id, station_id, seed, us AS s0 FROM (
  SELECT b.*, t.seed, row_number() OVER (PARTITION BY b.feed_id, t.seed ORDER BY
    CASE WHEN b.us <= t.s_max - {G.min_effect_s}::BIGINT * 1000000 THEN 0 ELSE 1 END,
    CASE WHEN b.us <= t.s_max - {G.min_effect_s}::BIGINT * 1000000 THEN {K.hash_sql("t.seed || '|drift|' || b.us")} ELSE b.us END,
    b.us) AS rn
  FROM base b JOIN ({_targets("capacity")}) t USING (feed_id, period_id, station_id) WHERE t.rank = 1) WHERE rn = 1""")
view("changes_capacity", f"""
SELECT {_ids}, false AS removed, greatest(b.num_bikes_available + e.magnitude, 0) AS num_bikes_available,
  b.num_docks_available, NULL::INTEGER AS true_available
FROM drift_start d JOIN exps e ON e.seed = d.seed AND e.class = 'class4_capacity'
JOIN base b ON b.feed_id = d.feed_id AND b.period_id = d.period_id AND b.station_id = d.station_id AND b.us >= d.s0""")
view("changes_jump", f"""
SELECT * FROM (
  SELECT {_ids}, false AS removed,
    least(greatest(b.num_bikes_available + magnitude * CASE WHEN
      {K.hash_sql("e.seed || '|jump-sign|' || b.station_id || '|' || b.us")} % 2 = 0 THEN 1 ELSE -1 END, 0),
      b.num_bikes_available + b.num_docks_available) AS num_bikes_available,
    b.num_bikes_available + b.num_docks_available - num_bikes_available AS d1, NULL::INTEGER AS true_available,
    b.num_bikes_available AS b0, b.num_bikes_available + b.num_docks_available AS cap
  FROM base b JOIN exps e ON e.class = 'class5_jump'
  WHERE {K.uniform_sql("e.seed || '|jump|' || b.station_id || '|' || b.us")} < e.rate)
WHERE num_bikes_available <> b0""")
view("silent_stations", f"""
SELECT feed_id, station_id, seed FROM (
  SELECT feed_id, station_id, seed, row_number() OVER (PARTITION BY feed_id, seed ORDER BY
      {K.hash_sql("seed || '|silent|' || station_id")}, station_id) AS rank,
    greatest(1, round_even({G.silent_share}::DOUBLE * count(*) OVER (PARTITION BY feed_id, seed), 0)) AS wanted
  FROM (SELECT DISTINCT feed_id, station_id FROM base) CROSS JOIN seeds) WHERE rank <= wanted""")
view("changes_silent", f"""
SELECT {_ids}, false AS removed, b.num_bikes_available, b.num_docks_available,
  greatest(b.num_bikes_available - e.magnitude, 0) AS true_available
FROM silent_stations s JOIN exps e ON e.seed = s.seed AND e.class = 'class6_silent'
JOIN base b ON b.feed_id = s.feed_id AND b.station_id = s.station_id WHERE b.num_bikes_available > 0""")
view("changes", f"""
SELECT {CHANGE_SQL} FROM changes_dropout UNION ALL SELECT {CHANGE_SQL} FROM changes_frozen
UNION ALL SELECT {CHANGE_SQL} FROM changes_stale UNION ALL SELECT {CHANGE_SQL} FROM changes_capacity
UNION ALL SELECT experiment_id, class, intensity_idx, seed, feed_id, period_id, station_id, us, removed,
  num_bikes_available, cap - num_bikes_available, true_available FROM changes_jump
UNION ALL SELECT {CHANGE_SQL} FROM changes_silent""")

# Full corrupted copies, scored, repaired and compared row by row.
view("corrupted", """
SELECT e.experiment_id, e.class, e.intensity_idx, e.seed, b.feed_id, b.period_id, b.station_id, b.us,
  CASE WHEN c.us IS NULL THEN b.num_bikes_available ELSE c.num_bikes_available END AS num_bikes_available,
  CASE WHEN c.us IS NULL THEN b.num_docks_available ELSE c.num_docks_available END AS num_docks_available,
  coalesce(c.true_available, b.num_bikes_available) AS true_available, coalesce(c.removed, false) AS removed
FROM base b CROSS JOIN exps e LEFT JOIN changes c
  ON c.experiment_id = e.experiment_id AND c.feed_id = b.feed_id AND c.period_id = b.period_id
  AND c.station_id = b.station_id AND c.us = b.us""")
view("corrupted_kept", "SELECT * FROM corrupted WHERE NOT removed")
_EK = "experiment_id, feed_id, period_id, station_id"
view("corrupted_scored", f"""
SELECT {_EK}, us, {K.PROBA} AS proba, {K.PROBA} >= 0.4::DOUBLE AS decision
FROM ({K.lag_sql("corrupted_kept", _EK)}) WHERE {K.PRESENT}""")
view("repair_flags", f"""
SELECT *, CASE WHEN class = 'class2_frozen' THEN
    min(num_bikes_available) OVER f = max(num_bikes_available) OVER f
    AND min(num_docks_available) OVER f = max(num_docks_available) OVER f
  WHEN class = 'class5_jump' THEN coalesce(abs(num_bikes_available - lag(num_bikes_available) OVER w)
    > (us - lag(us) OVER w) / 60000000.0::DOUBLE, false) ELSE false END AS flag
FROM corrupted WHERE class IN ('class2_frozen', 'class4_capacity', 'class5_jump')
WINDOW w AS (PARTITION BY {_EK} ORDER BY us),
  f AS (PARTITION BY {_EK} ORDER BY us RANGE BETWEEN 2699999999 PRECEDING AND CURRENT ROW)""")
view("recovered", f"""
SELECT * FROM (SELECT experiment_id, class, intensity_idx, seed, feed_id, period_id, station_id, us,
  last_value(CASE WHEN NOT flag THEN num_bikes_available END IGNORE NULLS) OVER w AS num_bikes_available,
  last_value(CASE WHEN NOT flag THEN num_docks_available END IGNORE NULLS) OVER w AS num_docks_available
  FROM repair_flags WINDOW w AS (PARTITION BY {_EK} ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE num_bikes_available IS NOT NULL AND num_docks_available IS NOT NULL""")
view("recovered_scored", f"""
SELECT {_EK}, us, {K.PROBA} AS proba, {K.PROBA} >= 0.4::DOUBLE AS decision
FROM ({K.lag_sql("recovered", _EK)}) WHERE {K.PRESENT}""")
view("true_labels", f"""
SELECT {_EK}, us, lead(true_available <= 2 OR num_docks_available <= 2, 4)
  OVER (PARTITION BY experiment_id, feed_id, station_id ORDER BY us) AS true_label
FROM corrupted WHERE class = 'class6_silent'""")
view("merged", """
SELECT e.experiment_id, e.class, e.intensity_idx, e.seed, k.feed_id, k.period_id, k.station_id, k.us,
  k.proba AS p_clean, k.decision AS d_clean, k.label, c.proba AS p_corrupted,
  coalesce(c.decision, false) AS d_corrupted, c.decision IS NULL AS missing,
  coalesce(r.decision, c.decision, false) AS d_recovered,
  CASE WHEN e.class = 'class6_silent' THEN t.true_label ELSE k.label END AS truth
FROM scored k SEMI JOIN test_periods p USING (feed_id, period_id) CROSS JOIN exps e
LEFT JOIN corrupted_scored c ON c.experiment_id = e.experiment_id AND c.feed_id = k.feed_id AND c.period_id = k.period_id
  AND c.station_id = k.station_id AND c.us = k.us
LEFT JOIN recovered_scored r ON r.experiment_id = e.experiment_id AND r.feed_id = k.feed_id AND r.period_id = k.period_id
  AND r.station_id = k.station_id AND r.us = k.us
LEFT JOIN true_labels t ON t.experiment_id = e.experiment_id AND t.feed_id = k.feed_id AND t.period_id = k.period_id
  AND t.station_id = k.station_id AND t.us = k.us
WHERE k.label IS NOT NULL AND (e.class <> 'class6_silent' OR t.true_label IS NOT NULL)""")
_PEN = "(0.25::DOUBLE * 1.94::DOUBLE * (1 - 0.5::DOUBLE) * 0.5::DOUBLE)"


def _start_flag(d: str) -> str:
    return f"{d} AND NOT coalesce(lag({d}) OVER w AND us - lag(us) OVER w <= 1350000000, false)"


view("eval_counts", f"""
SELECT experiment_id, class, intensity_idx, seed, count(*) AS n_rows,
  count(*) FILTER (WHERE d_clean <> d_corrupted) AS n_flips, count(*) FILTER (WHERE missing) AS n_missing,
  sum(abs(p_corrupted - p_clean)) AS abs_err,
  count(*) FILTER (WHERE sk) AS n_dispatches_clean, count(*) FILTER (WHERE sc) AS n_dispatches_corrupted,
  round(count(*) FILTER (WHERE label AND NOT d_clean) * {_PEN} + count(*) FILTER (WHERE sk) * 15::DOUBLE, 6) AS kc,
  round(count(*) FILTER (WHERE truth AND NOT d_corrupted) * {_PEN} + count(*) FILTER (WHERE sc) * 15::DOUBLE, 6) AS cc,
  CASE WHEN class IN ('class2_frozen', 'class4_capacity', 'class5_jump') THEN
    round(count(*) FILTER (WHERE label AND NOT d_recovered) * {_PEN} + count(*) FILTER (WHERE sr) * 15::DOUBLE, 6) END AS rc
FROM (SELECT *, {_start_flag("d_clean")} AS sk, {_start_flag("d_corrupted")} AS sc, {_start_flag("d_recovered")} AS sr
      FROM merged WINDOW w AS (PARTITION BY experiment_id, feed_id, period_id, station_id ORDER BY us))
GROUP BY 1, 2, 3, 4""")
view("results", """
SELECT experiment_id, class, intensity_idx, seed, n_rows, n_flips, n_missing AS n_rows_missing_in_corrupted,
  n_flips / n_rows::DOUBLE AS flip_rate,
  coalesce(abs_err, 0) / nullif(n_rows - n_missing, 0) AS forecast_error,
  n_dispatches_clean, n_dispatches_corrupted, cc - kc AS delta_cost, rc - kc AS delta_cost_recovered,
  CASE WHEN class = 'class6_silent' THEN 0::DOUBLE ELSE (cc - rc) / nullif(cc - kc, 0) END AS recovery_rate
FROM eval_counts""")
ROUNDED = ("flip_rate", "forecast_error", "delta_cost", "delta_cost_recovered", "recovery_rate")


def changes_of(spark, sf, *classes):
    base, periods = K.test_rows(spark, sf)
    return K.change_rows(base, periods, classes or None)


def experiment_results(spark, sf):
    base, periods = K.test_rows(spark, sf)
    clean = materialise(evaluate.clean_scores(base, K.CFG, K.MODEL, adapters.weather(spark, sf)), "clean")
    changes = materialise(K.change_rows(base, periods), "changes")
    return evaluate.evaluate_experiments(clean, changes, inject.experiments(spark, G), K.CFG, K.MODEL, K.COSTS)


def tidy(df, *names):
    for n in names:
        df = df.withColumn(n, C.rounded(F.col(n)))
    return df


# ---- fault classes ----------------------------------------------------------------------

for _name, _class in (
    ("inject_dropout", G.DROPOUT), ("inject_frozen", G.FROZEN), ("inject_stale", G.STALE),
    ("inject_capacity", G.CAPACITY), ("inject_jump", G.JUMP), ("inject_silent", G.SILENT),
):

    @query(_name, f"SELECT {CHANGE_SQL} FROM changes WHERE class = '{_class}'")
    def _changes(spark, sf, fault_class=_class):
        return changes_of(spark, sf, fault_class).select(*CHANGE_COLS)


@query("confine_to_period", "SELECT feed_id, seed, period_id, start_us, end_us, t_min, t_max FROM chosen")
def confine_to_period(spark, sf):
    base, periods = K.test_rows(spark, sf)
    return inject.chosen_periods(base, periods, G).select(
        FEED, "seed", PERIOD, "start_us", "end_us", "t_min", "t_max"
    )


EXPOSURE_SQL = """
SELECT e.experiment_id, e.class, e.intensity_idx, e.seed, (SELECT count(*) FROM base) AS test_rows,
  count(c.us) FILTER (WHERE c.removed OR c.num_bikes_available IS NULL) AS rows_removed_or_empty,
  count(c.us) FILTER (WHERE NOT (c.removed OR c.num_bikes_available IS NULL)) AS rows_altered,
  count(DISTINCT CASE WHEN c.us IS NOT NULL THEN (c.feed_id, c.station_id) END) AS stations_affected
FROM exps e LEFT JOIN changes c USING (experiment_id) GROUP BY 1, 2, 3, 4"""


def exposure(spark, sf):
    base, periods = K.test_rows(spark, sf)
    n_rows = base.agg(F.count(F.lit(1)).alias("test_rows"))
    return inject.exposure(K.change_rows(base, periods), inject.experiments(spark, G), n_rows)


@query("injection_grid", EXPOSURE_SQL)
def injection_grid(spark, sf):
    return exposure(spark, sf)


@query("injection_summary", f"""
SELECT class, min(n) AS min_rows, median(n) AS median_rows, max(n) AS max_rows
FROM (SELECT class, rows_removed_or_empty + rows_altered AS n FROM ({EXPOSURE_SQL})) GROUP BY 1""")
def injection_summary(spark, sf):
    n = (F.col("rows_removed_or_empty") + F.col("rows_altered")).alias("n")
    # 20 experiments per class: a group of fixed size.
    return exposure(spark, sf).select("class", n).groupBy("class").agg(
        F.min("n").alias("min_rows"), F.median("n").alias("median_rows"), F.max("n").alias("max_rows")
    )


@query("exposure_census", f"""
SELECT class, intensity_idx, min(rows_removed_or_empty) AS min_removed, max(rows_removed_or_empty) AS max_removed,
  min(rows_altered) AS min_altered, max(rows_altered) AS max_altered, max(stations_affected) AS max_stations
FROM ({EXPOSURE_SQL}) GROUP BY 1, 2""")
def exposure_census(spark, sf):
    return exposure(spark, sf).groupBy("class", "intensity_idx").agg(
        F.min("rows_removed_or_empty").alias("min_removed"), F.max("rows_removed_or_empty").alias("max_removed"),
        F.min("rows_altered").alias("min_altered"), F.max("rows_altered").alias("max_altered"),
        F.max("stations_affected").alias("max_stations"),
    )


@query("injection_invariants", """
SELECT class, CAST(sum(over_stations) AS BIGINT) AS over_stations, CAST(sum(over_periods) AS BIGINT) AS over_periods,
  CAST(sum(broken_capacity) AS BIGINT) AS broken_capacity, CAST(sum(visible) AS BIGINT) AS visible, CAST(sum(outside) AS BIGINT) AS outside
FROM (SELECT class, experiment_id, feed_id,
  CASE WHEN class IN ('class2_frozen', 'class4_capacity') AND count(DISTINCT station_id) > 1 THEN 1 ELSE 0 END AS over_stations,
  CASE WHEN class NOT IN ('class5_jump', 'class6_silent') AND count(DISTINCT period_id) > 1 THEN 1 ELSE 0 END AS over_periods,
  count(*) FILTER (WHERE class = 'class5_jump' AND num_bikes_available + num_docks_available <> cap) AS broken_capacity,
  count(*) FILTER (WHERE class = 'class6_silent' AND (num_bikes_available <> b0 OR true_available > b0)) AS visible,
  count(*) FILTER (WHERE class = 'class5_jump' AND (num_bikes_available < 0 OR num_bikes_available > cap)) AS outside
  FROM (SELECT c.*, b.num_bikes_available AS b0, b.num_bikes_available + b.num_docks_available AS cap
        FROM changes c JOIN base b USING (feed_id, period_id, station_id, us)) GROUP BY 1, 2, 3) GROUP BY 1""")
def injection_invariants(spark, sf):
    base, periods = K.test_rows(spark, sf)
    changes = K.change_rows(base, periods)
    clean = base.select(*PK, F.col(BIKES).alias("b0"), (F.col(BIKES) + F.col(DOCKS)).alias("cap"))
    cls, bikes = F.col("class"), F.col(BIKES)
    per = changes.join(clean, list(PK)).groupBy("class", "experiment_id", FEED).agg(
        (cls.isin(G.FROZEN, G.CAPACITY) & (F.count_distinct(STATION) > 1)).cast("int").alias("over_stations"),
        (~cls.isin(G.JUMP, G.SILENT) & (F.count_distinct(PERIOD) > 1)).cast("int").alias("over_periods"),
        C.count_if((cls == G.JUMP) & (bikes + F.col(DOCKS) != F.col("cap"))).alias("broken_capacity"),
        C.count_if((cls == G.SILENT) & ((bikes != F.col("b0")) | (F.col("true_available") > F.col("b0")))).alias("visible"),
        C.count_if((cls == G.JUMP) & ((bikes < 0) | (bikes > F.col("cap")))).alias("outside"),
    )
    names = ("over_stations", "over_periods", "broken_capacity", "visible", "outside")
    return per.groupBy("class").agg(*[F.sum(n).alias(n) for n in names])


def grid_store(spark, sf, *classes):
    """The grid, or some of its classes, as a written delta store."""
    base, periods = K.test_rows(spark, sf)
    exps = inject.experiments(spark, G)
    path = work_path(spark, "grid")
    delta_store.write_store(base, K.change_rows(base, periods, classes or None), exps.filter(F.col("class").isin(*classes)) if classes else exps, path)
    return path


@query("injected_sink", "SELECT class, intensity_idx, seed, count(*) AS n FROM corrupted_kept GROUP BY 1, 2, 3")
def injected_sink(spark, sf):
    lines = delta_store.manifest(spark, grid_store(spark, sf))
    return lines.filter(F.col("data_status") == inject.SYNTHETIC).select("class", "intensity_idx", "seed", F.col("corrupted_rows").alias("n"))


@query("injected_manifest", """
SELECT e.experiment_id, e.class, e.intensity_idx, e.seed, (SELECT count(*) FROM base) AS clean_rows,
  count(c.us) FILTER (WHERE c.removed) AS removed_rows, count(c.us) FILTER (WHERE NOT c.removed) AS altered_rows,
  (SELECT count(*) FROM base) - count(c.us) FILTER (WHERE c.removed) AS corrupted_rows, 'complete' AS status
FROM exps e LEFT JOIN changes c USING (experiment_id) GROUP BY 1, 2, 3, 4""")
def injected_manifest(spark, sf):
    return delta_store.manifest(spark, grid_store(spark, sf)).select(
        *EXPERIMENT, "clean_rows", "removed_rows", "altered_rows", "corrupted_rows", "status"
    )


@query("injected_scan", """
SELECT feed_id, period_id, station_id, us, num_bikes_available, num_docks_available FROM corrupted_kept
WHERE class = 'class5_jump' AND intensity_idx = 2 AND seed = 0 AND period_id >= 60""")
def injected_scan(spark, sf):
    rows = delta_store.read_experiment(spark, grid_store(spark, sf, G.JUMP), G.JUMP, 2, 0, F.col(PERIOD) >= 60)
    return rows.select(*PK, BIKES, DOCKS)


@query("injected_removals", """
SELECT feed_id, period_id, station_id, us, num_bikes_available, num_docks_available, true_available FROM corrupted_kept
WHERE class = 'class1_dropout' AND intensity_idx = 3 AND seed = 1""")
def injected_removals(spark, sf):
    """An experiment whose changes are tombstones."""
    rows = delta_store.read_experiment(spark, grid_store(spark, sf, G.DROPOUT), G.DROPOUT, 3, 1)
    return rows.select(*PK, BIKES, DOCKS, "true_available")


@query("changed_rows_diff", """
SELECT c.experiment_id, count(*) FILTER (WHERE c.num_bikes_available <> b.num_bikes_available) AS rows_changed
FROM corrupted_kept c JOIN base b USING (feed_id, period_id, station_id, us) GROUP BY 1""")
def changed_rows_diff(spark, sf):
    base, periods = K.test_rows(spark, sf)
    changes = K.change_rows(base, periods)
    differ = changes.filter(~F.col("removed")).join(
        base.select(*PK, F.col(BIKES).alias("b0")), list(PK)
    ).groupBy("experiment_id").agg(C.count_if(F.col(BIKES) != F.col("b0")).alias("n"))
    zero = F.lit(0).cast("bigint")
    return inject.experiments(spark, G).select("experiment_id").join(differ, "experiment_id", "left").select(
        "experiment_id", F.coalesce("n", zero).alias("rows_changed")
    )


@query("exposure_diff", """
SELECT e.experiment_id, b.feed_id, b.station_id, count(*) FILTER (WHERE c.us IS NULL OR c.num_bikes_available IS NULL) AS gone,
  count(*) FILTER (WHERE c.num_bikes_available <> b.num_bikes_available OR c.num_docks_available <> b.num_docks_available) AS altered
FROM base b CROSS JOIN (SELECT * FROM exps WHERE class <> 'class6_silent') e LEFT JOIN corrupted_kept c
  ON c.experiment_id = e.experiment_id AND c.feed_id = b.feed_id AND c.period_id = b.period_id
  AND c.station_id = b.station_id AND c.us = b.us GROUP BY 1, 2, 3 HAVING gone > 0 OR altered > 0""")
def exposure_diff(spark, sf):
    gone = F.col("removed") | F.col(BIKES).isNull()
    rows = changes_of(spark, sf).filter(F.col("class") != G.SILENT)
    return rows.groupBy("experiment_id", *SERIES).agg(
        C.count_if(gone).alias("gone"), C.count_if(~gone).alias("altered")
    )


@query("snapshot_repeat", f"""
SELECT experiment_id, station_id, us, num_bikes_available, num_docks_available FROM changes_stale""")
def snapshot_repeat(spark, sf):
    return changes_of(spark, sf, G.STALE).select("experiment_id", STATION, US, BIKES, DOCKS)


@query("station_membership", """
SELECT b.feed_id, b.period_id, b.station_id, b.us, s.seed FROM base b JOIN silent_stations s USING (feed_id, station_id)""")
def station_membership(spark, sf):
    base, _ = K.test_rows(spark, sf)
    return base.join(inject.silent_stations(base, G), list(SERIES)).select(*PK, "seed")


@query("distinct_pairs", """
SELECT DISTINCT experiment_id, feed_id, period_id, station_id FROM changes WHERE class = 'class5_jump'""")
def distinct_pairs(spark, sf):
    return changes_of(spark, sf, G.JUMP).select("experiment_id", *PERIOD_SERIES).distinct()


@query("union_periods", """
SELECT experiment_id, part, count(*) AS n, CAST(sum(num_bikes_available) AS BIGINT) AS bikes FROM (
  SELECT e.experiment_id, 'rest' AS part, num_bikes_available FROM base b JOIN (SELECT * FROM exps WHERE class = 'class1_dropout') e ON true
  WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.seed = e.seed AND c.feed_id = b.feed_id AND c.period_id = b.period_id)
  UNION ALL SELECT k.experiment_id, 'corrupted', num_bikes_available FROM corrupted_kept k JOIN chosen c
    ON c.seed = k.seed AND c.feed_id = k.feed_id AND c.period_id = k.period_id WHERE k.class = 'class1_dropout')
GROUP BY 1, 2""")
def union_periods(spark, sf):
    base, periods = K.test_rows(spark, sf)
    exps = inject.experiments(spark, G).filter(F.col("class") == G.DROPOUT).select(*EXPERIMENT)
    picked = materialise(inject.chosen_periods(base, periods, G).select(FEED, "seed", PERIOD), "picked")
    changes = K.change_rows(base, periods, [G.DROPOUT])
    # The corrupted part is the drawn periods only; of what stays outside, periods are counted before experiments multiply them.
    keys = ["experiment_id", *PK]
    inside = base.join(picked, [FEED, PERIOD]).join(F.broadcast(exps), "seed").join(changes.select(*keys, "removed"), keys, "left")
    corrupted = inside.filter(~F.coalesce("removed", F.lit(False))).groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(BIKES).alias("bikes")
    )
    totals = base.groupBy(FEED, PERIOD).agg(F.count(F.lit(1)).alias("n"), F.sum(BIKES).alias("bikes"))
    rest = totals.crossJoin(F.broadcast(exps)).join(picked, [FEED, "seed", PERIOD], "left_anti").groupBy("experiment_id").agg(
        F.sum("n").alias("n"), F.sum("bikes").alias("bikes")
    )
    part = lambda rows, name: rows.select("experiment_id", F.lit(name).alias("part"), "n", "bikes")
    return part(rest, "rest").unionByName(part(corrupted, "corrupted"))


# ---- repair ------------------------------------------------------------------------------


@query("safeguard_repair", """
SELECT experiment_id, feed_id, period_id, station_id, us, num_bikes_available, num_docks_available FROM recovered""")
def safeguard_repair_query(spark, sf):
    base, periods = K.test_rows(spark, sf)
    exps = inject.experiments(spark, G)
    chosen = materialise(inject.chosen_periods(base, periods, G), "chosen")
    out = None
    for fault_class in (G.FROZEN, G.CAPACITY, G.JUMP):
        ids = inject.ids_of(exps, fault_class)
        rows = inject.side_by_side(base, inject.change_rows(base, periods, G, [fault_class], chosen), ids)
        good = safeguard_repair(rows, fault_class, K.CFG, copies=len(ids)).select(*PERIOD_SERIES, US, F.posexplode("good").alias("_at", "_good"))
        part = good.filter(F.col("_good").isNotNull()).select(
            F.get(F.array(*[F.lit(i) for i in ids]), F.col("_at")).alias("experiment_id"), *PERIOD_SERIES, US,
            F.col("_good.bikes").alias(BIKES), F.col("_good.docks").alias(DOCKS),
        )
        out = part if out is None else out.unionByName(part)
    return out


# ---- evaluation --------------------------------------------------------------------------


@query("evaluate_experiment", """
SELECT * EXCLUDE (flip_rate, forecast_error, delta_cost, delta_cost_recovered, recovery_rate),
  round(flip_rate, 6) AS flip_rate, round(forecast_error, 6) AS forecast_error, round(delta_cost, 6) AS delta_cost,
  round(delta_cost_recovered, 6) AS delta_cost_recovered, round(recovery_rate, 6) AS recovery_rate FROM results""")
def evaluate_experiment(spark, sf):
    return tidy(experiment_results(spark, sf), *ROUNDED)
