"""Registered queries: hypothesis tests on results."""

from __future__ import annotations

from pyspark.sql import functions as F

from pollgauge.config import FEED, SERIES, STATION
from pollgauge.functions import columns as C
from pollgauge.operators import profile, stats
from pollgauge.plans import common as K
from pollgauge.plans.catalog import query, view
from pollgauge.plans.faults import tidy
from pollgauge.session import materialise
from pollgauge.sources import adapters

A, B, Y = "class", "intensity_idx", "delta_cost"
N_PERM, N_BOOT, N_PAIRED = 5000, 2000, 5000

view("cells", """
SELECT event_type AS class, CAST(user_id % 4 AS INTEGER) AS intensity_idx, CAST((user_id // 4) % 5 AS INTEGER) AS seed,
  round(avg(value), 6) AS delta_cost, round(avg(value * ((event_id % 3) / 3::DOUBLE)), 6) AS delta_cost_recovered
FROM events GROUP BY 1, 2, 3""")

# ---- occurrence -------------------------------------------------------------------------


def _g_sql(factor: str, keys: str) -> str:
    return f"""
SELECT '{factor}' AS factor, 2 * sum(CASE WHEN y > 0 THEN y * ln(y / e) ELSE 0 END) AS g, count(*) - 1 AS df,
  sum((y - e) * (y - e) / e) / (count(*) - 1) AS dispersion
FROM (SELECT y, n * (sum(y) OVER ()) / (sum(n) OVER ())::DOUBLE AS e FROM (
  SELECT count(*) FILTER (WHERE jump_flag)::DOUBLE AS y, count(*) AS n FROM local_flags GROUP BY {keys}))"""


@query("occurrence_unevenness", f"""
SELECT factor, round(g, 4) AS g, df, round(dispersion, 4) AS dispersion, round(g / dispersion, 4) AS g_scaled FROM (
{_g_sql("station_id", "feed_id, station_id")} UNION ALL {_g_sql("hour", "hour")} UNION ALL {_g_sql("day", "day")})""")
def occurrence_unevenness(spark, sf):
    bins = materialise(profile.exposure_bins(K.flagged(spark, sf), K.CFG.local_tz), "bins")
    by_station, by_day = bins.filter(F.col(STATION).isNotNull()), bins.filter(F.col("day").isNotNull())
    out = None
    for name, rows, factor in (
        ("station_id", by_station, [FEED, STATION]), ("hour", by_station, ["hour"]), ("day", by_day, ["day"])
    ):
        part = stats.unevenness(rows, factor).select(
            F.lit(name).alias("factor"), F.round("g", 4).alias("g"), "df",
            F.round("dispersion", 4).alias("dispersion"), F.round("g_scaled", 4).alias("g_scaled"),
        )
        out = part if out is None else out.unionByName(part)
    return out


# Rounds of proportional fitting in the twins; the operator stops by itself.
SQL_ROUNDS = 30


def _two_factor_sql(a: str, b: str) -> str:
    """Bins with both levels, y, n and mu: proportional fitting with its rounds written out."""
    grouped = f"SELECT {a}, {b}, count(*) FILTER (WHERE jump_flag)::DOUBLE AS y, count(*)::DOUBLE AS n FROM local_flags GROUP BY {a}, {b}"

    def rates(by: str, other: str, source: str) -> str:
        return f"SELECT {by}, coalesce(sum(y) / nullif(sum(n * rate), 0), 0) AS rate FROM bins JOIN {source} USING ({other}) GROUP BY {by}"

    steps = [f"b0 AS MATERIALIZED (SELECT {b}, sum(y) / sum(n) AS rate FROM bins GROUP BY {b})"]
    for k in range(1, SQL_ROUNDS + 1):
        steps += [f"a{k} AS MATERIALIZED ({rates(a, b, f'b{k - 1}')})", f"b{k} AS MATERIALIZED ({rates(b, a, f'a{k}')})"]
    steps.append(f"last_a AS MATERIALIZED ({rates(a, b, f'b{SQL_ROUNDS}')})")
    return f"""(WITH bins AS MATERIALIZED ({grouped}), {", ".join(steps)}
SELECT bins.*, n * l.rate * r.rate AS mu FROM bins JOIN last_a l USING ({a}) JOIN b{SQL_ROUNDS} r USING ({b}))"""


def _ratio_sql(name: str, factor: str, other: str, fitted: str) -> str:
    return f"""
SELECT '{name}' AS factor, count(*) AS n_bins, round(2 * sum(CASE WHEN y > 0 THEN y * ln(mu / e) ELSE 0 END), 4) AS lr,
  count(DISTINCT ({factor})) - 1 AS lr_df, round(sum((y - mu) * (y - mu) - mu) / sum(mu * mu), 6) AS dispersion
FROM (SELECT *, n * (sum(y) OVER w) / (sum(n) OVER w) AS e FROM {fitted} WINDOW w AS (PARTITION BY {other}))"""


view("station_hour_fit", "SELECT * FROM " + _two_factor_sql("feed_id, station_id", "hour"))
view("day_hour_fit", "SELECT * FROM " + _two_factor_sql("day", "hour"))


def _fits(spark, sf):
    """Fitted bins of (station, hour) and of (day, hour)."""
    bins = materialise(profile.exposure_bins(K.flagged(spark, sf), K.CFG.local_tz), "bins")
    return (
        materialise(stats.two_factor_fit(bins.filter(F.col(STATION).isNotNull()), [FEED, STATION], ["hour"]), "fit"),
        materialise(stats.two_factor_fit(bins.filter(F.col("day").isNotNull()), ["day"], ["hour"]), "fit"),
    )


@query("occurrence_ratios", " UNION ALL ".join([
    _ratio_sql("station_id", "feed_id, station_id", "hour", "station_hour_fit"),
    _ratio_sql("hour", "hour", "feed_id, station_id", "station_hour_fit"),
    _ratio_sql("day", "day", "hour", "day_hour_fit"),
]))
def occurrence_ratios(spark, sf):
    """Likelihood ratios of station and hour, each beside the other, and of day beside hour."""
    by_station, by_day = _fits(spark, sf)
    station, out = [FEED, STATION], None
    for name, fitted, factor, other in (
        ("station_id", by_station, station, ["hour"]), ("hour", by_station, ["hour"], station), ("day", by_day, ["day"], ["hour"])
    ):
        part = stats.adjusted_ratio(fitted, factor, other).select(
            F.lit(name).alias("factor"), "n_bins", F.round("lr", 4).alias("lr"), "lr_df", F.round("dispersion", 6).alias("dispersion")
        )
        out = part if out is None else out.unionByName(part)
    return out


_levels_sql = """
SELECT '{0}' AS factor, CAST({0} AS VARCHAR) AS level, sum(y) AS observed, round(sum(mu), 2) + 0.0::DOUBLE AS fitted FROM day_hour_fit GROUP BY {0}"""


@query("occurrence_adjusted", f"""
SELECT v.*, r.lr_df AS df, r.lr FROM ({_levels_sql.format("day")} UNION ALL {_levels_sql.format("hour")}) v
CROSS JOIN ({_ratio_sql("day", "day", "hour", "day_hour_fit")}) r""")
def occurrence_adjusted(spark, sf):
    """The Poisson fit of day and hour: its counts per day and per hour equal the observed ones."""
    bins = materialise(profile.exposure_bins(K.flagged(spark, sf), K.CFG.local_tz), "bins")
    fitted = materialise(stats.two_factor_fit(bins.filter(F.col("day").isNotNull()), ["day"], ["hour"]), "fit")
    ratio = stats.adjusted_ratio(fitted, ["day"], ["hour"]).select(F.col("lr_df").alias("df"), F.round("lr", 4).alias("lr"))
    out = None
    for name in ("day", "hour"):
        sums = fitted.groupBy(F.col(name).cast("string").alias("level")).agg(
            F.sum("y").cast("double").alias("observed"), (F.round(F.sum("prediction"), 2) + 0.0).alias("fitted")
        )
        part = sums.select(F.lit(name).alias("factor"), "level", "observed", "fitted")
        out = part if out is None else out.unionByName(part)
    return out.crossJoin(ratio)


# Are the flags of a station even over the three thirds of the day?  Two degrees of freedom, so p = exp(-G / 2).
view("third_tests", """
SELECT feed_id, station_id, exp(-sum(CASE WHEN y > 0 THEN y * ln(y / e) ELSE 0 END)) AS p FROM (
  SELECT *, n * (sum(y) OVER w) / (sum(n) OVER w)::DOUBLE AS e FROM (
    SELECT feed_id, station_id, hour(make_timestamp(us)) // 8 AS third, count(*) FILTER (WHERE jump_flag)::DOUBLE AS y, count(*) AS n
    FROM flagged GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY feed_id, station_id)) GROUP BY 1, 2""")


@query("holm_adjust", """
SELECT feed_id, station_id, round(p, 6) AS p, round(h, 6) AS p_holm, h < 0.05 AS reject FROM (
  SELECT *, max(step) OVER (ORDER BY p, feed_id, station_id) AS h FROM (
    SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, feed_id, station_id) + 1) * p) AS step FROM third_tests))""")
def holm_adjust(spark, sf):
    third = F.floor(C.utc_hour() / 8).alias("third")
    bins = K.flagged(spark, sf).groupBy(*SERIES, third).agg(
        C.count_if(F.col("jump_flag")).cast("double").alias("y"), F.count(F.lit(1)).alias("n")
    )
    whole = bins.groupBy(*SERIES).agg(F.sum("y").alias("_y"), F.sum("n").alias("_n"))
    expected = F.col("n") * F.col("_y") / F.col("_n")
    term = F.when(F.col("y") > 0, F.col("y") * F.log(F.col("y") / expected)).otherwise(F.lit(0.0))
    tests = bins.join(whole, list(SERIES)).groupBy(*SERIES).agg(F.exp(-F.sum(term)).alias("p"))
    out = stats.holm_adjust(materialise(tests, "tests"), "p")
    return tidy(out.select(*SERIES, "p", "p_holm", "reject"), "p", "p_holm")


# ---- propagation ------------------------------------------------------------------------


def _means_sql(source: str, y: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    comma = f"{by}, " if by else ""
    return f"""
SELECT *, avg(m) OVER (PARTITION BY {comma}class) AS ma, avg(m) OVER (PARTITION BY {comma}intensity_idx) AS mb, avg(m) OVER ({part}) AS g
FROM (SELECT {comma}class, intensity_idx, count(*) AS r, avg({y}) AS m, var_pop({y}) * count(*) AS ss_in FROM {source}
      GROUP BY {comma}class, intensity_idx)"""


def _ss_sql(source: str, y: str, by: str = "") -> str:
    comma = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {comma}count(DISTINCT class) AS na, count(DISTINCT intensity_idx) AS nb, count(*) AS cells, min(r) AS r_min, max(r) AS r_max,
  sum(r * (ma - g) ** 2) AS ss_a, sum(r * (mb - g) ** 2) AS ss_b, sum(r * (m - ma - mb + g) ** 2) AS ss_ab, sum(ss_in) AS ss_res
FROM ({_means_sql(source, y, by)}) {group}"""


view("anova", f"""
SELECT ss_a, ss_b, ss_ab, ss_res, na - 1 AS df_a, nb - 1 AS df_b, (na - 1) * (nb - 1) AS df_ab, cells * (r_min - 1) AS df_res,
  cells = na * nb AND r_min = r_max AS balanced,
  ss_a / (na - 1) / (ss_res / (cells * (r_min - 1))) AS f_a, ss_b / (nb - 1) / (ss_res / (cells * (r_min - 1))) AS f_b,
  ss_ab / ((na - 1) * (nb - 1)) / (ss_res / (cells * (r_min - 1))) AS f_ab FROM ({_ss_sql("cells", "delta_cost")})""")
ANOVA_ROUNDED = ("ss_a", "ss_b", "ss_ab", "ss_res", "f_a", "f_b", "f_ab")


@query("two_way_anova", f"""
SELECT df_a, df_b, df_ab, df_res, balanced, {", ".join(f"round({c}, 6) AS {c}" for c in ANOVA_ROUNDED)} FROM anova""")
def two_way_anova(spark, sf):
    return tidy(stats.two_way_anova(adapters.cell_results(spark, sf), A, B, Y), *ANOVA_ROUNDED)


view("main_fit", """
SELECT class, intensity_idx, delta_cost, row_number() OVER (ORDER BY class, intensity_idx, seed) AS pos,
  avg(delta_cost) OVER (PARTITION BY class) + avg(delta_cost) OVER (PARTITION BY intensity_idx) - avg(delta_cost) OVER () AS fit FROM cells""")


@query("levene", """
WITH z AS (SELECT class, intensity_idx, abs(delta_cost - median(delta_cost) OVER (PARTITION BY class, intensity_idx)) AS z FROM cells),
c AS (SELECT count(*) AS r, avg(z) AS m, var_pop(z) AS v FROM z GROUP BY class, intensity_idx),
w AS (SELECT avg(z) AS g, count(*) AS n FROM z)
SELECT round(sum(r * (m - g) ** 2) / (count(*) - 1) / (sum(r * v) / (any_value(n) - count(*))), 6) AS levene,
  count(*) - 1 AS df1, any_value(n) - count(*) AS df2 FROM c CROSS JOIN w""".replace("WITH z AS", "SELECT * FROM (WITH z AS", 1) + ")")
def levene(spark, sf):
    return tidy(stats.levene(adapters.cell_results(spark, sf), [A, B], Y), "levene")


@query("normality_check", """
SELECT n, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round(n / 6 * (skew * skew + kurt * kurt / 4), 6) AS jb,
  round(exp(-n / 6 * (skew * skew + kurt * kurt / 4) / 2), 6) AS p_value
FROM (SELECT n, m3 / m2 ** 1.5 AS skew, m4 / (m2 * m2) - 3 AS kurt FROM (
  SELECT count(*) AS n, avg(e * e) AS m2, avg(e * e * e) AS m3, avg(e * e * e * e) AS m4 FROM (
    SELECT delta_cost - avg(delta_cost) OVER (PARTITION BY class, intensity_idx) AS e FROM cells)))""")
def normality_check(spark, sf):
    return tidy(stats.normality(adapters.cell_results(spark, sf), [A, B], Y), "skew", "kurt", "jb", "p_value")


@query("permutation_interaction", f"""
SELECT round(f_observed, 6) AS f_observed, replicates, reached, round(f_max, 6) AS f_max, round(f_mean, 6) AS f_mean,
  round(reached / replicates::DOUBLE, 6) AS p_value
FROM (SELECT any_value(o.f_ab) AS f_observed, count(*) AS replicates, count(*) FILTER (WHERE f >= o.f_ab) AS reached, max(f) AS f_max, avg(f) AS f_mean
FROM (SELECT ss_ab / ((na - 1) * (nb - 1)) / (ss_res / (cells * (r_min - 1))) AS f FROM ({_ss_sql(f'''(
  SELECT d.rep, b.class, b.intensity_idx, b.fit + d.res AS y FROM (
    SELECT rep, res, row_number() OVER (PARTITION BY rep ORDER BY ('0x' || substr(md5(rep || '|perm|' || pos), 1, 8))::BIGINT, pos) AS pos
    FROM (SELECT pos, delta_cost - fit AS res FROM main_fit) CROSS JOIN range({N_PERM}) r(rep)) d JOIN main_fit b USING (pos))''', "y", "rep")}))
CROSS JOIN anova o)""")
def permutation_interaction(spark, sf):
    cells = materialise(adapters.cell_results(spark, sf), "cells")
    out = stats.permutation_interaction(cells, A, B, Y, "seed", N_PERM)
    return tidy(out, "f_observed", "f_max", "f_mean", "p_value")


# ---- intervals and recovery ---------------------------------------------------------------


def _boot_sql(y: str, n_boot: int) -> str:
    return f"""
SELECT class, intensity_idx, any_value(n) AS n, any_value(centre) AS centre,
  quantile_cont(bm, 0.025) AS ci_low, quantile_cont(bm, 0.975) AS ci_high
FROM (SELECT s.class, s.intensity_idx, rep, any_value(n) AS n, any_value(centre) AS centre, avg(c.y) AS bm
  FROM (SELECT class, intensity_idx, count(*) AS n, avg({y}) AS centre FROM cells GROUP BY 1, 2) s
  CROSS JOIN range({n_boot}) r(rep) CROSS JOIN range(100) d(draw)
  JOIN (SELECT class, intensity_idx, {y} AS y, row_number() OVER (PARTITION BY class, intensity_idx ORDER BY seed) - 1 AS pos FROM cells) c
    ON c.class = s.class AND c.intensity_idx = s.intensity_idx AND draw < n
    AND c.pos = ('0x' || substr(md5(s.class || '|' || s.intensity_idx || '|' || rep || '|' || draw), 1, 8))::BIGINT % n
  GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query("bootstrap_ci", f"""
SELECT class, intensity_idx, n, round(centre, 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high
FROM ({_boot_sql("delta_cost", N_BOOT)})""")
def bootstrap_ci(spark, sf):
    cells = materialise(adapters.cell_results(spark, sf), "cells")
    return tidy(stats.bootstrap_ci(cells, [A, B], "seed", Y, N_BOOT), "mean", "ci_low", "ci_high")


@query("paired_bootstrap", f"""
SELECT class, intensity_idx, n, round(centre, 6) AS mean_recovered, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high,
  round(b, 6) AS mean_before, round(a, 6) AS mean_after, round(share, 6) AS recovered_share
FROM ({_boot_sql("(delta_cost - delta_cost_recovered)", N_PAIRED)}) JOIN (
  SELECT class, intensity_idx, avg(delta_cost) AS b, avg(delta_cost_recovered) AS a,
    sum(delta_cost - delta_cost_recovered) / nullif(sum(delta_cost), 0) AS share FROM cells GROUP BY 1, 2) USING (class, intensity_idx)""")
def paired_bootstrap(spark, sf):
    cells = materialise(adapters.cell_results(spark, sf), "cells")
    out = stats.paired_bootstrap(cells, [A, B], "seed", Y, "delta_cost_recovered", N_PAIRED)
    return tidy(out, "mean_recovered", "ci_low", "ci_high", "mean_before", "mean_after", "recovered_share")


@query("wilcoxon_signed_rank", """
SELECT class, n_pairs, n_nonzero, w, round((w - n_nonzero * (n_nonzero + 1) / 4::DOUBLE)
    / sqrt(n_nonzero * (n_nonzero + 1) * (2 * n_nonzero + 1) / 24::DOUBLE - ties / 48::DOUBLE), 6) AS z
FROM (SELECT class, any_value(np) AS n_pairs, count(*) AS n_nonzero, CAST(sum((t * t - 1)) AS BIGINT) AS ties,
    least(sum(CASE WHEN d > 0 THEN mid ELSE 0 END), sum(CASE WHEN d < 0 THEN mid ELSE 0 END)) AS w
  FROM (SELECT class, d, np, count(*) OVER (PARTITION BY class, abs(d)) AS t,
      rank() OVER (PARTITION BY class ORDER BY abs(d)) + (count(*) OVER (PARTITION BY class, abs(d)) - 1) / 2::DOUBLE AS mid
    FROM (SELECT class, round(delta_cost - delta_cost_recovered, 9) AS d, count(*) OVER (PARTITION BY class) AS np FROM cells)
    WHERE d <> 0) GROUP BY 1)""")
def wilcoxon_signed_rank(spark, sf):
    cells = adapters.cell_results(spark, sf)
    return tidy(stats.wilcoxon_signed_rank(cells, [A], Y, "delta_cost_recovered"), "z")


