"""Counts and rates that describe a collection, its log, its flags and its scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollgauge.config import BIKES, DOCKS, FEED, PERIOD_SERIES, SECOND_US, SERIES, STATION, US, FeedConfig
from pollgauge.functions.columns import count_if, critical, hour_us, local_ts
from pollgauge.operators.features import with_label
from pollgauge.operators.periods import dwell_rows
from pollgauge.operators.ranking import quantiles
from pollgauge.operators.sequence import Blocks, at_home, near_window, neighbourhood


def collection_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per feed: rows, stations, polls, first and last poll.

    Rows are first counted per poll and per station, so no distinct count has to
    hold all values of a feed in one task.
    """
    per_poll = df.groupBy(FEED, US).agg(F.count(F.lit(1)).alias("_n"))
    polls = per_poll.groupBy(FEED).agg(
        F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("polls"),
        F.min(US).alias("first_us"), F.max(US).alias("last_us"),
    )
    if approximate:
        stations = df.groupBy(FEED).agg(F.approx_count_distinct(STATION).alias("stations"))
    else:
        stations = df.select(*SERIES).distinct().groupBy(FEED).agg(F.count(F.lit(1)).alias("stations"))
    return polls.join(stations, FEED)


def critical_station_hours(df: DataFrame, cfg: FeedConfig, by: Sequence[str]) -> DataFrame:
    """Hours spent critical, by the real time to the next row, and by the plain row count."""
    rows = dwell_rows(df, cfg).withColumn("critical", critical(at=cfg.critical_at))
    return rows.groupBy(*by).agg(
        (F.sum(F.when(F.col("critical"), F.col("dwell_s")).otherwise(F.lit(0.0))) / 3600).alias("station_hours"),
        (count_if(F.col("critical")) * F.lit(cfg.row_hours)).alias("station_hours_naive"),
    )


def substrate_summary(census: DataFrame, segments: DataFrame) -> DataFrame:
    """One row per feed over its periods: totals, spread of durations, day totals, shares.

    The median is exact and comes from counted ranks, not from a collected list.
    """
    hours = F.col("duration_h")
    totals = census.groupBy(FEED).agg(
        F.count(F.lit(1)).alias("periods_retained"),
        F.sum(hours).alias("total_h"), F.avg(hours).alias("mean_h"), F.min(hours).alias("min_h"), F.max(hours).alias("max_h"),
        *[
            F.sum(c).alias(c)
            for c in ("observations", "observations_clean", "jump_rows_excluded", "frozen_rows_flagged_kept",
                      "observations_forecastable", "critical_observations", "label_positive")
        ],
    )
    days = census.groupBy(FEED, "day").agg(F.count(F.lit(1)).alias("_n"), F.sum(hours).alias("_h"))
    by_day = days.groupBy(FEED).agg(
        F.count(F.lit(1)).alias("distinct_days"), count_if(F.col("_n") > 1).alias("days_with_multiple_periods"),
        F.avg("_h").alias("day_mean_h"), F.min("_h").alias("day_min_h"), F.max("_h").alias("day_max_h"),
    )
    found = segments.groupBy(FEED).agg(F.count(F.lit(1)).alias("segments_found"))
    median = quantiles(census, [FEED], "duration_h", {"median_h": 0.5})
    out = totals.join(by_day, FEED).join(found, FEED).join(median, FEED)
    clean = F.nullif(F.col("observations_clean"), F.lit(0))
    usable = F.nullif(F.col("observations_forecastable"), F.lit(0))
    return out.withColumn("critical_share", F.col("critical_observations") / clean).withColumn(
        "label_positive_rate", F.col("label_positive") / usable
    )


def exposure_bins(flagged: DataFrame, zone: str, flag: str = "jump_flag") -> DataFrame:
    """Flags and rows per (station, local hour) and per (local day, local hour), in one pass."""
    local = local_ts(US, zone)
    rows = flagged.select(
        FEED, STATION, F.date_format(local, "yyyy-MM-dd").alias("day"), F.hour(local).alias("hour"), F.col(flag).alias("_f")
    )
    keys = [F.col(c) for c in (FEED, STATION, "day", "hour")]
    sets = [[keys[0], keys[1], keys[3]], [keys[2], keys[3]]]
    out = rows.groupingSets(sets, *keys).agg(count_if(F.col("_f")).alias("n_jump"), F.count(F.lit(1)).alias("n_obs"))
    return out.withColumn("log_exposure", F.log(F.col("n_obs").cast("double")))


def rate_per_thousand(flagged: DataFrame, zone: str, flag: str = "jump_flag") -> DataFrame:
    rate = count_if(F.col(flag)) * F.lit(1000.0) / F.count(F.lit(1))
    return flagged.groupBy(F.hour(local_ts(US, zone)).alias("hour")).agg(
        count_if(F.col(flag)).alias("n_jump"), F.count(F.lit(1)).alias("n_obs"), rate.alias("per_thousand")
    )


def parse_log(log: DataFrame) -> DataFrame:
    """Log rows with epoch seconds; the payload hash is kept only for answered polls."""
    ok = F.col("status") == "200"
    return (
        log.withColumn("poll_s", F.unix_timestamp("ts", "yyyyMMdd'T'HHmmss'Z'"))
        .withColumn("ok", ok)
        .withColumn("payload", F.when(ok, F.col("sha16")))
        .withColumn("error_kind", F.when(~ok, F.split("sha16", ":")[0]))
    )


def collection_health(log: DataFrame, cfg: FeedConfig) -> DataFrame:
    """Coverage (were we polling?) and success rate (did the feed answer?) per feed."""
    rows = parse_log(log)
    out = rows.groupBy(FEED).agg(
        F.count(F.lit(1)).alias("logged"), count_if(F.col("ok")).alias("answered"), count_if(~F.col("ok")).alias("errors"),
        (F.max("poll_s") - F.min("poll_s")).alias("span_s"),
        F.min(F.when(F.col("ok"), F.col("n_stations"))).alias("stations_min"),
        F.max(F.when(F.col("ok"), F.col("n_stations"))).alias("stations_max"),
    )
    return (
        out.withColumn("expected", (F.floor(F.col("span_s") / F.lit(cfg.report_cadence_s)) + 1).cast("bigint"))
        .withColumn("coverage", F.lit(100.0) * F.col("logged") / F.col("expected"))
        .withColumn("success_rate", F.lit(100.0) * F.col("answered") / F.col("logged"))
    )


def poll_gaps(log: DataFrame, cfg: FeedConfig) -> DataFrame:
    """Every gap above the report limit between consecutive log rows of a feed."""
    rows = Blocks(log, [FEED], cfg.block_us).previous("_prev", [US]).frame()
    gap_us = F.col(US) - F.col("_prev.us")
    return rows.filter(gap_us > cfg.report_gap_s * SECOND_US).select(
        FEED, F.col("_prev.us").alias("from_us"), F.round(gap_us / F.lit(1e6), 0).cast("bigint").alias("gap_s")
    )


def time_lost(log: DataFrame, cfg: FeedConfig) -> DataFrame:
    """Number and total length of each feed's reported gaps."""
    gaps = poll_gaps(log, cfg).groupBy(FEED)
    return gaps.agg(F.count(F.lit(1)).alias("gaps"), F.sum("gap_s").alias("lost_s"))


def runs(df: DataFrame, keys: Sequence[str], start, cfg: FeedConfig, fields: Sequence[str]) -> DataFrame:
    """One row per run of a series: `run`, `length`.  `start(prev)` tells where a run begins."""
    blocks = Blocks(df, keys, cfg.block_us).previous("_prev", fields)
    numbered = blocks.running_sum("run", start(F.col("_prev")).cast("int")).frame()
    return numbered.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("length"), F.min(US).alias("start_us"))


def longest_repeat_streak(log: DataFrame, cfg: FeedConfig) -> DataFrame:
    """Longest run of identical payloads among answered polls, per feed."""
    rows = parse_log(log).filter("ok").select(FEED, US, "payload")

    def begins(prev):
        return prev.isNull() | ~F.coalesce(F.col("payload") == prev["payload"], F.lit(False))

    return runs(rows, [FEED], begins, cfg, ["payload"]).groupBy(FEED).agg(F.max("length").alias("longest_streak"))


def offset_counts(reports: DataFrame) -> DataFrame:
    """Station rows per offset between the feed's clock and the station's clock."""
    return reports.groupBy("offset_s").agg(F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, count: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(count), key).limit(k)


def offset_spread(reports: DataFrame) -> DataFrame:
    """How many snapshots hold 1, 2, ... distinct offsets: is the clock per station or per feed?"""
    pairs = reports.select(FEED, US, "offset_s").distinct()
    per = pairs.groupBy(FEED, US).agg(F.count(F.lit(1)).alias("distinct_offsets"))
    return per.groupBy("distinct_offsets").agg(F.count(F.lit(1)).alias("snapshots"))


def pickup_rate(df: DataFrame, cfg: FeedConfig) -> DataFrame:
    """Departures per station-hour over station-hours without a critical row: mean and quantiles."""
    rows = Blocks(df, SERIES, cfg.block_us).previous("_prev", [BIKES]).frame()
    left = F.greatest(F.col(f"_prev.{BIKES}") - F.col(BIKES), F.lit(0))
    hours = rows.groupBy(*SERIES, hour_us().alias("hour_us")).agg(
        F.sum(F.coalesce(left, F.lit(0))).alias("departures"), F.bool_or(critical(at=cfg.critical_at)).alias("_crit")
    )
    calm = hours.filter(~F.col("_crit"))
    spread = quantiles(calm, [], "departures", {"median_departures": 0.5, "p75_departures": 0.75})
    head = calm.agg(F.count(F.lit(1)).alias("station_hours"), F.avg("departures").alias("mean_departures"))
    return head.crossJoin(spread)


def capacity_swing(df: DataFrame) -> DataFrame:
    """Per station: spread of bikes plus docks, which a fixed capacity would keep at zero."""
    total = F.col(BIKES) + F.col(DOCKS)
    return df.groupBy(*SERIES).agg((F.max(total) - F.min(total)).alias("swing"))


def swing_counts(swings: DataFrame, cuts: Sequence[int]) -> DataFrame:
    """Per feed and cut-off: stations whose spread lies above it, and others."""
    cut = F.explode(F.array(*[F.lit(c) for c in cuts])).alias("cut")
    rows = swings.select(FEED, "swing", cut).groupBy(FEED, "cut")
    return rows.agg(count_if(F.col("swing") > F.col("cut")).alias("above"), count_if(F.col("swing") <= F.col("cut")).alias("up_to"))


def flag_profile(df: DataFrame, flag: str) -> DataFrame:
    """Flag rate by UTC hour and by station, in one pass."""
    rows = df.select(FEED, STATION, F.hour(F.timestamp_micros(US)).alias("hour"), F.col(flag).alias("_f"))
    keys = [F.col(FEED), F.col(STATION), F.col("hour")]
    out = rows.groupingSets([[keys[0], keys[1]], [keys[2]]], *keys).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("_f")).alias("n_flagged")
    )
    return out.withColumn("rate", F.col("n_flagged") / F.col("n"))


def flag_streaks(df: DataFrame, flag: str, keys: Sequence[str], cfg: FeedConfig) -> DataFrame:
    """One row: flagged streaks, their median length in rows, and stations flagged above 80 %."""

    def begins(prev):
        return prev.isNull() | (F.col(flag) != prev[flag])

    blocks = Blocks(df, keys, cfg.block_us).previous("_prev", [flag])
    numbered = blocks.running_sum("run", begins(F.col("_prev")).cast("int")).frame()
    streaks = numbered.filter(F.col(flag)).groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("length"))
    median = quantiles(streaks, [], "length", {"median_length": 0.5})
    n = streaks.agg(F.count(F.lit(1)).alias("streaks"), F.max("length").alias("longest"))
    share = df.groupBy(*SERIES).agg(F.avg(F.col(flag).cast("int")).alias("_r"))
    return n.crossJoin(median).crossJoin(share.agg(count_if(F.col("_r") > 0.8).alias("stations_above_80")))


def score_distribution(scored: DataFrame, tau: float, near: float) -> DataFrame:
    """One row: spread of the score, and the rows within `near` of the threshold."""
    points = {"p_min": 0.0, "p_median": 0.5, "p95": 0.95, "p99": 0.99, "p_max": 1.0}
    close = count_if(F.abs(F.col("proba") - tau) <= near)
    return scored.agg(F.count(F.lit(1)).alias("n"), close.alias("near_tau")).crossJoin(
        quantiles(scored, [], "proba", points)
    )


def target_decomposition(df: DataFrame, cfg: FeedConfig) -> DataFrame:
    """One row: how the label splits into near-empty and near-full, and how fill relates to it."""
    capacity = F.nullif(F.col(BIKES) + F.col(DOCKS), F.lit(0))
    rows = (
        df.withColumn("empty", F.col(BIKES) <= cfg.critical_at)
        .withColumn("full", F.col(DOCKS) <= cfg.critical_at)
        .withColumn("critical", critical(at=cfg.critical_at))
        .withColumn("off_centre", F.abs(F.col(BIKES) / capacity - 0.5))
    )
    near = neighbourhood(rows, 0, cfg.reach_us(cfg.horizon), cfg.block_us)
    w = near_window(PERIOD_SERIES)
    for flag, name in (("critical", "label"), ("empty", "label_empty"), ("full", "label_full")):
        near = with_label(near, cfg, w, flag, name)
    seen = at_home(near).filter(F.col("label").isNotNull())
    label = F.col("label").cast("double")
    return seen.agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("label")).alias("n_label"),
        count_if(F.col("label_empty")).alias("n_empty"), count_if(F.col("label_full")).alias("n_full"),
        F.corr("off_centre", label).alias("corr_off_centre"), F.corr(F.col(BIKES).cast("double"), label).alias("corr_bikes"),
    )

