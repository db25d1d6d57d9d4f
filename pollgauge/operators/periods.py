"""Continuous periods, certification, and what a period holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pollgauge.config import FEED, PERIOD, PERIOD_SERIES, SECOND_US, STATION, US, FeedConfig
from pollgauge.functions.columns import block_of, count_if, critical, to_ts, true_when
from pollgauge.operators.detect import frozen_rows, jump_rows
from pollgauge.operators.sequence import Blocks, at_home, near_window, neighbourhood
from pollgauge.session import materialise


def distinct_polls(df: DataFrame) -> DataFrame:
    """The poll times of each feed; partial aggregation shrinks the rows before the shuffle."""
    return df.select(FEED, US).distinct()


def continuity_segments(df: DataFrame, cfg: FeedConfig) -> DataFrame:
    """Maximal runs of polls with no gap above the limit: one row per segment of a feed."""
    blocks = Blocks(distinct_polls(df), [FEED], cfg.block_us).previous("prev", [US])
    starts = F.col("prev").isNull() | (F.col(US) - F.col("prev.us") > cfg.max_gap_us)
    numbered = blocks.running_sum("segment", starts.cast("int")).frame()
    return (
        numbered.groupBy(FEED, "segment")
        .agg(F.min(US).alias("start_us"), F.max(US).alias("end_us"), F.count(F.lit(1)).alias("polls"))
        .withColumn("duration_h", (F.col("end_us") - F.col("start_us")) / F.lit(3600.0 * SECOND_US))
        .withColumn("day", F.to_date(to_ts("start_us")))
        .withColumn("retained", F.col("end_us") - F.col("start_us") >= cfg.min_period_s * SECOND_US)
    )


def retained_periods(segments: DataFrame) -> DataFrame:
    """The segments long enough to forecast in, numbered from 0 within the feed."""
    order = Window.partitionBy(FEED).orderBy("segment")
    kept = segments.filter("retained")
    return kept.withColumn(PERIOD, (F.row_number().over(order) - 1).cast("int")).drop("segment", "retained")


def longest_segment(segments: DataFrame) -> DataFrame:
    """The longest segment of each feed; the earliest one on a tie."""
    cols = ["start_us", "end_us", "duration_h"]
    order = F.struct((F.col("end_us") - F.col("start_us")).alias("length"), (-F.col("start_us")).alias("early"))
    return segments.groupBy(FEED).agg(F.max_by(F.struct(*cols), order).alias("best")).select(FEED, "best.*")


def assign_period(df: DataFrame, periods: DataFrame, cfg: FeedConfig, keep: str = PERIOD) -> DataFrame:
    """Rows that lie inside a period, with its id.

    Periods do not overlap, so a row matches at most once.  Each period is listed
    under every time block it touches, which turns the range match into an equi
    join on (feed, block); Spark broadcasts the list when its size allows it.
    """
    listed = periods.select(
        FEED,
        keep,
        "start_us",
        "end_us",
        F.explode(
            F.sequence(block_of("start_us", cfg.block_us), block_of("end_us", cfg.block_us))
        ).alias("_blk"),
    )
    inside = F.col(US).between(F.col("start_us"), F.col("end_us"))
    cut = df.withColumn("_blk", block_of(US, cfg.block_us))
    return cut.join(listed, [FEED, "_blk"]).filter(inside).drop("_blk", "start_us", "end_us")


def in_test_window(periods: DataFrame, val_end_us: int, test_end_us: int) -> DataFrame:
    """Periods that start inside (val_end, test_end]."""
    return periods.filter((F.col("start_us") > val_end_us) & (F.col("start_us") <= test_end_us))


def certify_periods(df: DataFrame, periods: DataFrame, cfg: FeedConfig) -> DataFrame:
    """Rows of the retained periods without implausible jumps."""
    flagged = jump_rows(assign_period(df, periods, cfg), cfg, PERIOD_SERIES)
    return flagged.filter(~F.col("jump_flag")).drop("jump_flag")


def certify_longest(df: DataFrame, cfg: FeedConfig) -> DataFrame:
    """Rows of each feed's longest segment without implausible jumps, flagged for frozen counters."""
    best = longest_segment(continuity_segments(df, cfg)).withColumn(PERIOD, F.lit(0))
    return frozen_rows(certify_periods(df, best, cfg), cfg.frozen_window_s, cfg, PERIOD_SERIES)


def dwell_rows(df: DataFrame, cfg: FeedConfig) -> DataFrame:
    """Add `dwell_s`: time to the station's next row, at most the gap limit.

    The last row of a period stands for one poll.
    """
    rows = Blocks(df, PERIOD_SERIES, cfg.block_us).following("_next", [US]).frame()
    last = F.col("_next").isNull()
    ahead = F.least(F.col("_next.us") - F.col(US), F.lit(cfg.max_gap_us))
    dwell = F.when(last, F.lit(cfg.cadence_s * SECOND_US)).otherwise(ahead)
    return rows.withColumn("dwell_s", dwell / F.lit(float(SECOND_US))).drop("_next")


def episode_starts(df: DataFrame, flag: str, keys, cfg: FeedConfig, gap: bool) -> DataFrame:
    """Add `episode_start`: a true row whose previous row is not true.

    With `gap`, a previous row further away than the gap limit does not count, so
    the look-back is bounded; without it the previous row may be any time ago.
    """
    if gap:
        near = neighbourhood(df, cfg.max_gap_us, 0, cfg.block_us)
        w = near_window(keys)
        joined = (F.col(US) - F.lag(US).over(w)) <= cfg.max_gap_us
        before = true_when(joined & F.lag(flag).over(w))
        return at_home(near.withColumn("episode_start", F.col(flag) & ~before))
    blocks = Blocks(df, keys, cfg.block_us).previous("_prev", [flag])
    rows = blocks.frame()
    return rows.withColumn("episode_start", F.col(flag) & ~true_when(F.col(f"_prev.{flag}"))).drop("_prev")


def period_census(df: DataFrame, periods: DataFrame, cfg: FeedConfig) -> DataFrame:
    """Fourteen counts per retained period."""
    from pollgauge.operators.features import build_features

    periods = materialise(periods, "periods")
    flagged = materialise(jump_rows(assign_period(df, periods, cfg), cfg, PERIOD_SERIES), "flagged")
    raw = flagged.groupBy(FEED, PERIOD).agg(
        F.count_distinct(STATION).alias("stations"),
        F.count(F.lit(1)).alias("observations"),
        count_if(F.col("jump_flag")).alias("jump_rows_excluded"),
    )
    clean = flagged.filter(~F.col("jump_flag")).drop("jump_flag")
    rows = frozen_rows(build_features(clean, cfg), cfg.frozen_window_s, cfg, PERIOD_SERIES)
    usable = F.col("label").isNotNull()
    for name in cfg.feature_columns:
        usable = usable & F.col(name).isNotNull()
    kept = rows.groupBy(FEED, PERIOD).agg(
        count_if(F.col("frozen")).alias("frozen_rows_flagged_kept"),
        F.count(F.lit(1)).alias("observations_clean"),
        count_if(usable).alias("observations_forecastable"),
        count_if(F.col("critical")).alias("critical_observations"),
        count_if(usable & F.col("label")).alias("label_positive"),
    )
    head = periods.select(FEED, PERIOD, "day", "start_us", "end_us", "duration_h", "polls")
    return head.join(raw, [FEED, PERIOD]).join(kept, [FEED, PERIOD])


def critical_rows(df: DataFrame, cfg: FeedConfig) -> DataFrame:
    return df.withColumn("critical", critical(at=cfg.critical_at))
