"""Detectors: dropout, frozen counter, stale feed, inconsistent count, implausible jump."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pollgauge.config import BIKES, DOCKS, FEED, SECOND_US, SERIES, US, FeedConfig
from pollgauge.functions.columns import floor_to, true_when
from pollgauge.operators.sequence import BLOCK, Blocks, at_home, neighbourhood


def registry_absent(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered stations that the frame never shows."""
    return registry.join(df.select(*SERIES).distinct(), list(SERIES), "left_anti")


def detect_dropout(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Every registered station with `dropped`: true if it never appears in the frame."""
    seen = df.select(*SERIES).distinct().withColumn("_seen", F.lit(True))
    out = registry.select(*SERIES).join(seen, list(SERIES), "left")
    return out.select(*SERIES, F.col("_seen").isNull().alias("dropped"))


def detect_dropout_by_window(df: DataFrame, registry: DataFrame, window_s: int) -> DataFrame:
    """Registered stations missing from a tumbling window in which their feed was polled."""
    slot = floor_to(US, window_s * SECOND_US).alias("window_us")
    seen = df.select(*SERIES, slot).distinct()
    expected = seen.select(FEED, "window_us").distinct().join(registry.select(*SERIES), FEED)
    return expected.join(seen, [*SERIES, "window_us"], "left_anti")


def step_change(df: DataFrame, cfg: FeedConfig, keys: Sequence[str] = SERIES) -> DataFrame:
    """Add `delta_bikes` and `elapsed_min` against the station's previous row."""
    rows = Blocks(df, keys, cfg.block_us).previous("_prev", [US, BIKES]).frame()
    return (
        rows.withColumn("delta_bikes", F.abs(F.col(BIKES) - F.col(f"_prev.{BIKES}")))
        .withColumn("elapsed_min", (F.col(US) - F.col("_prev.us")) / F.lit(60.0 * SECOND_US))
        .drop("_prev")
    )


def jump_rows(df: DataFrame, cfg: FeedConfig, keys: Sequence[str] = SERIES) -> DataFrame:
    """Add `jump_flag`: more bikes moved since the previous row than the flow limit allows."""
    rows = step_change(df, cfg, keys)
    flag = true_when(F.col("delta_bikes") > F.lit(cfg.max_flow_per_min) * F.col("elapsed_min"))
    return rows.withColumn("jump_flag", flag).drop("delta_bikes", "elapsed_min")


def frozen_rows(
    df: DataFrame, window_s: int, cfg: FeedConfig, keys: Sequence[str] = SERIES, min_rows: int = 1
) -> DataFrame:
    """Add `frozen`: bikes and docks both constant over the last `window_s` seconds.

    A window with a single row is constant; raise `min_rows` to ask for more.
    """
    width = window_s * SECOND_US - 1
    near = neighbourhood(df, width, 0, cfg.block_us)
    w = Window.partitionBy(*keys, BLOCK).orderBy(US).rangeBetween(-width, 0)
    flag = (F.min(BIKES).over(w) == F.max(BIKES).over(w)) & (F.min(DOCKS).over(w) == F.max(DOCKS).over(w))
    if min_rows > 1:
        flag = flag & (F.count(F.lit(1)).over(w) >= min_rows)
    return at_home(near.withColumn("frozen", true_when(flag)))


def repeat_of_previous(polls: DataFrame, cfg: FeedConfig, hash_col: str = "payload_sha256") -> DataFrame:
    """Add `repeat_hash`: the payload equals the previous poll's payload."""
    rows = Blocks(polls, [FEED], cfg.block_us, "request_us").previous("_prev", [hash_col]).frame()
    return rows.withColumn("repeat_hash", true_when(F.col(hash_col) == F.col(f"_prev.{hash_col}"))).drop("_prev")


def detect_stale(polls: DataFrame, cfg: FeedConfig) -> DataFrame:
    """Add `stale`: the feed's clock lags behind, or the payload repeats."""
    age_us = F.col("request_us") - F.col("last_updated_us")
    rows = repeat_of_previous(polls, cfg)
    return rows.withColumn("stale", (age_us > cfg.stale_age_s * SECOND_US) | F.col("repeat_hash"))


def detect_type_mismatch(df: DataFrame, type_cols: Sequence[str]) -> DataFrame:
    """Add `inconsistent`: the total differs from the sum of its parts (nulls count as zero)."""
    total = F.lit(0)
    for name in type_cols:
        total = total + F.coalesce(F.col(name), F.lit(0))
    return df.withColumn("inconsistent", F.col(BIKES) != total)


def detect_capacity_mismatch(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Add `inconsistent`: bikes plus docks differ from the registered capacity."""
    out = df.join(registry.select(*SERIES, "capacity"), list(SERIES), "left")
    return out.withColumn("inconsistent", true_when(F.col(BIKES) + F.col(DOCKS) != F.col("capacity"))).drop("capacity")

