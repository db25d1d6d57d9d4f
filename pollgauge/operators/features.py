"""Gap-safe lag features and the forecast label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollgauge.config import BIKES, DOCKS, PERIOD_SERIES, US, FeedConfig
from pollgauge.functions.columns import critical, hour_us, utc_hour, utc_weekday
from pollgauge.operators.sequence import at_home, near_window, neighbourhood


def with_lags(
    df: DataFrame, cfg: FeedConfig, window, bikes: str = BIKES, docks: str = DOCKS, prefix: str = ""
) -> DataFrame:
    """Add bikes and docks of k rows ago, null when those rows span too long a time."""
    added = {}
    for k in cfg.lags:
        near_enough = (F.col(US) - F.lag(US, k).over(window)) <= cfg.reach_us(k)
        added[f"{prefix}bikes_lag{k}"] = F.when(near_enough, F.lag(bikes, k).over(window))
        added[f"{prefix}docks_lag{k}"] = F.when(near_enough, F.lag(docks, k).over(window))
    return df.withColumns(added)


def with_label(df: DataFrame, cfg: FeedConfig, window, flag: str = "critical", name: str = "label") -> DataFrame:
    """Add the flag of `horizon` rows ahead, null when those rows span too long a time."""
    ahead = (F.lead(US, cfg.horizon).over(window)) - F.col(US)
    return df.withColumn(name, F.when(ahead <= cfg.reach_us(cfg.horizon), F.lead(flag, cfg.horizon).over(window)))


def with_calendar(df: DataFrame) -> DataFrame:
    return df.withColumn("hour", utc_hour()).withColumn("weekday", utc_weekday())


def weather_join(df: DataFrame, weather: DataFrame) -> DataFrame:
    """Attach the hour's weather; hours without weather give nulls.

    Weather has one row per hour.  Spark broadcasts it while it is below the
    broadcast threshold and joins by hour beyond it.
    """
    return df.withColumn("hour_us", hour_us()).join(weather, "hour_us", "left").drop("hour_us")


def build_features(
    df: DataFrame,
    cfg: FeedConfig,
    weather: DataFrame | None = None,
    keys: Sequence[str] = PERIOD_SERIES,
    label: bool = True,
) -> DataFrame:
    """Critical flag, lags, calendar, weather and label, with one shuffle of the rows."""
    rows = df.withColumn("critical", critical(at=cfg.critical_at))
    near = neighbourhood(rows, cfg.lag_reach_us, cfg.reach_us(cfg.horizon) if label else 0, cfg.block_us)
    w = near_window(keys)
    near = with_lags(near, cfg, w)
    if label:
        near = with_label(near, cfg, w)
    out = with_calendar(at_home(near))
    return out if weather is None else weather_join(out, weather)


def forecastable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose features and label are all present."""
    return df.dropna(subset=[*columns, "label"])

