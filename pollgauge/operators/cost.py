"""Policy cost, cost scenarios, flips, and recovery."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pollgauge.config import SERIES, CostModel, FeedConfig
from pollgauge.functions.columns import count_if
from pollgauge.operators.periods import episode_starts
from pollgauge.session import fixed_table


def cost_columns(cfg: FeedConfig, costs: CostModel, missed: str = "missed", dispatches: str = "n_dispatches") -> list[Column]:
    penalty = F.col(missed) * F.lit(costs.penalty_per_row(cfg.row_hours))
    transit = F.col(dispatches) * F.lit(costs.dispatch)
    return [penalty.alias("c_penalty"), transit.alias("c_transit"), (penalty + transit).alias("total")]


def total_cost(missed: Column, dispatches: Column, cfg: FeedConfig, costs: CostModel) -> Column:
    return missed * F.lit(costs.penalty_per_row(cfg.row_hours)) + dispatches * F.lit(costs.dispatch)


def cost_counts(
    df: DataFrame, cfg: FeedConfig, by: Sequence[str] = (), decision: str = "decision",
    critical: str = "label", keys: Sequence[str] | None = SERIES,
) -> DataFrame:
    """Missed critical rows and dispatches, the two numbers that any cost scenario needs.

    With `keys`, a run of true decisions is one dispatch; without, every true row is one.
    """
    missed = count_if(F.col(critical) & ~F.col(decision)).alias("missed")
    if keys is None:
        return df.groupBy(*by).agg(missed, count_if(F.col(decision)).alias("n_dispatches"))
    rows = episode_starts(df, decision, keys, cfg, gap=True)
    return rows.groupBy(*by).agg(missed, count_if(F.col("episode_start")).alias("n_dispatches"))


def policy_cost(df: DataFrame, cfg: FeedConfig, costs: CostModel, **kwargs) -> DataFrame:
    counts = cost_counts(df, cfg, **kwargs)
    return counts.select("*", *cost_columns(cfg, costs))


def scenarios(spark: SparkSession, costs: CostModel) -> DataFrame:
    """All 81 combinations of the four three-level parameters; a table of fixed size."""
    axes = (
        ("sigma", costs.sigma_levels),
        ("revenue_per_ride", costs.revenue_levels),
        ("pickup_rate_per_hour", costs.pickup_levels),
        ("c_dispatch", costs.dispatch_levels),
    )
    schema = ", ".join(f"{name} string, {name}_value double" for name, _ in axes)
    picks = product(*[list(zip(costs.level_names, levels)) for _, levels in axes])
    return fixed_table(spark, [tuple(chain.from_iterable(pick)) for pick in picks], schema)


def cost_sweep(counts: DataFrame, cfg: FeedConfig, costs: CostModel) -> DataFrame:
    """Cost in every scenario from one pass over the rows."""
    grid = counts.crossJoin(F.broadcast(scenarios(counts.sparkSession, costs)))
    penalty = (
        F.col("missed") * F.lit(cfg.row_hours) * F.col("pickup_rate_per_hour_value")
        * (F.lit(1.0) - F.col("sigma_value")) * F.col("revenue_per_ride_value")
    )
    transit = F.col("n_dispatches") * F.col("c_dispatch_value")
    return grid.select(
        *counts.columns, "sigma", "revenue_per_ride", "pickup_rate_per_hour", "c_dispatch",
        penalty.alias("c_penalty"), transit.alias("c_transit"), (penalty + transit).alias("total"),
    )


def flip_rate(first: str, second: str) -> Column:
    return F.avg((F.col(first) != F.col(second)).cast("int"))


def recovery_rate(clean: Column, corrupted: Column, recovered: Column) -> Column:
    """Share of the extra cost that the repair won back; null without extra cost."""
    gap = corrupted - clean
    return (corrupted - recovered) / F.nullif(gap, F.lit(0.0))
