"""Safeguard: flagged readings are replaced by the station's last unflagged reading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pollgauge.config import BIKES, DOCKS, PERIOD_SERIES, SECOND_US, US, FaultGrid, FeedConfig
from pollgauge.functions.columns import true_when
from pollgauge.operators.detect import detect_type_mismatch, frozen_rows, jump_rows
from pollgauge.operators.sequence import BLOCK, Blocks, at_home, neighbourhood


def carry_forward(df: DataFrame, flag: str | Column, cfg: FeedConfig, keys: Sequence[str] = PERIOD_SERIES) -> DataFrame:
    """Replace flagged readings by the last unflagged ones; flagged rows before any are dropped."""
    bad = F.col(flag) if isinstance(flag, str) else flag
    usable = F.when(~bad, F.struct(BIKES, DOCKS))
    rows = Blocks(df, keys, cfg.block_us).carry_forward("_good", usable).frame()
    return (
        rows.filter(F.col("_good").isNotNull())
        .withColumn(BIKES, F.col(f"_good.{BIKES}"))
        .withColumn(DOCKS, F.col(f"_good.{DOCKS}"))
        .drop("_good")
    )


def safeguard_repair(
    df: DataFrame, fault_class: str, cfg: FeedConfig, keys: Sequence[str] = PERIOD_SERIES, copies: int | None = None
) -> DataFrame | None:
    """Repair with the detector of the fault class, or None where no detector applies.

    Removed rows (dropout), a repeated feed (stale) and a fault the feed does not
    show (silent) leave nothing to flag in these rows.

    With `copies`, the rows hold so many experiments side by side (`inject.side_by_side`); they are all kept, with an
    array `good` of the readings (bikes, docks) that the repair leaves, null where it drops the row.
    """
    if copies is not None and fault_class in (FaultGrid.FROZEN, FaultGrid.CAPACITY, FaultGrid.JUMP):
        return _repair_side_by_side(df, fault_class, cfg, keys, copies)
    if fault_class == FaultGrid.FROZEN:
        flagged, flag = frozen_rows(df, cfg.repair_window_s, cfg, keys), "frozen"
    elif fault_class == FaultGrid.CAPACITY:
        # The feed carries no type columns, so the total is compared with itself.
        flagged, flag = detect_type_mismatch(df, [BIKES]), "inconsistent"
    elif fault_class == FaultGrid.JUMP:
        flagged, flag = jump_rows(df, cfg, keys), "jump_flag"
    else:
        return None
    return carry_forward(flagged, flag, cfg, keys).drop(flag)


def _repair_side_by_side(rows: DataFrame, fault_class: str, cfg: FeedConfig, keys: Sequence[str], n: int) -> DataFrame:
    """`safeguard_repair` for all experiments of a class in one pass, by the same rules."""
    places = F.array(*[F.lit(i) for i in range(n)])
    if fault_class == FaultGrid.FROZEN:
        width = cfg.repair_window_s * SECOND_US - 1
        near = neighbourhood(rows, width, 0, cfg.block_us)
        w = Window.partitionBy(*keys, BLOCK).orderBy(US).rangeBetween(-width, 0)

        def held(name: str, i):
            seen = F.transform(name, lambda row: F.get(row, i))
            return F.array_min(seen) == F.array_max(seen)

        near = near.withColumns({"_b": F.collect_list("c_bikes").over(w), "_d": F.collect_list("c_docks").over(w)})
        flags = F.transform(places, lambda i: true_when(held("_b", i) & held("_d", i)))
        rows = at_home(near.withColumn("_flag", flags)).drop("_b", "_d")
        blocks = Blocks(rows, keys, cfg.block_us)
    elif fault_class == FaultGrid.CAPACITY:
        differs = lambda i: F.get("c_bikes", i) != F.coalesce(F.get("c_bikes", i), F.lit(0))
        blocks = Blocks(rows.withColumn("_flag", F.transform(places, differs)), keys, cfg.block_us)
    else:
        blocks = Blocks(rows, keys, cfg.block_us).previous("_prev", [US, "c_bikes"])
        minutes = (F.col(US) - F.col("_prev.us")) / F.lit(60.0 * SECOND_US)
        limit = F.lit(cfg.max_flow_per_min) * minutes
        moved = lambda i: F.abs(F.get("c_bikes", i) - F.get(F.col("_prev.c_bikes"), i))
        blocks = blocks.with_columns(_flag=F.transform(places, lambda i: true_when(moved(i) > limit)))
    reading = lambda i: F.struct(F.get("c_bikes", i).alias("bikes"), F.get("c_docks", i).alias("docks"))
    usable = F.transform(places, lambda i: F.when(~F.get("_flag", i), reading(i)))
    return blocks.carry_forward_each("good", usable, n).frame().drop("_flag", "_prev")
