"""What the injected faults do to decisions and cost.

The clean rows are scored once.  A dropout, stale or capacity fault changes few
rows, and a changed row can reach only as far as the longest valid lag plus one
episode gap.  So these experiments are rescored only in the time blocks that a
change can reach, and all other rows keep their clean result.  Frozen and jump
faults are followed by a repair that acts on every row, so these experiments
are rescored in full, side by side in the clean rows.  A silent fault changes no decision, only the outcome.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pollgauge.config import (
    BIKES, DOCKS, PERIOD_SERIES, US, CostModel, FaultGrid, FeedConfig, FrozenModel,
)
from pollgauge.functions.columns import block_of, count_if, logistic, true_when
from pollgauge.operators.cost import recovery_rate, total_cost
from pollgauge.operators.features import build_features, with_lags
from pollgauge.operators.inject import EXPERIMENT, VALUES, ids_of, side_by_side
from pollgauge.operators.repair import safeguard_repair
from pollgauge.operators.sequence import BLOCK, HOME, at_home, near_window, neighbourhood
from pollgauge.session import materialise

SERIES_OF_EXPERIMENT = ("experiment_id", *PERIOD_SERIES)
# Columns of the per-block sums; `x_` marks a difference to the clean rows.
SUMS = ("flips", "missing", "abs_err", "x_dispatches", "x_missed", "r_dispatches", "r_missed")


def clean_scores(base: DataFrame, cfg: FeedConfig, model: FrozenModel, weather: DataFrame | None = None) -> DataFrame:
    """All clean rows with score, decision, label, and the time of the row that gave the label.

    `counted` marks the rows that enter the comparison: scored and labelled.
    """
    rows = build_features(base, cfg, weather)
    rows = rows.withColumn("proba", logistic(model)).withColumn("decision", F.col("proba") >= model.tau)
    rows = rows.withColumn("counted", F.col("proba").isNotNull() & F.col("label").isNotNull())
    near = neighbourhood(rows, cfg.max_gap_us, cfg.reach_us(cfg.horizon), cfg.block_us)
    w = near_window(PERIOD_SERIES)
    near = near.withColumn("label_us", F.when(F.col("label").isNotNull(), F.lead(US, cfg.horizon).over(w)))
    among = Window.partitionBy(*PERIOD_SERIES, BLOCK, "counted").orderBy(US)
    return at_home(near.withColumn("start", _starts("decision", among, cfg)))


def _starts(flag: str, window, cfg: FeedConfig):
    joined = (F.col(US) - F.lag(US).over(window)) <= cfg.max_gap_us
    return F.col(flag) & ~true_when(joined & F.lag(flag).over(window))


def clean_totals(clean: DataFrame) -> DataFrame:
    """One row: compared rows, clean dispatches, clean missed rows."""
    return clean.filter("counted").agg(
        F.count(F.lit(1)).alias("n_rows"),
        count_if(F.col("start")).alias("k_dispatches"),
        count_if(F.col("label") & ~F.col("decision")).alias("k_missed"),
    )


def _rescore(near: DataFrame, cfg: FeedConfig, model: FrozenModel) -> DataFrame:
    """Sums per experiment over the home rows of `near`.

    Removed rows form window groups of their own, so the lags of the remaining rows
    skip them while the rows stay in the frame.
    """
    # All windows below group by (series, block) and more, so this shuffle serves them all.
    rows = near.repartition(*SERIES_OF_EXPERIMENT, BLOCK)
    seen = Window.partitionBy(*SERIES_OF_EXPERIMENT, BLOCK, "removed").orderBy(US)
    rows = with_lags(rows, cfg, seen, "c_bikes", "c_docks", "c_")
    proba = F.when(~F.col("removed"), logistic(model, "c_"))
    rows = rows.withColumn("c_proba", proba)
    rows = rows.withColumn("c_decision", true_when(F.col("c_proba") >= model.tau))
    rows = rows.filter("counted")
    among = Window.partitionBy(*SERIES_OF_EXPERIMENT, BLOCK).orderBy(US)
    rows = rows.withColumn("c_start", _starts("c_decision", among, cfg))
    return _sums(rows.filter(HOME), repaired=False)


def _sums(home: DataFrame, repaired: bool) -> DataFrame:
    """Sums per experiment of counted rows; `r_` columns are there if `repaired`."""
    label, was = F.col("label"), F.col("decision")

    def extra(cond):
        return count_if(cond) - count_if(label & ~was)

    zero = F.lit(None).cast("bigint")
    return home.groupBy("experiment_id").agg(
        count_if(was != F.col("c_decision")).alias("flips"),
        count_if(F.col("c_proba").isNull()).alias("missing"),
        F.coalesce(F.sum(F.abs(F.col("c_proba") - F.col("proba"))), F.lit(0.0)).alias("abs_err"),
        (count_if(F.col("c_start")) - count_if(F.col("start"))).alias("x_dispatches"),
        extra(label & ~F.col("c_decision")).alias("x_missed"),
        (count_if(F.col("r_start")) - count_if(F.col("start")) if repaired else zero).alias("r_dispatches"),
        (extra(label & ~F.col("r_decision")) if repaired else zero).alias("r_missed"),
    )


def _carried(clean: DataFrame) -> DataFrame:
    """Clean columns that rescoring needs; lags are rebuilt from the changed readings."""
    return clean.select(*[c for c in clean.columns if c not in ("label_us", "critical") and "_lag" not in c])


def _reach_us(cfg: FeedConfig) -> int:
    return cfg.lag_reach_us + cfg.max_gap_us


def local_effects(clean: DataFrame, changes: DataFrame, cfg: FeedConfig, model: FrozenModel) -> DataFrame:
    """Sums of the experiments whose changes stay local, from the blocks they can reach."""
    touched = F.sequence(
        block_of(US, cfg.block_us), block_of(F.col(US) + F.lit(_reach_us(cfg)), cfg.block_us)
    )
    scope = materialise(changes.select(*SERIES_OF_EXPERIMENT, F.explode(touched).alias(BLOCK)).distinct(), "scope")
    near = neighbourhood(_carried(clean), _reach_us(cfg), 0, cfg.block_us)
    rows = near.join(scope, [*PERIOD_SERIES, BLOCK])
    delta = changes.select(*SERIES_OF_EXPERIMENT, US, F.struct(*VALUES).alias("new"))
    rows = rows.join(delta, [*SERIES_OF_EXPERIMENT, US], "left")
    hit = F.col("new").isNotNull()
    rows = (
        rows.withColumn("removed", F.coalesce(F.col("new.removed"), F.lit(False)))
        .withColumn("c_bikes", F.when(hit, F.col(f"new.{BIKES}")).otherwise(F.col(BIKES)))
        .withColumn("c_docks", F.when(hit, F.col(f"new.{DOCKS}")).otherwise(F.col(DOCKS)))
    )
    return _rescore(rows, cfg, model)


def repaired_decisions(
    clean: DataFrame, changes: DataFrame, fault_class: str, ids: list[str], cfg: FeedConfig, model: FrozenModel
) -> DataFrame:
    """Counted rows with `c_decision` and `r_decision`, before and after the repair: arrays in the order of `ids`.

    Frozen and jump faults remove no row, so their experiments share the clean rows' times and lie side by side. The
    repair drops rows at the start of a series only, where a null reading stands for no row. Complete at `HOME` rows.
    """
    n = len(ids)
    rows = side_by_side(_carried(clean), changes.filter(F.col("class") == fault_class), ids)
    near = safeguard_repair(rows, fault_class, cfg, copies=n)
    near = near.withColumns({f"r_{name}": F.transform("good", lambda g: g[name]) for name in ("bikes", "docks")})
    near = near.withColumn("dropped", F.transform("good", lambda g: g.isNull())).drop("good")
    near = neighbourhood(near, _reach_us(cfg), 0, cfg.block_us).repartition(*PERIOD_SERIES, BLOCK)
    places = F.array(*[F.lit(i) for i in range(n)])
    w = near_window(PERIOD_SERIES)
    rows = with_lags(with_lags(near, cfg, w, "c_bikes", "c_docks", "c_"), cfg, w, "r_bikes", "r_docks", "r_")
    rows = rows.filter("counted").withColumn("c_proba", F.transform(places, lambda i: logistic(model, "c_", i)))
    rows = rows.withColumn("c_decision", F.transform("c_proba", lambda p: true_when(p >= model.tau)))
    mended = lambda i: F.when(~F.get("dropped", i), logistic(model, "r_", i) >= model.tau)
    return rows.withColumn("r_decision", F.transform(places, lambda i: F.coalesce(mended(i), F.get("c_decision", i))))


def repaired_effects(
    clean: DataFrame, changes: DataFrame, exps: DataFrame, cfg: FeedConfig, model: FrozenModel
) -> DataFrame:
    """Sums of the frozen and jump experiments, before and after the repair."""
    parts = []
    for fault_class in (FaultGrid.FROZEN, FaultGrid.JUMP):
        ids = ids_of(exps, fault_class)
        if ids:
            parts.append(_sums_side_by_side(repaired_decisions(clean, changes, fault_class, ids, cfg, model), ids, cfg))
    none = clean.limit(0).selectExpr("*", "'' AS experiment_id", "decision AS c_decision", "proba AS c_proba", "start AS c_start")
    return reduce(DataFrame.unionByName, parts) if parts else _sums(none, repaired=False)


def _sums_side_by_side(rows: DataFrame, ids: list[str], cfg: FeedConfig) -> DataFrame:
    w = near_window(PERIOD_SERIES)
    joined = (F.col(US) - F.lag(US).over(w)) <= cfg.max_gap_us
    clean = ["label", "decision", "proba", "start"]
    rows = rows.select(
        HOME, *clean, "c_proba", "c_decision", "r_decision", true_when(joined).alias("_joined"),
        F.lag("c_decision").over(w).alias("_c"), F.lag("r_decision").over(w).alias("_r"),
    ).filter(HOME)
    began = lambda now, was, i: F.get(now, i) & ~(F.col("_joined") & true_when(F.get(was, i)))
    each = F.transform(F.array(*[F.lit(i) for i in range(len(ids))]), lambda i: F.struct(
        i.alias("experiment_id"), *[F.get(c, i).alias(c) for c in ("c_proba", "c_decision", "r_decision")],
        began("c_decision", "_c", i).alias("c_start"), began("r_decision", "_r", i).alias("r_start"),
    ))
    sums = _sums(rows.select(*clean, F.explode(each).alias("e")).select(*clean, "e.*"), repaired=True)
    return sums.withColumn("experiment_id", F.get(F.array(*[F.lit(i) for i in ids]), F.col("experiment_id")))


def silent_effects(clean: DataFrame, changes: DataFrame, cfg: FeedConfig) -> DataFrame:
    """Sums of the silent experiments: the same decisions against the true outcome."""
    at = cfg.critical_at
    truth = changes.select(
        *SERIES_OF_EXPERIMENT,
        F.col(US).alias("label_us"),
        ((F.col("true_available") <= at) | (F.col(DOCKS) <= at)).alias("true_label"),
    )
    rows = clean.filter("counted").join(truth, [*PERIOD_SERIES, "label_us"])
    missed = count_if(F.col("true_label") & ~F.col("decision")) - count_if(F.col("label") & ~F.col("decision"))
    zero = F.lit(0).cast("bigint")
    none = F.lit(None).cast("bigint")
    sums = [zero, zero, F.lit(0.0), zero, missed, none, none]
    return rows.groupBy("experiment_id").agg(*[c.alias(n) for c, n in zip(sums, SUMS)])


def evaluate_experiments(
    clean: DataFrame, changes: DataFrame, exps: DataFrame, cfg: FeedConfig, model: FrozenModel, costs: CostModel
) -> DataFrame:
    """One row per experiment: flips, forecast error, dispatches, extra cost, recovery.

    `clean` (from `clean_scores`) and `changes` should be written tables: both are read several times.
    """
    g = FaultGrid
    local = changes.filter(F.col("class").isin(g.DROPOUT, g.STALE, g.CAPACITY))
    sums = reduce(
        DataFrame.unionByName,
        [
            local_effects(clean, local, cfg, model),
            repaired_effects(clean, changes, exps, cfg, model),
            silent_effects(clean, changes.filter(F.col("class") == g.SILENT), cfg),
        ],
    )
    rows = exps.select(*EXPERIMENT).join(sums, "experiment_id", "left").crossJoin(clean_totals(clean))

    def total(name: str):
        return F.coalesce(F.col(name), F.lit(0))

    k_cost = total_cost(F.col("k_missed"), F.col("k_dispatches"), cfg, costs)
    c_cost = total_cost(F.col("k_missed") + total("x_missed"), F.col("k_dispatches") + total("x_dispatches"), cfg, costs)
    # The capacity detector compares the total with itself, so its repair changes nothing.
    r_cost = F.when(
        F.col("class").isin(g.FROZEN, g.JUMP),
        total_cost(F.col("k_missed") + F.col("r_missed"), F.col("k_dispatches") + F.col("r_dispatches"), cfg, costs),
    ).when(F.col("class") == g.CAPACITY, c_cost)
    rows = rows.withColumn("n_flips", total("flips")).withColumn("n_rows_missing_in_corrupted", total("missing"))
    present = F.col("n_rows") - F.col("n_rows_missing_in_corrupted")
    # Costs are rounded first, so that a zero gap is exactly zero in any summation order.
    rows = (
        rows.withColumn("_k", F.round(k_cost, 6)).withColumn("_c", F.round(c_cost, 6)).withColumn("_r", F.round(r_cost, 6))
    )
    recovery = F.when(F.col("class") == g.SILENT, F.lit(0.0)).otherwise(
        recovery_rate(F.col("_k"), F.col("_c"), F.col("_r"))
    )
    return rows.filter("n_rows > 0").select(
        *EXPERIMENT,
        "n_rows",
        "n_flips",
        "n_rows_missing_in_corrupted",
        (F.col("n_flips") / F.col("n_rows")).alias("flip_rate"),
        (F.coalesce(F.col("abs_err"), F.lit(0.0)) / F.nullif(present, F.lit(0))).alias("forecast_error"),
        F.col("k_dispatches").alias("n_dispatches_clean"),
        (F.col("k_dispatches") + total("x_dispatches")).alias("n_dispatches_corrupted"),
        (F.col("_c") - F.col("_k")).alias("delta_cost"),
        (F.col("_r") - F.col("_k")).alias("delta_cost_recovered"),
        recovery.alias("recovery_rate"),
    )


def dose_response(results: DataFrame) -> DataFrame:
    """Means per class and intensity; nulls are skipped."""
    return results.groupBy("class", "intensity_idx").agg(
        F.avg("flip_rate").alias("flip_rate"),
        F.avg("delta_cost").alias("delta_cost"),
        F.avg("recovery_rate").alias("recovery_rate"),
        F.count("seed").alias("n"),
    )
