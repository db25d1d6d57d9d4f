"""Reproducible faults, stored as the rows that they change.

An experiment is (class, intensity, seed).  Instead of 120 full copies of the
clean rows, `change_rows` lists only rows that a fault removes or alters;
`apply_changes` rebuilds a full copy where one is needed.  All choices come from
hashes of (seed, purpose, key), so they do not depend on partitioning, and the
key leaves out the intensity, so that a seed places its fault at the same spot
at every intensity.

Where a fault goes is drawn first and written as a small table.  The join with
the clean rows is then planned from the table's known size: as a broadcast, which
leaves the clean rows unshuffled, or as a shuffle when there are very many feeds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pollgauge.config import BIKES, DOCKS, FEED, PERIOD, PERIOD_SERIES, SECOND_US, SERIES, STATION, US, FaultGrid
from pollgauge.functions.columns import count_if, hash32, uniform
from pollgauge.operators.sequence import number_rows
from pollgauge.session import fixed_table, materialise

EXPERIMENT = ("experiment_id", "class", "intensity_idx", "seed")
EXPERIMENT_SCHEMA = (
    "class string, intensity_idx int, seed int, stations int, window_s bigint, magnitude int, rate double"
)
VALUES = ("removed", BIKES, DOCKS, "true_available")
# Fixed text: the label that every injected dataset carries.
SYNTHETIC = "SYNTHETIC - modified from observed data; never to be reported as observed data"


def experiments(spark: SparkSession, grid: FaultGrid) -> DataFrame:
    """The grid as a table of fixed size, one row per experiment."""
    table = fixed_table(spark, grid.rows(), EXPERIMENT_SCHEMA)
    name = F.concat(F.col("class"), F.lit("__i"), F.col("intensity_idx"), F.lit("__seed"), F.col("seed"))
    return table.select(name.alias("experiment_id"), "*")


def _of_class(exps: DataFrame, fault_class: str) -> DataFrame:
    return exps.filter(F.col("class") == fault_class)


def _seeds(spark: SparkSession, grid: FaultGrid) -> DataFrame:
    return fixed_table(spark, [(s,) for s in grid.seeds], "seed int")


def chosen_periods(base: DataFrame, periods: DataFrame, grid: FaultGrid) -> DataFrame:
    """One period per feed and seed, with the bounds of its rows."""
    spark = base.sparkSession
    draw = F.struct(hash32(F.col("seed"), "period", F.col(FEED), F.col(PERIOD)), F.col(PERIOD))
    pick = (
        periods.crossJoin(F.broadcast(_seeds(spark, grid)))
        .groupBy(FEED, "seed")
        .agg(F.min_by(F.struct(PERIOD, "start_us", "end_us"), draw).alias("p"))
        .select(FEED, "seed", "p.*")
    )
    span = base.groupBy(FEED, PERIOD).agg(F.min(US).alias("t_min"), F.max(US).alias("t_max"))
    return pick.join(span, [FEED, PERIOD])


def _target_stations(base: DataFrame, chosen: DataFrame, purpose: str, most: int) -> DataFrame:
    """The first `most` stations of the chosen period in hash order, ranked from 1.

    The literal limit lets Spark keep only the first rows of each map task before the shuffle.
    """
    spans = base.groupBy(*PERIOD_SERIES).agg(F.min(US).alias("s_min"), F.max(US).alias("s_max"))
    listed = spans.join(chosen, [FEED, PERIOD])
    order = Window.partitionBy(FEED, "seed").orderBy(hash32(F.col("seed"), purpose, F.col(STATION)), STATION)
    return listed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _window_start(purpose: str, low: str, high: str):
    """Start of a window of `window_s` inside [low, high]; at `low` if the span is too short."""
    room = F.col(high) - F.col("window_s") * SECOND_US - F.col(low)
    u = uniform(F.col("seed"), purpose, F.col(STATION))
    return F.when(room <= 0, F.col(low)).otherwise(F.col(low) + F.floor(u * room).cast("bigint"))


def _within(base: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows of the placed station that lie in [start_us, stop_us] of the placed period."""
    cols = [*EXPERIMENT, *PERIOD_SERIES, "start_us", "stop_us", "magnitude"]
    placed = materialise(placed.select(*cols), "placed")
    return base.join(placed, list(PERIOD_SERIES)).filter(
        F.col(US).between(F.col("start_us"), F.col("stop_us"))
    )


def _as_changes(rows: DataFrame, removed=None, bikes=None, docks=None, true_available=None) -> DataFrame:
    """Rows as changes; altered rows that end up equal to the clean row are left out."""
    none = F.lit(None).cast("int")
    out = rows.select(
        *EXPERIMENT,
        *PERIOD_SERIES,
        US,
        (removed if removed is not None else F.lit(False)).alias("removed"),
        (bikes if bikes is not None else F.col(BIKES)).cast("int").alias("_b"),
        (docks if docks is not None else F.col(DOCKS)).cast("int").alias("_d"),
        (true_available if true_available is not None else none).cast("int").alias("true_available"),
        F.col(BIKES).alias("_b0"),
        F.col(DOCKS).alias("_d0"),
    )
    same = F.col("_b").eqNullSafe(F.col("_b0")) & F.col("_d").eqNullSafe(F.col("_d0"))
    hidden = F.coalesce(F.col("true_available") != F.col("_b0"), F.lit(False))
    return (
        out.filter(F.col("removed") | ~same | hidden)
        .withColumn(BIKES, F.col("_b"))
        .withColumn(DOCKS, F.col("_d"))
        .select(*EXPERIMENT, *PERIOD_SERIES, US, *VALUES)
    )


def inject_dropout(base: DataFrame, exps: DataFrame, chosen: DataFrame, grid: FaultGrid) -> DataFrame:
    """Rows of k stations vanish for a while, each station with its own start."""
    targets = _target_stations(base, chosen, "dropout", max(k for k, _ in grid.dropout))
    placed = (
        targets.drop("start_us", "end_us")
        .join(_of_class(exps, grid.DROPOUT), "seed")
        .filter(F.col("rank") <= F.col("stations"))
        .withColumn("start_us", _window_start("dropout-start", "t_min", "t_max"))
        .withColumn("stop_us", F.col("start_us") + F.col("window_s") * SECOND_US)
    )
    return _as_changes(_within(base, placed), removed=F.lit(True))


def inject_frozen(base: DataFrame, exps: DataFrame, chosen: DataFrame, grid: FaultGrid) -> DataFrame:
    """One station repeats the first reading of a window until the window ends."""
    placed = (
        _target_stations(base, chosen, "frozen", 1)
        .drop("start_us", "end_us")
        .join(_of_class(exps, grid.FROZEN), "seed")
        .withColumn("start_us", _window_start("frozen-start", "s_min", "s_max"))
        .withColumn("stop_us", F.col("start_us") + F.col("window_s") * SECOND_US)
    )
    rows = _within(base, placed)
    first = rows.groupBy(*EXPERIMENT, *PERIOD_SERIES).agg(F.min_by(F.struct(BIKES, DOCKS), US).alias("held"))
    rows = rows.join(first, [*EXPERIMENT, *PERIOD_SERIES])
    return _as_changes(rows, bikes=F.col(f"held.{BIKES}"), docks=F.col(f"held.{DOCKS}"))


def inject_stale(base: DataFrame, exps: DataFrame, chosen: DataFrame, grid: FaultGrid) -> DataFrame:
    """The whole feed repeats one poll; a station absent from that poll reads null."""
    ours = chosen.join(_of_class(exps, grid.STALE), "seed").select(
        *EXPERIMENT, FEED, PERIOD, "start_us", (F.col("end_us") - F.col("window_s") * SECOND_US).alias("scope_end"),
        "window_s",
    )
    polls = base.select(FEED, PERIOD, US).distinct()
    candidates = polls.join(ours, [FEED, PERIOD]).filter(F.col(US).between(F.col("start_us"), F.col("scope_end")))
    last = candidates.groupBy("experiment_id", FEED).agg(F.max(US).alias("last_us"))
    draw = F.struct(hash32(F.col("seed"), "stale", F.col(FEED), F.col(US)), F.col(US))
    # With fewer than two candidates no row is left below the last one, and nothing changes.
    freeze = (
        candidates.join(last, ["experiment_id", FEED])
        .filter(F.col(US) < F.col("last_us"))
        .groupBy(*EXPERIMENT, FEED, PERIOD, "window_s")
        .agg(F.min_by(US, draw).alias("from_us"))
    )
    rows = base.join(materialise(freeze, "freeze"), [FEED, PERIOD])
    shot = rows.filter(F.col(US) == F.col("from_us")).select(
        "experiment_id", *SERIES, F.struct(BIKES, DOCKS).alias("held")
    )
    hit = rows.filter((F.col(US) > F.col("from_us")) & (F.col(US) <= F.col("from_us") + F.col("window_s") * SECOND_US))
    hit = hit.join(shot, ["experiment_id", *SERIES], "left")
    return _as_changes(hit, bikes=F.col(f"held.{BIKES}"), docks=F.col(f"held.{DOCKS}"))


def inject_capacity(base: DataFrame, exps: DataFrame, chosen: DataFrame, grid: FaultGrid) -> DataFrame:
    """From a drift start to the end of the period one station over-reports its bikes."""
    target = _target_stations(base, chosen, "capacity", 1).select(*PERIOD_SERIES, "seed", "s_min", "s_max", "end_us")
    polls = base.select(*PERIOD_SERIES, US).join(materialise(target, "target"), list(PERIOD_SERIES))
    late = F.col(US) > F.col("s_max") - grid.min_effect_s * SECOND_US
    draw = F.struct(late, F.when(late, F.col(US)).otherwise(hash32(F.col("seed"), "drift", F.col(US))), F.col(US))
    start = polls.groupBy(*PERIOD_SERIES, "seed", "end_us").agg(F.min_by(US, draw).alias("start_us"))
    placed = start.withColumnRenamed("end_us", "stop_us").join(_of_class(exps, grid.CAPACITY), "seed")
    return _as_changes(_within(base, placed), bikes=F.greatest(F.col(BIKES) + F.col("magnitude"), F.lit(0)))


def inject_jump(base: DataFrame, exps: DataFrame, grid: FaultGrid) -> DataFrame:
    """Random rows jump up or down by the magnitude, inside the station's capacity."""
    ours = _of_class(exps, grid.JUMP)
    by_seed = ours.groupBy("seed").agg(
        F.collect_list(F.struct("experiment_id", "class", "intensity_idx", "magnitude", "rate")).alias("levels")
    )
    # Hits depend on the seed only, so rows that no seed hits are dropped before they fan out.
    u = uniform(F.col("seed"), "jump", F.col(STATION), F.col(US))
    top = max(grid.jump_rate, 0.0)
    hits = base.crossJoin(F.broadcast(by_seed)).filter(u < top)
    rows = hits.withColumn("lv", F.explode("levels")).select("*", "lv.*").filter(u < F.col("rate"))
    sign = F.when(hash32(F.col("seed"), "jump-sign", F.col(STATION), F.col(US)) % 2 == 0, 1).otherwise(-1)
    capacity = F.col(BIKES) + F.col(DOCKS)
    moved = F.least(F.greatest(F.col(BIKES) + sign * F.col("magnitude"), F.lit(0)), capacity)
    return _as_changes(rows, bikes=moved, docks=capacity - moved)


def silent_stations(base: DataFrame, grid: FaultGrid) -> DataFrame:
    """A share of each feed's stations per seed, at least one."""
    spark = base.sparkSession
    stations = base.select(*SERIES).distinct()
    wanted = stations.groupBy(FEED).agg(
        F.greatest(F.lit(1), F.bround(F.lit(grid.silent_share) * F.count(F.lit(1)), 0)).cast("bigint").alias("wanted")
    )
    drawn = stations.crossJoin(F.broadcast(_seeds(spark, grid))).withColumn(
        "_h", hash32(F.col("seed"), "silent", F.col(STATION))
    )
    ranked = number_rows(drawn, [FEED, "seed"], F.shiftright("_h", 24), ["_h", STATION], "rank")
    return ranked.join(wanted, FEED).filter(F.col("rank") <= F.col("wanted")).select(*SERIES, "seed")


def inject_silent(base: DataFrame, exps: DataFrame, grid: FaultGrid) -> DataFrame:
    """Some bikes of the affected stations are unusable; the feed does not show it."""
    hit = silent_stations(base, grid).join(_of_class(exps, grid.SILENT), "seed")
    rows = base.join(materialise(hit.select(*SERIES, *EXPERIMENT, "magnitude"), "silent"), list(SERIES))
    return _as_changes(rows, true_available=F.greatest(F.col(BIKES) - F.col("magnitude"), F.lit(0)))


def change_rows(
    base: DataFrame, periods: DataFrame, grid: FaultGrid, classes: Sequence[str] | None = None,
    chosen: DataFrame | None = None,
) -> DataFrame:
    """Every row that any experiment removes or alters.

    Windowed faults act inside one seed-chosen period of a feed; jump and silent
    faults act on all rows.  Pass a written `chosen` table to draw the periods once.
    """
    exps = experiments(base.sparkSession, grid)
    chosen = chosen_periods(base, periods, grid) if chosen is None else chosen
    makers = {
        grid.DROPOUT: lambda: inject_dropout(base, exps, chosen, grid),
        grid.FROZEN: lambda: inject_frozen(base, exps, chosen, grid),
        grid.STALE: lambda: inject_stale(base, exps, chosen, grid),
        grid.CAPACITY: lambda: inject_capacity(base, exps, chosen, grid),
        grid.JUMP: lambda: inject_jump(base, exps, grid),
        grid.SILENT: lambda: inject_silent(base, exps, grid),
    }
    parts = [makers[c]() for c in (classes or makers)]
    return reduce(DataFrame.unionByName, parts)


def apply_changes(base: DataFrame, changes: DataFrame, exps: DataFrame) -> DataFrame:
    """Full corrupted copies of the rows for the listed experiments, with `removed` marked."""
    full = base.crossJoin(F.broadcast(exps.select(*EXPERIMENT)))
    delta = changes.select(
        "experiment_id", *PERIOD_SERIES, US, F.struct(*VALUES).alias("new")
    )
    rows = full.join(delta, ["experiment_id", *PERIOD_SERIES, US], "left")
    hit = F.col("new").isNotNull()
    return (
        rows.withColumn("removed", F.coalesce(F.col("new.removed"), F.lit(False)))
        .withColumn("true_available", F.coalesce(F.col("new.true_available"), F.col(BIKES)))
        .withColumn(BIKES, F.when(hit, F.col(f"new.{BIKES}")).otherwise(F.col(BIKES)))
        .withColumn(DOCKS, F.when(hit, F.col(f"new.{DOCKS}")).otherwise(F.col(DOCKS)))
        .drop("new")
    )


def ids_of(exps: DataFrame, fault_class: str) -> list[str]:
    """The experiments of a class, a handful of names."""
    return sorted(r[0] for r in _of_class(exps, fault_class).select("experiment_id").collect())


def side_by_side(rows: DataFrame, changes: DataFrame, ids: list[str]) -> DataFrame:
    """The rows once, with arrays `c_bikes` and `c_docks`: the readings of each experiment, in the order of `ids`.

    For faults that remove no row: `apply_changes` for all experiments of a class at once, whose full copies every
    later step would shuffle.
    """
    place = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("experiment_id"))
    listed = changes.select(*PERIOD_SERIES, US, F.struct(place.alias("at"), BIKES, DOCKS).alias("e")).filter("e.at > 0")
    delta = listed.groupBy(*PERIOD_SERIES, US).agg(F.collect_list("e").alias("_new"))

    def each(name: str):
        new = lambda i: F.filter("_new", lambda e: e["at"] == i)
        changed = lambda i: F.when(F.size(new(i)) > 0, F.get(new(i), F.lit(0))[name]).otherwise(F.col(name))
        places = F.array(*[F.lit(i + 1) for i in range(len(ids))])
        return F.when(F.col("_new").isNull(), F.array_repeat(F.col(name), len(ids))).otherwise(F.transform(places, changed))

    joined = rows.join(delta, [*PERIOD_SERIES, US], "left")
    return joined.withColumns({"c_bikes": each(BIKES), "c_docks": each(DOCKS)}).drop("_new", BIKES, DOCKS)


def exposure(changes: DataFrame, exps: DataFrame, n_rows: DataFrame) -> DataFrame:
    """Per experiment: rows removed or emptied, rows altered, stations affected.

    `n_rows` is a single row with `test_rows`.
    """
    empty = F.col("removed") | F.col(BIKES).isNull()
    counted = changes.groupBy("experiment_id").agg(
        count_if(empty).alias("_gone"),
        count_if(~empty).alias("_altered"),
        F.count_distinct(*SERIES).alias("_stations"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        exps.select(*EXPERIMENT)
        .join(counted, "experiment_id", "left")
        .crossJoin(n_rows)
        .select(
            *EXPERIMENT,
            "test_rows",
            F.coalesce("_gone", zero).alias("rows_removed_or_empty"),
            F.coalesce("_altered", zero).alias("rows_altered"),
            F.coalesce("_stations", zero).alias("stations_affected"),
        )
    )
