"""The facts of the published self-checks, on the same tiny inputs."""

import pytest
from pyspark.sql import functions as F

from pollgauge.config import PERIOD_SERIES, CostModel, FaultGrid, FeedConfig
from pollgauge.operators import cost, detect, inject, model
from pollgauge.operators.features import build_features
from pollgauge.operators.periods import (
    assign_period, continuity_segments, critical_rows, dwell_rows, episode_starts, retained_periods,
)

CFG = FeedConfig()
SMALL = FeedConfig(block_s=600)


def test_lags_and_label_stop_at_a_gap(spark, status_frame):
    minutes = [i if i <= 50 else i + 300 for i in range(200)]
    df = status_frame([("f", "s", m, i % 20, 20 - i % 20) for i, m in enumerate(minutes)])
    for cfg in (CFG, FeedConfig(block_s=3600)):
        rows = [r for r in build_features(df, cfg, keys=("feed_id", "station_id")).orderBy("us").collect()]
        assert [i for i, r in enumerate(rows) if r["bikes_lag1"] is None] == [0, 51]
        assert rows[45]["label"] is None
        assert rows[60]["label"] is not None


def test_weather_is_joined_by_hour(spark, status_frame):
    minutes = [i if i <= 50 else i + 300 for i in range(200)]
    df = status_frame([("f", "s", m, 5, 15) for m in minutes])
    hour = 3_600_000_000
    first = status_frame.start
    weather = spark.createDataFrame(
        [(first, 20.0, 0.0), (first + 5 * hour, 21.0, 1.0)], "hour_us bigint, temp_c double, precip_mm double"
    )
    rows = build_features(df, CFG, weather, keys=("feed_id", "station_id")).orderBy("us").collect()
    assert len(rows) == 200
    assert (rows[0]["temp_c"], rows[51]["temp_c"]) == (20.0, 21.0)
    plain = build_features(df, CFG, keys=("feed_id", "station_id")).orderBy("us").collect()
    assert [r["label"] for r in rows] == [r["label"] for r in plain]


def test_dropout_detector(spark, status_frame):
    df = status_frame([("f", "s1", 0, 5, 5), ("f", "s2", 0, 5, 5)])
    registry = spark.createDataFrame([("f", s) for s in ("s1", "s2", "s3")], "feed_id string, station_id string")
    got = {r["station_id"]: r["dropped"] for r in detect.detect_dropout(df, registry).collect()}
    assert got == {"s1": False, "s2": False, "s3": True}


def test_frozen_detector(status_frame):
    rows = [("f", "stuck", i, 5, 10) for i in range(100)] + [("f", "normal", i, i % 10, 20 - i % 10) for i in range(100)]
    for cfg in (CFG, SMALL):
        out = detect.frozen_rows(status_frame(rows), 3600, cfg)
        at = {r["station_id"]: r["frozen"] for r in out.filter(F.col("us") == status_frame.start + 90 * 60_000_000).collect()}
        assert at == {"stuck": True, "normal": False}


def test_frozen_flags_a_lone_row_unless_asked(status_frame):
    df = status_frame([("f", "s", 0, 5, 5)])
    assert detect.frozen_rows(df, 3600, CFG).first()["frozen"]
    assert not detect.frozen_rows(df, 3600, CFG, min_rows=2).first()["frozen"]


def test_stale_detector(spark):
    s = 1_000_000
    polls = spark.createDataFrame(
        [("f", 0, 0 - 30 * s, "a"), ("f", 60 * s, 60 * s - 300 * s, "b"), ("f", 120 * s, 100 * s, "c"), ("f", 180 * s, 170 * s, "c")],
        "feed_id string, request_us bigint, last_updated_us bigint, payload_sha256 string",
    )
    got = [r["stale"] for r in detect.detect_stale(polls, CFG).orderBy("request_us").collect()]
    assert got == [False, True, False, True]


def test_type_sum_ignores_nulls(spark):
    df = spark.createDataFrame([(5, 3, 2, 0), (5, 3, 1, 0), (5, 3, 2, None)],
                               "num_bikes_available int, bike int, ebike int, ebike_with_childseat int")
    got = detect.detect_type_mismatch(df, ["bike", "ebike", "ebike_with_childseat"]).collect()
    assert [r["inconsistent"] for r in got] == [False, True, False]


def test_spike_is_flagged_up_and_down(status_frame):
    df = status_frame([("f", "s", i, b, 20) for i, b in enumerate([10, 10, 18, 10, 10, 10])])
    got = [r["jump_flag"] for r in detect.jump_rows(df, CFG).orderBy("us").collect()]
    assert got == [False, False, True, True, False, False]


def test_episodes_break_at_a_gap(spark, status_frame):
    df = status_frame([("f", "s", m, 0, 0) for m in (0, 1, 2, 3)]).withColumn(
        "decision", F.col("us") != status_frame.start + 2 * 60_000_000
    )
    keys = ("feed_id", "station_id")
    assert episode_starts(df, "decision", keys, CFG, gap=True).filter("episode_start").count() == 2
    far = status_frame([("f", "s", m, 0, 0) for m in (0, 1, 5760, 5761)]).withColumn("decision", F.lit(True))
    assert episode_starts(far, "decision", keys, CFG, gap=True).filter("episode_start").count() == 2
    assert episode_starts(far, "decision", keys, CFG, gap=False).filter("episode_start").count() == 1


def test_cost_and_sweep(spark, status_frame):
    df = status_frame([("f", "s", m, 0, 0) for m in range(4)])
    df = df.withColumn("decision", F.col("us") < status_frame.start + 2 * 60_000_000).withColumn("label", F.lit(True))
    one = cost.policy_cost(df, CFG, CostModel()).first()
    assert (one["missed"], one["n_dispatches"]) == (2, 1)
    assert one["c_penalty"] == pytest.approx(2 / 60 * 1.94 * 0.5 * 0.5)
    assert one["c_transit"] == 15.0
    assert cost.policy_cost(df, CFG, CostModel(), keys=None).first()["n_dispatches"] == 2
    sweep = cost.cost_sweep(cost.cost_counts(df, CFG), CFG, CostModel()).toPandas()
    assert len(sweep) == 81 and sweep["total"].min() < sweep["total"].max()
    assert (sweep.loc[sweep["revenue_per_ride"] == "low", "c_penalty"] == 0).all()


def test_flip_rate(spark):
    df = spark.createDataFrame([(True, True), (True, True), (False, False), (True, False)], "a boolean, b boolean")
    assert df.agg(cost.flip_rate("a", "b").alias("r")).first()["r"] == 0.25


def test_segments_and_boundaries(status_frame):
    rows = [("f", f"s{s}", d * 1440 + i, i % 6, 20 - i % 6) for s in range(2) for d in range(2) for i in range(300)]
    rows += [("f", "s0", 3 * 1440 + i, 5, 15) for i in range(10)]
    df = status_frame(rows)
    for cfg in (CFG, FeedConfig(block_s=1800)):
        segs = continuity_segments(df, cfg)
        assert [r["retained"] for r in segs.orderBy("start_us").collect()] == [True, True, False]
        inside = assign_period(df, retained_periods(segs), cfg)
        assert inside.count() == 1200
        feats = build_features(inside, cfg).toPandas().sort_values("us")
        for _, g in feats.groupby(["period_id", "station_id"]):
            assert g["bikes_lag15"].isna().to_numpy()[:15].all() and g["bikes_lag15"].notna().to_numpy()[15:].all()
            assert g["label"].isna().to_numpy()[-120:].all() and g["label"].notna().to_numpy()[:-120].all()
        assert dwell_rows(inside, cfg).agg(F.sum("dwell_s")).first()[0] == 1200 * 60.0
        crit = episode_starts(critical_rows(inside, cfg), "critical", PERIOD_SERIES, cfg, gap=False)
        # Each run of 0, 1, 2 bikes is one episode: 50 per station and day.
        assert crit.filter("episode_start").count() == 4 * 50


def test_classifier_separates(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] + rng.normal(scale=0.1, size=500)) > 0
    df = spark.createDataFrame([(*map(float, r), bool(v)) for r, v in zip(x, y)], "a double, b double, c double, label boolean")
    fitted = model.train_classifier(df, ["a", "b", "c"]).with_tau(0.5)
    right = model.score(df, fitted).filter(F.col("decision") == F.col("label")).count()
    assert right / 500 > 0.9


# ---- faults ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def grid():
    return FaultGrid(dropout=((1, 600),), frozen_s=(600,), stale_s=(120,), capacity=(5,), jump=(100,), jump_rate=1.0,
                     silent=(2,), silent_share=0.34, seeds=(7,))


@pytest.fixture(scope="module")
def faulty(spark, status_frame, feed_rows, grid):
    base = status_frame(feed_rows, period=0).cache()
    first, last = status_frame.start, status_frame.start + 59 * 60_000_000
    periods = spark.createDataFrame([("f", 0, first, last)], "feed_id string, period_id int, start_us bigint, end_us bigint")
    full = inject.apply_changes(base, inject.change_rows(base, periods, grid), inject.experiments(spark, grid))
    clean = base.select("station_id", "us", F.col("num_bikes_available").alias("b0"), F.col("num_docks_available").alias("d0"))
    return full.join(clean, ["station_id", "us"]).toPandas()


def of(faulty, name):
    return faulty[faulty["class"] == name].sort_values(["station_id", "us"])


def test_dropout_hits_one_station(faulty, grid):
    gone = of(faulty, grid.DROPOUT).query("removed")
    assert gone["station_id"].nunique() == 1 and 10 <= len(gone) <= 11


def test_frozen_window_holds_one_value(faulty, grid):
    rows = of(faulty, grid.FROZEN)
    hit = rows[rows["num_bikes_available"] != rows["b0"]]
    assert hit["station_id"].nunique() == 1
    assert hit["num_bikes_available"].nunique() == 1 and hit["num_docks_available"].nunique() == 1


def test_stale_repeats_one_poll(faulty, grid):
    rows = of(faulty, grid.STALE)
    hit = rows[rows["num_bikes_available"] != rows["b0"]]
    assert len(hit) == 6 and hit["us"].nunique() == 2
    assert (hit.groupby("station_id")["num_bikes_available"].nunique() == 1).all()


def test_capacity_breaks_one_station_to_the_end(faulty, grid):
    rows = of(faulty, grid.CAPACITY)
    hit = rows[rows["num_bikes_available"] + rows["num_docks_available"] != 20]
    assert hit["station_id"].nunique() == 1
    assert hit["us"].max() == rows["us"].max() and len(hit) > 30
    assert (hit["num_bikes_available"] == hit["b0"] + 5).all()


def test_jump_keeps_capacity(faulty, grid):
    rows = of(faulty, grid.JUMP)
    assert (rows["num_bikes_available"] + rows["num_docks_available"] == rows["b0"] + rows["d0"]).all()
    assert rows["num_bikes_available"].between(0, 20).all()
    assert (rows["num_bikes_available"] != rows["b0"]).any()


def test_silent_leaves_the_feed_alone(faulty, grid):
    rows = of(faulty, grid.SILENT)
    assert (rows["num_bikes_available"] == rows["b0"]).all()
    assert (rows["true_available"] <= rows["b0"]).all()
    assert rows.loc[rows["true_available"] < rows["b0"], "station_id"].nunique() == 1


def test_same_seed_same_changes_in_any_partitioning(spark, status_frame, feed_rows):
    base = status_frame(feed_rows, period=0)
    first, last = status_frame.start, status_frame.start + 59 * 60_000_000
    periods = spark.createDataFrame([("f", 0, first, last)], "feed_id string, period_id int, start_us bigint, end_us bigint")
    g = FaultGrid()
    one = inject.change_rows(base, periods, g).toPandas()
    two = inject.change_rows(base.repartition(7, "us"), periods, g).toPandas()
    cols = list(one.columns)
    key = ["experiment_id", "station_id", "us"]
    assert len(one) > 0
    assert one.sort_values(key).reset_index(drop=True).equals(two[cols].sort_values(key).reset_index(drop=True))
