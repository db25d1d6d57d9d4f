"""Blocked operators against plain pandas, with one hot series and blocks far shorter than the series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pollgauge.operators import ranking
from pollgauge.operators.sequence import (
    Blocks, at_home, near_window, neighbourhood, number_rows, shift_rows,
)

BLOCK = 50


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(7)
    parts = []
    for key, n in (("hot", 900), ("a", 60), ("b", 5), ("one", 1)):
        us = np.sort(rng.choice(np.arange(0, 4000), size=n, replace=False))
        parts.append(pd.DataFrame({"k": key, "us": us, "v": rng.integers(0, 9, n), "ok": rng.random(n) < 0.2}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def frame(spark, series):
    return spark.createDataFrame(series)


def ordered(df):
    return df.toPandas().sort_values(["k", "us"]).reset_index(drop=True)


def same(got, want):
    got = got.astype(float).to_numpy()
    np.testing.assert_array_equal(np.nan_to_num(got, nan=-1), np.nan_to_num(want.astype(float).to_numpy(), nan=-1))


def test_previous(frame, series):
    got = ordered(Blocks(frame, ["k"], BLOCK).previous("p", ["v"]).frame().select("k", "us", F.col("p.v").alias("p")))
    same(got["p"], series.sort_values(["k", "us"]).groupby("k")["v"].shift(1).reset_index(drop=True))


def test_running_sum(frame, series):
    got = ordered(Blocks(frame, ["k"], BLOCK).running_sum("s", F.col("v")).frame())
    same(got["s"], series.sort_values(["k", "us"]).groupby("k")["v"].cumsum().reset_index(drop=True))


def test_carry_forward(frame, series):
    got = ordered(Blocks(frame, ["k"], BLOCK).carry_forward("c", F.when(F.col("ok"), F.col("v"))).frame())
    s = series.sort_values(["k", "us"])
    want = s["v"].where(s["ok"]).groupby(s["k"]).ffill().reset_index(drop=True)
    same(got["c"], want)


def test_chained_steps_keep_every_row(frame, series):
    got = Blocks(frame, ["k"], BLOCK).previous("p", ["v"]).running_sum("s", F.lit(1)).frame()
    assert got.count() == len(series)


def test_neighbourhood_serves_bounded_windows(frame, series):
    near = neighbourhood(frame, before_us=30, after_us=20, block_us=BLOCK)
    w = near_window(["k"])
    near = near.withColumn("back", F.when(F.col("us") - F.lag("us", 2).over(w) <= 30, F.lag("v", 2).over(w)))
    near = near.withColumn("ahead", F.when((F.lead("us", 3).over(w)) - F.col("us") <= 20, F.lead("v", 3).over(w)))
    got = ordered(at_home(near))
    s = series.sort_values(["k", "us"]).reset_index(drop=True)
    g = s.groupby("k")
    same(got["back"], g["v"].shift(2).where(s["us"] - g["us"].shift(2) <= 30))
    same(got["ahead"], g["v"].shift(-3).where(g["us"].shift(-3) - s["us"] <= 20))


def test_shift_rows_has_no_time_limit(frame, series):
    got = ordered(shift_rows(frame, ["k"], 4, "v", "x", BLOCK))
    same(got["x"], series.sort_values(["k", "us"]).groupby("k")["v"].shift(-4).reset_index(drop=True))


@pytest.mark.parametrize("steps, block", [(1, BLOCK), (9, 3), (9, 10_000), (70, BLOCK)])
def test_a_lead_reaches_over_short_blocks(frame, series, steps, block):
    got = ordered(shift_rows(frame, ["k"], steps, "v", "x", block))
    same(got["x"], series.sort_values(["k", "us"]).groupby("k")["v"].shift(-steps).reset_index(drop=True))


def test_a_lead_keeps_null_values_and_null_keys(spark):
    rows = [(None, 1, 5), (None, 200, None), (None, 300, 7), ("a", 1, None), ("a", 2, 3), ("a", 3, None), ("a", 4, 9)]
    df = spark.createDataFrame(rows, "k string, us bigint, v int")
    got = shift_rows(df, ["k"], 2, "v", "x", BLOCK).orderBy("k", "us").collect()
    assert [(r.k, r.us, r.v, r.x) for r in got] == [
        (None, 1, 5, 7), (None, 200, None, None), (None, 300, 7, None),
        ("a", 1, None, None), ("a", 2, 3, 9), ("a", 3, None, None), ("a", 4, 9, None),
    ]
    assert shift_rows(df.limit(0), ["k"], 2, "v", "x", BLOCK).count() == 0


def test_number_rows(frame, series):
    got = ordered(number_rows(frame, ["k"], F.expr("us div 100"), ["us"], "n"))
    same(got["n"], series.sort_values(["k", "us"]).groupby("k").cumcount().add(1).reset_index(drop=True))


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.6, 0.975, 1.0])
def test_quantiles_are_exact(spark, q):
    rng = np.random.default_rng(3)
    # A third of the rows share one value, and outliers stretch the range.
    values = np.concatenate([np.full(400, 5.0), rng.normal(0, 1, 700), rng.normal(0, 1e6, 20)])
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = ranking.quantiles(df, [], "v", {"x": q}).first()["x"]
    assert got == pytest.approx(float(np.quantile(values, q)), rel=1e-12, abs=1e-12)


def test_mid_ranks(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice(["x", "y"], 500), "v": rng.integers(0, 80, 500)})
    got = ranking.rank_table(spark.createDataFrame(pdf), ["k"], "v").withColumn("r", ranking.mid_rank()).toPandas()
    want = pdf.assign(r=pdf.groupby("k")["v"].rank()).groupby(["k", "v"])["r"].first()
    for row in got.itertuples():
        assert row.r == want[(row.k, row.v)]
