"""The driver contract, and counts of one chain that an independent run gave."""

import re

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as contract
from check import compare
from pollgauge.config import BIKES, PERIOD_SERIES, QUARTER_HOURLY
from pollgauge.operators.detect import frozen_rows, jump_rows
from pollgauge.operators.periods import assign_period, continuity_segments, retained_periods
from pollgauge.session import materialise
from pollgauge.sources import adapters

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SF = "/root/testdata/sf0.01"
SAMPLE = ("detect_jump", "gap_checked_lag", "assign_period", "dispatch_episodes", "inject_jump", "roc_auc", "cost_sweep")


def test_entry_returns_rows(spark):
    assert contract.entry(spark).limit(5).count() == 5


def test_twins_belong_to_queries():
    queries, twins = contract.queries(), contract.oracle_sql()
    assert len(queries) >= 120
    assert set(twins) <= set(queries)
    # Every query of the library itself has a twin.
    own = {name for name in queries if not re.match(r"op\d+_|pipeline$", name)}
    assert own <= set(twins)


def test_sample_of_queries_agrees_with_duckdb(spark):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    queries, twins = contract.queries(), contract.oracle_sql()
    for name in SAMPLE:
        ok, text, _ = compare(spark, con, name, queries[name], twins[name], SF)
        assert ok, f"{name}: {text}"


def test_chain_counts(spark):
    station = (F.col("user_id") % 4).cast("string")
    rows = materialise(adapters.status(spark, SF, station, F.lit("all")), "status")
    cfg = QUARTER_HOURLY
    segs = continuity_segments(rows, cfg)
    periods = retained_periods(segs)
    inside = materialise(jump_rows(assign_period(rows, periods, cfg), cfg, PERIOD_SERIES), "inside")
    clean = inside.filter(~F.col("jump_flag"))
    frozen = frozen_rows(clean, 3600, cfg, PERIOD_SERIES).filter("frozen").count()
    counts = (rows.count(), segs.count(), periods.count(), inside.count(), inside.filter("jump_flag").count(), frozen)
    assert counts == (6660, 95, 79, 6541, 555, 922)
    assert rows.filter(F.col(BIKES) > 20).count() == 0
