"""Plans of rules over whole series: how often they read and shuffle."""

import re

import pytest

from pollgauge.operators.sequence import Blocks
from pollgauge.plans import load_queries

SF = "/root/testdata/sf0.01"


def plan(df, final):
    if final:
        df.write.format("noop").mode("overwrite").save()
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def used(text):
    """Nodes of the plan that ran: a finished adaptive plan prints the first plan below it."""
    return text.split("+- == Initial Plan ==")[0]


def test_a_step_reads_its_input_once(spark):
    df = load_queries()["detect_jump"].run(spark, SF)
    text = used(plan(df, final=True))
    assert len(re.findall(r"Scan parquet", text)) == 1
    assert "ReusedExchange" in text


@pytest.mark.parametrize("name", ["continuity_segments", "carry_forward", "period_census", "boundary_probe", "critical_episodes"])
def test_chains_do_not_multiply(spark, name):
    df = load_queries()[name].run(spark, SF)
    first = plan(df, final=False)
    scans, exchanges = len(re.findall(r"Scan parquet", first)), len(re.findall(r"Exchange hashpartitioning|Exchange SinglePartition|Exchange rangepartitioning", first))
    assert exchanges <= 10 and scans <= 4


def test_a_lead_needs_no_row_number_join(spark):
    text = used(plan(load_queries()["silent_label"].run(spark, SF), final=True))
    assert len(re.findall(r"Scan parquet", text)) <= 2
    assert len(re.findall(r"(?<!Reused)Exchange (?:hash|range|Single)", text)) <= 4


def test_null_keys_stay(spark):
    rows = [(None, 1, 5), (None, 2, 6), (None, 200, 7), ("a", 1, 1), ("a", 150, 2)]
    df = spark.createDataFrame(rows, "k string, us bigint, v int")
    got = Blocks(df, ["k"], 50).previous("prev", ["v"]).frame().orderBy("k", "us").collect()
    assert [(r.k, r.us, r.prev and r.prev.v) for r in got] == [(None, 1, None), (None, 2, 5), (None, 200, 6), ("a", 1, None), ("a", 150, 1)]
