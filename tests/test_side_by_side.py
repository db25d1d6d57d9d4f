import random

import pytest
from pyspark.sql import functions as F

from pollgauge.config import BIKES, DOCKS, PERIOD_SERIES, US, FaultGrid, FeedConfig
from pollgauge.operators import inject
from pollgauge.operators.repair import safeguard_repair

CFG = FeedConfig(block_s=600)


@pytest.mark.parametrize("fault_class", [FaultGrid.FROZEN, FaultGrid.CAPACITY, FaultGrid.JUMP])
def test_side_by_side_repair_is_that_of_full_copies(spark, status_frame, fault_class):
    random.seed(3)
    rows = [("f", f"s{s}", m, random.choice((3, 4, 9)), 11) for s in range(3) for m in range(40) if random.random() < 0.9]
    base = status_frame(rows, period=0).cache()
    exps = inject.experiments(spark, FaultGrid()).filter((F.col("class") == fault_class) & (F.col("seed") < 2))
    ids = inject.ids_of(exps, fault_class)
    assert len(ids) == 8
    changed = []
    for r in base.collect():
        for i in ids:
            if random.random() < 0.3:
                changed.append((i, r["feed_id"], 0, r["station_id"], r[US], False, random.choice((0, 3, 20, None)), 5, None))
    schema = f"experiment_id string, feed_id string, period_id int, station_id string, us long, removed boolean, {BIKES} int, {DOCKS} int, true_available int"
    changes = spark.createDataFrame(changed, schema)
    keys = ("experiment_id", *PERIOD_SERIES)
    want = safeguard_repair(inject.apply_changes(base, changes, exps), fault_class, CFG, keys).select(*keys, US, BIKES, DOCKS)
    side = inject.side_by_side(base, changes, ids)
    assert side.count() == len(rows)  # no copy for each experiment
    good = safeguard_repair(side, fault_class, CFG, copies=len(ids)).select(*PERIOD_SERIES, US, F.posexplode("good").alias("at", "g")).filter("g IS NOT NULL")
    got = good.select(*PERIOD_SERIES, US, "at", "g.*").collect()
    assert sorted(((ids[r["at"]], r["feed_id"], r["period_id"], r["station_id"], r[US], r["bikes"], r["docks"]) for r in got), key=repr) == sorted(
        (tuple(r) for r in want.collect()), key=repr
    )
