"""The store of injected data: rows, manifest, partitions and row groups that a reader touches."""

import re

import pytest
from pyspark.sql import functions as F

from pollgauge.config import FaultGrid
from pollgauge.operators import inject
from pollgauge.session import materialise, work_path
from pollgauge.sources import delta_store as store

GRID = FaultGrid()


@pytest.fixture(scope="module")
def written(spark, status_frame):
    """Two feeds that share a station name, three periods of sixty polls, and three experiments; one changes nothing."""
    rows = [(f, s, i, 5 + i % 7, 10) for f in ("f", "g") for s in ("s", "t") for i in range(180)]
    base = status_frame(rows).withColumn("period_id", F.floor((F.col("us") - F.lit(status_frame.start)) / 3_600_000_000).cast("int"))
    base = materialise(base, "base")
    exps = inject.experiments(spark, GRID).filter("seed = 0 AND intensity_idx IN (0, 1) AND class IN ('class1_dropout', 'class5_jump')")
    gone = (F.col("feed_id") == "f") & (F.col("station_id") == "s") & (F.col("period_id") == 1)
    changed = base.filter(gone).select("*", F.lit("class1_dropout").alias("class"), F.lit(0).alias("intensity_idx"), F.lit(0).alias("seed"), F.lit(True).alias("removed"), F.col("num_bikes_available").alias("true_available"))
    up = base.filter("us % 7 = 0").withColumn("num_bikes_available", F.col("num_bikes_available") + 1)
    changed = changed.unionByName(up.select("*", F.lit("class5_jump").alias("class"), F.lit(1).alias("intensity_idx"), F.lit(0).alias("seed"), F.lit(False).alias("removed"), F.col("num_bikes_available").alias("true_available")))
    path = work_path(spark, "store")
    store.write_store(base, changed, exps, path, rows_in_group=50)
    return base, path


def values(df):
    return sorted((r.feed_id, r.station_id, r.us, r.num_bikes_available, r.num_docks_available) for r in df.collect())


def test_experiments_read_back(spark, written):
    base, path = written
    clean = values(base)
    gone = values(store.read_experiment(spark, path, "class1_dropout", 0, 0))
    assert set(gone) < set(clean) and len(clean) - len(gone) == 60 and not any(r[:2] == ("f", "s") and (r[2] - min(c[2] for c in clean)) // 3_600_000_000 == 1 for r in gone)
    up = values(store.read_experiment(spark, path, "class5_jump", 1, 0))
    assert up == [(f, s, us, b + (us % 7 == 0), d) for f, s, us, b, d in clean]
    assert values(store.read_experiment(spark, path, "class1_dropout", 1, 0)) == clean  # changes nothing
    with pytest.raises(ValueError):
        store.read_experiment(spark, path, "class1_dropout", 0, 99)


def test_manifest(spark, written):
    lines = {(r["class"], r.intensity_idx): r for r in store.manifest(spark, written[1]).collect()}
    assert {k: (r.clean_rows, r.removed_rows, r.altered_rows, r.corrupted_rows) for k, r in lines.items()} == {
        ("class1_dropout", 0): (720, 60, 0, 660), ("class1_dropout", 1): (720, 0, 0, 720),
        ("class5_jump", 0): (720, 0, 0, 720), ("class5_jump", 1): (720, 0, lines["class5_jump", 1].altered_rows, 720),
    }
    assert lines["class5_jump", 1].altered_rows == written[0].filter("us % 7 = 0").count()
    assert {r.status for r in lines.values()} == {"complete"} and {r.data_status for r in lines.values()} == {inject.SYNTHETIC}
    assert lines["class1_dropout", 0].window_s == 300 and lines["class5_jump", 0].magnitude == 2


def test_a_reader_goes_to_its_partition_and_pushes_periods(spark, written):
    df = store.read_experiment(spark, written[1], "class5_jump", 1, 0, F.col("period_id") >= 2)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    parts = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert any("class5_jump" in p and "intensity_idx" in p and "seed" in p for p in parts)
    assert len(re.findall(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(period_id,2\)", plan)) == 2
    assert {r.period_id for r in df.collect()} == {2}
    read = store.changed_rows(spark, written[1], "class5_jump", 1, 0).select(F.input_file_name().alias("f")).distinct().collect()
    assert read and all("class=class5_jump/intensity_idx=1/seed=0" in r.f for r in read)


def test_a_period_filter_skips_row_groups(spark, written):
    """Files are sorted by period, so the groups that hold a period are few; their bytes are what a reader needs."""
    import pyarrow.parquet as pq

    wanted = total = 0
    for f in spark.read.parquet(f"{written[1]}/clean").inputFiles():
        meta = pq.ParquetFile(f.removeprefix("file://")).metadata
        at = meta.schema.to_arrow_schema().get_field_index("period_id")
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            stats = group.column(at).statistics
            total += group.total_byte_size
            wanted += group.total_byte_size if stats.min <= 2 <= stats.max else 0
    assert 0 < wanted < 0.7 * total


def test_a_store_without_a_manifest_is_not_read(spark, written):
    path = work_path(spark, "store")
    written[0].write.parquet(f"{path}/clean")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.read_experiment(spark, path, "class5_jump", 1, 0)
