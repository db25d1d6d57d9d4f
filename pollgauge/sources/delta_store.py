"""Injected data as one clean table, the rows that each experiment changes, and a manifest.

A store is a folder of three tables. `clean` holds the clean rows once, dealt by feed and day and sorted by period, so
that a period filter skips files and row groups. `changes` holds what experiments alter, with a tombstone (`removed`)
for a row that is gone, in one partition for each experiment. `manifest` has a line for each experiment: its place in
the grid and its parameters, the label of synthetic data, the counts of clean, removed, altered and remaining rows, and
a status. It is written last, so a store without one is not finished. A reader goes to the partition of its experiment
before it meets the clean rows, and nothing is ever multiplied by the number of experiments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pollgauge.config import BIKES, DOCKS, FEED, PERIOD, PERIOD_SERIES, SECOND_US, STATION, US
from pollgauge.functions.columns import block_of, count_if
from pollgauge.operators.inject import SYNTHETIC, VALUES

PLACE = ("class", "intensity_idx", "seed")
KEYS = (*PERIOD_SERIES, US)
COMPLETE = "complete"
ROWS_IN_GROUP = 100_000  # about, for bytes of a row group; smaller groups skip more and cost more metadata
BYTES_OF_ROW = 40


def _clustered(rows: DataFrame, *first: str) -> DataFrame:
    """Rows dealt by feed and day, each file sorted by period."""
    return rows.repartition(*first, FEED, block_of(US, 86_400 * SECOND_US)).sortWithinPartitions(*first, PERIOD, STATION, US)


def write_store(base: DataFrame, changes: DataFrame, experiments: DataFrame, path: str, rows_in_group: int = ROWS_IN_GROUP) -> None:
    """Write clean rows, changed rows and then the manifest below `path`, which must not exist.

    `experiments` is the table of the grid; one that changes nothing has a line in the manifest and no partition.
    """
    options = {"parquet.block.size": str(rows_in_group * BYTES_OF_ROW), "parquet.block.size.row.check.min": str(rows_in_group), "parquet.page.row.count.limit": "5000"}
    _clustered(base.select(*KEYS, BIKES, DOCKS)).write.options(**options).parquet(f"{path}/clean")
    labelled = changes.select(*PLACE, *KEYS, *VALUES, F.lit(SYNTHETIC).alias("data_status"))
    _clustered(labelled, *PLACE).write.options(**options).partitionBy(*PLACE).parquet(f"{path}/changes")
    # Counted from what was written, so the manifest describes the files.
    spark = base.sparkSession
    clean_rows = spark.read.parquet(f"{path}/clean").count()
    counted = spark.read.parquet(f"{path}/changes").groupBy(*PLACE).agg(count_if(F.col("removed")).alias("removed"), count_if(~F.col("removed")).alias("altered"))
    zero = F.lit(0).cast("bigint")
    lines = experiments.join(counted, list(PLACE), "left").select(
        "experiment_id", *PLACE, "stations", "window_s", "magnitude", "rate", F.lit(SYNTHETIC).alias("data_status"),
        F.lit(clean_rows).cast("bigint").alias("clean_rows"), F.coalesce("removed", zero).alias("removed_rows"), F.coalesce("altered", zero).alias("altered_rows"),
        (F.lit(clean_rows) - F.coalesce("removed", zero)).alias("corrupted_rows"), F.lit(COMPLETE).alias("status"),
    )
    lines.coalesce(1).write.parquet(f"{path}/manifest")  # one line for each experiment


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a finished store; Spark reports a missing path for another."""
    return spark.read.parquet(f"{path}/manifest")


def clean_rows(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/clean")
    return rows if where is None else rows.filter(where)


def changed_rows(spark: SparkSession, path: str, fault_class: str | None = None, intensity_idx: int | None = None, seed: int | None = None) -> DataFrame:
    """Changed rows and tombstones; what is given selects partitions, the others are not listed or read."""
    rows = spark.read.parquet(f"{path}/changes")
    for name, value in zip(PLACE, (fault_class, intensity_idx, seed)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows


def patched(clean: DataFrame, changes: DataFrame) -> DataFrame:
    """Clean rows with the changes of one experiment: altered values instead of clean ones, removed rows gone.

    `true_available` is what was there: the feed's number but for silent faults.
    """
    new = changes.select(*KEYS, F.struct(*VALUES).alias("new"))
    rows = clean.join(new, list(KEYS), "left")
    hit = F.col("new").isNotNull()
    value = lambda c: F.when(hit, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
    return rows.filter(~F.coalesce("new.removed", F.lit(False))).select(
        *KEYS, value(BIKES), value(DOCKS), F.coalesce("new.true_available", BIKES).alias("true_available"), F.lit(SYNTHETIC).alias("data_status"),
    )


def read_experiment(spark: SparkSession, path: str, fault_class: str, intensity_idx: int, seed: int, where: Column | None = None) -> DataFrame:
    """The corrupted rows of one experiment, those that meet `where` (on the keys) only.

    The condition reaches both scans. An experiment that the manifest does not list as complete is an error.
    """
    listed = manifest(spark, path).filter((F.col("class") == fault_class) & (F.col("intensity_idx") == intensity_idx) & (F.col("seed") == seed))
    line = listed.select("status").first()
    if line is None or line.status != COMPLETE:
        raise ValueError(f"no finished experiment {fault_class}, {intensity_idx}, {seed} in {path}")
    changes = changed_rows(spark, path, fault_class, intensity_idx, seed)
    return patched(clean_rows(spark, path, where), changes if where is None else changes.filter(where))
