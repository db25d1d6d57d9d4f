"""Exact ranks and quantiles without sorting a whole group in one task.

Equal values are counted first and the counts written, approximate quantiles (a bounded sketch) split
the value range into even buckets, and counts carry from bucket to bucket.  The
sketch only decides where to cut; ranks and quantiles are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pollgauge.session import materialise

MIN_BUCKETS = 64
SKETCH = 20  # accuracy of the sketch, as a multiple of the buckets


def bucket_count(spark) -> int:
    """As many buckets as the session shuffles into, so that they grow with the cluster and the data."""
    return max(MIN_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def rank_table(df: DataFrame, keys: Sequence[str], value: str, **extra: Column) -> DataFrame:
    """One row per distinct value: `n` copies, `below` smaller values, `total` in the group.

    `extra` adds further aggregates per value.
    """
    keys = list(keys)
    seen = df.filter(F.col(value).isNotNull())
    hist = seen.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in extra.items()]
    )
    hist = materialise(hist, "histogram")
    buckets = bucket_count(df.sparkSession)
    points = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = hist.groupBy(*keys).agg(F.percentile_approx(value, points, F.lit(SKETCH * buckets)).alias("_cuts"))
    joined = hist.join(cuts, keys) if keys else hist.crossJoin(cuts)
    bucket = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    joined = joined.withColumn("_bkt", bucket).drop("_cuts")

    by_bucket = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = (
        joined.groupBy(*keys, "_bkt")
        .agg(F.sum("n").alias("_size"))
        .withColumn("_off", F.coalesce(F.sum("_size").over(by_bucket), F.lit(0)))
        .withColumn("total", F.sum("_size").over(whole))
        .drop("_size")
    )
    inside = Window.partitionBy(*keys, "_bkt").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        joined.join(offsets, [*keys, "_bkt"])
        .withColumn("below", (F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("_off")).cast("bigint"))
        .drop("_bkt", "_off")
    )


def mid_rank() -> Column:
    """Average rank (from 1) of a `rank_table` row."""
    return F.col("below") + (F.col("n") + 1) / F.lit(2.0)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per name in `points`."""
    ranked = rank_table(df, keys, value)
    v = F.col(value).cast("double")

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("below") <= index) & (index < F.col("below") + F.col("n")), v))

    aggs = []
    for name, q in points.items():
        place = F.lit(q) * (F.col("total") - 1)
        low = F.floor(place)
        aggs += [at(low).alias(f"_{name}_lo"), at(F.ceil(place)).alias(f"_{name}_hi")]
    out = ranked.groupBy(*keys).agg(F.max("total").alias("_t"), *aggs)
    for name, q in points.items():
        place = F.lit(q) * (F.col("_t") - 1)
        part = place - F.floor(place)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out = out.withColumn(name, lo + (hi - lo) * part)
    return out.select(*keys, *points)
