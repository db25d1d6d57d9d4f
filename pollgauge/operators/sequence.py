"""Ordered operators over series that may be too long for one task.

A plain window over one series puts the whole series into one task.  Here a
series is cut into time blocks, and a block is the window group:

* `neighbourhood` copies the rows near a block edge into the next or previous
  block.  It serves every rule with a bounded reach (lags with a time check,
  labels, rolling windows) with one shuffle and no join.
* `Blocks` serves rules with an unbounded reach (previous row, carry forward,
  running sums).  Each block is reduced to one edge row, the edge rows carry
  values from block to block, and join back on the block key.  Edge rows and rows
  are read from one shuffle of the input.  A further step starts from a written
  table, so a chain of steps grows by one join each and is not planned twice.

A group is then one series within one block, however long the series is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pollgauge.config import US
from pollgauge.functions.columns import block_of
from pollgauge.session import materialise, settled

BLOCK = "_blk"
HOME = "_home"


def neighbourhood(
    df: DataFrame, before_us: int, after_us: int, block_us: int, order: str = US
) -> DataFrame:
    """Give each block the rows up to `before_us` ahead of it and `after_us` behind it.

    `_home` is true on a row's own block.  Window results are complete on home
    rows for any rule that looks back at most `before_us` and ahead at most `after_us`.
    """
    own = block_of(order, block_us)
    first = block_of(F.col(order) - F.lit(after_us), block_us)
    last = block_of(F.col(order) + F.lit(before_us), block_us)
    return df.withColumn(BLOCK, F.explode(F.sequence(first, last))).withColumn(HOME, F.col(BLOCK) == own)


def near_window(keys: Sequence[str], order: str = US):
    return Window.partitionBy(*keys, BLOCK).orderBy(order)


def at_home(df: DataFrame) -> DataFrame:
    return df.filter(HOME).drop(BLOCK, HOME)


class Blocks:
    """A frame cut into (series, block) groups, with carries across the block edges."""

    def __init__(self, df: DataFrame, keys: Sequence[str], block_us: int, order: str = US, settle: bool = True):
        df = settled(df, "series") if settle else df
        self.keys = list(keys)
        self.order = order
        self.group = [*self.keys, BLOCK]
        cut = df.withColumn(BLOCK, block_of(order, block_us))
        # One shuffle; the edge rows and the rows themselves are both read from it.
        self.df = cut.repartition(*self.group)
        self._joined = False

    def _settle(self) -> None:
        """Write the result of an earlier step, which this step would otherwise read twice."""
        if self._joined:
            self.df = materialise(self.df, "blocks").repartition(*self.group)

    def _window(self):
        return Window.partitionBy(*self.group).orderBy(self.order)

    def _edge_window(self):
        return Window.partitionBy(*self.keys).orderBy(BLOCK)

    def _join(self, edges: DataFrame) -> DataFrame:
        """Rows with the carry of their block.  Null-safe: rows with a null key part stay, and the plans of both
        sides start from the same shuffle, as no null filter is inferred for either."""
        named = edges.withColumnsRenamed({c: f"_e{i}" for i, c in enumerate(self.group)})
        same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_e{i}")) for i, c in enumerate(self.group)))
        self._joined = True
        return self.df.join(named, same).drop(*[f"_e{i}" for i in range(len(self.group))])

    def previous(self, name: str, fields: Sequence[str]) -> Blocks:
        """Add struct `name`: the listed fields of the previous row of the series, or null."""
        return self._neighbour(name, fields, F.max_by, F.lag)

    def following(self, name: str, fields: Sequence[str]) -> Blocks:
        """Add struct `name`: the listed fields of the next row of the series, or null."""
        return self._neighbour(name, fields, F.min_by, F.lead)

    def _neighbour(self, name: str, fields: Sequence[str], edge_row, step) -> Blocks:
        self._settle()
        edges = (
            self.df.groupBy(*self.group)
            .agg(edge_row(F.struct(*fields), self.order).alias("_edge"))
            .withColumn("_carry", step("_edge").over(self._edge_window()))
            .drop("_edge")
        )
        inside = step(F.struct(*fields)).over(self._window())
        self.df = self._join(edges).withColumn(name, F.coalesce(inside, F.col("_carry"))).drop("_carry")
        return self

    def ahead(self, name: str, value: Column, steps: int) -> Blocks:
        """Add `name`: `value` of the row `steps` rows ahead in the series, whatever the elapsed time; null beyond its end.

        A block's edge row holds its first `steps` values, so those of as many following blocks reach any row.
        """
        self._settle()
        self.df = self.df.withColumn("_v", F.struct(value.alias("v")))
        place = F.row_number().over(self._window())
        first = (
            self.df.withColumn("_at", place).filter(F.col("_at") <= steps)
            .groupBy(*self.group).agg(F.sort_array(F.collect_list(F.struct("_at", "_v"))).alias("_first"))
        )
        behind = self._edge_window().rowsBetween(1, steps)
        edges = first.withColumn("_carry", F.slice(F.flatten(F.collect_list("_first").over(behind)), 1, steps)["_v"]).drop("_first")
        left = F.count(F.lit(1)).over(Window.partitionBy(*self.group)) - place
        self.df = self.df.withColumns({"_inside": F.lead("_v", steps).over(self._window()), "_left": left})
        beyond = F.get("_carry", (F.lit(steps - 1) - F.col("_left")).cast("int"))
        self.df = self._join(edges).withColumn(name, F.coalesce("_inside", beyond)["v"]).drop("_inside", "_left", "_carry", "_v")
        return self

    def carry_forward(self, name: str, value: Column) -> Blocks:
        """Add `name`: the last non-null `value` up to and including the row."""
        self._settle()
        self.df = self.df.withColumn("_v", value)
        last_known = F.max_by(F.col("_v"), F.when(F.col("_v").isNotNull(), F.col(self.order)))
        before = self._edge_window().rowsBetween(Window.unboundedPreceding, -1)
        edges = (
            self.df.groupBy(*self.group)
            .agg(last_known.alias("_known"))
            .withColumn("_carry", F.last("_known", ignorenulls=True).over(before))
            .drop("_known")
        )
        up_to = self._window().rowsBetween(Window.unboundedPreceding, 0)
        inside = F.last("_v", ignorenulls=True).over(up_to)
        self.df = self._join(edges).withColumn(name, F.coalesce(inside, F.col("_carry"))).drop("_carry", "_v")
        return self

    def carry_forward_each(self, name: str, values: Column, n: int) -> Blocks:
        """Add array `name`: for each of `n` places of the array `values`, the last non-null one up to and including the row."""
        self._settle()
        self.df = self.df.withColumn("_v", values)
        at = [F.get("_v", F.lit(i)) for i in range(n)]
        known = [F.max_by(v, F.when(v.isNotNull(), F.col(self.order))).alias(f"_known{i}") for i, v in enumerate(at)]
        before = self._edge_window().rowsBetween(Window.unboundedPreceding, -1)
        carried = F.array(*[F.last(f"_known{i}", ignorenulls=True).over(before) for i in range(n)])
        edges = self.df.groupBy(*self.group).agg(*known).select(*self.group, carried.alias("_carry"))
        up_to = self._window().rowsBetween(Window.unboundedPreceding, 0)
        self.df = self.df.withColumn("_inside", F.array(*[F.last(v, ignorenulls=True).over(up_to) for v in at]))
        filled = F.zip_with("_inside", "_carry", lambda inside, carry: F.coalesce(inside, carry))
        self.df = self._join(edges).withColumn(name, filled).drop("_inside", "_carry", "_v")
        return self

    def running_sum(self, name: str, value: Column) -> Blocks:
        """Add `name`: the sum of `value` from the start of the series to the row."""
        self._settle()
        self.df = self.df.withColumn("_v", value.cast("bigint"))
        before = self._edge_window().rowsBetween(Window.unboundedPreceding, -1)
        edges = (
            self.df.groupBy(*self.group)
            .agg(F.sum("_v").alias("_sum"))
            .withColumn("_carry", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
            .drop("_sum")
        )
        up_to = self._window().rowsBetween(Window.unboundedPreceding, 0)
        total = F.sum("_v").over(up_to) + F.col("_carry")
        self.df = self._join(edges).withColumn(name, total.cast("bigint")).drop("_carry", "_v")
        return self

    def with_columns(self, **cols: Column) -> Blocks:
        for name, col in cols.items():
            self.df = self.df.withColumn(name, col)
        return self

    def frame(self) -> DataFrame:
        return self.df.drop(BLOCK)


def previous_row(df, keys, fields, block_us, name="prev", order=US) -> DataFrame:
    return Blocks(df, keys, block_us, order).previous(name, fields).frame()


def shift_rows(df: DataFrame, keys: Sequence[str], steps: int, value: str, name: str, block_us: int) -> DataFrame:
    """`value` of the row `steps` rows ahead in the series, whatever the elapsed time."""
    return Blocks(df, keys, block_us).ahead(name, F.col(value), steps).frame()


def number_rows(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence, name: str) -> DataFrame:
    """Number the rows of each group from 1 in `order`, cut into ordered buckets.

    `bucket` must grow with `order`.  No task sorts more than one bucket of a group.
    """
    cut = df.withColumn("_bkt", bucket)
    before = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        cut.groupBy(*keys, "_bkt")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_off", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .drop("_size")
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_bkt").orderBy(*order))
    out = cut.join(sizes, [*keys, "_bkt"])
    return out.withColumn(name, (inside + F.col("_off")).cast("bigint")).drop("_bkt", "_off")
