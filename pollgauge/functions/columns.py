"""Column helpers: time, hashes, flags and the logistic score.  All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pollgauge.config import BIKES, DOCKS, SECOND_US, US, FrozenModel

TWO_32 = 4294967296.0


def micros(ts: str | Column) -> Column:
    """Epoch microseconds of a timestamp (with or without time zone)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def to_ts(us: str | Column = US) -> Column:
    return F.timestamp_micros(us)


def floor_to(us: str | Column, step_us: int) -> Column:
    col = F.col(us) if isinstance(us, str) else us
    return (col - F.pmod(col, F.lit(step_us))).cast("bigint")


def block_of(us: str | Column, step_us: int) -> Column:
    """Index of the time block that holds `us`."""
    col = F.col(us) if isinstance(us, str) else us
    return F.call_function("div", col - F.pmod(col, F.lit(step_us)), F.lit(step_us))


def hour_us(us: str | Column = US) -> Column:
    return floor_to(us, 3600 * SECOND_US)


def utc_hour(us: str | Column = US) -> Column:
    return F.hour(to_ts(us))


def utc_weekday(us: str | Column = US) -> Column:
    """Monday = 0."""
    return F.weekday(to_ts(us))


def local_ts(us: str | Column, zone: str) -> Column:
    return F.from_utc_timestamp(to_ts(us), zone)


def critical(bikes: str | Column = BIKES, docks: str | Column = DOCKS, at: int = 2) -> Column:
    """Nearly empty or nearly full."""
    b = F.col(bikes) if isinstance(bikes, str) else bikes
    d = F.col(docks) if isinstance(docks, str) else docks
    return (b <= at) | (d <= at)


def hash32(*parts) -> Column:
    """An integer in [0, 2^32) from the joined parts; the same in any engine and partitioning."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """A number in [0, 1) from the joined parts."""
    return hash32(*parts).cast("double") / F.lit(TWO_32)


def logistic(model: FrozenModel, lag_prefix: str = "", at: Column | None = None) -> Column:
    """Probability of the frozen score; null when any input is null.

    `lag_prefix` reads the lag inputs from prefixed columns, so that two versions
    of the readings can be scored in one row; with `at`, from that place of arrays.
    """

    def source(name: str) -> Column:
        if "_lag" not in name:
            return F.col(name).cast("double")
        lag = F.col(lag_prefix + name)
        return (lag if at is None else F.get(lag, at)).cast("double")

    terms = [F.lit(c) * source(name) for name, c in model.coefficients.items()]
    z = reduce(lambda a, b: a + b, terms, F.lit(model.intercept))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def true_when(cond: Column) -> Column:
    """The condition with null read as false."""
    return F.coalesce(cond, F.lit(False))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def rounded(col: Column, digits: int = 6) -> Column:
    return F.round(col.cast("double"), digits)
