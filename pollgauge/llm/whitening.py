"""Whitening of vectors by the principal components of their covariance.

Components become whole numbers, so sums and the covariance are exact: tasks multiply matrices of values centred on
the whole number nearest to the mean, add the products as integers, and what the mean differs from that number, under
half a unit, comes off exactly. The eigenvectors start in float32 and are corrected by the Ogita-Aishima iteration, a
few matrix products in a higher precision, whose error is squared in each round. Eigenvalues too close for it to tell
apart form clusters; within a cluster a small eigenproblem, shifted by the cluster's mean, turns the vectors first.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollgauge.llm.registry import corpus_query, table
from pollgauge.session import materialise

SCALE = 64.0
COMPONENTS = 32
LARGEST = 2.0**40  # entries whose scaled size reaches this are no more usable than infinite ones
EXACT = 2**53  # whole numbers below this are exact as doubles
ROUNDS = 20
HIGH = np.longdouble


def whole_numbers(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * c) of every entry as long; null where the vector or an entry is null, not finite or far too large."""
    x = lambda v: F.lit(scale) * v.cast("double")
    usable = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(x(v)) < LARGEST))
    return F.when(usable, F.transform(vector, lambda v: F.floor(x(v)).cast("bigint")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of `dims` entries; what a shorter one lacks is zero."""
    ends = column.offsets.to_numpy()
    sizes = np.diff(ends)
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), flat.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def exact_products(y: np.ndarray) -> np.ndarray:
    """y'y of whole numbers as Python integers."""
    largest = int(np.abs(y).max(initial=0))
    if largest * largest * max(len(y), 1) < EXACT:  # all partial sums are exact as doubles
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if largest >= 1 << 20 and len(y) > 1:  # rows of everyday size need not pay for one that is not
        large = np.abs(y).max(1) >= 1 << 20
        if large.any() and not large.all():
            return exact_products(y[~large]) + exact_products(y[large])
    if len(y) > 1024 and largest < 1 << 20:
        half = len(y) // 2
        return exact_products(y[:half]) + exact_products(y[half:])
    o = y.astype(object)
    return o.T @ o


def summed_products(rows: DataFrame, column: str, dims: int, centre: np.ndarray | None) -> list[list]:
    """Sums of x'x over all rows, whole numbers minus `centre` exactly, or doubles as they are; one partial sum for each task."""
    exact = centre is not None
    at = [(i, j) for i in range(dims) for j in range(i, dims)]

    def run(batches):
        total = None
        for batch in batches:
            x = _matrix(batch.column(column), dims)
            p = exact_products(x - centre) if exact else x.T @ x
            total = p if total is None else total + p
        if total is None:
            return
        values = [total[i, j] for i, j in at]
        kind = pa.decimal128(38, 0) if exact else pa.float64()
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()), pa.array([Decimal(int(v)) if exact else float(v) for v in values], kind)],
            names=["i", "j", "v"],
        )

    parts = rows.select(column).mapInArrow(run, f"i int, j int, v {'decimal(38,0)' if exact else 'double'}")
    out = [[0] * dims for _ in range(dims)]
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # dims squared rows
        out[r.i][r.j] = out[r.j][r.i] = int(r.v) if exact else r.v
    return out


def ratio(numerator: int, denominator: int) -> HIGH:
    """A quotient of integers of any size, rounded once."""
    return np.ldexp(HIGH(str((numerator << 80) // denominator)), -80)


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of neighbouring values (in order) that are at most `gap` apart, two or more each."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def _eigen_estimates(a: np.ndarray, x: np.ndarray):
    """Eigenvalue estimates, X'AX, I - X'X and the distance below which two eigenvalues cannot be told apart."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # equal but for rounding, which small differences of eigenvalues would magnify
    values = np.diag(s) / (1 - np.diag(r))
    norm = lambda m: float(np.linalg.norm(m.astype(np.float64), 2))
    return values, s, r, 2 * (norm(s - np.diag(values)) + norm(a) * norm(r))


def corrected(a: np.ndarray, x: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of a symmetric matrix from approximate eigenvectors, to the precision of `a`.

    Each round solves X + XE for the correction E to first order: pairs of separated eigenvalues give
    (s + value * r) / difference, pairs of one cluster only regain orthogonality, and the cluster is turned by its own
    eigenvectors before the next round. It ends when X'AX is diagonal and X'X the identity but for rounding.
    """
    noise = 4 * len(a) * float(np.finfo(a.dtype).eps)
    for _ in range(rounds):
        values, s, r, close = _eigen_estimates(a, x)
        size = float(np.abs(values).max())
        if np.abs(r).max() < noise and np.abs(s - np.diag(np.diag(s))).max() < noise * size:
            break
        cluster = np.arange(len(a))
        clusters = _clusters(values, close)
        for members in clusters:
            cluster[members] = members[0]
        told = cluster[None, :] != cluster[:, None]
        apart = np.where(told, values[None, :] - values[:, None], 1)
        # (s + value * r) / difference, as the half that restores orthogonality and the half that turns.
        x = x + x @ (r / 2 + np.where(told, (s + (values[None, :] + values[:, None]) / 2 * r) / apart, 0))
        for members in clusters:
            v = x[:, members]
            inner = v.T @ (a @ v - values[members].mean() * v)
            inner = (inner + inner.T) / 2
            if np.abs(inner - np.diag(np.diag(inner))).max() > noise * size / 4:  # less has no direction of its own
                q = np.linalg.eigh((inner / np.abs(inner).max()).astype(np.float64))[1].astype(a.dtype)
                x[:, members] = v @ (q @ (1.5 * np.eye(len(q), dtype=a.dtype) - (q.T @ q) / 2))  # orthogonal beyond double precision
    values = _eigen_estimates(a, x)[0]
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def eigenpairs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors of a symmetric matrix in high precision."""
    a = a.astype(HIGH)
    size = np.abs(a).max(initial=0)
    if not size > 0:
        return np.zeros(len(a), HIGH), np.eye(len(a), dtype=HIGH)
    rough = np.linalg.eigh((a / size).astype(np.float32))[1]
    values, x = corrected(a / size, rough.astype(HIGH))
    return values * size, x / np.sqrt((x * x).sum(0))


def whitened_rows(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE) -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error of every usable row and component.

    Rows whose vector is null, or holds an entry that is null, not finite or of 2^40 or more after scaling, are left
    out. Entries that a shorter vector lacks count as zero. Repeated and null keys stay, each row for itself. There are
    as many components as have variance: fewer than asked where vectors lie in a smaller space, so none for one row or
    equal rows, and no rows for an empty table. Equal eigenvalues share a space; its basis is the same for all rows. A
    deviation past the range of long is null. Other columns are left out.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), whole_numbers(F.col(vector), scale).alias("x")).filter("x IS NOT NULL")
    rows = materialise(rows, "whole")
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    schema = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not n or not dims:
        return df.sparkSession.createDataFrame([], schema)
    sums = rows.select(F.posexplode("x").alias("pos", "x")).groupBy("pos").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()  # dims rows
    total = [0] * dims
    for r in sums:
        total[r.pos] = int(r.s)
    # A constant added to all entries, as the stated form of x has one, moves entries and means alike and leaves no trace below.
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    rest = [s - n * int(c) for s, c in zip(total, centre)]  # n times what the mean exceeds the centre by, under n / 2
    products = summed_products(rows, "x", dims, centre)
    cov = np.array([[ratio(n * products[i][j] - rest[i] * rest[j], n * n) for j in range(dims)] for i in range(dims)], HIGH)
    values, x = eigenpairs(cov)
    usable = int((values > dims * np.finfo(np.float64).eps * max(values[0], HIGH(0))).sum())
    take = min(components, usable)
    if not take:
        return df.sparkSession.createDataFrame([], schema)
    turn = (x[:, :take] / np.sqrt(values[:take])).astype(np.float64)
    mean_rest = np.array([ratio(s, n) for s in rest], np.float64)
    shares = [float(v) for v in values[:take] / np.trace(cov)]
    rest_of = np.array(rest, object)

    def deviations(y: np.ndarray) -> list[int | None]:
        largest = n * int(np.abs(y).max(initial=0)) + max(map(abs, rest))
        if largest * largest * dims < 2**63:
            z = n * y - rest_of.astype(np.int64)
            return np.einsum("ij,ij->i", z, z).tolist()
        z = n * y.astype(object) - rest_of
        return [v if v < 2**63 else None for v in (z * z).sum(1)]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _matrix(batch.column("x"), dims) - centre
            w = np.ascontiguousarray((y - mean_rest) @ turn)
            ends = np.arange(len(y) + 1, dtype=np.int32) * take
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(deviations(y), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel()))], names=["key", "deviation", "w"],
            )

    whitened = materialise(rows.mapInArrow(run, f"key {kind}, deviation bigint, w array<double>"), "whitened")
    # Whitened values are centred already: their sums are zero but for rounding.
    products = np.array(summed_products(whitened, "w", take, None), np.float64) / n
    error = float(np.abs(products - np.eye(take)).max())
    out = whitened.select("key", "deviation", F.posexplode("w").alias("pos", "value"))
    share = F.get(F.array(*[F.lit(s) for s in shares]), F.col("pos"))
    return out.select(
        F.col("key").alias(key), (F.col("pos") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
        F.col("value").alias("whitened"), share.alias("explained"), F.lit(error).alias("identity_error"),
    )


@corpus_query("op11_whitened_vectors")
def whitened_vectors(spark, sf_dir):
    """The first 32 whitened components of every vector."""
    return whitened_rows(table(spark, sf_dir, "embeddings"))
