"""Whitening against exact arithmetic and plain numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from pollgauge.llm.registry import table
from pollgauge.llm.whitening import HIGH, corrected, eigenpairs, exact_products, ratio, whitened_rows

SF = "/root/testdata/sf0.01"
EPS = float(np.finfo(HIGH).eps)
VECTORS = "vec_id bigint, embedding array<float>, label int, key string, x string, w string, n string, deviation string"


def symmetric(values, seed=1):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0].astype(HIGH)
    for _ in range(3):  # orthogonal to high precision
        q = q @ (np.eye(len(values), dtype=HIGH) * HIGH(1.5) - (q.T @ q) / 2)
    return (q * np.array(values, HIGH)) @ q.T


@pytest.mark.parametrize("values", [
    np.arange(1, 41),
    [1] * 10 + [2] * 10 + [5],
    [1 + k * 1e-9 for k in range(8)] + [3, 3 + 1e-7, 3 + 2e-7, 10],
    [1 + k * 1e-13 for k in range(5)] + [1e-6, 1e-6 + 1e-15, 50],
    np.geomspace(1e-7, 1, 30),
    [0, 0, 1, 1, 2],
    [7],
], ids=["apart", "equal", "close", "very close", "graded", "singular", "one"])
def test_eigenpairs_to_high_precision(values):
    a = symmetric(values)
    got, x = eigenpairs(a)
    size = float(np.abs(a).max())
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 200 * EPS * len(a)
    assert np.abs(a @ x - x * got).max() < 200 * EPS * len(a) * size
    assert np.allclose(got.astype(float), sorted(map(float, values), reverse=True), rtol=0, atol=1e-15 * size * len(a))


def test_float32_start_is_corrected():
    a = symmetric(np.arange(1, 21))
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(HIGH)
    before = np.abs(a @ rough - rough * np.diag(rough.T @ a @ rough)).max()
    values, x = corrected(a, rough)
    assert before > 1e-7 and np.abs(a @ x - x * values).max() < 1e-16


def test_exact_products():
    rng = np.random.default_rng(3)
    y = rng.integers(-300, 300, (5000, 6))
    for rows in (y, np.vstack([y, rng.integers(-2**39, 2**39, (3, 6))]), rng.integers(-2**19, 2**19, (30_000, 3)), y[:0]):
        o = rows.astype(object)
        want = [[sum(int(a) * int(b) for a, b in zip(o[:, i], o[:, j])) for j in range(rows.shape[1])] for i in range(rows.shape[1])]
        assert [[int(v) for v in line] for line in exact_products(rows)] == want
    assert abs(float(ratio(10**30 + 1, 3) - HIGH(10**30) / 3)) < 1e13 and float(ratio(-1, 4)) == -0.25


def plain(vectors):
    """Integer vectors -> n, deviations, eigenvalues, whitened covariance check inputs, from exact sums."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    dev = [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x]
    cov = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])
    centred = np.array([[float(Fraction(n * r[i] - s[i], n)) for i in range(d)] for r in x])
    return n, dev, cov, centred


def check(rows, ids, vectors, components=32):
    n, dev, cov, centred = plain(vectors)
    values, x = np.linalg.eigh(cov)
    values, x = values[::-1], x[:, ::-1]
    take = min(components, int((values > len(cov) * 2.3e-16 * values[0]).sum()))
    assert len(rows) == n * take and {r.n for r in rows} == {n}
    assert max(r.identity_error for r in rows) < 1e-4 and len({r.identity_error for r in rows}) == 1
    by_key = {}
    for r in rows:
        by_key.setdefault((r.vec_id, r.component), []).append(r)
    want = (centred @ x[:, :take]) / np.sqrt(values[:take])
    signs = {}
    for c in range(take):
        got = np.array([by_key[i, c + 1][0].whitened for i in ids])
        signs[c] = np.sign(got @ want[:, c])
        assert np.allclose(got * signs[c], want[:, c], rtol=1e-7, atol=1e-7)
        assert all(math.isclose(by_key[i, c + 1][0].explained, values[c] / np.trace(cov), rel_tol=1e-9) for i in ids)
    for i, v in zip(ids, dev):
        assert by_key[i, 1][0].deviation == v


def test_embeddings(spark):
    rows = table(spark, SF, "embeddings").collect()
    good = [r for r in rows if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check(whitened_rows(table(spark, SF, "embeddings")).collect(), [r.vec_id for r in good], [r.embedding for r in good])


def test_messy_rows(spark):
    rng = np.random.default_rng(4)
    good = {i: rng.standard_normal(5).tolist() for i in range(40)}
    bad = {100: None, 101: [1.0, None, 2.0, 0.0, 0.0], 102: [float("nan")] * 5, 103: [1.0, float("-inf"), 0.0, 0.0, 0.0], 104: [3e38] * 5}
    rows = [(k, v, 0, "x", "x", "x", "x", "x") for k, v in {**good, **bad}.items()]
    got = whitened_rows(spark.createDataFrame(rows, VECTORS)).collect()
    check(got, list(good), list(good.values()))
    # Repeated rows count each, null keys stay.
    rows = [(1, [0.0, 1.0], *[None] * 6), (1, [0.0, 1.0], *[None] * 6), (None, [3.0, -1.0], *[None] * 6), (2, [5.0], *[None] * 6)]
    got = whitened_rows(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == 8 and sorted((r.vec_id or 0) for r in got) == [0, 0, 1, 1, 1, 1, 2, 2] and got[0].identity_error < 1e-9
    same = [(r.component, r.whitened) for r in got if r.vec_id == 1]
    assert len(set(same)) == 2


def test_small_and_empty_tables(spark):
    build = lambda vectors: whitened_rows(spark.createDataFrame([(i, v, *[None] * 6) for i, v in enumerate(vectors)], VECTORS))
    empty = build([])
    assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert build([[1.0, 2.0]]).collect() == build([[1.0], [1.0]]).collect() == build([[], []]).collect() == build([None]).collect() == []
    line = build([[1.0, 2.0], [2.0, 4.0], [5.0, 10.0]]).collect()  # one dimension of variance
    assert len(line) == 3 and all(math.isclose(r.explained, 1) for r in line)
    large = build([[2.0**33, 0.0], [-(2.0**33), 1.0], [0.0, 2.0]]).collect()
    assert {r.deviation for r in large if r.vec_id != 2} == {None} and large[0].identity_error < 1e-6
