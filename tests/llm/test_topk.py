"""Top-k search against brute force."""

import numpy as np
from pyspark.sql import functions as F

from pollgauge.llm.topk import block_top_k, top_k

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, v string, q string"


def brute(rows, k, is_query):
    vectors = [(key, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for key, v in rows
               if key is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, one in vectors:
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(one, v)), c) for c, v in vectors if c != q)
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k=3, **options):
    df = spark.createDataFrame([(key, v, 0, "x", "x", "x") for key, v in rows], SCHEMA)
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 5 == 0, k, **options).collect())


def test_random_vectors_in_many_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.integers(-3, 4, 6) / 64).tolist()) for i in range(150)]  # many ties and zeros
    want = brute(rows, 4, lambda q: q % 5 == 0)
    assert run(spark, rows, 4, query_rows=7, candidate_rows=20) == want
    assert run(spark, rows, 4) == want


def test_messy_rows(spark):
    rows = [(0, [0.5, -0.5]), (5, [0.5, -0.5]), (10, None), (15, [None, 1.0]), (20, [float("nan"), 1.0]), (25, [float("inf"), 1.0]), (None, [1.0, 1.0]),
            (1, []), (2, [1.0]), (3, [1.0, 2.0, 3.0]), (4, [0.25, 0.25]), (4, [0.25, 0.25]), (4, [9.0, 9.0]), (30, [])]
    assert run(spark, rows, 20) == brute(rows, 20, lambda q: q % 5 == 0)


def test_rows_of_one_key_stay_apart(spark):
    """The larger vector of a repeated key is the best match; a repeated query asks with each of its vectors, never itself."""
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0]), (5, [0.0, 1.0]), (5, [2.0, 0.0]), (5, [2.0, 0.0])]
    assert run(spark, rows, 3)[0] == (0, 1, 5, 8192)
    for options in ({}, {"query_rows": 1, "candidate_rows": 2}):
        assert run(spark, rows, 4, **options) == brute(rows, 4, lambda q: q % 5 == 0)


def test_tiles_agree_with_one_array():
    rng = np.random.default_rng(8)
    ids, vectors = rng.integers(0, 60, 100), rng.integers(-2, 3, (100, 5))
    for queries in (vectors[:30], vectors[:30] * np.array([1, 0, 1, 0, 0])):
        one = block_top_k(ids[:30], queries, ids, vectors, 7)
        some = block_top_k(ids[:30], queries, ids, vectors, 7, rows_at_once=4, tile=9)
        assert [sorted(zip(*map(np.ndarray.tolist, x))) for x in (one, some)][0] == sorted(zip(*map(np.ndarray.tolist, some)))


def test_fewer_rows_than_k_and_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])], 20) == [(0, 1, 1, 64 * 128)]
    assert run(spark, [(1, [1.0]), (2, [2.0])], 20) == []


def test_large_numbers_do_not_wrap():
    ids, big = np.arange(6), 2**30
    vectors = np.array([[big, 1], [big, 2], [0, 3], [-big, 4], [big, 2], [1, 1]], np.int64)
    q, c, s = block_top_k(np.array([0]), vectors[:1], ids, vectors, 3)
    assert sorted(zip(c.tolist(), s.tolist())) == [(1, big * big + 2), (4, big * big + 2), (5, big + 1)] and set(q) == {0}
