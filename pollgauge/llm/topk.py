"""Exact top-k inner products by term-at-a-time accumulation.

Vectors are turned into integers. A component is a term and its non-zero values are the term's postings. The stated
query set meets all rows in blocks: for every pair of a query block and a candidate block, each term of the queries
scatters its weighted postings into dense score arrays, partition selection takes the k best of a query, and the
lists of all candidate blocks are merged. Nothing is pruned, so the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pollgauge.llm.registry import corpus_query, table
from pollgauge.session import materialise

CANDIDATES = 8192  # rows of a candidate block
QUERIES = 2048  # rows of a query block
PAIR_TASKS = 20_000  # tasks among which pairs of blocks are dealt out, beyond which a task has several in turn
TILE = 1024  # candidates, and
ROWS_AT_ONCE = 128  # queries whose dense score arrays stay in a processor's cache


def quantised(embedding: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of every component, as long; null where the vector or a component is null or not finite."""
    x = lambda v: v.cast("double")
    usable = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) != float("inf")))
    return F.when(usable, F.transform(embedding, lambda v: F.floor(F.lit(scale) * x(v)).cast("bigint")))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros, which have no postings."""
    lists = column.combine_chunks()
    ends = lists.offsets.to_numpy()
    sizes = np.diff(ends)
    flat = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def _best(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of each row, ties to the smaller `order` (distinct numbers from 0 on, the same for all rows or one line each)."""
    n = scores.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), scores.shape)
    span = int(order.max(initial=0)) + 1
    if float(np.abs(scores).max(initial=0)) * span < 2**62:  # score and order in one number, so that no two are equal
        return np.argpartition(scores.astype(np.int64) * span - order, n - k, axis=1)[:, n - k:]
    order = np.broadcast_to(order, scores.shape)
    return np.stack([np.lexsort((o, -s.astype(object)))[:k] for s, o in zip(scores, order)])


def block_top_k(query_ids, queries, ids, vectors, k: int, rows_at_once: int = ROWS_AT_ONCE, tile: int = TILE, own=None):
    """(query id, candidate id, score) of the k best candidates of each query, ties to smaller ids; rows with a query's own id are not its candidates.

    Term at a time: each component of a block of queries scatters its products with the component's postings into
    the score arrays of a tile of candidates. Of every tile the k best stay, and the k best of all tiles are kept.
    """
    by_id = np.argsort(ids, kind="stable")
    ids, vectors = ids[by_id], vectors[by_id]
    terms = min(queries.shape[1], vectors.shape[1])
    bound = max(1.0, float(np.abs(queries).max(initial=0))) * max(1.0, float(np.abs(vectors).max(initial=0))) * max(terms, 1)
    kind = np.int32 if bound < 2**31 else np.int64
    low = np.iinfo(np.int32).min if kind is np.int32 else -(2**62)  # below every score
    tiles = []
    for at in range(0, len(ids), tile):
        part = vectors[at:at + tile].astype(kind)
        postings = []
        for t in range(terms):
            where = np.flatnonzero(part[:, t])
            # A term that most candidates have is added along the whole array, its zeros with it; only a rare one is scattered.
            postings.append((None, np.ascontiguousarray(part[:, t])) if 4 * len(where) > len(part) else (where, part[where, t]))
        tiles.append((at, len(part), postings))
    out_q, out_c, out_s = [], [], []
    for at in range(0, len(query_ids), rows_at_once):
        block, block_ids = queries[at:at + rows_at_once, :terms].astype(kind), query_ids[at:at + rows_at_once]
        names = block_ids if own is None else own[at:at + rows_at_once]  # the candidates that a query leaves out
        own_lo, own_hi = np.searchsorted(ids, names, "left"), np.searchsorted(ids, names, "right")
        places, found = [], []
        buffer = np.empty((len(block), tile), kind)
        for start, size, postings in tiles:
            scores, products = np.zeros((len(block), size), kind), buffer[:, :size]
            for t, (where, weights) in enumerate(postings):
                if where is None:
                    np.multiply(block[:, t, None], weights, out=products)
                    scores += products
                elif len(where) and len(rows := np.flatnonzero(block[:, t])):
                    scores[np.ix_(rows, where)] += block[rows, t, None] * weights
            for r in np.flatnonzero((own_lo < start + size) & (own_hi > start)):
                scores[r, max(own_lo[r] - start, 0):own_hi[r] - start] = low
            best = _best(scores, np.arange(size), k)
            places.append(best + start)
            found.append(np.take_along_axis(scores, best, 1))
        if not tiles:
            continue
        places, found = np.concatenate(places, 1), np.concatenate(found, 1)
        best = _best(found, places, k)
        places, found = np.take_along_axis(places, best, 1), np.take_along_axis(found, best, 1)
        open_ = (places < own_lo[:, None]) | (places >= own_hi[:, None])
        out_q.append(np.broadcast_to(block_ids[:, None], open_.shape)[open_])
        out_c.append(ids[places[open_]])
        out_s.append(found[open_].astype(np.int64))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (out_q, out_c, out_s))


def top_k(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0,
          query_rows: int = QUERIES, candidate_rows: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row that `is_query` marks, itself left out.

    Rows with a null key, or a vector that is null or holds a null or non-finite component, take no part. Components
    that one of two vectors lacks count as zero. Rows of a repeated key are candidates each, none for a query of that
    key, and queries each; rows that agree in score and key come in any order, which no column tells apart. Rows fall
    into blocks by a hash of key and vector, so equal vectors of different keys spread over all blocks. Every pair of
    blocks has a number and the pairs are dealt out in turn, so tasks are even; a task's memory is one pair of blocks.
    A query's lists have k rows for each candidate block.
    """
    rows = df.select(F.col(key).alias("id"), quantised(F.col(vector), scale).alias("v"), is_query.alias("q"))
    # A number for each row tells queries of one key apart; it is written, so a task that runs again sees the same.
    rows = materialise(rows.filter("id IS NOT NULL AND v IS NOT NULL").withColumn("row", F.monotonically_increasing_id()), "vectors")
    total, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    n_c, n_q = max(1, -(-total // candidate_rows)), max(1, -(-asked // query_rows))
    place = lambda n, salt: F.pmod(F.xxhash64("id", "row", F.lit(salt)), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select(F.lit(1).alias("side"), "id", "row", "v", place(n_c, 0).alias("c"), each(n_q).alias("b"))
    queries = rows.filter("q").select(F.lit(0).alias("side"), "id", "row", "v", each(n_c).alias("c"), place(n_q, 1).alias("b"))
    pair = (F.col("b") * n_c + F.col("c")).cast("bigint").alias("pair")
    both = queries.select(pair, "side", "id", "row", "v").unionByName(candidates.select(pair, "side", "id", "row", "v"))
    tasks = min(n_c * n_q, PAIR_TASKS)

    def meet(batches):
        held, at = [], None

        def done(parts):
            met = pa.Table.from_batches(parts)
            asked, found = met.filter(pc.equal(met.column("side"), 0)), met.filter(pc.equal(met.column("side"), 1))
            if not asked.num_rows or not found.num_rows:
                return
            q, c, s = block_top_k(np.arange(asked.num_rows), _matrix(asked.column("v")), found.column("id").to_numpy(), _matrix(found.column("v")), k, own=asked.column("id").to_numpy())
            lines, names = asked.column("row").to_numpy(), asked.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (lines[q], names[q], c, s)], names=["row", "query_id", "vec_id", "score"])

        for batch in batches:
            pairs = batch.column("pair").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pairs)) + 1).tolist(), len(pairs)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if at is not None and pairs[lo] != at:
                    yield from done(held)
                    held = []
                at = pairs[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from done(held)

    dealt = both.repartitionById(tasks, F.pmod("pair", F.lit(tasks)).cast("int")).sortWithinPartitions("pair")
    lists = dealt.mapInArrow(meet, "row bigint, query_id bigint, vec_id bigint, score bigint")
    best = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
    SELECT row_number() OVER () AS row, vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@corpus_query("op4_top_k_search", SQL)
def top_k_search(spark, sf_dir):
    """The 20 best of all rows for every twentieth vector."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
