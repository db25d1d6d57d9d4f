"""Conflict-constrained best-fit packing of documents into sequences of a fixed length.

Open bins are ordered by their free space. A piece goes to the bin with the least free space that holds it and does
not conflict: the search starts at the first bin that is large enough and walks to the next larger ones until a bin is
compatible. Each bin carries two bitmaps, of the sources and of the duplicate clusters in it. A document longer than a
bin is cut into whole bins and a rest. Documents are dealt into shards by a hash of their key and packed longest
first, shard by shard, so the work of a task is bounded and no group is gathered.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollgauge.llm.registry import corpus_query, table
from pollgauge.session import materialise

CAPACITY = 2048  # words of a bin, with one end mark for each document
SHARD_PIECES = 2048  # pieces of a shard on average
GROUP_PIECES = 4096  # pieces that are packed together at most
WORD = "[^\\x20\\x09-\\x0D]+"


def best_fit(lengths, sources, clusters, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and place in it of each piece, in the order given; None as source or cluster conflicts with nothing."""
    bit = {}
    for kind, values in (("s", sources), ("c", clusters)):
        seen, twice = set(), set()
        for v in values:
            (twice if v in seen else seen).add(v)
        twice.discard(None)
        bit[kind] = {v: 1 << i for i, v in enumerate(sorted(twice, key=str))}  # a value that comes once cannot conflict
    free: list[tuple[int, int]] = []  # (free space, bin), ordered
    held_s: list[int] = []
    held_c: list[int] = []
    bins, places = [], []
    for length, source, cluster in zip(lengths, sources, clusters):
        s, c = bit["s"].get(source, 0), bit["c"].get(cluster, 0)
        at = bisect_left(free, (length, -1))
        while at < len(free) and (held_s[free[at][1]] & s or held_c[free[at][1]] & c):
            at += 1
        if at < len(free):
            space, b = free.pop(at)
        else:
            space, b = capacity, len(held_s)
            held_s.append(0)
            held_c.append(0)
        held_s[b] |= s
        held_c[b] |= c
        bins.append(b)
        places.append(capacity - space)
        if space > length:
            insort(free, (space - length, b))
    return bins, places


def pack(docs: DataFrame, length: Column, cluster: Column, key: str = "doc_id", source: str = "source", capacity: int = CAPACITY,
         shard_pieces: int = SHARD_PIECES, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """key, piece, start, length, bin_id, bin_start of every piece of every row.

    `length` is at least one. No bin holds two pieces of one source, two of one cluster, or more than `capacity`.
    Null sources and clusters conflict with nothing. Repeated rows and null keys are each packed. A shard with many
    more pieces than meant, as when one key repeats, is packed in groups of `group_pieces`.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), cluster.cast("bigint").alias("cluster"), F.greatest(length, F.lit(1)).cast("bigint").alias("total"))
    rows = materialise(rows, "lengths")
    pieces = F.ceil(F.col("total") / capacity).cast("bigint")
    n = rows.agg(F.coalesce(F.sum(pieces), F.lit(0))).first()[0]
    shards = max(1, -(-n // shard_pieces))
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)))
    cut = cut.select(
        F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "source", "cluster", "piece", (F.col("piece") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).alias("length"),
    )
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        held: list[pa.Table] = []
        shard, made = None, 0

        def close():
            nonlocal made
            rows = pa.concat_tables(held).combine_chunks()
            held.clear()
            bins, places = best_fit(*(rows.column(c).to_pylist() for c in ("length", "source", "cluster")), capacity)
            ids = np.array(bins, np.int64) + (shard << 32) + made
            made += max(bins) + 1
            columns = [rows.column(c).combine_chunks() for c in ("key", "piece", "start", "length")]
            return pa.RecordBatch.from_arrays([*columns, pa.array(ids), pa.array(places, pa.int64())], names=["key", "piece", "start", "length", "bin_id", "bin_start"])

        for batch in batches:
            of = batch.column("shard").to_numpy()
            edges = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if a == b:
                    continue
                if shard is not None and of[a] != shard and held:
                    yield close()
                if of[a] != shard:
                    shard, made = int(of[a]), 0
                while a < b:
                    take = min(b - a, group_pieces - sum(t.num_rows for t in held))
                    held.append(pa.Table.from_batches([batch.slice(a, take)]))
                    a += take
                    if sum(t.num_rows for t in held) >= group_pieces:
                        yield close()
        if held:
            yield close()

    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, shards // 8)
    order = [F.col("shard"), F.desc("length"), F.col("key"), F.col("piece"), F.col("source"), F.col("cluster")]
    packed = cut.repartition(tasks, "shard").sortWithinPartitions(*order).mapInArrow(run, f"key {kind}, piece bigint, start bigint, length bigint, bin_id bigint, bin_start bigint")
    return packed.withColumnRenamed("key", key)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack documents by their words and one end mark; equal texts but for case and white space are one cluster.

    Null and empty texts have the end mark only; they conflict by their source, not as copies.
    """
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[\\x20\\x09-\\x0D]+", " "))
    return pack(docs, words + 1, F.when(plain != "", F.xxhash64(plain)), capacity=capacity)


@corpus_query("op5_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    """Pack all documents."""
    return pack_documents(table(spark, sf_dir, "documents"))
