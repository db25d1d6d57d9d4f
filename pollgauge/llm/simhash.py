"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints within the error budget agree in whole blocks of bits. Every table brings another choice of blocks to
the front; below each front, the fingerprints form a binary trie (a sorted array, nodes are ranges). Node pairs are
traversed together, level by level: two children that differ in their bit cost one error, and a pair beyond the
budget is dropped, as is a pair whose leaves are all connected already. A task returns a spanning forest of the
links it found, never the pairs themselves.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollgauge.llm.components import components
from pollgauge.llm.hashing import shingle_digests
from pollgauge.llm.near_copies import SIMILARITY, similar_components, text_hash
from pollgauge.llm.registry import corpus_query, table
from pollgauge.session import materialise

SEED = 42
HOT_NODE = 50_000  # distinct fingerprints below one front beyond which its trie is dealt out by node pairs
SPLIT_BITS = 8
LEAF_PAIRS = 32  # node pairs with so few leaf pairs are compared leaf by leaf
FRONTIER = 200_000  # node pairs that are held at once
TASK_ROWS = 500_000


# ---- fingerprints


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text: a bit is set if it is set in over half the shingle hashes."""
    hashes = shingle_digests(text, shingle, SEED)
    if not hashes:
        return 0
    bits = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(bits), 65_536):
        ones += np.unpackbits(bits[at:at + 65_536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """key, fp (bigint with the bits of the fingerprint) of every row; null texts have no words."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(fps.view(np.int64))], names=["key", "fp"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, fp bigint")


# ---- tables


def layouts(budget: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """For each table: bits of its front, and (shift from, width, shift to) of each block.

    With one block more than errors, one block is equal; beyond three errors, with two blocks more, two are, so
    that the front keeps about 16 bits.
    """
    keep = 1 if budget <= 3 else 2
    n = budget + keep
    edges = [round(64 * i / n) for i in range(n + 1)]
    blocks = [(64 - edges[i + 1], edges[i + 1] - edges[i]) for i in range(n)]
    out = []
    for front in combinations(range(n), keep):
        order = [*front, *(i for i in range(n) if i not in front)]
        to, parts = 64, []
        for i in order:
            to -= blocks[i][1]
            parts.append((blocks[i][0], blocks[i][1], to))
        out.append((sum(blocks[i][1] for i in front), parts))
    return out


def _front_first(fp: np.ndarray, parts) -> np.ndarray:
    code = np.zeros_like(fp)
    for source, width, to in parts:
        code |= ((fp >> np.uint64(source)) & np.uint64((1 << width) - 1)) << np.uint64(to)
    return code


def _restore(code: np.ndarray, parts) -> np.ndarray:
    fp = np.zeros_like(code)
    for source, width, to in parts:
        fp |= ((code >> np.uint64(to)) & np.uint64((1 << width) - 1)) << np.uint64(source)
    return fp


# ---- trie join


class Forest:
    """Components of leaves; labels are the smallest index of a component."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.changes = np.arange(n)  # label changes up to each index: a range without one is connected

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
        self.label = label
        self.changes = np.r_[0, np.cumsum(label[1:] != label[:-1])]

    def one(self, lo, hi) -> np.ndarray:
        return self.changes[hi - 1] == self.changes[lo]


def trie_links(code: np.ndarray, pairs: list[tuple], budget: int, frontier: int = FRONTIER) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (indexes i, j) of the links between leaves below the given node pairs.

    `code` is sorted and unique; a node pair is (bits of the common depth, lo, hi, lo, hi, errors so far) as arrays.
    """
    forest = Forest(len(code))
    stack = list(pairs)
    while stack:
        depth, ul, uh, vl, vh, d = stack.pop()
        if len(ul) > frontier:
            cut = len(ul) // 2
            stack.append((depth, *(x[cut:] for x in (ul, uh, vl, vh, d))))
            stack.append((depth, *(x[:cut] for x in (ul, uh, vl, vh, d))))
            continue
        open_ = ~((forest.label[ul] == forest.label[vl]) & forest.one(ul, uh) & forest.one(vl, vh))
        ul, uh, vl, vh, d = (x[open_] for x in (ul, uh, vl, vh, d))
        n = (uh - ul) * (vh - vl)
        few = (n <= LEAF_PAIRS) if depth < 64 else np.ones(len(n), bool)
        if few.any():
            a, b, w, m = ul[few], vl[few], (vh - vl)[few], n[few]
            step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            i, j = np.repeat(a, m) + step // np.repeat(w, m), np.repeat(b, m) + step % np.repeat(w, m)
            near = (i < j) & (np.bitwise_count(code[i] ^ code[j]) <= budget)
            if near.any():
                forest.unite(i[near], j[near])
        if few.all():
            continue
        ul, uh, vl, vh, d = (x[~few] for x in (ul, uh, vl, vh, d))
        bit = np.uint64(1 << (63 - depth))
        upper = ~np.uint64((1 << (64 - depth)) - 1)
        um, vm = (np.searchsorted(code, (code[lo] & upper) | bit) for lo in (ul, vl))
        um, vm = np.clip(um, ul, uh), np.clip(vm, vl, vh)
        same = ul == vl
        apart = ~same
        children = (
            np.concatenate([ul, um, ul, um[apart]]), np.concatenate([um, uh, um, uh[apart]]),
            np.concatenate([vl, vm, vm, vl[apart]]), np.concatenate([vm, vh, vh, vm[apart]]),
            np.concatenate([d, d, d + 1, d[apart] + 1]),
        )
        cl, ch, el, eh, cd = children
        alive = (ch > cl) & (eh > el) & (cd <= budget) & ~((cl == el) & (ch - cl == 1))
        if alive.any():
            stack.append((depth + 1, *(x[alive] for x in children)))
    child = np.flatnonzero(forest.label != np.arange(len(code)))
    return child, forest.label[child]


def fingerprint_links(nodes: DataFrame, budget: int = 3, hot_node: int = HOT_NODE) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints `fp` that differ in at most `budget` bits.

    A front with more than `hot_node` fingerprints is dealt out by the pairs of its nodes SPLIT_BITS further down:
    a fingerprint goes to its node's pairs with every node that the budget allows.
    """
    if budget < 1:
        raise ValueError("distinct fingerprints differ in a bit at least")
    spaces = layouts(budget)

    def tables(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for t, (bits, parts) in enumerate(spaces):
                code = _front_first(fp, parts)
                front, own = code >> np.uint64(64 - bits), (code << np.uint64(bits)) >> np.uint64(64 - SPLIT_BITS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fp), t, np.int32)), pa.array(front.astype(np.int64)), pa.array(code.view(np.int64)), pa.array(own.astype(np.int32))],
                    names=["t", "front", "code", "own"],
                )

    rows = nodes.select("fp").mapInArrow(tables, "t int, front bigint, code bigint, own int")
    hot = materialise(rows.groupBy("t", "front").count().filter(F.col("count") > hot_node).select("t", "front", F.lit(True).alias("hot")), "hot")
    rows = rows.join(hot, ["t", "front"], "left")
    masks = [m for m in range(1 << SPLIT_BITS) if m.bit_count() <= budget]
    other = F.explode(F.when(F.col("hot"), F.array(*[F.col("own").bitwiseXOR(F.lit(m)) for m in masks])).otherwise(F.array(F.lit(-1))))
    rows = rows.select("t", "front", "code", "own", other.alias("other"))
    lo = F.when(F.col("other") < 0, -1).otherwise(F.least("own", "other"))
    hi = F.when(F.col("other") < 0, -1).otherwise(F.greatest("own", "other"))
    rows = rows.select("t", "front", lo.alias("lo"), hi.alias("hi"), "code")

    def links(t, front, lo, hi, code):
        """Links within consecutive rows of one table, all of them whole fronts or all of one pair of split nodes."""
        bits, parts = spaces[t]
        code = np.unique(code.view(np.uint64))
        if lo < 0:
            starts = np.flatnonzero(np.r_[True, (code[1:] >> np.uint64(64 - bits)) != (code[:-1] >> np.uint64(64 - bits))])
            ends = np.r_[starts[1:], len(code)]
            starts, ends = starts[ends - starts > 1], ends[ends - starts > 1]
            pair = (bits, starts, ends, starts, ends, np.zeros(len(starts), np.int64))
        else:
            cut = int(np.searchsorted(code, np.uint64(((front << SPLIT_BITS) | hi) << (64 - bits - SPLIT_BITS))))
            u, v = (0, len(code)) if lo == hi else (0, cut), (0, len(code)) if lo == hi else (cut, len(code))
            pair = (bits + SPLIT_BITS, *(np.array([x]) for x in (*u, *v, (lo ^ hi).bit_count())))
            if lo != hi and not 0 < cut < len(code):
                return None
        if not len(pair[1]):
            return None
        i, j = trie_links(code, [pair], budget)
        fp = _restore(code, parts).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], names=["a", "b"])

    def run(batches):
        held: list[np.ndarray] = []

        def flush(final):
            if not held:
                return
            data = np.concatenate(held, axis=1)
            t, front, lo, hi, code = data
            # A table's whole fronts go together; each pair of split nodes goes alone.
            new = np.r_[True, (t[1:] != t[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | ((lo[1:] >= 0) & (front[1:] != front[:-1]))]
            at = np.r_[np.flatnonzero(new), len(t)]
            last = len(t)
            if not final:  # the last front may go on in the next batch
                last = int(np.flatnonzero(np.r_[True, new[1:] | (front[1:] != front[:-1])])[-1])
            for s, e in zip(at[:-1], np.minimum(at[1:], last)):
                if s < e:
                    out = links(int(t[s]), int(front[s]), int(lo[s]), int(hi[s]), code[s:e])
                    if out is not None and out.num_rows:
                        yield out
            held[:] = [data[:, last:]] if last < len(t) else []

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if sum(h.shape[1] for h in held) >= TASK_ROWS:
                yield from flush(False)
        yield from flush(True)

    dealt = rows.repartition("t", "front", "lo", "hi").sortWithinPartitions("t", "lo", "hi", "front")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, budget: int = 3) -> DataFrame:
    """key, fp and component_id (smallest key that can be reached over links) of every row.

    Rows with equal fingerprints are one node, so copies never meet in one task. Rows without words have
    fingerprint zero and link like any other. Null keys count for no component; one with null keys only has a null
    id. Repeated rows are returned as often as they come; other columns are left out.
    """
    marked = materialise(fingerprints(df, key, text, shingle), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("key").alias("first")), "nodes")
    roots = components(materialise(fingerprint_links(nodes, budget), "links"))
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(labelled.join(smallest, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select(F.col("key").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, similarity: float = SIMILARITY, budget: int = 3) -> DataFrame:
    """The rows of `docs` without all but one row of each component of near-duplicates: its smallest key stays.

    SimHash components (`near_duplicates`) are candidates, as are texts with equal MinHash bands, for 64 bits miss pairs of
    different length or few shingles; an exact check of all candidates decides.

    Links are pairs of texts whose sets of shingles have a Jaccard similarity of at least `similarity`. Rows are told
    apart by key and text, so a repeated key keeps a row in every component where it is the smallest. Of rows that
    agree in both, null and empty texts being the same, the smallest stays. Rows with a null key are kept.
    """
    found = near_duplicates(docs.select(text_hash(text).alias("x"), F.col(text).alias("text")), "x", "text", shingle, budget)
    alike = materialise(found.select("x", F.col("component_id").alias("grp")).distinct(), "alike")
    marked, roots = similar_components(docs, key, text, shingle, similarity, groups=alike)
    # A component is settled by minima, which are reduced before they are dealt out, so a large one is no hot key.
    sets = marked.filter("key IS NOT NULL").groupBy("node").agg(F.min(F.struct("key", "x")).alias("first"))
    named = materialise(sets.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "named")
    first = named.groupBy("root").agg(F.min("first").alias("first")).select("first.key", "first.x")
    copies = marked.filter("key IS NOT NULL").groupBy("key", "x").agg(F.count("*").alias("copies"))
    stays = materialise(copies.join(first, ["key", "x"], "left_semi"), "stays")
    hash_ = "x" + "_" * max(map(len, docs.columns))  # a name that no column has
    rows = docs.withColumn(hash_, text_hash(text))
    here = lambda t: (rows[key] == t["key"]) & (rows[hash_] == t["x"])
    kept = rows.join(stays.filter("copies = 1"), here(stays), "left_semi").select(docs.columns).unionByName(docs.filter(F.col(key).isNull()))
    repeated = stays.filter("copies > 1")
    if repeated.isEmpty():
        return kept
    doubles = rows.join(repeated, here(repeated), "left_semi").groupBy(key, hash_).agg(F.min(F.struct(*[F.col(c) for c in docs.columns])).alias(hash_ + "row"))
    return kept.unionByName(doubles.select(F.col(hash_ + "row.*")))


@corpus_query("op8_simhash_components")
def simhash_components(spark, sf_dir):
    """Components of all documents whose fingerprints differ in at most three bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
