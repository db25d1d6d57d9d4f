"""Near-duplicates by the exact Jaccard similarity of the sets of word shingles.

Candidates share one of BANDS hashes of ROWS minima each (MinHash), so a pair of similarity s is a candidate with a
chance of 1 - (1 - s^ROWS)^BANDS: 0.99998 at 0.8. Texts with equal sets are one node before anything is paired. The
buckets of all bands are merged into candidate groups, so two nodes meet once however many bands they share, and a
node's shingles are shipped once for each block it takes part in. No pair is ever written: a task holds one block of
nodes (or two), counts their shared shingles as products of incidence matrices, and returns a spanning forest of the
pairs that are as similar as asked; no estimate decides.

A group of more than one block is settled in two rounds. First each block is compared within itself, with one leader
of the group in every block. Then the blocks are dealt anew by the components found so far, and pairs of blocks are
compared unless both hold one and the same component. What is left of a group that never merges is its size squared
over the block, in tasks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollgauge.llm.components import components
from pollgauge.llm.hashing import shingle_digests
from pollgauge.session import materialise

SIMILARITY = 0.8
BANDS, ROWS = 36, 6
_random = np.random.default_rng(20_240_701)
MASKS = _random.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64)
FACTORS = _random.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
CHUNK = 512  # shingles whose hashes are mixed at once
BLOCK_NODES, BLOCK_SHINGLES = 512, 1_000_000  # of a block on average; a single text may have more
TERMS = 4096  # columns of an incidence matrix


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(np.frombuffer(shingle_digests(text, shingle), ">u8").astype(np.uint64))


def node_of(hashes: np.ndarray) -> int:
    """A number (bigint) for a set of shingles; zero for a text without words."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64)) if len(hashes) else 0


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """A hash (bigint) of the minima of each band."""
    import xxhash

    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        mixed = hashes[None, at:at + CHUNK] ^ MASKS
        mixed *= FACTORS
        np.minimum(low, mixed.min(1), out=low)
    rows = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def text_hash(text: str | Column) -> Column:
    """What tells texts apart beside their key."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def sketches(df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """key, x (hash of the text), node, n (shingles) and bands of every row."""

    def run(batches):
        for batch in batches:
            nodes, sizes, bands = [], [], []
            for t in batch.column("text"):
                hashes = shingle_set(t.as_py(), shingle)
                nodes.append(node_of(hashes))
                sizes.append(len(hashes))
                bands.append(bands_of(hashes) if len(hashes) else [])
            columns = [batch.column("key"), batch.column("x"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "x", "node", "n", "bands"])

    rows = df.select(F.col(key).alias("key"), text_hash(text).alias("x"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, x bigint, node bigint, n bigint, bands array<bigint>")


def shingles_of(df: DataFrame, wanted: DataFrame, text: str, shingle: int) -> DataFrame:
    """node and its sorted shingle hashes (binary), of texts whose hash is wanted; one row for each such text."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    rows = df.select(F.col(text).alias("text"), text_hash(text).alias("x"))
    return rows.join(wanted, "x", "left_semi").groupBy("x").agg(F.first("text").alias("text")).select("text").mapInArrow(run, "node bigint, shingles binary")


def shared_counts(one: list[np.ndarray], other: list[np.ndarray] | None = None) -> np.ndarray:
    """Shared shingles of every set of `one` with every set of `other` (with each other, if none), TERMS shingles at a time."""
    sets = one + (other or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    terms = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(terms, kind="stable")
    terms, owner = terms[order], owner[order]
    same = terms[1:] == terms[:-1]
    held = np.r_[same, False] | np.r_[False, same]  # a shingle of one set only is shared by none
    terms, owner = terms[held], owner[held]
    column = np.cumsum(np.r_[False, terms[1:] != terms[:-1]]) if len(terms) else terms.astype(np.int64)
    n = len(one)
    out = np.zeros((n, len(sets) - n if other is not None else n), np.float32)
    cuts = np.searchsorted(column, np.arange(0, int(column[-1]) + 1 + TERMS, TERMS)) if len(column) else [0]
    for lo, hi in zip(cuts, cuts[1:]):
        held = np.zeros((len(sets), min(TERMS, int(column[hi - 1] - column[lo]) + 1)), np.float32)
        held[owner[lo:hi], column[lo:hi] - column[lo]] = 1
        out += held[:n] @ (held[n:] if other is not None else held).T
    return out.astype(np.int64)


def spanning_forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a symmetric relation connects."""
    open_, edges = np.ones(len(near), bool), []
    for start in np.flatnonzero(near.any(1)).tolist():
        if not open_[start]:
            continue
        open_[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(near[at] & open_)
            open_[new] = False
            queue.extend(new.tolist())
            edges.extend((at, x) for x in new.tolist())
    return edges


def block_links(sides: list[int], nodes: list[int], roots: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A forest of the similar pairs of a block (all sides equal), or between its two sides; pairs with one root are joined already."""
    side, root = np.array(sides), np.array(roots)
    order = np.argsort(side, kind="stable")
    first = order[side[order] == side.min()]
    second = order[side[order] != side.min()]
    size = np.array([len(s) for s in sets])
    near = np.zeros((len(sets), len(sets)), bool)
    a, b = (first, second) if len(second) else (first, first)
    shared = shared_counts([sets[i] for i in a], [sets[i] for i in b] if len(second) else None)
    union = size[a][:, None] + size[b][None, :] - shared
    found = (shared >= similarity * union - 1e-9) & (shared / union >= similarity) & (root[a][:, None] != root[b][None, :])
    near[np.ix_(a, b)] = found
    near |= near.T
    return [(nodes[i], nodes[j]) for i, j in spanning_forest(near)]


def linked(dealt: DataFrame, block: list[str], similarity: float) -> DataFrame:
    """a, b: links found in blocks of rows (block..., side, node, root, shingles), which fit a task each."""

    def run(batches):
        held, at = [], None

        def done():
            found = block_links([h[0] for h in held], [h[1] for h in held], [h[2] for h in held], [np.frombuffer(h[3], np.uint64) for h in held], similarity) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in block)))
            rows = zip(keys, *(batch.column(c).to_pylist() for c in ("side", "node", "root", "shingles")))
            for key, *row in rows:
                if key != at and held:
                    yield done()
                    held = []
                at = key
                held.append(row)
        if held:
            yield done()

    rows = dealt.select(*block, "side", "node", "root", "shingles").repartition(*block).sortWithinPartitions(*block)
    return rows.mapInArrow(run, "a bigint, b bigint")


def candidate_groups(nodes: DataFrame, buckets: DataFrame | None = None) -> DataFrame:
    """node, grp of every node that shares a band with another one; nodes that chains of shared bands connect are one group.

    `buckets` (node, h) are further ones that count like bands.
    """
    rows = nodes.select("node", F.explode("bands").alias("h"))
    rows = rows if buckets is None else rows.unionByName(buckets)
    shared = rows.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("h", "lo")
    links = rows.join(shared, "h").filter("node != lo").select(F.col("lo").alias("a"), F.col("node").alias("b"))
    return components(links.distinct()).select("node", F.col("root").alias("grp"))


def similar_components(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = SIMILARITY,
                       block_nodes: int = BLOCK_NODES, block_shingles: int = BLOCK_SHINGLES, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, x, node) of every row, and (node, root) of every node with a link to another one.

    Rows of equal sets, texts without words among them, have one node. `groups` (x, grp) are candidates found by another
    method: texts of one group are compared too.
    """
    marked = materialise(sketches(df, key, text, shingle), "sketches")
    nodes = marked.filter("n > 0").groupBy("node").agg(F.min("x").alias("x"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialise(nodes, "nodes")
    buckets = None
    if groups is not None:
        held = marked.filter("n > 0").select("x", "node").distinct().join(groups.distinct(), "x")
        buckets = held.select("node", F.xxhash64(F.lit("group"), "grp").alias("h")).distinct()
    groups = materialise(candidate_groups(nodes, buckets), "groups")
    live = materialise(nodes.drop("bands").join(groups, "node"), "live")
    blocks_of = lambda count, size: F.greatest(F.ceil(count / block_nodes), F.ceil(size / block_shingles)).cast("int")
    size = live.groupBy("grp").agg(blocks_of(F.count("*"), F.sum("n")).alias("blocks"), F.min("node").alias("leader"))
    # Rows of one node have one set of shingles, so any of its texts will do; two with one hash give the node twice.
    shingles = shingles_of(df, live.select("x"), text, shingle).groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = materialise(live.select("node", "grp").join(shingles, "node"), "sets")
    # Only a group of many blocks differs from the rest, so groups are looked up by what they have in all.
    size = materialise(size, "sizes")
    dealt = sets.join(size, "grp").withColumn("block", F.when(
        (F.col("node") == F.col("leader")) & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1),
    ).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))))
    dealt = dealt.select("grp", F.explode("block").alias("block"), F.lit(0).alias("side"), "node", F.col("node").alias("root"), "shingles")
    links = materialise(linked(dealt, ["grp", "block"], similarity), "links")
    roots = materialise(components(links), "roots")
    many = size.filter("blocks > 1").select("grp")
    if not many.isEmpty():
        more = materialise(across_blocks(sets.join(many, "grp", "left_semi"), roots, blocks_of, similarity), "links")
        roots = materialise(components(links.unionByName(more)), "roots")
    return marked.select("key", "x", "node"), roots


def across_blocks(sets: DataFrame, roots: DataFrame, blocks_of, similarity: float) -> DataFrame:
    """Links between nodes of large groups that have different roots so far.

    A component that fills a block has blocks of its own; the others share blocks. Each pair of blocks of a group meets
    in one task, but for two of one component, and blocks that several components share meet themselves too.
    """
    known = sets.join(roots, "node", "left").select("grp", "node", "shingles", F.coalesce("root", "node").alias("root"))
    known = materialise(known, "known")
    weight = (F.octet_length("shingles") / 8).cast("bigint")
    parts = known.groupBy("grp", "root").agg(F.count("*").alias("count"), F.sum(weight).alias("size")).withColumn("own", blocks_of(F.col("count"), F.col("size")))
    parts = parts.withColumn("own", F.when(F.col("own") > 1, F.col("own")).otherwise(0))
    rest = parts.filter("own = 0").groupBy("grp").agg(blocks_of(F.sum("count"), F.sum("size")).alias("shared"))
    parts = materialise(parts.join(rest, "grp", "left").select("grp", "root", "own", F.coalesce("shared", F.lit(0)).alias("shared")), "parts")
    # A block is (component, or null for shared ones; number).
    own = F.when(F.col("own") > 0, F.col("root"))
    number = F.pmod(F.when(F.col("own") > 0, F.xxhash64("node")).otherwise(F.xxhash64("root")), F.greatest("own", F.when(F.col("own") > 0, 1).otherwise(F.col("shared")))).cast("int")
    placed = known.join(parts, ["grp", "root"]).select("grp", "node", "root", "shingles", own.alias("of"), number.alias("no"))
    placed = materialise(placed, "placed")
    blocks = materialise(placed.select("grp", "of", "no").distinct().withColumn("id", F.xxhash64("of", "no")), "blocks")
    left = blocks.select("grp", F.col("of").alias("of_a"), F.col("id").alias("a"))
    right = blocks.select("grp", F.col("of").alias("of_b"), F.col("id").alias("b"))
    one = F.col("of_a").isNotNull() & F.col("of_a").eqNullSafe(F.col("of_b"))
    pairs = left.join(right, "grp").filter((F.col("a") <= F.col("b")) & ~one).select("grp", "a", "b")
    pairs = materialise(pairs, "pairs").select("grp", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("id"))
    rows = placed.withColumn("id", F.xxhash64("of", "no")).join(pairs, ["grp", "id"])
    return linked(rows.withColumn("side", (F.col("id") != F.col("a")).cast("int")), ["grp", "a", "b"], similarity)
