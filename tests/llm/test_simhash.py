"""Trie join and components against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from pollgauge.llm.components import components
from pollgauge.llm.near_copies import shared_counts, similar_components, spanning_forest
from pollgauge.llm.simhash import fingerprint, fingerprint_links, keep_one, near_duplicates, trie_links


def plain_fingerprint(text, k=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lowered) if x]
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_labels(codes, budget):
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= budget
    label = np.arange(len(codes))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(codes))])
        if (new == label).all():
            return label
        label = new


def clustered(seed, clusters=30, members=25, flips=6):
    rng = np.random.default_rng(seed)
    out = set()
    for base in rng.integers(0, 2**63, clusters, dtype=np.uint64):
        for _ in range(members):
            x = int(base)
            for bit in rng.integers(0, 64, rng.integers(0, flips)):
                x ^= 1 << int(bit)
            out.add(x)
    return np.array(sorted(out | {0, 2**64 - 1}), np.uint64)


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("text", [None, "", "  \n", "A", "A b", "a B c", "É é É é", "x " * 50_000, "one two three four five\x0bsix\x1cseven　eight", "THE the The " * 7])
def test_fingerprints(text):
    assert fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("frontier", [3, 200_000])
@pytest.mark.parametrize("budget", [1, 3, 7])
def test_trie_links(budget, frontier):
    codes = clustered(budget)
    whole = tuple(np.array([x]) for x in (0, len(codes), 0, len(codes), 0))
    i, j = trie_links(codes, [(0, *whole)], budget, frontier)
    assert len(i) < len(codes)
    label = np.arange(len(codes))
    for a, b in zip(i, j):
        assert np.bitwise_count(codes[a] ^ codes[b]) <= 64
        label[label == label[a]] = label[b]
    assert same_partition(label.tolist(), plain_labels(codes, budget).tolist())


@pytest.mark.parametrize("budget,hot", [(3, 50_000), (3, 3), (5, 3)])
def test_links_over_fronts_and_split_nodes(spark, budget, hot):
    codes = clustered(11, 12)
    signed = codes.view(np.int64).tolist()
    links = fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), budget, hot)
    roots = {r.node: r.root for r in components(links).collect()}
    assert same_partition([roots.get(x, x) for x in signed], plain_labels(codes, budget).tolist())


def test_components_of_a_long_path_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_documents_against_brute_force(spark, sf_texts):
    df = spark.createDataFrame([r[:2] for r in sf_texts], "doc_id bigint, text string")
    fps = {d: plain_fingerprint(t) for d, t, *_ in sf_texts[:120]} | {d: fingerprint(t) for d, t, *_ in sf_texts[120:]}
    codes = np.array(sorted(set(fps.values())), np.uint64)
    label = dict(zip(codes.tolist(), plain_labels(codes, 3).tolist()))
    first = {}
    for d in sorted(fps):
        first.setdefault(label[fps[d]], d)
    got = near_duplicates(df).collect()
    assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == sorted((d, f, first[label[f]]) for d, f in fps.items())


def test_messy_rows(documents):
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(5, "a b c d"), (3, "A  b\nC d"), (9, None), (8, ""), (3, "A  b\nC d"), (None, "a b c d"), (None, "quite another text of words"), (7, long), (6, long + "x")]
    got = {(r.doc_id, r.component_id) for r in near_duplicates(documents(rows)).collect()}
    assert {(5, 3), (3, 3), (None, 3), (9, 8), (8, 8), (7, 6), (6, 6), (None, None)} == got
    assert near_duplicates(documents(rows)).count() == len(rows)


def test_keep_one(documents):
    rows = [(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (8, ""), (9, None), (10, "quite another text of words")]
    docs = documents(rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, "a b c d"), (None, "a b c d"), (8, ""), (10, "quite another text of words")], key=str)
    assert keep_one(documents([])).count() == 0


def plain_similarity(a, b, k):
    one, other = (lambda w: {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))})(a.split()), (lambda w: {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))})(b.split())
    return len(one & other) / len(one | other)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain_components(sets, similarity):
    """A label for each set: those that pairs of at least this exact Jaccard similarity connect, empty sets being equal."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    seen, holders = {}, {}
    for i, s in enumerate(sets):
        if frozenset(s) in seen:
            root[find(i)] = find(seen[frozenset(s)])
            continue
        seen[frozenset(s)] = i
        shared = Counter(j for x in s for j in holders.get(x, ()))
        for j, n in shared.items():
            if n / (len(s) + len(sets[j]) - n) >= similarity:
                root[find(i)] = find(j)
        for x in s:
            holders.setdefault(x, []).append(i)
    return [find(i) for i in range(len(sets))]


def edited(words, places, mark):
    return " ".join(f"{mark}{i}" if i in places else w for i, w in enumerate(words))


def test_near_copies_of_low_similarity_link(spark):
    """Pairs with a similarity of 0.8 to 0.9, most of them beyond six bits of a fingerprint."""
    rows = []
    for g in range(40):
        words = [f"g{g}w{i}" for i in range(200)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, edited(words, {40, 90, 140} if g % 2 else {40, 90, 120, 150}, "x"))]
        assert 0.8 <= plain_similarity(rows[-2][1], rows[-1][1], 5) < 0.9
    far = sum((fingerprint(rows[i][1], 5) ^ fingerprint(rows[i + 1][1], 5)).bit_count() > 6 for i in range(0, 80, 2))
    assert far > 20
    kept = keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=5)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 80, 2))


def test_texts_below_the_similarity_stay(spark):
    """Pairs of 0.7 to 0.8, some within six bits of a fingerprint."""
    rows = []
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(200)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, edited(words, {30, 60, 90, 120, 150}, "x"))]
        assert 0.7 < plain_similarity(rows[-2][1], rows[-1][1], 5) < 0.8
    assert any((fingerprint(rows[i][1], 5) ^ fingerprint(rows[i + 1][1], 5)).bit_count() <= 6 for i in range(0, 120, 2))
    kept = keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=5)
    assert kept.count() == 120


def test_a_rejected_link_does_not_split_a_group(spark):
    """Copies of one text drift step by step: neighbours are similar, ends are not, yet all are one group."""
    rows = []
    for g in range(8):
        words = [f"g{g}w{i}" for i in range(200)]
        rows += [(g * 20 + s, edited(words, {10 * i + 5 for i in range(s)}, "x")) for s in range(12)]
    assert plain_similarity(rows[0][1], rows[11][1], 5) < 0.8 < plain_similarity(rows[0][1], rows[1][1], 5)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in keep_one(df, shingle=5).collect()) == [g * 20 for g in range(8)]


@pytest.mark.parametrize("nodes, terms", [(512, 1_000_000), (6, 1_000_000), (6, 300), (1, 1)])
def test_components_with_blocks_of_any_size(spark, nodes, terms):
    """Chains, groups that never merge and strays, in one block or in many: the components of brute force."""
    rng = random.Random(nodes)
    rows = []
    for g in range(4):
        words = [f"g{g}w{i}" for i in range(60)]
        for s in range(14):
            rows.append(" ".join(edited(words, set(rng.sample(range(60), g)), f"x{s if s % 2 else ''}").split()))
    rows += ["a b c d e f", "A b c d e  f", "", "one", None] + [" ".join(f"common{i}" for i in range(30)) + " " + " ".join(f"s{k}t{i}" for i in range(12)) for k in range(10)]
    rng.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    marked, roots = similar_components(df, block_nodes=nodes, block_shingles=terms)
    roots = {r.node: r.root for r in roots.collect()}
    got = {r.key: roots.get(r.node, r.node) for r in marked.collect()}
    want = plain_components([shingles(t, 5) for t in rows], 0.8)
    assert groups(got) == groups(dict(enumerate(want))) and len(groups(got)) < len(rows) - 10


def groups(labels):
    out = {}
    for k, v in labels.items():
        out.setdefault(v, set()).add(k)
    return {frozenset(v) for v in out.values()}


def test_forest_of_a_block_connects_what_is_near():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.r_[base[rng.random(60) < 0.95], rng.integers(0, 2**63, 2, dtype=np.uint64)]) for _ in range(40)] + [rng.integers(0, 2**63, 5, dtype=np.uint64)]
    counts = shared_counts(sets)
    assert all(counts[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(41) for j in range(41) if i != j)
    assert (shared_counts(sets[:7], sets[7:]) == counts[:7, 7:]).all() and shared_counts([sets[40], base[:0]]).sum() == 0
    near = rng.random((50, 50)) < 0.02
    near |= near.T
    edges = spanning_forest(near)
    assert all(near[a, b] for a, b in edges) and len(edges) == len({frozenset(e) for e in edges}) < 50
    both = [set(x) for x in edges] + [{i} for i in range(50)]
    full = [{i, j} for i in range(50) for j in range(i) if near[i, j]]
    assert len(set(labels_of(both))) == len(set(labels_of(full + [{i} for i in range(50)])))


def labels_of(sets):
    label = list(range(50))
    for _ in range(50):
        for s in sets:
            low = min(label[i] for i in s)
            for i in s:
                label[i] = low
    return label


def test_near_duplicates_of_an_empty_table(documents):
    assert near_duplicates(documents([])).collect() == []


def test_keep_one_takes_its_candidates_from_the_simhash_join(spark, monkeypatch):
    from pollgauge.llm import near_copies, simhash

    asked = []

    def components_of(df, key, text, shingle, budget):
        asked.append((sorted(r[key] for r in df.collect()), shingle, budget))
        return simhash_near(df, key, text, shingle, budget)

    simhash_near = simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", components_of)
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame(
        [(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, "quite another text of a few words"), (None, "a"), (4, None)], "doc_id long, text string"
    )
    assert sorted(r["doc_id"] or 0 for r in simhash.keep_one(docs, shingle=5).collect()) == [0, 1, 3, 4]
    assert len(asked) == 1 and len(asked[0][0]) == 5 and asked[0][1:] == (5, 3)
    # A SimHash component counts like a band.
    nodes = spark.createDataFrame([(1, [10, 11]), (2, [12]), (3, [13])], "node long, bands array<bigint>")
    buckets = spark.createDataFrame([(1, 99), (2, 99)], "node long, h long")
    assert near_copies.candidate_groups(nodes).count() == 0
    assert sorted(map(tuple, near_copies.candidate_groups(nodes, buckets).collect())) == [(1, 1), (2, 1)]
