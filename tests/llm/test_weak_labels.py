"""Label model, scorer, held-out accuracy, messy rows."""

import math
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np

from pollgauge.llm.registry import table
from pollgauge.llm.weak_labels import BAD, BITS, FAULTS, GOOD, LABELLERS, MIN_SCORE, MIN_WORDS, NONE, SIGNS, Texts, fit_quality, fit_scorer, fit_votes, posterior, score_quality, vote_patterns, weak_label_quality

sys.path.insert(0, str(Path(__file__).parent))
from plain import WORD, plain_hash, spread  # noqa: E402

PLAIN = "The first of these texts is plain. It has some words, and ends its sentences well. Nothing here is odd or loud at all."


def votes(text):
    return dict(zip(LABELLERS, Texts([text]).votes()[0].tolist()))


def test_votes():
    assert set(votes(None).values()) == set(votes("").values()) == {NONE}
    plain = votes(PLAIN)
    assert BAD not in plain.values() and plain["plain_words"] == plain["letters"] == plain["sentence_ends"] == GOOD
    assert votes(" ".join(w + "###" for w in PLAIN.split()))["symbol_words"] == BAD
    assert votes(PLAIN.upper())["capitals"] == BAD
    assert votes("Ha " * 40)["repeats"] == votes("Ha " * 40)["distinct"] == BAD
    assert votes(" | ".join(PLAIN.split()))["bars"] == BAD
    assert votes(" ".join(w + "!!" for w in PLAIN.split()))["shouts"] == BAD
    batch = Texts([PLAIN, None, "Ha " * 40, ""]).votes()
    assert (batch[0] == Texts([PLAIN]).votes()[0]).all() and (batch[2] == Texts(["Ha " * 40]).votes()[0]).all()


def test_accuracies_are_recovered():
    rng = np.random.default_rng(1)
    n, kinds = 40_000, len(FAULTS)
    cls = rng.choice(kinds + 1, n, p=[0.8] + [0.2 / kinds] * kinds)
    votes = np.full((n, len(LABELLERS)), NONE, np.int8)
    for k in range(kinds):
        votes[(cls == k + 1) & (rng.random(n) < 0.85), k] = BAD
        votes[(cls != k + 1) & (rng.random(n) < 0.01), k] = BAD
    for j in range(kinds, len(LABELLERS)):
        right = np.where(cls == 0, rng.random(n) < 0.9, rng.random(n) < 0.75)
        votes[:, j] = np.where((cls == 0) == right, GOOD, BAD)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, given = fit_votes(patterns, counts.astype(float))
    assert abs(share[0] - 0.8) < 0.02
    assert all(abs(given[k, k + 1, BAD] - 0.85) < 0.06 for k in range(kinds))
    assert all(abs(given[j, 0, GOOD] - 0.9) < 0.02 for j in range(kinds, len(LABELLERS)))
    assert ((posterior(votes, share, given) > 0.5) == (cls == 0)).mean() > 0.96


def test_scorer_learns_soft_targets():
    rng = np.random.default_rng(2)
    row = np.repeat(np.arange(400), 2)
    bucket = np.stack([np.arange(400) % 2, rng.integers(2, 9, 400)], 1).ravel()
    w, bias = fit_scorer(row, bucket, np.ones(800), np.full(400, 2), np.where(np.arange(400) % 2, 0.95, 0.05), bits=4)
    p = 1 / (1 + np.exp(-(np.bincount(row, w[bucket]) / 2 + bias)))
    assert (abs(p - np.where(np.arange(400) % 2, 0.95, 0.05)) < 0.1).all()


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs = table(spark, sf, "documents")
    model = fit_quality(docs.filter("doc_id % 2 = 0"))  # no label is used
    held = score_quality(docs.filter("doc_id % 2 = 1"), *model).join(table(spark, sf, "labels"), "doc_id").groupBy("quality", "kept").count()
    n = {(r.quality, r.kept): r["count"] for r in held.collect()}
    assert n[1, True] >= 0.99 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.95 * (n[0, False] + n.get((0, True), 0))


def test_messy_rows(documents):
    rows = [(i, PLAIN + f" Text {i}.") for i in range(30)] + [(100 + i, " ".join(f"w{i}{j}###" for j in range(30))) for i in range(8)]
    rows += [(200, None), (201, " \n"), (None, PLAIN), (0, PLAIN + " Text 0."), (202, PLAIN * 5000)]
    docs = documents(rows)
    got = score_quality(docs, *fit_quality(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert not by[200].kept and not by[201].kept and by[None].kept and by[202].kept and by[5].kept
    assert not any(by[100 + i].kept for i in range(8))
    assert sum(r.n for r in vote_patterns(docs).collect()) == len(rows)
    none = documents([])
    assert vote_patterns(none).collect() == [] and score_quality(none, *fit_quality(none)).collect() == []


def test_a_hot_key_does_not_displace_others_from_the_fit(spark, monkeypatch):
    import pollgauge.llm.weak_labels as module

    seen = []
    monkeypatch.setattr(module, "fit_scorer", lambda row, bucket, count, words, good: seen.append(len(words)))
    docs = spark.createDataFrame([(0, f"one hot text {i}") for i in range(200)] + [(i, f"another text {i}") for i in range(1, 20)], "doc_id bigint, text string")
    module.fit_quality(docs, fit_rows=20)
    assert seen == [20]


def shape_of(byte):
    char = chr(byte)
    return 0 if char in " \t\n\x0b\x0c\r" else 1 if byte >= 128 or char.islower() else 2 if char.isupper() else 3 if char.isdigit() else byte


def plain_words(text):
    return re.findall(rb"[^ \t\n\x0b\x0c\r]+", (text or "").encode())


def plain_votes(text):
    words, shapes = plain_words(text), [shape_of(b) for b in (text or "").encode()]
    if not words:
        return (NONE,) * len(LABELLERS)
    share = lambda flags: sum(flags) / len(words)
    capitals, small, other = shapes.count(2), shapes.count(1), sum(s > 2 for s in shapes)

    def plain(w):
        stop = w[-1:] in (b".", b",")
        return sum(shape_of(b) > 2 for b in w) == stop and (len(w) > 1 or not stop)

    shares = {
        "symbol_words": share(any(b in b"#*$%&" for b in w) for w in words), "capitals": capitals / max(capitals + small, 1),
        "repeats": share(a == b for a, b in zip(words, words[1:])), "bars": share(w == b"|" for w in words),
        "shouts": share(w.endswith(b"!!") for w in words), "plain_words": share(map(plain, words)),
        "letters": (capitals + small) / max(capitals + small + other, 1), "distinct": len(set(words)) / len(words),
        "sentence_ends": share(w.endswith(b".") for w in words),
    }
    faults = [BAD if shares[name] >= bad else NONE for name, bad in FAULTS]
    signs = [NONE if len(words) < MIN_WORDS else BAD if shares[n] <= bad else GOOD if shares[n] >= good else NONE for n, bad, good in SIGNS]
    return (*faults, *signs)


def plain_posteriors(counts, rounds=200):
    """P(good | votes) of every pattern, by expectation-maximisation with loops."""
    kinds, n = len(FAULTS), len(LABELLERS)
    share = [0.8] + [0.2 / kinds] * kinds

    def start(j, c):
        if j >= kinds:
            return [0.05, 0.75, 0.2] if c == 0 else [0.4, 0.4, 0.2]
        return [0.01, 0.0, 0.99] if c == 0 else [0.8, 0.0, 0.2] if c == j + 1 else [0.05, 0.0, 0.95]

    given = [[[p + 1e-9 for p in start(j, c)] for c in range(kinds + 1)] for j in range(n)]

    def classes(votes):
        if all(v == NONE for v in votes):
            return share
        p = [s * math.prod(given[j][c][v] for j, v in enumerate(votes)) for c, s in enumerate(share)]
        return [x / sum(p) for x in p]

    for _ in range(rounds):
        weight = {votes: [k * p for p in classes(votes)] for votes, k in counts.items()}
        sums = [math.fsum(w[c] for w in weight.values()) for c in range(kinds + 1)]
        share = [(x + 1) / (sum(counts.values()) + kinds + 1) for x in sums]
        for j in range(n):
            for c in range(kinds + 1):
                given[j][c] = [(math.fsum(w[c] for v, w in weight.items() if v[j] == vote) + 0.1) / (sums[c] + 0.3) for vote in (BAD, GOOD, NONE)]
    return {votes: classes(votes)[0] for votes in counts}


def plain_score(text, weights, bias):
    words, total, before = plain_words(text), 0.0, None
    for i, w in enumerate(words):
        shapes = [shape_of(b) for b in w]
        h = plain_hash(bytes(s for k, s in enumerate(shapes) if k == 0 or s != shapes[k - 1]))
        if i and w == words[i - 1]:
            h ^= WORD
        total += weights[h >> (64 - BITS)]
        if before is not None:
            total += weights[spread((before * 3 + h) & WORD) >> (64 - BITS)]
        before = h
    return 1 / (1 + math.exp(-max(-500, min(500, total / len(words) + bias)))) if words else 0.0


def test_query_against_plain_python(spark, sf_texts):
    """Every row of the query at sf0.01: votes, label model, posterior and score; the scorer's fit is taken as given."""
    sf = "/root/testdata/sf0.01"
    votes = {d: plain_votes(text) for d, text, *_ in sf_texts}
    good = plain_posteriors(Counter(votes.values()))
    _, (weights, bias) = fit_quality(table(spark, sf, "documents"))
    got = {r.doc_id: r for r in weak_label_quality(spark, sf).collect()}
    assert got.keys() == votes.keys() and len(set(votes.values())) > 5
    for d, text, *_ in sf_texts:
        score = plain_score(text, weights, bias)
        assert abs(got[d].weak_label - good[votes[d]]) < 1e-6 and abs(got[d].score - score) < 1e-9
        assert got[d].kept == (score >= MIN_SCORE) or abs(score - MIN_SCORE) < 1e-9
