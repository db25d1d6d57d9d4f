"""Ordinal regression: gradients, order of grades, held-out accuracy, messy rows."""

import math
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np

from pollgauge.llm.registry import table
from pollgauge.llm.toxicity import CUT, OrdinalModel, drop_toxic, fit_ordinal, fit_toxicity, graded, logistic, severity, toxicity_severity, word_keys

sys.path.insert(0, str(Path(__file__).parent))
from plain import plain_hash, signed, spread  # noqa: E402


def loss(model, row, word, count, grade, grades=3):
    n = len(grade)
    score = np.zeros(n)
    for r, w, c in zip(row, word, count):
        at = np.flatnonzero(model.words == w)
        score[r] += model.weights[at[0]] * np.log1p(c) if len(at) else 0
    edges = np.c_[np.zeros(n), logistic(model.thresholds[None, :] - score[:, None]), np.ones(n)]
    return -np.log(edges[np.arange(n), grade + 1] - edges[np.arange(n), grade]).mean()


def toy(seed, n=600):
    rng = np.random.default_rng(seed)
    grade = rng.choice(4, n, p=[0.7, 0.1, 0.1, 0.1])
    row, word = [], []
    for i, g in enumerate(grade):
        w = [*rng.integers(100, 160, 20), *rng.integers(0, 5, 2 * g)]
        row += [i] * len(w)
        word += w
    pairs, count = np.unique(np.stack([row, word]), axis=1, return_counts=True)
    return pairs[0], pairs[1], count, grade


def test_the_fit_is_a_minimum():
    row, word, count, grade = toy(1)
    model = fit_ordinal(row, word, count, grade, l1=0.0, steps=1500, screen=0.0)
    best = loss(model, row, word, count, grade)
    for k in range(3):
        for step in (-0.2, 0.2):
            moved = model.thresholds.copy()
            moved[k] += step
            assert loss(OrdinalModel(model.words, model.weights, np.sort(moved)), row, word, count, grade) >= best - 1e-4
    for k in range(len(model.words)):
        for step in (-0.2, 0.2):
            moved = model.weights.copy()
            moved[k] += step
            assert loss(OrdinalModel(model.words, moved, model.thresholds), row, word, count, grade) >= best - 1e-3


def test_thresholds_are_ordered_and_severity_rises():
    model = fit_ordinal(*toy(2))
    assert (np.diff(model.thresholds) > 0).all()
    above = model.above(np.linspace(-5, 20, 50))
    assert (np.diff(above.sum(1)) > 0).all() and (np.diff(above, axis=1) <= 0).all()
    row, word, count, grade = toy(3)
    score = np.bincount(row, [dict(zip(model.words, model.weights)).get(w, 0) * np.log1p(c) for w, c in zip(word, count)], len(grade))
    mean = [model.above(score).sum(1)[grade == g].mean() for g in range(4)]
    assert mean == sorted(mean) and mean[3] - mean[0] > 1.5


def test_weak_cases():
    none = np.zeros(0, np.int64)
    assert fit_ordinal(none, none, none, none).above(np.zeros(2)).max() < 0.1
    assert len(fit_ordinal(np.array([0, 1]), np.array([1, 1]), np.array([1, 1]), np.array([0, 0])).words) == 0
    assert graded(none, none, none, np.array([0, 0])).tolist() == [0, 0]


def test_word_keys():
    row, key = word_keys(["Trash, trash", None, "", "trash-can É"])
    whole = lambda i: set(key[row == i].tolist())
    assert set(row.tolist()) == {0, 3} and whole(0) < whole(3)


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = fit_toxicity(docs, labels.filter("doc_id % 3 > 0"))
    judged = severity(docs, model).withColumnRenamed("toxic", "found").join(labels.filter("doc_id % 3 = 0"), "doc_id").groupBy("toxic", "found").count()
    n = {(r.toxic, r.found): r["count"] for r in judged.collect()}
    assert n[1, True] >= 0.93 * (n[1, True] + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.01 * (n[0, False] + n.get((0, True), 0))


def test_messy_rows(spark, documents):
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)] + [(None, 1, 1), (41, None, None), (0, 1, 0), (999, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = [(i, "nasty foul words here" if i % 4 == 0 else f"quite fine text number {i}") for i in range(40)]
    rows += [(41, None), (42, ""), (None, "nasty foul words here"), (43, "fine text " * 100_000), (44, "nasty foul words here"), (44, "nasty foul words here")]
    docs = documents(rows)
    model = fit_toxicity(docs, labels)
    got = severity(docs, model).collect()
    assert len(got) == len(rows)
    toxic = sorted((r.doc_id for r in got if r.toxic), key=str)
    assert toxic == sorted([*range(0, 40, 4), None, 44, 44], key=str)
    left = drop_toxic(docs, model)
    assert left.schema == docs.schema and left.count() == len(rows) - len(toxic)
    nothing = fit_toxicity(documents([]), labels.limit(0))
    assert severity(documents([]), nothing).collect() == [] and not any(r.toxic for r in severity(docs, nothing).collect())


def test_a_repeated_labelled_key_is_fitted_once(spark):
    from pollgauge.llm.toxicity import labelled_words

    docs = spark.createDataFrame([(1, f"bad word{i % 3} more") for i in range(300)] + [(i, "kind words here") for i in range(2, 12)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 12)], "doc_id bigint, toxic int")
    assert len(labelled_words(docs, labels, "doc_id", "text", 100)[3]) == 11


def plain_severity(text, weights, thresholds):
    """Severity of one text, word by word, with the fitted weights by feature."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())
    seen = Counter(signed(plain_hash(w)) for w in words)
    seen.update(signed(spread((plain_hash(w[:n]) + n) & (1 << 64) - 1)) for w in words for n in (4, 5, 6, 7) if len(w) > n)
    score = math.fsum(weights.get(k, 0.0) * math.log1p(n) for k, n in seen.items()) if words else -math.inf
    above = [1 / (1 + math.exp(min(t - score, 700))) for t in thresholds]
    share = [a - b for a, b in zip([1.0, *above], [*above, 0.0])]
    return sum(above), share.index(max(share)), above[0] >= CUT


def test_query_against_plain_python(spark, sf_texts):
    """Every row of the query at sf0.01; the fit is taken as given."""
    sf = "/root/testdata/sf0.01"
    model = fit_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
    weights = dict(zip(model.words.tolist(), model.weights.tolist()))
    want = {d: plain_severity(text, weights, model.thresholds.tolist()) for d, text, *_ in sf_texts}
    got = {r.doc_id: r for r in toxicity_severity(spark, sf).collect()}
    assert got.keys() == want.keys() and len(weights) > 0 and any(w[2] for w in want.values())
    for d, (expected, grade, toxic) in want.items():
        assert abs(got[d].expected_severity - expected) < 1e-9 and (got[d].grade, got[d].toxic) == (grade, toxic)
