"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pollgauge.llm import variants
from pollgauge.llm.registry import table
from pollgauge.llm.variants import near_words, roots_of, spelling_variants, text_words, word_counts

SF = "/root/testdata/sf0.01"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_words(key, text):
    out = []
    for run in RUN.findall(text or ""):
        run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
        h = zlib.crc32(f"{key}:{run}".encode()) if key is not None else 1
        if h % 31 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out.append(run)
    return [w for w in out if len(w) >= 7]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[p + 1:] == b[p + 1:] if len(a) == len(b) else a[p:] == b[p + 1:]


def plain(counts, ratio=10):
    """word -> (form, root, n, n_near, form_n); candidates from deletion patterns, each pair checked."""
    shared = {}
    for w in counts:
        for x in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            shared.setdefault(x, []).append(w)
    near = {w: {v for x in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))} for v in shared[x] if one_edit(v, w)} for w in counts}
    best = {w: min(near[w], key=lambda v: (-counts[v], v)) for w in counts if near[w]}
    form = {w: v for w, v in best.items() if counts[v] >= ratio * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), counts[w], len(near[w]), counts[form[w]] if w in form else None) for w in counts}


def rows_of(df):
    rows = [(r.word, (r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_documents(spark):
    docs = table(spark, SF, "documents")
    counts = Counter(w for r in docs.collect() for w in plain_words(r.doc_id, r.text))
    got = rows_of(spelling_variants(docs))
    assert got == plain({w: n for w, n in counts.items() if n >= 2})
    assert sum(v[0] is not None for v in got.values()) > 50


@pytest.mark.parametrize("limit", [4096, 2])
@pytest.mark.parametrize("letters, sizes", [("ab", (7, 10)), ("abcdeé", (7, 8)), ("abcdefghijklmnop", (7, 7))])
def test_random_words(spark, letters, sizes, limit):
    """Dense vocabularies; with small groups every group is dealt again until single places are left."""
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(*sizes))) for _ in range(600)}
    words |= {w[:3] + w[4:] + rng.choice(letters) for w in list(words)[:100]} | {"q" * k for k in range(7, 30)}
    counts = {w: rng.choice((2, 3, 40, 40, 500)) for w in sorted(words) if len(w) >= 7}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    want = {}
    for w in counts:
        near = [v for v in counts if one_edit(v, w)]
        if near:
            form = min(near, key=lambda v: (-counts[v], v))
            want[w] = (len(near), form, counts[form])
    assert {r.word: (r.n_near, r.form, r.form_n) for r in near_words(vocabulary, group_words=limit).collect()} == want


def test_chunks_end_at_groups(spark, monkeypatch):
    monkeypatch.setattr(variants, "CHUNK_WORDS", 3)
    words = ["abcdefgh", "abcdefgx", "abcdefg", "zbcdefgh", "abcdefghi", "mnopqrst", "mnopqrs", "nopqrstu"]
    batches = []
    counts = Counter()
    got = variants._near_of_groups(batches)
    assert list(got) == []
    vocabulary = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    got = {r.word: r.n_near for r in near_words(vocabulary.repartition(1)).collect()}
    assert got == {w: n for w in words if (n := sum(one_edit(w, v) for v in words))} and not counts


def test_words_of_a_text():
    rng = random.Random(5)
    signs = "abcXYZéÉÿ×÷ßñ \n1-日😀"
    for key in range(400):
        text = "".join(rng.choice(signs) for _ in range(300))
        assert [w.decode("latin-1") for w in text_words(key, text)] == plain_words(key, text)
        assert [w.decode("latin-1") for w in text_words(None, text)] == plain_words(None, text)


def test_root_follows_forms(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(9)] + [("x", "w5"), ("y", "z")]
    got = {r.word: r.root for r in roots_of(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {**{f"w{i}": "w9" for i in range(9)}, "x": "w9", "y": "z"}


def test_messy_rows(documents):
    long = "Abcdefghij" * 5_000
    rows = [(1, None), (2, ""), (3, "1234 ..."), (4, "variant Variant varianto"), (4, "variant Variant varianto"), (None, "VARIANT variants"), (5, "variants"),
            (6, long + " " + long[:-1]), (7, long + " " + long[:-1]), (8, "ÀÉÍÓÚÑÇ àéíóúñç ÀÉÍÓÚÑÇ àéíóúñç")]
    counts = Counter(w for k, t in rows for w in plain_words(k, t))
    got = rows_of(spelling_variants(documents(rows)))
    assert got == plain({w: n for w, n in counts.items() if n >= 2}) and len(got) >= 6


def test_ties_go_to_the_smaller_word(documents):
    text = " ".join(["abcdefgy"] * 40 + ["abcdefgx"] * 40 + ["abcdefg"] * 2)
    got = rows_of(spelling_variants(documents([(None, text)])))
    assert got["abcdefg"] == ("abcdefgx", "abcdefgx", 2, 2, 40) and got["abcdefgy"][0] is None


def test_empty_table(documents):
    assert spelling_variants(documents([])).collect() == []
    assert word_counts(documents([(1, None)])).collect() == []
    assert np.array_equal(variants.Words([]).shared_prefixes(), np.zeros(0))
