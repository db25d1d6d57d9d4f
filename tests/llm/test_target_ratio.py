"""Base counts and ratios against brute force."""

import collections
import math
import re

import pytest
import xxhash

from pollgauge.llm import target_ratio
from pollgauge.llm.target_ratio import bucket_ratios, target_ratio_rules, with_base_counts


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def base(text):
    w, text = words(text), text or ""
    windows = collections.Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    covered = {p for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
TEXTS = [None, "", " \t\n\x0b\x0c\r ", "a", "a b", "a b c", "a a a a", "a b c a b c", "x\n\nx\n x\nx ", "#|é <日本> 😀 z y", "\n\n\n", "a\x1cb \x85 c",
         "one two three four " * 3 + "five", "w" * 100_000, "a b c d " * 30_000]


@pytest.mark.parametrize("bits", [20, 3])
def test_base_counts(documents, monkeypatch, bits):
    monkeypatch.setattr(target_ratio, "PLACE_BITS", bits)  # three bits send longer texts the exact way
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: tuple(r[c] for c in COUNTS) for r in with_base_counts(documents(rows, clashes=False)).collect()}
    assert got == {i: base(t) for i, t in rows}


def test_equal_hashes_of_different_windows_are_told_apart(documents, monkeypatch):
    monkeypatch.setattr(target_ratio, "PLACE_BITS", 62)  # two bits of hash are left, so most windows share one
    rows = [(0, " ".join(f"w{i % 17}" for i in range(60))), (1, " ".join(f"w{i}" for i in range(60))), (2, "a b c d e a b c")]
    got = {r.doc_id: r.n_repeat_words for r in with_base_counts(documents(rows, clashes=False)).collect()}
    assert got == {i: base(t)[4] for i, t in rows}


def test_documents(spark, sf_texts):
    df = spark.createDataFrame([r[:2] for r in sf_texts], "doc_id bigint, text string")
    got = {r.doc_id: (*(r[c] for c in COUNTS), r.base_failed) for r in with_base_counts(df).collect()}
    want = {d: base(t) for d, t, *_ in sf_texts}
    assert got == {d: (*b, b[0] < 50 or 100 * b[4] > 50 * b[0]) for d, b in want.items()}


def spark_hash(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed)
    return seed - 2**64 if seed >= 2**63 else seed


def test_ratios_and_scores_against_brute_force(spark, documents):
    good = [" ".join(f"good{(i * k) % 23}" for k in range(1, 70)) for i in range(1, 13)]
    bad = [" ".join(f"bad{(i * k) % 31}###" for k in range(1, 70)) for i in range(1, 5)]
    rows = list(enumerate([*good, *bad]))
    docs, trusted = documents(rows), spark.createDataFrame([(i,) for i in range(12)], "doc_id bigint")
    raw, target = collections.Counter(), collections.Counter()
    grams = lambda w: [spark_hash(x) % 64 for x in w] + [spark_hash(a, b) % 64 for a, b in zip(w, w[1:])]
    for i, t in rows:
        raw.update(grams(words(t)))
        if i < 12:
            target.update(grams(words(t)))
    shift = math.log((sum(raw.values()) + 64) / (sum(target.values()) + 64))
    want = {b: round((math.log((target[b] + 1) / (raw[b] + 1)) + shift) * 1e6) for b in range(64)}
    got = {r.bucket: r.micro for r in bucket_ratios(docs, trusted, "doc_id", "text", 64).collect()}
    assert got.keys() == want.keys() and all(abs(got[b] - want[b]) <= 1 for b in want)
    judged = {r.doc_id: r for r in target_ratio_rules(docs, trusted, buckets=1 << 12).collect()}
    assert min(judged[i].micro_ratio for i in range(12)) > max(judged[i].micro_ratio for i in range(12, 16))
    assert not any(judged[i].kept for i in range(12, 16))


def test_messy_rows(spark, documents):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, None), (2, ""), (3, text), (3, text), (None, text), (4, text + " " + "v " * 100_000)]
    got = target_ratio_rules(documents(rows), spark.createDataFrame([(3,), (None,), (99,)], "doc_id bigint")).collect()
    seen = sorted(((r.doc_id, r.n_words, r.base_failed, r.kept) for r in got), key=str)
    assert seen == sorted([(1, 0, True, False), (2, 0, True, False), (3, 80, False, True), (3, 80, False, True), (None, 80, False, True), (4, 100_080, True, False)], key=str)
    none = spark.createDataFrame([], "doc_id bigint")
    assert target_ratio_rules(documents([]), none).collect() == []
    assert target_ratio_rules(documents(rows), none).count() == len(rows)


def test_labelled_documents(spark):
    from pollgauge.llm.registry import load_corpus_queries, table

    sf = "/root/testdata/sf0.1"
    judged = load_corpus_queries()[0]["op6_target_ratio"](spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("NOT base_failed")
    share = {r.quality: r.share for r in judged.groupBy("quality").agg({"kept": "max"}).withColumnRenamed("max(kept)", "share").collect()}
    kept = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert share[1] and kept[1, True] >= 0.995 * (kept[1, True] + kept.get((1, False), 0))
    assert kept[0, False] >= 0.9 * (kept[0, False] + kept.get((0, True), 0))
