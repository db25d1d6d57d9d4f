"""Evidence parsing, fusion against brute force, messy rows."""

import collections
import math

import numpy as np
from pyspark.sql import functions as F

from pollgauge.llm.language import FOLD, address_parts, declared_language, identify, keep_identified, page_evidence, text_model, trigram_counts, trigrams
from pollgauge.llm.registry import load_corpus_queries

EVIDENCE = "doc_id bigint, markup string, host string, domain string, suffix string"


def evidence(spark, rows=()):
    return spark.createDataFrame(list(rows), EVIDENCE)


def test_addresses_and_markup(spark):
    rows = [("https://Blog.A.example.org/fr/12", "<HTML class='x' LANG=FR-ca>"), ("http://host/12", '<html lang="">'), ("no address", "<p lang='de'>"), (None, None), ("https://a.b.co:80/english/", "<html\nlang = 'es'>")]
    df = spark.createDataFrame(rows, "url string, html string")
    host, domain, suffix = address_parts(F.col("url"))
    got = [tuple(r) for r in df.select(host, domain, suffix, declared_language(F.col("html"))).collect()]
    assert got == [("blog.a.example.org", "example.org", "fr", "fr"), ("host", "host", "host", None), (None, None, None, None), (None, None, None, None), ("a.b.co", "b.co", "co", "es")]


def test_page_evidence_takes_the_smallest_page(spark):
    rows = [(2, "http://a.org/fr/7?x=1", "<html lang=fr>"), (1, "http://b.org/de/7.html#top", "<html lang=de>"), (3, "http://c.org/en/8/", None), (4, "http://c.org/en/none", "<html lang=en>"), (5, None, "<html lang=en>")]
    got = sorted(map(tuple, page_evidence(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()))
    assert got == [(7, "de", "b.org", "b.org", "de"), (8, None, "c.org", "c.org", "en")]


def plain_trigrams(text):
    raw = [32, *FOLD[np.frombuffer((text or "").lower().encode(), np.uint8)].tolist(), 32]
    return [int(np.uint32(a << 16 | b << 8 | c) * np.uint32(2654435761) >> np.uint32(18)) for a, b, c in zip(raw, raw[1:], raw[2:]) if (a, b, c) != (32, 32, 32)]


def test_trigrams():
    texts = ["", None, "a", "Ab c", "É 1 2", "   ", "last"]
    with np.errstate(over="ignore"):
        bucket, ends = trigrams(texts)
        starts = np.r_[0, ends[:-1]]
        got = [[int(x) for x in bucket[a:b] if x >= 0] for a, b in zip(starts, ends)]
        assert got == [plain_trigrams(t) for t in texts]
    assert len(trigrams([])[0]) == 0 or (trigrams([])[0] == -1).all()


def test_fusion_against_brute_force(documents, spark):
    texts = {"en": "the and of to in that is was for on with he as at by this had not", "fr": "le la les des une dans que pour qui sur avec est pas par plus au ce il"}
    rows = [(i, " ".join(np.random.default_rng(i).choice(texts[l].split(), 12)), l if i % 7 else {"en": "fr", "fr": "en"}[l], f"s{i % 3}") for i, l in enumerate(["en", "fr", "en"] * 20)]
    rows += [(100, "xx", "en", "s1"), (101, "the", None, None)]
    pages = [(i, "fr" if i % 3 == 1 else "en", f"h{i % 2}.x.org", "x.org", "fr" if i % 2 else "en") for i in range(0, 60, 4)]
    got = {r.doc_id: r for r in identify(documents(rows), evidence(spark, pages), languages=("en", "fr")).collect()}

    names, by = ["en", "fr", "und"], {p[0]: p[1:] for p in pages}
    counts = {l: collections.Counter(x for _, t, d, _ in rows if d == l for x in plain_trigrams(t)) for l in ("en", "fr")}
    logp = lambda l, x: math.log((counts[l][x] + 1) / (sum(counts[l].values()) + 2**14)) if l != "und" else -math.log(2**14)
    ll = {k: [sum(logp(l, x) for x in plain_trigrams(t)) / 3 for l in names] for k, t, *_ in rows}
    guess = {k: int(np.argmax(v)) for k, v in ll.items()}
    facts = {k: (by[k][0] if k in by else d, by[k][1] if k in by else s and f"source:{s}", by[k][2] if k in by else s and f"source:{s}", by[k][3] if k in by else None) for k, _, d, s in rows}
    tally = lambda i, v: [sum(1 for k, f in facts.items() if f[i] == v and guess[k] == g) for g in range(3)]
    overall = [(sum(1 for g in guess.values() if g == l) + 1) / (len(rows) + 3) for l in range(3)]
    smooth = lambda n, above: [(x + 20 * a) / (sum(n) + 20) for x, a in zip(n, above)]
    for k, (markup, host, domain, suffix) in facts.items():
        p = list(ll[k])
        prior = smooth(tally(1, host), smooth(tally(2, domain), overall)) if host else overall
        for l in range(3):
            p[l] += math.log(prior[l])
            for i, v in ((0, markup), (3, suffix)):
                if v is not None:
                    values = {f[i] for f in facts.values() if f[i] is not None}
                    p[l] += math.log((tally(i, v)[l] + 1) / (sum(tally(i, x)[l] for x in values) + len(values)))
        best = int(np.argmax(p))
        share = 1 / sum(math.exp(x - p[best]) for x in p)
        assert got[k].language == names[best] and abs(got[k].posterior - share) < 1e-9, k


def test_messy_rows(documents, spark):
    rows = [(1, None), (2, ""), (3, "the and of"), (3, "the and of"), (None, "the and of", None, None), (4, "the " * 200_000), (5, "12 34 | #")]
    docs = documents(rows)
    got = sorted(((r.doc_id, r.language, r.kept) for r in identify(docs, evidence(spark)).collect()), key=str)
    assert [g for g in got if g[0] in (1, 2, 5)] == [(1, "und", False), (2, "und", False), (5, "und", False)]
    assert len(got) == len(rows) and got.count((3, "en", True)) == 2 and (None, "en", True) in got
    kept = keep_identified(docs, evidence(spark))
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [3, 3, 4]
    assert identify(documents([]), evidence(spark)).collect() == []
    assert keep_identified(documents([]), evidence(spark)).collect() == []


def test_model_of_no_texts(documents):
    model = text_model(trigram_counts(documents([]), F.col("lang")))
    assert np.allclose(np.exp(model).sum(1), 1)


def test_documents(spark, sf_texts):
    got = load_corpus_queries()[0]["op7_language_fusion"](spark, "/root/testdata/sf0.01").collect()
    lang = {d: l for d, _, l, _ in sf_texts}
    assert sum(r.language == lang[r.doc_id] and r.kept for r in got) >= 0.995 * len(sf_texts)
