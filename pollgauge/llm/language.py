"""Language identification by fusing text, markup, address and host evidence.

For every language l the log posterior of a document is the sum of

* the text: log likelihoods of hashed byte trigrams, from counts over all documents by their declared language,
* the declared markup language d: log P(d | l),
* the address suffix s (a language code in the path, else the last label of the host): log P(s | l),
* the host: log P(l | host), where a host's counts are smoothed by its parent domain's and these by all documents'.

The tables of the last three come from grouped aggregation of what the text alone says, so a declaration or a
suffix is trusted as far as it agrees with the texts. Missing evidence adds nothing. `und` (undetermined) is a
language whose trigrams are all equally likely.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollgauge.llm.hashing import joined, sliced
from pollgauge.llm.registry import corpus_query, table
from pollgauge.session import materialise

LANGUAGES = ("de", "en", "es", "fr")
UNDETERMINED = "und"
BUCKETS = 1 << 14
TEXT_WEIGHT = 1 / 3  # each byte is in three trigrams
SMOOTHING = 20.0  # documents that a parent's shares count for
MIN_POSTERIOR = 0.5

# Lower-case ASCII letters and the bytes of longer characters stand for themselves, all others are a space.
FOLD = np.array([b if b >= 128 or chr(b).islower() else 32 for b in range(256)], np.uint32)


def trigrams(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around each byte of the texts (-1 where there is none), and where each text ends.

    A text has a space on either side, so a single letter has a trigram; three spaces are none.
    """
    data, ends = joined(texts, lower=True)
    out = np.full(len(data), -1, np.int32)
    if len(data) > 1:
        code = np.r_[np.uint32(32), FOLD[data]]  # a line feed, folded to a space, stands behind each text
        left, middle, right = code[:-2], code[1:-1], code[2:]
        h = ((left << np.uint32(16)) | (middle << np.uint32(8)) | right) * np.uint32(2654435761)
        plain = (left != 32) | (middle != 32) | (right != 32)
        out[:-1] = np.where(plain, (h >> np.uint32(32 - int(math.log2(buckets)))).astype(np.int32), -1)
    out[ends - 1] = -1
    return out, ends


def trigram_counts(docs: DataFrame, declared: Column, text: str = "text", languages=LANGUAGES, buckets: int = BUCKETS) -> DataFrame:
    """declared, bucket, n: trigrams of all texts with a declared language of the list; each task adds up its own first."""

    def run(batches):
        sums = {}
        for part, texts in sliced(batches):
            names = part.column("declared").to_pylist()
            bucket, ends = trigrams(texts, buckets)
            starts = np.r_[0, ends[:-1]]
            for name in set(names):
                mine = np.concatenate([bucket[a:b] for a, b, d in zip(starts, ends, names) if d == name])
                sums[name] = sums.get(name, 0) + np.bincount(mine[mine >= 0], minlength=buckets)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"declared": [name] * len(at), "bucket": at.astype(np.int32), "n": n[at].astype(np.int64)})

    rows = docs.select(declared.alias("declared"), F.col(text).alias("text")).filter(F.col("declared").isin(*languages) & F.col("text").isNotNull())
    return rows.mapInArrow(run, "declared string, bucket int, n bigint").groupBy("declared", "bucket").agg(F.sum("n").alias("n"))


def text_model(counts: DataFrame, languages=LANGUAGES, buckets: int = BUCKETS) -> np.ndarray:
    """Log probability of each bucket in each language, `und` last: languages times buckets numbers, whatever the input."""
    n = np.zeros((len(languages) + 1, buckets))
    for r in counts.collect():
        n[languages.index(r.declared), r.bucket] = r.n
    n[-1] = 0
    n += 1
    return np.log(n / n.sum(1, keepdims=True))


def text_likelihoods(docs: DataFrame, model: np.ndarray, carried: list[Column], text: str = "text", weight: float = TEXT_WEIGHT) -> DataFrame:
    """The carried columns and `ll`, the weighted log likelihoods of each text (all zero without trigrams)."""
    rows = docs.select(*carried, F.col(text).alias("__text"))
    out = rows.drop("__text").schema
    log_p = np.ascontiguousarray(model)
    buckets = model.shape[1]

    def run(batches):
        for part, texts in sliced(batches, "__text"):
            bucket, ends = trigrams(texts, buckets)
            none = bucket < 0
            sums = [np.add.reduceat(np.where(none, 0.0, p[bucket]), np.r_[0, ends[:-1]]) if len(ends) else np.zeros(0) for p in log_p]
            ll = np.stack(sums, 1) * weight
            columns = [part.column(i) for i in range(part.num_columns - 1)]
            lists = pa.ListArray.from_arrays(np.arange(0, ll.size + 1, ll.shape[1], dtype=np.int32), ll.ravel())
            yield pa.RecordBatch.from_arrays([*columns, lists], names=[*out.names, "ll"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)
    return rows.mapInArrow(run, f"{fields}, ll array<double>")


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, parent domain and suffix of an address; null where it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    host = F.when(host != "", host)
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#-]|$)", 1))
    labels = F.split(host, r"\.")
    domain = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host)
    return host, domain, F.when(path != "", path).otherwise(F.element_at(labels, -1))


def declared_language(html: Column) -> Column:
    """Primary part of the lang attribute of the html element, lower-case; null where there is none."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return F.when(found != "", found)


def page_evidence(pages: DataFrame) -> DataFrame:
    """doc_id, markup, host, domain, suffix of the documents whose number ends an address; the smallest page counts."""
    host, domain, suffix = address_parts(F.col("url"))
    doc = F.regexp_extract(F.col("url"), r"^[^?#]*/(\d+)(?:\.[A-Za-z]+)?/?(?:[?#].*)?$", 1).try_cast("bigint")
    rows = pages.select(doc.alias("doc_id"), F.struct("page_id", declared_language(F.col("html")).alias("markup"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix")).alias("page"))
    return rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("page").alias("page")).select("doc_id", "page.markup", "page.host", "page.domain", "page.suffix")


def _shares(rows: DataFrame, by: str, languages: tuple, smoothing: float, above: Column | None = None, parent: str | None = None, parents: DataFrame | None = None) -> DataFrame:
    """Share of each language among the rows of every value of `by`, drawn to shares `above`, or to those of its parent."""
    n = [F.count_if(F.col("guess") == i).alias(f"n{i}") for i in range(len(languages))]
    rows = rows.filter(F.col(by).isNotNull())
    if parents is None:
        counts = rows.groupBy(by).agg(*n)
    else:
        counts = rows.groupBy(by).agg(*n, F.min(parent).alias(parent)).join(parents.withColumnRenamed("shares", "above"), parent, "left")
        above = F.col("above")
    total = sum((F.col(f"n{i}") for i in range(len(languages))), F.lit(0))
    shares = F.array(*[(F.col(f"n{i}") + smoothing * F.get(above, F.lit(i))) / (total + smoothing) for i in range(len(languages))])
    return counts.select(by, shares.alias("shares"))


def _given(rows: DataFrame, by: str, languages: tuple) -> DataFrame:
    """log P(value of `by` | language), add-one smoothed over the values that occur."""
    n = [F.count_if(F.col("guess") == i).alias(f"n{i}") for i in range(len(languages))]
    counts = materialise(rows.filter(F.col(by).isNotNull()).groupBy(by).agg(*n), "given")
    totals = counts.agg(F.count("*"), *[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(len(languages))]).first()
    logs = F.array(*[F.log((F.col(f"n{i}") + 1.0) / float(totals[i + 1] + max(1, totals[0]))) for i in range(len(languages))])
    return counts.select(by, logs.alias(f"log_{by}"))


def identify(docs: DataFrame, evidence: DataFrame, key: str = "doc_id", text: str = "text", declared: str = "lang", source: str = "source",
             languages: tuple = LANGUAGES, min_posterior: float = MIN_POSTERIOR, smoothing: float = SMOOTHING) -> DataFrame:
    """key, language, posterior and kept of every row.

    `evidence` has key, markup, host, domain and suffix of some keys. A document without a page has its own declared
    language as markup and its source as host. Kept is a language of the list with a posterior of `min_posterior` or
    more from a text with trigrams; null and empty texts are undetermined. Ties go to the first in alphabet. Repeated
    rows and rows with a null key are each judged. Host tables grow with the hosts, so they are joined, not broadcast
    by hand, and Spark may split a hot host.
    """
    names = (*languages, UNDETERMINED)
    own = F.lower(F.regexp_extract(F.col(declared), r"^([A-Za-z]{2,3})", 1))
    own = F.when(own != "", own)
    model = text_model(trigram_counts(docs, own, text, languages), languages)
    rows = text_likelihoods(docs, model, [F.col(key).alias("key"), own.alias("own"), F.col(source).cast("string").alias("source")], text)
    guess = F.when(F.array_max("ll") < 0, F.array_position("ll", F.array_max("ll")).cast("int") - 1)
    rows = materialise(rows.withColumn("guess", guess), "likelihoods")
    pages = evidence.select(F.col(key).alias("key"), "markup", F.col("host").alias("page_host"), F.col("domain").alias("page_domain"), "suffix")
    rows = rows.join(pages, "key", "left")
    host = F.coalesce("page_host", F.concat(F.lit("source:"), "source"))
    rows = rows.select("key", "ll", "guess", F.coalesce("markup", "own").alias("markup"), "suffix", host.alias("host"), F.coalesce("page_domain", host).alias("domain"))
    rows = materialise(rows, "evidence")

    everywhere = rows.agg(*[F.count_if(F.col("guess") == i) for i in range(len(names))]).first()
    total = sum(everywhere)
    overall = [(n + 1) / (total + len(names)) for n in everywhere]
    top = F.array(*[F.lit(float(p)) for p in overall])
    domain_shares = materialise(_shares(rows, "domain", names, smoothing, above=top), "domains")
    host_shares = materialise(_shares(rows, "host", names, smoothing, parent="domain", parents=domain_shares), "hosts").withColumnRenamed("shares", "prior")
    fused = rows.join(host_shares, "host", "left").join(_given(rows, "markup", names), "markup", "left").join(_given(rows, "suffix", names), "suffix", "left")
    posterior = F.array(*[
        F.get("ll", F.lit(i)) + F.log(F.coalesce(F.get("prior", F.lit(i)), F.lit(overall[i])))
        + F.coalesce(F.get("log_markup", F.lit(i)), F.lit(0.0)) + F.coalesce(F.get("log_suffix", F.lit(i)), F.lit(0.0))
        for i in range(len(names))
    ])
    fused = fused.select("key", "guess", posterior.alias("p"))
    best = F.array_max("p")
    where = F.array_position("p", best).cast("int") - 1
    share = 1 / F.aggregate("p", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    language = F.when(F.col("guess").isNull(), UNDETERMINED).otherwise(F.get(F.array(*[F.lit(n) for n in names]), where))
    fused = fused.select(F.col("key").alias(key), language.alias("language"), F.when(F.col("guess").isNotNull(), share).otherwise(0.0).alias("posterior"))
    return fused.withColumn("kept", (F.col("language") != UNDETERMINED) & (F.col("posterior") >= min_posterior))


def keep_identified(docs: DataFrame, evidence: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` whose key was kept. Of rows that repeat a key all stay if one is kept; null keys go."""
    kept = identify(docs, evidence, key, **options).filter("kept").select(key).distinct()
    return docs.join(kept, key, "left_semi").select(docs.columns)


@corpus_query("op7_language_fusion")
def language_fusion(spark, sf_dir):
    """Language of every document from its text, its page's markup and address, and its host."""
    return identify(table(spark, sf_dir, "documents"), page_evidence(table(spark, sf_dir, "pages")))
