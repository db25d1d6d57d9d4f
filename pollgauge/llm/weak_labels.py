"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text. Votes overlap, so their patterns over all documents show
how far each labeller can be trusted: expectation-maximisation of a latent class model estimates for each class how
often each labeller votes what. Bad texts fail in different ways, so there is one good class and a bad class for each
kind of fault. The posterior of a row's votes is its soft label, and soft labels of a bounded sample train a linear
scorer on hashed word shapes, which then judges every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollgauge.llm.hashing import joined, mixed, runs, segment_hashes, sliced
from pollgauge.llm.registry import corpus_query, table
from pollgauge.session import materialise

FIT_ROWS = 6_000  # bound on the rows that the scorer is fitted on, chosen by a hash of the key
BITS = 14  # of a feature's bucket
MIN_SCORE = 0.5  # probability of good text from which a document is kept
BAD, GOOD, NONE = 0, 1, 2

# Labellers that only ever vote bad: (name, share from which they do).
FAULTS = (("symbol_words", 0.20), ("capitals", 0.50), ("repeats", 0.20), ("bars", 0.10), ("shouts", 0.20))
# Labellers of both votes: (name, share up to which they vote bad, share from which they vote good).
SIGNS = (("plain_words", 0.70, 0.90), ("letters", 0.85, 0.93), ("distinct", 0.10, 0.30), ("sentence_ends", 0.005, 0.02))
MIN_WORDS = 20  # shares of fewer words are no evidence for the labellers of both votes
LABELLERS = tuple(name for name, *_ in (*FAULTS, *SIGNS))

SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&"))
# Shape of a byte: 0 white space, 1 small letter or longer character, 2 capital, 3 digit, other signs themselves.
SHAPE = np.array([0 if SPACES[b] else 1 if b >= 128 or chr(b).islower() else 2 if chr(b).isupper() else 3 if chr(b).isdigit() else b for b in range(256)], np.uint8)


class Texts:
    """Words of a batch of texts: row, hash, and repetition of the word before it."""

    def __init__(self, texts: list[str | None]):
        self.data, self.ends = joined(texts, lower=False)
        self.n = len(texts)
        self.starts, self.stops = runs(~SPACES[self.data])
        self.row = np.searchsorted(self.ends, self.starts, "right")
        self.words = np.bincount(self.row, minlength=self.n)
        self.hash = segment_hashes(self.data, self.starts, self.stops)
        self.follows = np.r_[False, self.row[1:] == self.row[:-1]] if len(self.row) else np.zeros(0, bool)
        self.repeat = self.follows & np.r_[False, self.hash[1:] == self.hash[:-1]] if len(self.row) else self.follows

    def share(self, of_words) -> np.ndarray:
        return np.bincount(self.row[of_words], minlength=self.n) / np.maximum(self.words, 1)

    def votes(self) -> np.ndarray:
        """A column of votes for each labeller; a text without words has none."""
        last = self.data[self.stops - 1] if len(self.stops) else np.zeros(0, np.uint8)
        long = self.stops - self.starts > 1
        before = np.where(long, self.data[self.stops - 2], 0) if len(self.stops) else last
        signs = np.r_[0, np.cumsum(SYMBOLS[self.data])]
        shape = SHAPE[self.data]
        text_of = np.r_[0, self.ends[:-1]] if self.n else self.ends
        add = lambda mask: np.add.reduceat(mask.astype(np.int64), text_of) if self.n else np.zeros(0)
        capitals, small, other = add(shape == 2), add(shape == 1), add(shape > 2)
        # Plain: letters, and one full stop or comma at most behind them.
        odd = np.r_[0, np.cumsum((shape > 2))]
        stop = (last == ord(".")) | (last == ord(","))
        plain = (odd[self.stops] - odd[self.starts] - stop == 0) & (long | ~stop) if len(self.row) else np.zeros(0, bool)
        pairs = np.unique(np.stack([self.row.astype(np.uint64), self.hash]), axis=1) if len(self.row) else np.zeros((2, 0), np.uint64)
        shares = {
            "symbol_words": self.share(signs[self.stops] > signs[self.starts]) if len(self.row) else np.zeros(self.n),
            "capitals": capitals / np.maximum(capitals + small, 1),
            "repeats": self.share(self.repeat),
            "bars": self.share(~long & (last == ord("|"))),
            "shouts": self.share((last == ord("!")) & (before == ord("!"))),
            "plain_words": self.share(plain),
            "letters": (capitals + small) / np.maximum(capitals + small + other, 1),
            "distinct": np.bincount(pairs[0].astype(np.int64), minlength=self.n) / np.maximum(self.words, 1),
            "sentence_ends": self.share(last == ord(".")),
        }
        out = np.full((self.n, len(LABELLERS)), NONE, np.int8)
        for j, (name, bad) in enumerate(FAULTS):
            out[shares[name] >= bad, j] = BAD
        for j, (name, bad, good) in enumerate(SIGNS, len(FAULTS)):
            vote = np.where(shares[name] <= bad, BAD, np.where(shares[name] >= good, GOOD, NONE))
            out[:, j] = np.where(self.words >= MIN_WORDS, vote, NONE)
        out[self.words == 0] = NONE
        return out

    def features(self, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
        """(row, bucket) of every word shape and pair of shapes; a repeated word has a shape of its own."""
        if not len(self.row):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        shape = SHAPE[self.data]
        kept = (shape != 0) & np.r_[True, shape[1:] != shape[:-1]]
        count = np.cumsum(kept)
        h = segment_hashes(shape[kept], count[self.starts] - 1, count[self.stops - 1])
        h = np.where(self.repeat, ~h, h)
        pair = mixed(h[:-1] * np.uint64(3) + h[1:])[self.follows[1:]]
        bucket = np.concatenate([h, pair]) >> np.uint64(64 - bits)
        return np.concatenate([self.row, self.row[1:][self.follows[1:]]]), bucket.astype(np.int64)


# ---- label model


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Share of each class and P(vote | class) as labellers x classes x votes, by expectation-maximisation.

    Class 0 is good, class k the bad texts of fault k. It starts from labellers that are right more often than not.
    """
    n, kinds = patterns.shape[1], len(FAULTS)
    share = np.r_[0.8, np.full(kinds, 0.2 / kinds)]
    given = np.tile(np.array([0.4, 0.4, 0.2]), (n, kinds + 1, 1))
    given[:, 0] = [0.05, 0.75, 0.2]
    given[:kinds] = [0.05, 0.0, 0.95]
    given[:kinds, 0] = [0.01, 0.0, 0.99]
    given[np.arange(kinds), 1 + np.arange(kinds)] = [0.8, 0.0, 0.2]
    given += 1e-9
    for _ in range(rounds):
        weight = classes(patterns, share, given) * counts[:, None]
        share = (weight.sum(0) + 1) / (counts.sum() + kinds + 1)
        for vote in (BAD, GOOD, NONE):
            given[:, :, vote] = ((patterns == vote).T.astype(float) @ weight + 0.1) / (weight.sum(0) + 0.3)
    return share, given


def classes(patterns: np.ndarray, share: np.ndarray, given: np.ndarray) -> np.ndarray:
    """P(class | votes); not to vote is an outcome of its own. Rows on which nobody votes have the shares themselves."""
    ll = np.tile(np.log(share), (len(patterns), 1))
    for j in range(len(given)):
        ll += np.log(given[j])[:, patterns[:, j]].T
    p = np.exp(ll - ll.max(1, keepdims=True)) if len(ll) else ll
    p = p / p.sum(1, keepdims=True)
    return np.where((patterns == NONE).all(1)[:, None], share[None, :], p)


def posterior(patterns: np.ndarray, share: np.ndarray, given: np.ndarray) -> np.ndarray:
    """P(good | votes)."""
    return classes(patterns, share, given)[:, 0]


def fit_scorer(row, bucket, count, words, target, bits: int = BITS, steps: int = 300, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights of the buckets and a bias, by logistic regression on soft targets; features are counts per word."""
    w, bias, g2, b2 = np.zeros(1 << bits), 0.0, np.full(1 << bits, 1e-8), 1e-8
    n = len(target)
    if not n:
        return w, bias
    x = count / np.maximum(words, 1)[row]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[bucket], n) + bias, -500, 500)))
        slope = (p - target) / n
        g = np.bincount(bucket, x * slope[row], 1 << bits) + l2 * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
        b = slope.sum()
        b2 += b * b
        bias -= 0.2 * b / np.sqrt(b2)
    return w, bias


# ---- Spark


def vote_patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """pattern (one digit for each labeller), n: how often each pattern occurs; at most 3^labellers rows."""

    def run(batches):
        for _, texts in sliced(batches):
            patterns, n = np.unique(Texts(texts).votes(), axis=0, return_counts=True)
            yield pa.RecordBatch.from_pydict({"pattern": ["".join(map(str, p)) for p in patterns], "n": n.astype(np.int64)})

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "pattern string, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))


def fit_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS):
    """The label model over all documents, and the scorer fitted on a bounded sample of them, one row for each key.

    A key with several rows has, of its texts that are not blank, the one with the smallest hash.
    """
    seen = vote_patterns(docs, text).orderBy("pattern").collect()
    patterns = np.array([[int(c) for c in r.pattern] for r in seen], np.int8).reshape(len(seen), len(LABELLERS))
    labels = fit_votes(patterns, np.array([r.n for r in seen], float))
    keys = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    chosen = materialise(keys.orderBy(F.xxhash64("key"), "key").limit(fit_rows), "chosen")

    def run(batches):
        for part, texts in sliced(batches):
            t = Texts(texts)
            row, bucket = t.features()
            good = posterior(t.votes(), *labels)
            pairs, n = np.unique(np.stack([row, bucket]), axis=1, return_counts=True)
            at = np.searchsorted(pairs[0], np.arange(t.n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(good), pa.array(t.words.astype(np.int64)), pa.ListArray.from_arrays(at, pairs[1]), pa.ListArray.from_arrays(at, n.astype(np.int64))],
                names=["key", "good", "words", "buckets", "counts"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    order = F.struct((F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"), F.xxhash64("text").alias("h"), "text")
    rows = rows.groupBy("key").agg(F.min(order).alias("first")).select("key", "first.text")
    schema = f"key {docs.schema[key].dataType.simpleString()}, good double, words bigint, buckets array<bigint>, counts array<bigint>"
    got = rows.mapInArrow(run, schema).filter("words > 0").orderBy("key").toArrow().combine_chunks()
    if not got.num_rows:
        return labels, fit_scorer(*[np.zeros(0, np.int64)] * 5)
    lists, counts = got.column("buckets").combine_chunks(), got.column("counts").combine_chunks()
    row = np.repeat(np.arange(got.num_rows), np.diff(lists.offsets.to_numpy()))
    return labels, fit_scorer(row, lists.values.to_numpy(), counts.values.to_numpy(), got.column("words").to_numpy(), got.column("good").to_numpy())


def score_quality(docs: DataFrame, labels, scorer, key: str = "doc_id", text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """key, weak_label (posterior of the votes), score (probability of good text by the scorer) and kept of every row.

    Texts without words, null ones too, have score zero and are not kept. Repeated rows and null keys are each judged.
    """
    weights, bias = scorer

    def run(batches):
        for part, texts in sliced(batches):
            t = Texts(texts)
            row, bucket = t.features()
            score = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[bucket], t.n) / np.maximum(t.words, 1) + bias, -500, 500)))
            score = np.where(t.words > 0, score, 0.0)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(posterior(t.votes(), *labels)), pa.array(score), pa.array(score >= min_score)], names=["key", "weak_label", "score", "kept"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, weak_label double, score double, kept boolean").withColumnRenamed("key", key)


@corpus_query("op10_weak_label_quality")
def weak_label_quality(spark, sf_dir):
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, *fit_quality(docs))
