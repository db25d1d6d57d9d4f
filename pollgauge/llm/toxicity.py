"""Toxicity severity by cumulative-link ordinal regression on hashed words and word beginnings.

A document's linear score is one sum of shared word weights; ordered thresholds cut it into grades:
P(grade <= k) = logistic(threshold_k - score). The expected severity is the sum of P(grade > k) over all thresholds.
Weights have an L1 penalty, so the model that tasks receive is a short list of words.

The labels know only toxic or not. Grades of toxic rows come from the amount of evidence: words that the labels tie
to toxicity (a log odds of their rows) are counted in each toxic row, and the terciles of these counts are the
grades 1, 2 and 3. Grade 0 is not toxic. The fit takes as many toxic rows as others, and the thresholds are then
moved to the share that toxic rows have among all labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollgauge.llm.hashing import joined, mixed, runs, segment_hashes, sliced
from pollgauge.llm.registry import corpus_query, table
from pollgauge.session import materialise

FIT_ROWS = 3_000  # bound on the rows of either label that the model is fitted on, chosen by a hash of the key
BEGINNINGS = (4, 5, 6, 7)  # bytes of a longer word that are features beside the word
SCREEN = 1.0  # log odds, either way, from which a feature takes part in the fit
GRADES = 3
MIN_ROWS = 3  # rows that a word must occur in
EVIDENCE = 3.0  # log odds from which a word counts as evidence for the grades
L1 = 2e-4
STEPS = 300
CUT = 0.3  # P(grade > 0) from which a document is toxic

# Letters, digits and all bytes of longer characters.
LETTERS = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])


def word_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every word and every word beginning, lower-cased."""
    data, ends = joined(texts, lower=True)
    starts, stops = runs(LETTERS[data])
    row = np.searchsorted(ends, starts, "right")
    rows, keys = [row], [segment_hashes(data, starts, stops)]
    for n in BEGINNINGS:
        long = stops - starts > n
        rows.append(row[long])
        keys.append(mixed(segment_hashes(data, starts[long], starts[long] + n) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


@dataclass
class OrdinalModel:
    words: np.ndarray  # sorted word hashes with a weight
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of texts; one without words is below every threshold."""
        row, word = word_keys(texts)
        out = np.where(np.bincount(row, minlength=len(texts)) > 0, 0.0, -np.inf)
        if not len(self.words) or not len(word):
            return out
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        hit = self.words[at] == word
        pairs, n = np.unique(np.stack([row[hit], at[hit]]), axis=1, return_counts=True)
        np.add.at(out, pairs[0], self.weights[pairs[1]] * np.log1p(n))
        return out

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold k."""
        return logistic(scores[:, None] - self.thresholds[None, :])


def logistic(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


def odds_of(row, col, n_words: int, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of each word's rows being bad against other rows, and its number of rows."""
    with_bad, with_all = np.bincount(col, bad[row], n_words), np.bincount(col, minlength=n_words)
    odds = np.log((with_bad + 0.5) / (bad.sum() + 1)) - np.log((with_all - with_bad + 0.5) / ((~bad).sum() + 1))
    return odds, with_all


def fit_ordinal(row, word, count, grade: np.ndarray, grades: int = GRADES, l1: float = L1, steps: int = STEPS, min_rows: int = MIN_ROWS, screen: float = SCREEN) -> OrdinalModel:
    """Fit shared weights and ordered thresholds by proximal Adagrad on all rows at once.

    `row`, `word`, `count` list the words of each row. Words of few rows, and words that rows above grade 0 have as
    often as others, take no part. With no rows, or rows of one grade only, every score is zero.
    """
    n = len(grade)
    present = np.array([(grade > k).sum() for k in range(grades)], float)
    start = -np.log((present + 0.5) / (n - present + 0.5)) if n else np.full(grades, 3.0) + np.arange(grades)
    start = np.maximum.accumulate(start + 1e-3 * np.arange(grades))
    if n == 0 or present[0] in (0, n):
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), start)
    words, col = np.unique(word, return_inverse=True)
    odds, rows_with = odds_of(row, col, len(words), grade > 0)
    often = (rows_with >= min_rows) & (np.abs(odds) >= screen)
    keep = often[col]
    words, col = words[often], (np.cumsum(often) - 1)[col[keep]]
    row, x = row[keep], np.log1p(count[keep])
    order = np.argsort(row, kind="stable")
    row, col, x = row[order], col[order], x[order]
    w, g2 = np.zeros(len(words)), np.full(len(words), 1e-8)
    first, gaps = start[0], np.log(np.maximum(np.diff(start), 1e-3))
    t2 = np.full(grades, 1e-8)
    low, high = np.maximum(grade - 1, 0), np.minimum(grade, grades - 1)
    for _ in range(steps):
        theta = first + np.r_[0, np.cumsum(np.exp(gaps))]
        s = np.bincount(row, x * w[col], n) if len(col) else np.zeros(n)
        upper = np.where(grade == grades, 1.0, logistic(theta[high] - s))
        lower = np.where(grade == 0, 0.0, logistic(theta[low] - s))
        p = np.maximum(upper - lower, 1e-12)
        slope = 1 - upper - lower  # of the loss by the score
        gw = np.bincount(col, x * slope[row], len(words)) / n if len(col) else np.zeros(0)
        g2 += gw * gw
        rate = 0.5 / np.sqrt(g2)
        w = w - rate * gw
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        gt = np.zeros(grades)
        np.add.at(gt, high[grade < grades], -(upper * (1 - upper) / p)[grade < grades])
        np.add.at(gt, low[grade > 0], (lower * (1 - lower) / p)[grade > 0])
        gt /= n
        inner = np.cumsum(gt[::-1])[::-1]
        step = np.r_[inner[0], inner[1:] * np.exp(gaps)]
        t2 += step * step
        move = 0.2 * step / np.sqrt(t2)
        first, gaps = first - move[0], np.clip(gaps - move[1:], -6, 4)
    theta = first + np.r_[0, np.cumsum(np.exp(gaps))]
    used = w != 0
    return OrdinalModel(words[used], w[used], theta)


def graded(row, word, count, toxic: np.ndarray, grades: int = GRADES, evidence: float = EVIDENCE, min_rows: int = MIN_ROWS) -> np.ndarray:
    """Grades 0..grades of labelled rows; see the head of this module."""
    grade = np.zeros(len(toxic), np.int64)
    bad = toxic == 1
    if not bad.any():
        return grade
    words, col = np.unique(word, return_inverse=True)
    odds, rows_with = odds_of(row, col, len(words), bad)
    telling = (odds >= evidence) & (rows_with >= min_rows)
    hits = np.bincount(row, count * telling[col], len(toxic))
    some = bad & (hits > 0)
    grade[bad] = 1
    if some.any():
        cuts = np.quantile(hits[some], [k / grades for k in range(1, grades)])
        grade[some] = 1 + (hits[some][:, None] > cuts[None, :]).sum(1)
    return grade


def labelled_words(docs: DataFrame, labels: DataFrame, key: str, text: str, fit_rows: int) -> tuple:
    """Words of a bounded number of labelled rows, for the fit: arrays row, word, count, and the label of each row.

    A key with several labels is toxic if one of them says so; one with several rows has the row whose text has the
    smallest hash, so the bound on keys bounds the rows. Also returns the log odds of toxic among all labels.
    """
    every = materialise(labels.filter(F.col("toxic").isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max("toxic").alias("toxic")), "labelled")
    n, bad = every.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    some = lambda toxic: every.filter(F.col("toxic") == toxic).orderBy(F.xxhash64(key), key).limit(fit_rows)
    chosen = materialise(some(0).unionByName(some(1)), "chosen")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen.select(F.col(key).alias("key"), "toxic")), "key")
    rows = rows.groupBy("key", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")).select("key", "toxic", "first.text")

    def run(batches):
        for part, texts in sliced(batches):
            row, word = word_keys(texts)
            words, counts = [], []
            for i in range(len(texts)):
                w, n = np.unique(word[row == i], return_counts=True)
                words.append(w), counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("toxic").cast(pa.int32()), pa.array(words, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))],
                names=["key", "toxic", "words", "counts"],
            )

    schema = f"key {docs.schema[key].dataType.simpleString()}, toxic int, words array<bigint>, counts array<int>"
    found = materialise(rows.mapInArrow(run, schema), "words")
    # Screened on Spark, so that the driver gets the words that can take part and no others.
    kinds = {r.toxic: r["count"] for r in found.groupBy("toxic").count().collect()}
    with_bad, with_all = F.sum("toxic"), F.count("*")
    odds = F.log((with_bad + 0.5) / (kinds.get(1, 0) + 1)) - F.log((with_all - with_bad + 0.5) / (kinds.get(0, 0) + 1))
    words = found.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(odds.alias("odds"), with_all.alias("n"))
    telling = words.filter((F.col("n") >= MIN_ROWS) & (F.abs("odds") >= SCREEN)).select("word").toArrow()
    kept = np.sort(telling.column("word").to_numpy())

    def screened(batches):
        for batch in batches:
            lists, n = batch.column("words"), batch.column("counts")
            ends, word = lists.offsets.to_numpy(), lists.values.to_numpy()
            hit = np.isin(word, kept)
            at = np.r_[0, np.cumsum(hit)][ends].astype(np.int32)
            columns = [pa.ListArray.from_arrays(at, pa.array(word[hit])), pa.ListArray.from_arrays(at, pa.array(n.values.to_numpy()[hit]))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("toxic"), *columns], names=["key", "toxic", "words", "counts"])

    got = found.mapInArrow(screened, schema).toArrow().combine_chunks()
    prior = float(np.log((bad + 0.5) / (n - bad + 0.5)))
    if not got.num_rows:
        none = np.zeros(0, np.int64)
        return none, none, none, none, prior
    got = got.sort_by([("key", "ascending"), ("toxic", "ascending")]).combine_chunks()
    lists, counts = got.column("words").combine_chunks(), got.column("counts").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(got.num_rows), sizes), lists.values.to_numpy(), counts.values.to_numpy(), got.column("toxic").to_numpy(), prior


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> OrdinalModel:
    """The model of these labels; without labels of both kinds no text is toxic."""
    row, word, count, toxic, prior = labelled_words(docs, labels, key, text, fit_rows)
    model = fit_ordinal(row, word, count, graded(row, word, count, toxic))
    model.thresholds = model.thresholds + float(np.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5))) - prior
    return model


def severity(docs: DataFrame, model: OrdinalModel, key: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """key, expected_severity (0 to the number of thresholds), grade (the likeliest) and toxic of every row.

    Texts without words, null ones too, have severity zero. Rows are judged one by one, repeated ones and null keys too.
    """

    def run(batches):
        for part, texts in sliced(batches):
            above = model.above(model.scores(texts))
            share = -np.diff(np.c_[np.ones(len(above)), above, np.zeros(len(above))], axis=1)
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(above.sum(1)), pa.array(share.argmax(1).astype(np.int32)), pa.array(above[:, 0] >= cut)],
                names=["key", "expected_severity", "grade", "toxic"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, expected_severity double, grade int, toxic boolean").withColumnRenamed("key", key)


def drop_toxic(docs: DataFrame, model: OrdinalModel, text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of `docs`, all columns, that are not toxic; decided row by row without a shuffle."""

    def run(batches):
        for part, texts in sliced(batches, text):
            yield part.filter(pa.array(model.above(model.scores(texts))[:, 0] < cut))

    return docs.mapInArrow(run, docs.schema)


@corpus_query("op2_toxicity_severity")
def toxicity_severity(spark, sf_dir):
    """Severity of every document."""
    docs = table(spark, sf_dir, "documents")
    return severity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
