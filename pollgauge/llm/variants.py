"""Spelling variants: words of a corpus one edit apart, grouped under their frequent form.

The vocabulary is sorted and scanned with one banded edit matrix for each query word. Adjacent words share prefixes:
the rows of a shared prefix are computed once and reused by all words that have it, as the common prefix lengths (LCPs)
of neighbours tell, and a range of words whose shared prefix is already more than one edit away is skipped whole. The
band holds three cells, one on either side of the diagonal. All query words of a task's words are scanned together,
one character deeper in each step, so a step is a few numpy calls.

Work is dealt out so that near words meet without any word meeting the whole vocabulary. Two near words, the shorter
of length m, agree before their first difference p and behind it. For an interval a <= p < b they share their first a
and last m - b characters, which is the key of a group. Each m starts with two intervals; a group with too many words
is dealt again by halves of its interval. An interval of one place leaves two free characters at most, so groups are
bounded by the alphabet whatever the words are. A pair is found only in the group whose interval holds its p, so once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollgauge.llm.registry import corpus_query, table
from pollgauge.session import materialise

LETTERS = re.compile(rb"[a-z\xC0-\xFF]+")  # after A-Z are lower-cased, in Latin-1
MIN_LENGTH, MIN_COUNT = 7, 2
DELETE_EVERY = 31
RATIO = 10  # a form is at least so many times as frequent
GROUP_WORDS = 4096  # words from which a group is dealt again
CHUNK_WORDS = 20_000  # words that a task scans at once
COUNTED = 400_000  # distinct words that a task counts before it hands them on


def text_words(key: int | None, text: str | None, least: int = MIN_LENGTH) -> list[bytes]:
    """The words (Latin-1) of at least `least` letters of a text, those that its key marks with one letter deleted.

    Characters beyond U+00FF are in no word, so they become a question mark. A null key marks nothing.
    """
    raw = (text or "").encode("latin-1", "replace").lower()
    runs = [r for r in LETTERS.findall(raw) if len(r) >= least]
    if key is None:
        return runs
    start, crc = zlib.crc32(b"%d:" % key), zlib.crc32
    if raw.isascii():
        codes = [crc(r, start) for r in runs]
    else:
        codes = [crc(r if r.isascii() else r.decode("latin-1").encode(), start) for r in runs]
    marked = [i for i, h in enumerate(codes) if h % DELETE_EVERY == 0]
    for i in marked:
        r = runs[i]
        at = codes[i] % len(r)
        runs[i] = r[:at] + r[at + 1:]
    return [r for r in runs if len(r) >= least] if marked else runs


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_LENGTH) -> DataFrame:
    """word, n: occurrences of every word over all rows."""

    def table_of(counts):
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        counts = Counter()
        for batch in batches:
            for k, t in zip(batch.column("key"), batch.column("text")):
                counts.update(text_words(k.as_py(), t.as_py(), least))
                if len(counts) >= COUNTED:
                    yield table_of(counts)
                    counts.clear()
        yield table_of(counts)

    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Words:
    """Sorted words as code points, each between a pad and two pads, so that a band may look past both ends."""

    def __init__(self, words: list[str]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.at = np.cumsum(self.size + 3) - self.size - 2
        flat = np.frombuffer("\0".join(words).encode("utf-32-le"), np.int32) if words else np.zeros(0, np.int32)
        ends = np.cumsum(self.size + 1)
        self.chars = np.full(int((self.size + 3).sum()), -1, np.int32)
        inside = np.ones(len(flat), bool)
        inside[ends[:-1] - 1] = False
        self.chars[np.arange(int(self.size.sum())) + np.repeat(self.at - (np.cumsum(self.size) - self.size), self.size)] = flat[inside]

    def shared_prefixes(self) -> np.ndarray:
        """The LCP of every word and the one before it."""
        lcp = np.zeros(len(self.size), np.int64)
        live, k = np.arange(1, len(self.size)), 0
        while len(live):
            live = live[self.chars[self.at[live] + k] == self.chars[self.at[live - 1] + k]]
            live = live[self.size[live] > k]
            k += 1
            lcp[live] = k
        return lcp


def near_pairs(words: Words, lcp: np.ndarray, first: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of words of one group that are one edit apart, first differ in [a, b), and of which the shorter has m characters.

    `first` holds the first word of each group; m, a and b are those of the group; words are sorted within it and
    share a characters. A range of words with a common prefix is a node; a live pair is a node and a query word behind
    the node's start, with the band (cells left of, on and right of the diagonal) of its matrix at the prefix's length.
    """
    n, groups = len(words.size), len(first)
    by_lcp = np.argsort(lcp, kind="stable")
    places = lcp[by_lcp] * n + by_lcp  # (LCP, word) in order: where a node of that prefix length branches
    lo, hi, depth, of = first.copy(), np.r_[first[1:], n], a.copy(), np.arange(groups)
    count = hi - lo
    node, query = np.repeat(np.arange(groups), count), np.arange(n)
    left, on, right = (np.full(n, v, np.int8) for v in (1, 0, 1))
    found_i, found_j = [], []
    while len(query):
        # A word that ends at its node is compared there.
        ends = words.size[lo] == depth
        at = np.flatnonzero(ends[node])
        off = words.size[query[at]] - depth[node[at]]
        near = at[np.where(off == 0, on[at], np.where(off == 1, right[at], np.where(off == -1, left[at], 2))) == 1]
        i, j, g = lo[node[near]], query[near], of[node[near]]
        kept = (i < j) & (np.minimum(words.size[i], words.size[j]) == m[g])
        found_i.append(i[kept])
        found_j.append(j[kept])
        # Children: the node's first word, if it goes on, and every word that shares just the node's prefix with the one before.
        low, high = np.searchsorted(places, depth * n + lo + 1), np.searchsorted(places, depth * n + hi)
        goes_on = (~ends).astype(np.int64)
        children = goes_on + high - low
        base = np.cumsum(children) - children
        total = int(children.sum())
        if not total:
            break
        start = np.empty(total, np.int64)
        start[base[goes_on == 1]] = lo[goes_on == 1]
        size = high - low
        into = np.repeat(base + goes_on - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        start[into] = by_lcp[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        stop = np.empty(total, np.int64)
        stop[:-1] = start[1:]
        last = base + children - 1
        stop[last[children > 0]] = hi[children > 0]
        parent = np.repeat(np.arange(len(lo)), children)
        # One row of the matrix further: every live pair meets every child of its node.
        times = children[node]
        pair = np.repeat(np.arange(len(query)), times)
        child = np.repeat(base[node] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        ahead = query[pair] > start[child]
        pair, child = pair[ahead], child[ahead]
        d = depth[node[pair]]
        q = words.at[query[pair]] + d
        c = words.chars[words.at[start[child]] + d]
        new_left = np.minimum(left[pair] + (c != words.chars[q - 1]), on[pair] + 1)
        new_on = np.minimum(np.minimum(on[pair] + (c != words.chars[q]), right[pair] + 1), new_left + 1)
        # The cell right of the diagonal may lie past the query's end; cells never depend on those to their right.
        past = np.minimum(q + 1, words.at[query[pair]] + words.size[query[pair]] + 1)
        new_right = np.minimum(right[pair] + (c != words.chars[past]), new_on + 1)
        g = of[parent[child]]
        live = (np.minimum(np.minimum(new_left, new_on), new_right) <= 1) & ((new_on > 0) | (d + 1 < b[g]))
        live &= d - words.size[query[pair]] <= 0  # the matrix has gone on at most one character past the query
        pair, child = pair[live], child[live]
        left, on, right = (np.minimum(x[live], 2).astype(np.int8) for x in (new_left, new_on, new_right))
        query = query[pair]
        used, node = np.unique(child, return_inverse=True)
        lo, hi, depth, of = start[used], stop[used], depth[parent[used]] + 1, of[parent[used]]
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, np.int64),) * 2


def _near_of_groups(batches):
    """Near words of every word within its groups, from rows sorted by group and word."""

    def scan(rows: pa.Table):
        word, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        keys = np.stack([rows.column(c).to_numpy() for c in ("m", "a", "b", "g")])
        words = Words(word)
        lcp = words.shared_prefixes()
        new = np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)] | (lcp < keys[1])
        first = np.flatnonzero(new)
        group_size = np.diff(np.r_[first, len(word)])
        wide = np.repeat(group_size > 1, group_size)  # a word alone in its group has no near word there
        if not wide.any():
            return
        if not wide.all():
            yield from scan(rows.filter(pa.array(wide)))
            return
        lcp[first] = 0
        lcp = np.where(new, -1, lcp)  # a group's first word branches off no prefix
        i, j = near_pairs(words, lcp, first, keys[0][first], keys[1][first], keys[2][first])
        if not len(i):
            return
        to, other = np.r_[i, j], np.r_[j, i]
        order = np.lexsort((other, -n[other], to))  # words of a group are in code-point order
        to, other = to[order], other[order]
        at = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        at_n = np.diff(np.r_[at, len(to)])
        yield pa.RecordBatch.from_arrays(
            [pa.array([word[x] for x in to[at]], pa.string()), pa.array(at_n, pa.int64()), pa.array(-n[other[at]], pa.int64()), pa.array([word[x] for x in other[at]], pa.string())],
            names=["word", "n_near", "less", "form"],
        )

    held, size = [], 0

    def whole_groups(done: bool):
        """Scan what is held, up to the start of its last group unless it is the end."""
        rows = pa.Table.from_batches(held).combine_chunks()
        cut = rows.num_rows
        if not done:
            keys = np.stack([rows.column(c).to_numpy() for c in ("m", "a", "b", "g")])
            changes = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0))
            cut = int(changes[-1]) + 1 if len(changes) else 0
        return rows.slice(0, cut), rows.slice(cut).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK_WORDS:
            rows, held = whole_groups(False)
            size = sum(x.num_rows for x in held)
            if rows.num_rows:
                yield from scan(rows)
    if held:
        yield from scan(whole_groups(True)[0])


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows of (word, n, m, a, b) with the hash `g` of what the words of a group share."""
    return rows.withColumn("g", F.xxhash64(F.expr("substring(word, 1, a)"), F.expr("right(word, m - b)")))


def near_words(vocabulary: DataFrame, least: int = MIN_LENGTH, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, n_near, form and form_n of every word of (word, n) with a near word; `form` is its near word of largest n, ties to the smallest."""
    length = F.length("word")
    shorter = F.explode(F.filter(F.array(length, length - 1), lambda m: m >= least)).alias("m")
    rows = vocabulary.select("word", "n", shorter)
    half = F.expr("m div 2").cast("int")
    spans = F.explode(F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), (F.col("m") + 1).alias("b")))).alias("span")
    rows = _keyed(rows.select("word", "n", "m", spans).select("word", "n", "m", "span.a", "span.b"))
    done = []
    while True:
        size = rows.groupBy("m", "a", "b", "g").agg(F.count("*").alias("size"))
        hot = materialise(size.filter((F.col("size") > group_words) & (F.col("b") - F.col("a") > 1)).drop("size"), "hot")
        if hot.isEmpty():
            done.append(rows)
            break
        keys = ["m", "a", "b", "g"]
        done.append(rows.join(hot, keys, "left_anti").select(rows.columns))
        middle = F.expr("(a + b) div 2").cast("int")
        halves = F.explode(F.array(F.struct("a", middle.alias("b")), F.struct(middle.alias("a"), "b"))).alias("span")
        rows = rows.join(hot, keys, "left_semi").select("word", "n", "m", halves).select("word", "n", "m", "span.a", "span.b")
        rows = materialise(_keyed(rows), "halves")
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    keys = [F.col("m"), F.col("a"), F.col("b"), F.col("g")]
    dealt = rows.select("m", "a", "b", "g", "word", "n").repartition(*keys).sortWithinPartitions(*keys, F.expr("substring(word, 1, a)"), "word")
    parts = dealt.mapInArrow(_near_of_groups, "word string, n_near bigint, less bigint, form string")
    best = F.min(F.struct("less", "form"))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots_of(forms: DataFrame) -> DataFrame:
    """word, root of every word of (word, form): the last of the forms that follow. Forms are ever more frequent, so chains are short."""
    roots = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = materialise(roots.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return roots


def spelling_variants(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_LENGTH, count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of at least `least` letters with `count` or more occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; those that the key marks lose a letter.
    Null and empty texts have no words, rows with a null key keep their words whole, repeated rows count as often as
    they come, an empty table gives no rows. Words have any length. Ties between forms go to the smallest in code-point
    order. Other columns are left out.
    """
    vocabulary = materialise(word_counts(df, key, text, least).filter(F.col("n") >= count), "vocabulary")
    near = near_words(vocabulary, least)
    known = F.col("form_n") >= ratio * F.col("n")
    judged = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(known, F.col("form")).alias("form"), F.when(known, F.col("form_n")).alias("form_n"),
    )
    judged = materialise(judged, "judged")
    roots = roots_of(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@corpus_query("op12_spelling_variants")
def variants(spark, sf_dir):
    """Every word of all documents, its near words and its form."""
    return spelling_variants(table(spark, sf_dir, "documents"))
