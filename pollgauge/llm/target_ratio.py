"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Unigrams and bigrams of words fall into hashed buckets. Two multinomials over the buckets are counted, one over half
of the trusted documents and one over all documents, and a document's score is the mean log ratio of its n-grams. The
other half of the trusted documents shows how unseen good texts score: the threshold lies a number of standard
deviations below their mean. Ratios are whole micro-nats, so sums and the threshold are exact. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollgauge.llm.registry import corpus_query, table
from pollgauge.session import materialise

BUCKETS = 1 << 16
DEVIATIONS = 6  # standard deviations of held-out trusted scores that a document may fall below their mean
MIN_RATIO = -0.12  # mean log ratio (nats) from which a document is kept where too few are held out
MIN_WORDS = 50
SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
PLACE_BITS = 20


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _between(lo, hi) -> Column:
    """lo..hi-1 as an array, empty where there is none."""
    return F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def _head(array: str, n: Column) -> Column:
    """The first n elements, none if n is below one."""
    return F.slice(array, 1, F.greatest(n, F.lit(0)))


def _behind(array: str, start: int, n: Column) -> Column:
    """n elements from place `start`, none if n is below one."""
    return F.slice(array, start, F.greatest(n, F.lit(0)))


def _place(key: Column, low: int) -> Column:
    return key.bitwiseAND(F.lit(low)).cast("int")


def _covered(places: Column) -> Column:
    """Words in the 3-word windows that start at the given places."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))


def with_repeat_words(df: DataFrame) -> DataFrame:
    """Adds `n_repeat_words` to rows with `words`: words in 3-word windows that the text holds twice or more.

    Windows are sorted as numbers made of a hash and their place; neighbours with equal hashes are compared word by
    word. Should two different windows ever share a hash, or a text have over a million words, the windows of that
    text are sorted as strings instead.
    """
    low = (1 << PLACE_BITS) - 1
    n = F.size("words")
    df = df.withColumn("__hash", F.transform("words", lambda w: F.xxhash64(w)))
    two = F.zip_with(_head("__hash", n - 2), _behind("__hash", 2, n - 2), lambda a, b: F.xxhash64(a, b))
    windows = F.zip_with(two, _behind("__hash", 3, n - 2), lambda a, b: F.xxhash64(a, b))
    keyed = F.transform(windows, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("bigint")))
    df = df.withColumn("__keys", F.when(n <= low, F.sort_array(keyed)).otherwise(F.expr("cast(array() as array<bigint>)")))
    k = F.size("__keys")
    # Neighbours that differ in their places only; the one behind holds the larger place.
    twice = F.zip_with(_head("__keys", k - 1), _behind("__keys", 2, k - 1), lambda a, b: F.when(F.shiftright(a.bitwiseXOR(b), PLACE_BITS) == 0, F.struct(_place(a, low).alias("a"), _place(b, low).alias("b"))))
    df = df.withColumn("__twice", F.filter(twice, lambda t: t.isNotNull()))
    same = lambda a, b: (F.get("words", a) == F.get("words", b)) & (F.get("words", a + 1) == F.get("words", b + 1)) & (F.get("words", a + 2) == F.get("words", b + 2))
    df = df.withColumn("__places", F.flatten(F.transform("__twice", lambda t: F.array(t["a"], t["b"]))))
    odd = (n > low) | F.exists("__twice", lambda t: ~same(t["a"], t["b"]))
    text = lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    windows = F.when(odd, F.sort_array(F.transform(_between(F.lit(0), n - 2), lambda i: F.struct(text(i).alias("w"), i.alias("i")))))
    df = df.withColumn("__windows", windows)
    pair = F.filter(_between(F.lit(1), F.size("__windows")), lambda k: F.get("__windows", k)["w"] == F.get("__windows", k - 1)["w"])
    exact = F.flatten(F.transform(pair, lambda k: F.array(F.get("__windows", k - 1)["i"], F.get("__windows", k)["i"])))
    count = F.when(F.col("__windows").isNotNull(), _covered(exact)).otherwise(_covered(F.col("__places")))
    return df.withColumn("n_repeat_words", count.cast("bigint")).drop("__hash", "__keys", "__twice", "__places", "__windows")


def with_base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds words (in place of a column of that name), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed. Null texts have no words.

    Write the result before filtering on these columns: Spark pushes a filter into the steps, which then repeat.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.regexp(line, F.lit("[^\\x20\\x09-\\x0D]")))
    df = df.withColumns({"words": words_of(whole), "__lines": lines, "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("bigint")})
    df = df.withColumns({
        "n_words": F.size("words").cast("bigint"),
        "word_chars": F.length(F.array_join("words", "")).cast("bigint"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
    }).drop("__lines")
    df = with_repeat_words(df)
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def grams(buckets: int) -> Column:
    """Buckets of the unigrams and bigrams of `words`."""
    one = F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    n = F.size("words") - 1
    two = F.zip_with(_head("words", n), _behind("words", 2, n), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def bucket_ratios(docs: DataFrame, trusted: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """bucket, micro: log ratio of the two multinomials (add-one smoothed) in millionths, for every bucket.

    `trusted` has the keys of the target, any number of them, so the join is a sort-merge one at every size.
    """
    flagged = docs.select(key, text).join(trusted.select(key).distinct().withColumn("__target", F.lit(1)).hint("merge"), key, "left")
    words = flagged.select(words_of(F.coalesce(F.col(text), F.lit(""))).alias("words"), F.coalesce("__target", F.lit(0)).alias("target"))
    seen = words.select("target", F.explode(grams(buckets)).alias("bucket"))
    counts = materialise(seen.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target")), "buckets")
    raw, target = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    all_buckets = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    shift = math.log((raw + buckets) / (target + buckets))
    ratio = F.log((F.coalesce("target", F.lit(0)) + 1) / (F.coalesce("raw", F.lit(0)) + 1)) + shift
    return all_buckets.select("bucket", F.round(ratio * 1_000_000).cast("bigint").alias("micro"))


def _scored(rows: DataFrame, ratios: Column, buckets: int) -> DataFrame:
    """Adds the number of n-grams and the sum of their ratios to rows with `words`."""
    rows = rows.withColumn("__grams", grams(buckets)).withColumn("__n", F.size("__grams").cast("bigint"))
    return rows.withColumn("__sum", F.aggregate("__grams", F.lit(0).cast("bigint"), lambda a, b: a + F.get(ratios, b)))


def held_out_threshold(scored: DataFrame, held: DataFrame, key: str, min_ratio: float) -> int:
    """Micro-nats below which a document is rejected, from the scores of trusted documents that the target does not hold."""
    scores = scored.filter(F.col("n_words") >= MIN_WORDS).join(held.select(key).distinct(), key, "left_semi").select(F.floor(F.col("__sum") / F.col("__n")).alias("s"))
    n, total, squares = scores.agg(F.count("s"), F.sum("s"), F.sum(F.col("s").cast("decimal(38,0)") * F.col("s"))).first()
    if n < 2:
        return round(min_ratio * 1_000_000)
    return (total - DEVIATIONS * math.isqrt(max(0, n * int(squares) - total * total))) // n


def target_ratio_rules(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, min_ratio: float = MIN_RATIO) -> DataFrame:
    """key, the base counts, `micro_ratio` (mean log ratio in millionths, null without words) and `kept` of every row.

    Half of the trusted keys, by a hash, are the target and half set the threshold.
    Repeated rows count as often as they come; null keys are never trusted. With no trusted rows the target is
    uniform. Other columns are left out.
    """
    half = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(2))
    # One number for each bucket: a table of fixed size, folded into the plan as one array literal.
    listed = [r.micro for r in bucket_ratios(docs, trusted.filter(half == 0), key, text, buckets).orderBy("bucket").collect()]
    ratios = F.split(F.lit(",".join(map(str, listed))), ",").cast("array<bigint>")
    rows = _scored(with_base_counts(docs.select(key, F.col(text).alias("text"))).drop("text"), ratios, buckets)
    counts = [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    # Written: a later filter would be pushed into the steps above and repeat them for every word, and the threshold needs the scores first.
    scored = materialise(rows.select(*counts, "__n", "__sum"), "scored")
    least = held_out_threshold(scored, trusted.filter(half == 1), key, min_ratio)
    kept = ~F.col("base_failed") & (F.col("__sum") >= F.lit(least) * F.col("__n"))
    return scored.select(*counts, kept.alias("kept"), F.when(F.col("__n") > 0, F.floor(F.col("__sum") / F.col("__n"))).alias("micro_ratio"))


def trusted_rows(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """All keys labelled as good."""
    return labels.filter((F.col("quality") == 1) & F.col(key).isNotNull()).select(key).distinct()


@corpus_query("op6_target_ratio")
def target_ratio(spark, sf_dir):
    """Base counts and the target ratio's verdict for every document."""
    trusted = materialise(trusted_rows(table(spark, sf_dir, "labels")), "trusted")
    return target_ratio_rules(table(spark, sf_dir, "documents"), trusted)
