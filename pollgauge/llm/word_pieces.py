"""Word BPE encoding and decoding with a lexicon compiled into a minimal acyclic transducer.

The frequent words of a corpus and the ids they merge into are compiled once into an automaton: states with equal
futures are one state, so words share suffixes as well as prefixes, and ids sit as early on a path as all its words
agree on them. The automaton is a few flat arrays in one file that Spark hands to every executor and that workers map
into memory, so it is held once for each machine. A batch of words walks it together, one byte in each step. Words
that it does not hold are merged exactly, pair by pair, so the lexicon decides only how fast a word is encoded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import tempfile
import unicodedata
import uuid
from collections import Counter
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollgauge.llm.hashing import sliced
from pollgauge.llm.registry import corpus_query, table

LEXICON_WORDS = 131_072  # bound on the words of the automaton, which every machine holds
LEAST_COUNT = 2  # occurrences from which a word is worth a place
WORD_BYTES = 64  # longer words are merged whenever they come
COUNTED = 250_000  # distinct words that a task counts before it hands them on
SHORT = 32  # bytes up to which unseen words are merged together
END = "</w>"
# The tokenizer's own split pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Below this, Python and the tokenizer agree on lower case and on the classes of characters (checked in the tests).
COMMON = "Ԁ"


def byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(0x100 + rest.index(b)) for b in range(256)]


def written_out(end: int) -> re.Pattern:
    """PATTERN for lower-case characters below `end`, with its classes written out, which the plain module matches faster."""
    import regex

    signs = [chr(c) for c in range(end)]
    letter, number, space = ("".join(map(re.escape, filter(regex.compile(c).match, signs))) for c in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(f"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{number}]|[^{space}{letter}{number}]+")


class WordModel:
    """Vocabulary, merges and special tokens of a word BPE model, and its exact merges."""

    def __init__(self, file: str):
        import regex
        from tokenizers import Tokenizer

        data = json.loads(Path(file).read_text(encoding="utf-8"))
        model = data["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or model["dropout"] or data["post_processor"] or data["decoder"]:
            raise ValueError("not a word BPE model with word ends and no decoder")
        vocab = model["vocab"]
        signs = byte_signs()
        self.inner = [vocab[s] for s in signs]
        self.final = [vocab[s + END] for s in signs]
        self.merge = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        keys = np.array([a << 20 | b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        self.pair_ids = np.zeros(len(model["merges"]), np.int64)
        for r, new in self.merge.values():
            self.pair_ids[r] = new
        self.inner_ids, self.final_ids = np.array(self.inner, np.int64), np.array(self.final, np.int64)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ascii, self.common = written_out(0x80), written_out(ord(COMMON))
        # Normaliser and splitter of the tokenizer, for texts with rare characters, whose classes differ between versions of Unicode.
        whole = Tokenizer.from_file(file)
        self.normalise, self.split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str

    def _pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text.lower())
        if max(text) < COMMON:
            lower = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            if max(lower) < COMMON:  # composed and lower-case forms may lie beyond
                return self.common.findall(lower)
        normal = self.normalise(text)
        return [normal[a:b] for _, (a, b) in self.split(normal)]

    def words(self, text: str) -> list[str]:
        """The words of a text in order; special tokens stand as they are."""
        if self.marks is None or "<|" not in text:
            return self._pieces(text)
        out = []
        for i, part in enumerate(self.marks.split(text)):
            out.extend([part] if i % 2 else self._pieces(part))
        return out

    def merged(self, word: bytes) -> list[int]:
        """The ids of a word: the pair of the best rank is merged, leftmost first, until none is left. Pairs are in a heap, symbols in a linked list."""
        ids = [self.inner[b] for b in word[:-1]] + [self.final[word[-1]]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merge, heap = self.merge, []
        for i in range(n - 1):
            if m := merge.get((ids[i], ids[i + 1])):
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merge.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merge.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    def merged_together(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of many words: in each round every word merges its best pair, leftmost first."""
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        out: list = [None] * len(words)
        for i, w in enumerate(words):
            if len(w) > SHORT:
                out[i] = np.array(self.merged(w), np.int32)
        if not short:
            return out
        size = np.fromiter((len(words[i]) for i in short), np.int64, len(short))
        width = int(size.max()) + 1
        inside = np.arange(width) < size[:, None]
        raw = np.frombuffer(b"".join(words[i] for i in short), np.uint8)
        ids = np.full((len(short), width), -1, np.int64)
        ids[inside] = self.inner_ids[raw]
        rows = np.arange(len(short))
        ids[rows, size - 1] = self.final_ids[raw[np.cumsum(size) - 1]]
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        live, cells = rows, np.arange(width - 1)
        while len(live):
            at = rank[live].argmin(1)
            best = rank[live, at]
            some = best < len(self.pair_ids)
            live, at, best = live[some], at[some], best[some]
            if not len(live):
                break
            # Cells behind the pair move one to the left; only the pairs on either side of the new symbol change.
            source = cells + (cells > at[:, None])
            ids[live, at] = self.pair_ids[best]
            ids[live, :-1] = np.take_along_axis(ids[live], source, 1)
            rank[live] = np.take_along_axis(np.pad(rank[live], ((0, 0), (0, 1)), constant_values=len(self.pair_ids)), source, 1)
            rank[live, at] = self.ranks(ids[live, at], ids[live, at + 1])
            before = at > 0
            rank[live[before], at[before] - 1] = self.ranks(ids[live[before], at[before] - 1], ids[live[before], at[before]])
            ids[live, -1] = -1
        kept = ids >= 0
        for i, x in zip(short, np.split(ids[kept].astype(np.int32), np.cumsum(kept.sum(1))[:-1])):
            out[i] = x
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; the number of merges where they do not merge."""
        key = left << 20 | right & 0xFFFFF
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], len(self.pair_ids))

    def encode(self, texts: list[str | None], lexicon: Lexicon | None) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.words(t or "") for t in texts]
        every = list(chain.from_iterable(split))
        place = {w: i for i, w in enumerate(dict.fromkeys(every))}
        flat = np.fromiter(map(place.__getitem__, every), np.int64, len(every))
        distinct = [w.encode("utf-8", "surrogatepass") for w in place]
        if lexicon is None:
            found, sizes, values = np.zeros(len(distinct), bool), np.zeros(len(distinct), np.int64), np.zeros(0, np.int32)
        else:
            found, sizes, values = lexicon.look_up(distinct)
        at = np.cumsum(sizes) - sizes
        more, end = [values], len(values)
        unseen = np.flatnonzero(~found).tolist()
        for i, ids in zip(unseen, self.merged_together([distinct[i] for i in unseen])):
            special = self.special.get(distinct[i].decode("utf-8", "replace")) if distinct[i].startswith(b"<|") else None
            ids = ids if special is None else np.array([special], np.int32)
            at[i], sizes[i] = end, len(ids)
            end += len(ids)
            more.append(ids)
        values = np.concatenate(more)
        count = sizes[flat]
        ends = np.cumsum(count)
        ids = values[np.repeat(at[flat] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.r_[0, ends][np.cumsum([len(words) for words in split])]
        return np.split(ids, cuts[:-1]) if len(cuts) else []

    def decode(self, ids) -> str:
        """The tokens of the ids, word ends and special tokens included, with one space between."""
        ids = np.asarray(ids, np.int64)
        held = (ids >= 0) & (ids < len(self.tokens))
        return " ".join(map(self.tokens.__getitem__, (ids if held.all() else ids[held]).tolist()))


class Builder:
    """Minimal transducer from words in byte order, each with its ids: states are frozen once no later word can change them."""

    def __init__(self):
        self.register: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.path = [self._new()]
        self.word = b""

    @staticmethod
    def _new() -> list:
        return [{}, None]  # byte -> [ids, state], ids of a word that ends here or None

    def _freeze(self, down_to: int) -> None:
        while len(self.path) > down_to + 1:
            arcs, last = self.path.pop()
            form = (last, tuple((b, ids, to) for b, (ids, to) in arcs.items()))
            number = self.register.get(form)
            if number is None:
                number = self.register[form] = len(self.states)
                self.states.append(form)
            self.path[-1][0][self.word[len(self.path) - 1]][1] = number

    def add(self, word: bytes, ids: tuple[int, ...]) -> None:
        shared = 0
        while shared < min(len(word), len(self.word)) and word[shared] == self.word[shared]:
            shared += 1
        if self.word and (shared == len(word) or word[shared:] < self.word[shared:]):
            raise ValueError("words must be distinct and in byte order")
        self._freeze(shared)
        for k in range(shared):
            # An arc keeps the ids on which all its words agree; the rest moves on behind it.
            arc = self.path[k][0][word[k]]
            same = 0
            while same < min(len(arc[0]), len(ids)) and arc[0][same] == ids[same]:
                same += 1
            if moved := arc[0][same:]:
                arc[0] = arc[0][:same]
                state = self.path[k + 1]
                for other in state[0].values():
                    other[0] = moved + other[0]
                if state[1] is not None:
                    state[1] = moved + state[1]
            ids = ids[same:]
        for k in range(shared, len(word)):
            self.path[k][0][word[k]] = [ids if k == shared else (), None]
            self.path.append(self._new())
        self.path[-1][1] = () if shared < len(word) else ids
        self.word = word

    def save(self, path: str) -> None:
        """Close the automaton and write it as one file of flat arrays; the root is the last state."""
        self._freeze(0)
        arcs, last = self.path[0]
        self.states.append((last, tuple((b, ids, to) for b, (ids, to) in arcs.items())))
        pool, places = [], {}

        def put(ids: tuple[int, ...]) -> int:
            if ids not in places:
                places[ids] = len(pool)
                pool.extend(ids)
            return places[ids]

        keys, targets, outs, sizes, ends = [], [], [], [], []
        for number, (last, listed) in enumerate(self.states):
            for b, ids, to in sorted(listed):
                keys.append(number << 8 | b)
                targets.append(to)
                outs.append(put(ids))
                sizes.append(len(ids))
            ends.append((-1, 0) if last is None else (put(last), len(last)))
        parts = [keys, targets, outs, sizes, [e for e, _ in ends], [n for _, n in ends], pool]
        with open(path, "wb") as f:
            np.array([len(p) for p in parts], "<i8").tofile(f)
            for p in parts:
                np.array(p, "<i4").tofile(f)


class Lexicon:
    """A transducer file mapped into memory."""

    def __init__(self, path: str):
        sizes = np.fromfile(path, "<i8", 7)
        whole = np.memmap(path, "<i4", "r", offset=56, shape=(int(sizes.sum()),))
        self.keys, self.targets, self.outs, self.sizes, self.end_outs, self.end_sizes, self.pool = np.split(whole, np.cumsum(sizes)[:-1])
        self.root = len(self.end_outs) - 1

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is held, how many ids it has, and all ids one after the other; all words walk a byte at a time."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(length) - length
        slot = start + np.arange(len(words))  # a place for each byte and one for the end of each word
        out_at, out_n = np.zeros(int((length + 1).sum()), np.int64), np.zeros(int((length + 1).sum()), np.int64)
        found = (length > 0) & (length <= WORD_BYTES)
        if not len(self.keys):
            found[:] = False
        live, state, step = np.flatnonzero(found), np.full(len(words), self.root, np.int64), 0
        while len(live):
            ending = live[length[live] == step]
            if len(ending):
                at = self.end_outs[state[ending]]
                found[ending[at < 0]] = False
                out_at[slot[ending] + step], out_n[slot[ending] + step] = at, self.end_sizes[state[ending]]
                live = live[length[live] > step]
                if not len(live):
                    break
            key = state[live] << 8 | raw[start[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            goes = self.keys[arc] == key
            found[live[~goes]] = False
            live, arc = live[goes], arc[goes]
            out_at[slot[live] + step], out_n[slot[live] + step] = self.outs[arc], self.sizes[arc]
            state[live] = self.targets[arc]
            step += 1
        out_n[~np.repeat(found, length + 1)] = 0
        ends = np.cumsum(out_n)
        values = self.pool[np.repeat(out_at - (ends - out_n), out_n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return found, np.add.reduceat(out_n, slot) if len(words) else out_n, values.astype(np.int32)


@lru_cache(maxsize=2)
def word_model(file: str | None) -> WordModel:
    if file is None:
        import public_tokenizers

        file = public_tokenizers.path("word_bpe_49k.json")
    return WordModel(file)


@lru_cache(maxsize=2)
def lexicon_of(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def word_counts(df: DataFrame, model_file: str | None = None, text: str = "text") -> DataFrame:
    """word, n: occurrences of every word over all rows; words of more than WORD_BYTES bytes and special tokens are left out."""

    def table_of(counts: Counter) -> pa.RecordBatch:
        kept = {w: n for w, n in counts.items() if len(w.encode("utf-8", "surrogatepass")) <= WORD_BYTES}
        return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        model, counts = word_model(model_file), Counter()
        for _, texts in sliced(batches):
            for t in texts:
                counts.update(model.words(t or ""))
            for s in model.special:
                counts.pop(s, None)
            if len(counts) >= COUNTED:
                yield table_of(counts)
                counts.clear()
        yield table_of(counts)

    return df.select(F.col(text).alias("text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(df: DataFrame, model_file: str | None = None, text: str = "text", words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of all rows, `words` at most, and give the file to all executors; returns its name."""
    spark = df.sparkSession
    frequent = word_counts(df, model_file, text).filter(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), "word").limit(words).select("word")
    model, builder = word_model(model_file), Builder()
    listed = sorted(w.encode("utf-8", "surrogatepass") for w in frequent.toArrow().column("word").to_pylist())
    for word, ids in zip(listed, model.merged_together(listed)):
        builder.add(word, tuple(ids.tolist()))
    path = Path(tempfile.mkdtemp(prefix="pollgauge-lexicon-")) / f"lexicon-{uuid.uuid4().hex[:12]}.bin"
    builder.save(str(path))
    spark.sparkContext.addFile(str(path))  # served by the driver, also to executors that come later
    return path.name


def encoded(batches, lexicon: str | None, model_file: str | None):
    """Keys, ids and decoded texts of batches of (key, text), slice by slice."""
    model, held = word_model(model_file), lexicon_of(lexicon) if lexicon else None
    for batch, texts in sliced(batches):
        ids = model.encode(texts, held)
        yield batch.column("key"), ids, [model.decode(x) for x in ids]


def encode_texts(df: DataFrame, lexicon: str | None = None, model_file: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key, `ids` and `decoded`.

    Null texts count as empty and give no ids; a null key is kept; repeated rows and texts of any length are encoded
    whole; an empty table gives no rows. Other columns are left out, so their names cannot clash. `lexicon` is the name
    that `compile_lexicon` returned; without one every word is merged, with the same result.
    """
    fields = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for keys, ids, decoded in encoded(batches, lexicon, model_file):
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(decoded, pa.string())], names=["key", "ids", "decoded"])

    rows = fields.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, ids array<int>, decoded string")
    return rows.withColumnRenamed("key", key)


def token_digests(df: DataFrame, lexicon: str | None = None, model_file: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, `n_tokens`, `ids_sha256` (decimal ids, one space between) and `decoded_sha256` of each row."""
    fields = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        signs: list[str] = []
        digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for keys, ids, decoded in encoded(batches, lexicon, model_file):
            signs.extend(map(str, range(len(signs), max((int(x.max(initial=-1)) for x in ids), default=-1) + 1)))
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([digest(" ".join(map(signs.__getitem__, x.tolist()))) for x in ids], pa.string()),
                    pa.array([digest(t) for t in decoded], pa.string()),
                ],
                names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = fields.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return rows.withColumnRenamed("key", key)


@corpus_query("op13_word_pieces")
def word_pieces(spark, sf_dir):
    """Encode and decode every whole document, frequent words by the automaton of the documents' own words."""
    docs = table(spark, sf_dir, "documents")
    return token_digests(docs, compile_lexicon(docs))
