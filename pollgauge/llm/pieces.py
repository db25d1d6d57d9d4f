"""SentencePiece encoding and decoding by vectorised merge rounds.

A batch of texts becomes one flat array of symbols. Every round finds the best pair of each word (a segmented
minimum of pair ranks), merges its leftmost occurrences in all words at once, and compacts the array, until no
word has a pair left. Only distinct words of a batch are merged; the texts are then put together from them.

Why simultaneous merges are exact: the sequential rule takes the best pair, leftmost first. All occurrences of
one piece come before any worse pair, and a new pair that a merge makes can only step in between if it is better
and takes a symbol of another occurrence, so if XY + X is a piece better than XY. Such pieces are found when the
vocabulary is loaded, and only their leftmost occurrence in a word merges in a round. White-space runs, whose
pieces all share one score, come last: there the sequential rule works from the left in whole runs of the longest
piece, and what it does with the rest of a run is a small table.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollgauge.llm.registry import corpus_query, table

SPACE = "▁"
NO_RANK = np.iinfo(np.int64).max
WORDS_KEPT = 200_000  # distinct words that a worker remembers between batches


class PieceModel:
    """Pieces and scores of a BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        is_byte = np.array([sp.is_byte(i) for i in range(n)])
        normal = [i for i in range(n) if i not in special and not is_byte[i]]
        score = {text[i]: sp.get_score(i) for i in normal}
        self.ids = {text[i]: i for i in normal}
        self.byte_ids = np.zeros(256, np.int32)
        for i in np.flatnonzero(is_byte):
            self.byte_ids[int(text[i][1:-1], 16)] = i

        runs = {len(p) for p in score if set(p) == {SPACE}}
        long = [p for p in score if len(p) > 1 and set(p) != {SPACE}]
        if 1 not in runs or any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) for p in long):
            raise ValueError("white space pieces of this model stand inside words")
        if any(p.strip(SPACE) == "" and score[p] > min(score[q] for q in long) for p in score if len(p) > 1):
            raise ValueError("white space runs of this model do not come last")
        # Symbols are the ids of pieces; characters outside the vocabulary get numbers from n on, batch by batch.
        order = sorted(long, key=lambda p: -score[p])
        rank, last = {}, None
        for p in order:
            if last is None or score[p] != score[last]:
                rank[p] = len(rank)
                last = p
            else:
                raise ValueError("two pieces share a score")
        self.size = n
        top = self.longest_run = max(runs)
        parts = [self._run_parts(m, runs) for m in range(2 * top)]
        if any(parts[top + r] != [top] + parts[r] for r in range(top)):
            raise ValueError("white space runs of this model do not fall into runs of the longest piece")
        self.run_parts = [[self.ids[SPACE * k] for k in parts[r]] for r in range(top)]
        self.space, self.top_run = self.ids[SPACE], self.ids[SPACE * top]
        keys, ranks, made = [], [], []
        alone = np.zeros(len(rank), bool)
        for p, r in rank.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is None or b is None:
                    continue
                keys.append(a * n + b)
                ranks.append(r)
                made.append(self.ids[p])
                again = p + p[:cut]
                if rank.get(again, NO_RANK) <= r:
                    alone[r] = True
                again = p[cut:] + p
                if rank.get(again, NO_RANK) <= r:
                    alone[r] = True
        at = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.append(np.array(keys, np.int64)[at], NO_RANK)
        self.pair_ranks = np.append(np.array(ranks, np.int64)[at], NO_RANK)
        self.piece_of_rank = np.array([self.ids[p] for p in rank], np.int64)
        self.alone = alone

        # For decoding: the bytes that each id stands for, white space already a space.
        plain = [b"" if i in special and i != self.unk else " ⁇ ".encode() if i == self.unk else bytes([int(text[i][1:-1], 16)]) if is_byte[i]
                 else text[i].replace(SPACE, " ").encode() for i in range(n)]
        self.is_byte = is_byte
        self.is_control = np.array([i in special and i != self.unk for i in range(n)])
        self.starts_with_space = np.array([not is_byte[i] and text[i].startswith(SPACE) for i in range(n)])
        self.plain_len = np.array([len(b) for b in plain], np.int64)
        self.plain_at = np.concatenate([[0], np.cumsum(self.plain_len)])[:-1]
        self.plain = np.frombuffer(b"".join(plain), np.uint8)
        self.known: dict[str, int] = {}
        self._reset_store()
        probe = "Abé ﬁ 　\t1½  x\n"
        if self.encode([probe])[0][0].tolist() != sp.encode(probe, add_bos=True, add_eos=True):
            raise ValueError("this model normalises texts in a way that is not supported")

    # ---- words

    def _reset_store(self) -> None:
        self.known.clear()
        self.store_ids = np.zeros(0, np.int32)
        self.store_at = np.zeros(1, np.int64)

    def _pair_rank(self, left, right):
        known = (left < self.size) & (right < self.size)
        key = np.where(known, left * self.size + right, -1)
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK)

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, flat, and where each word starts."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, code = np.unique(flat, return_inverse=True)
        ids = np.array([self.ids.get(chr(c), self.size + k) for k, c in enumerate(chars)], np.int64)
        sym, word = ids[code], np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word, done_pos = [], [], []
        pos = np.arange(len(sym))
        rank = np.full(len(sym), NO_RANK)  # of the pair that starts at each symbol
        if len(sym) > 1:
            rank[:-1] = np.where(word[:-1] == word[1:], self._pair_rank(sym[:-1], sym[1:]), NO_RANK)
        while len(sym):
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[heads, len(sym)])
            best = np.repeat(np.minimum.reduceat(rank, heads), sizes)
            open_ = best != NO_RANK
            if not open_.all():  # words without a pair leave the array
                shut = ~open_
                done_sym.append(sym[shut]), done_word.append(word[shut]), done_pos.append(pos[shut])
                sym, word, pos, rank, best = sym[open_], word[open_], pos[open_], rank[open_], best[open_]
                if not len(sym):
                    break
            hit = rank == best
            at = np.flatnonzero(hit)
            # Of overlapping occurrences every second one counts, from the left of each streak.
            streak = np.r_[True, at[1:] != at[:-1] + 1]
            first = np.maximum.accumulate(np.where(streak, np.arange(len(at)), 0))
            take = (np.arange(len(at)) - first) % 2 == 0
            single = self.alone[best[at]]
            if single.any():
                leads = np.r_[True, word[at][1:] != word[at][:-1]]
                take &= ~single | leads
            at = at[take]
            sym[at] = self.piece_of_rank[best[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            sym, word, pos, rank, touched = sym[keep], word[keep], pos[keep], rank[keep], touched[keep]
            # Only pairs with a new symbol have a new rank.
            new = np.flatnonzero(touched | np.r_[touched[1:], False])
            inner = new[new < len(sym) - 1]
            rank[inner] = np.where(word[inner] == word[inner + 1], self._pair_rank(sym[inner], sym[inner + 1]), NO_RANK)
            if len(new) and new[-1] == len(sym) - 1:
                rank[-1] = NO_RANK
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        sym, word, pos = map(np.concatenate, (done_sym, done_word, done_pos))
        order = np.argsort(pos, kind="stable")
        sym, word = self._white_space_runs(sym[order], word[order])
        return self._fall_back(sym, word, chars, len(words))

    @staticmethod
    def _run_parts(length: int, runs: set[int]) -> list[int]:
        """The sequential rule on a white-space run: the leftmost pair that is a piece merges, until none is."""
        parts = [1] * length
        while (at := next((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in runs), None)) is not None:
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _white_space_runs(self, sym, word):
        space = sym == self.space
        inside = space[1:] & space[:-1] & (word[1:] == word[:-1])
        if not inside.any():
            return sym, word
        start = np.flatnonzero(space & ~np.r_[False, inside])
        end = np.flatnonzero(space & ~np.r_[inside, False]) + 1
        kept = np.flatnonzero(~space)
        at, out, owner = [kept], [sym[kept]], [word[kept]]
        for a, b in zip(start.tolist(), end.tolist()):
            whole, rest = divmod(b - a, self.longest_run)
            ids = [self.top_run] * whole + self.run_parts[rest]
            at.append(np.arange(a, a + len(ids)))
            out.append(np.array(ids, np.int64))
            owner.append(np.full(len(ids), word[a]))
        order = np.argsort(np.concatenate(at), kind="stable")
        return np.concatenate(out)[order], np.concatenate(owner)[order]

    def _fall_back(self, sym, word, chars, n_words):
        """Characters outside the vocabulary become the ids of their bytes."""
        odd = np.flatnonzero(sym >= self.size)
        if len(odd):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in chars[sym[odd] - self.size]]
            n = np.ones(len(sym), np.int64)
            n[odd] = [len(b) for b in raw]
            out, word = np.repeat(sym, n), np.repeat(word, n)
            at = np.repeat(np.cumsum(n)[odd] - n[odd], n[odd])
            inside = np.arange(len(at)) - np.repeat(np.cumsum(n[odd]) - n[odd], n[odd])
            out[at + inside] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            sym = out
        ends = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n_words))])
        return sym.astype(np.int32), ends

    # ---- texts

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], int]:
        """Ids of each text with begin and end ids; and how many words were merged for it."""
        spans: list[list[str]] = []
        for text in texts:
            if not text:
                spans.append([])
                continue
            parts = (SPACE + text.replace(" ", SPACE)).split(SPACE)[1:]
            if "" in parts:  # a run of spaces belongs to the word that follows it
                joined, held = [], ""
                for p in parts:
                    held += SPACE
                    if p:
                        joined.append(held + p)
                        held = ""
                if held:
                    joined.append(held)
                spans.append(joined)
            else:
                spans.append([SPACE + p for p in parts])
        if len(self.known) > WORDS_KEPT:
            self._reset_store()
        new = list({w for words in spans for w in words if w not in self.known})
        if new:
            ids, ends = self.merge_words(new)
            base = len(self.known)
            self.known.update((w, base + k) for k, w in enumerate(new))
            self.store_at = np.concatenate([self.store_at, self.store_at[-1] + ends[1:]])
            self.store_ids = np.concatenate([self.store_ids, ids])
        out = []
        for words in spans:
            code = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            starts, sizes = self.store_at[code], self.store_at[code + 1] - self.store_at[code]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            flat = np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
            ids = np.empty(total + 2, np.int32)
            ids[0], ids[-1] = self.bos, self.eos
            ids[1:-1] = self.store_ids[flat]
            out.append(ids)
        return out, len(new)

    def decode(self, ids: np.ndarray) -> str:
        """The text of an id sequence; bytes that form no character become one U+FFFD each."""
        ids = np.asarray(ids, np.int64)
        ids = ids[~self.is_control[ids]]
        if not len(ids):
            return ""
        sizes = self.plain_len[ids]
        ends = np.cumsum(sizes)
        flat = np.arange(int(ends[-1])) + np.repeat(self.plain_at[ids] - (ends - sizes), sizes)
        raw = self.plain[flat].tobytes()[int(self.starts_with_space[ids[0]]):]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            pass
        out, rest = [], raw
        while rest:
            try:
                out.append(rest.decode("utf-8"))
                break
            except UnicodeDecodeError as e:
                out.append(rest[: e.start].decode("utf-8") + "�")
                rest = rest[e.start + 1:]
        return "".join(out)


@lru_cache(maxsize=2)
def piece_model(model_file: str) -> PieceModel:
    return PieceModel(model_file)


def encode_texts(df: DataFrame, model_file: str | None = None, key: str = "doc_id", text: str = "text", batch_chars: int = 1_000_000) -> DataFrame:
    """One row per input row: the key, `ids` (with begin and end ids) and `decoded`.

    Null texts count as empty; a null key is kept. Other columns are left out, so their names cannot clash.
    A batch is cut into slices of about `batch_chars` characters, so long texts do not add up.
    The model file is opened by each worker; the public one is used where no path is given.
    """
    fields = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>, decoded string"

    def run(batches):
        import public_tokenizers

        model = piece_model(model_file or public_tokenizers.path("piece_bpe_32k.model"))
        for batch in batches:
            keys = batch.column("key")
            start, held, size = 0, [], 0
            for i, t in enumerate(batch.column("text")):
                held.append(t.as_py())
                size += len(held[-1])
                if size >= batch_chars or i == batch.num_rows - 1:
                    ids = model.encode(held)[0]
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(start, len(held)), pa.ListArray.from_arrays(ends, np.concatenate(ids)), pa.array([model.decode(x) for x in ids], pa.string())],
                        names=[key, "ids", "decoded"],
                    )
                    start, held, size = i + 1, [], 0

    return fields.mapInArrow(run, schema)


def token_digests(df: DataFrame, model_file: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, `n_tokens`, `ids_sha256` (little-endian unsigned 32-bit ids) and `decoded_sha256` of each row."""
    encoded = encode_texts(df, model_file, key, text)

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.array([hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(ends, ends[1:])]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in batch.column("decoded").to_pylist()]),
                ],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


@corpus_query("op3_piece_encoding")
def piece_encoding(spark, sf_dir):
    """Encode and decode every whole document."""
    return token_digests(table(spark, sf_dir, "documents"))
