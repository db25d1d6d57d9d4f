"""Word BPE against the tokenizers library; the transducer against a dictionary."""

import hashlib
import random
import sys
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pollgauge.llm import word_pieces as wp
from pollgauge.llm.registry import table
from pollgauge.llm.word_pieces import Builder, Lexicon, WordModel, compile_lexicon, encode_texts, token_digests, word_counts

FILE = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(FILE)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def model():
    return WordModel(FILE)


def same(model, library, texts, lexicon=None):
    for text, ids in zip(texts, model.encode(texts, lexicon), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, repr(text[:200])
        assert model.decode(ids) == library.decode(want, skip_special_tokens=False), repr(text[:200])


def build(path, entries) -> Lexicon:
    builder = Builder()
    for word, ids in sorted(entries.items()):
        builder.add(word, ids)
    builder.save(str(path))
    return Lexicon(str(path))


def looked_up(lexicon, words):
    found, sizes, values = lexicon.look_up(words)
    ends = np.cumsum(sizes)
    return [tuple(values[e - n:e].tolist()) if f else None for f, e, n in zip(found, ends, sizes)]


def test_documents(model, library, sf_texts):
    same(model, library, [t for _, t, *_ in sf_texts])


def test_random_texts(model, library):
    rng = random.Random(3)
    signs = "abAB'stdre  \n\té É̂ßΣσςİıǅ①½²日本😀\x00\x1c\x85​　-_.!#0 9"
    same(model, library, ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(5000)])
    parts = [t.replace("</w>", " ") for t in library.get_vocab()]
    same(model, library, ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)])


def test_special_tokens_in_texts(model, library):
    a, b = "<|startoftext|>", "<|endoftext|>"
    same(model, library, [a, b + b, f"x{a}y", f"it{b}'s", "<|END|> <|endoftext| >", f"é{a}é́", f"{a} {b}\n{a}A{b}", "<|<|endoftext|>|>"])


def test_all_characters(model, library):
    """Every character, and that the fast way and the library agree below COMMON, also behind combining marks."""
    same(model, library, ["".join(chr(c) + "a1" for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000) for lo in range(0, sys.maxunicode + 1, 64)])
    low = [chr(c) for c in range(ord(wp.COMMON))]
    marks = [c for c in low if unicodedata.combining(c)]
    same(model, library, ["".join(c + m + "x" for m in marks) for c in low if c.isalpha()])


def test_long_words(model, library):
    rng = random.Random(4)
    same(model, library, ["a" * 50_000, "!" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(30_000)), "日本" * 5_000, "<|endoftext|>" * 500])


def test_words_merge_together_as_alone(model):
    rng = random.Random(9)
    parts = [t.removesuffix("</w>").encode() for t in rng.sample(model.tokens[:49_000], 4000)]
    words = [w for w in [a + b for a, b in zip(parts, parts[1:])] + [b"a", b"ab" * 20, b"a" * 32, b"a" * 33, b"banana" * 5, *parts] if w]
    assert [x.tolist() for x in model.merged_together(words)] == [model.merged(w) for w in words]
    assert model.merged_together([]) == []


def test_transducer_holds_what_it_was_given(tmp_path):
    rng = random.Random(6)
    entries = {}
    for _ in range(3000):
        stem, end = "".join(rng.choice("abc") for _ in range(rng.randint(1, 5))), rng.choice(["", "ing", "ed", "er", "ers"])
        entries[(stem + end).encode()] = tuple([*map(ord, stem[:rng.randint(0, 3)]), *([1000 + len(end)] if end else []), rng.randint(0, 3)])
    lexicon = build(tmp_path / "a", entries)
    others = [("".join(rng.choice("abcdeginrs") for _ in range(rng.randint(1, 9)))).encode() for _ in range(3000)]
    words = [*entries, *others, b"", b"x" * 5000, "é".encode()]
    rng.shuffle(words)
    assert looked_up(lexicon, words) == [entries.get(w) for w in words]
    assert looked_up(lexicon, []) == []
    empty = build(tmp_path / "b", {})
    assert looked_up(empty, [b"a", b""]) == [None, None]


def test_transducer_is_minimal(tmp_path):
    """Suffixes are shared: 27 words of 3 letters with equal futures need 4 states; ids that words share sit on their prefix."""
    words = {bytes([a, b, c]): (a,) for a in b"abc" for b in b"abc" for c in b"abc"}
    lexicon = build(tmp_path / "a", words)
    assert len(lexicon.end_outs) == 4 and len(lexicon.keys) == 9
    lexicon = build(tmp_path / "b", {b"walked": (7, 1), b"walking": (7, 2), b"talked": (8, 1), b"talking": (8, 2)})
    assert len(lexicon.end_outs) == len("walking") + 1 + 1  # one path, and one state for the branch of "ed"
    with pytest.raises(ValueError):
        builder = Builder()
        builder.add(b"b", (1,))
        builder.add(b"a", (1,))


def test_known_and_unseen_words(model, library, tmp_path, sf_texts):
    texts = [t for _, t, *_ in sf_texts[:200]]
    words = sorted({w for t in texts for w in model.words(t or "")})
    lexicon = build(tmp_path / "a", {w.encode(): tuple(model.merged(w.encode())) for w in words[::2] if w not in model.special})
    found = lexicon.look_up([w.encode() for w in words])[0]
    assert 0.4 < found.mean() < 0.6
    same(model, library, [t or "" for t in texts], lexicon)


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_messy_rows(documents, library):
    rows = [(1, None), (2, ""), (3, "  Two  spaces's "), (3, "  Two  spaces's "), (None, "no key <|endoftext|>"), (4, "word " * 100_000), (5, "x" * 50_000)]
    df = documents(rows)
    want = sorted([(k, *digests(library, t)) for k, t in rows], key=str)
    for lexicon in (None, compile_lexicon(df), compile_lexicon(df, words=1), compile_lexicon(documents([]))):
        got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in token_digests(df, lexicon).collect()]
        assert sorted(got, key=str) == want


def test_query_on_documents(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in wp.word_pieces(spark, SF).collect()}
    assert got == {r.doc_id: digests(library, r.text) for r in table(spark, SF, "documents").collect()}


def test_frequent_words_over_all_rows(documents):
    df = documents([(1, "the cat the dog <|endoftext|>"), (2, "THE cat " + "z" * 100), (2, None)])
    assert {r.word: r.n for r in word_counts(df).collect()} == {"the": 3, "cat": 2, "dog": 1}


def test_empty_table(documents):
    assert token_digests(documents([]), compile_lexicon(documents([]))).collect() == []
    got = encode_texts(documents([(1, None)])).collect()
    assert got[0].ids == [] and got[0].decoded == ""
