"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from pollgauge.llm import pieces
from pollgauge.llm.pieces import PieceModel, encode_texts, token_digests

FILE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


@pytest.fixture(scope="module")
def model():
    return PieceModel(FILE)


def same(model, library, texts):
    for text, ids in zip(texts, model.encode(texts)[0]):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), repr(text)
        assert model.decode(ids) == library.decode(ids.tolist()), repr(text)


def test_documents(model, library, sf_texts):
    same(model, library, [t for _, t, *_ in sf_texts])


def test_random_texts(model, library):
    rng = random.Random(3)
    signs = "ab ▁eé\n\t①日😀nothi  \x00ananan\r　"
    same(model, library, ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(5000)])
    parts = [library.id_to_piece(i) for i in range(259, 32_000)]
    same(model, library, ["".join(rng.choice(parts).replace("▁", rng.choice([" ", ""])) for _ in range(rng.randint(0, 12))) * rng.randint(1, 3) for _ in range(5000)])


def test_white_space_runs(model, library):
    same(model, library, [a + " " * n + b for n in range(0, 70) for a in ("", "x") for b in ("", "x", "①", "\n")])


def test_long_words(model, library):
    rng = random.Random(4)
    same(model, library, ["a" * 50_000, " " * 50_000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "日本①" * 5_000, "<s></s><unk>" * 500])


def test_pieces_that_merge_alone_are_found(model):
    assert 0 < model.alone.sum() < len(model.alone)


def test_decoding_any_ids(model, library):
    rng = random.Random(5)
    for _ in range(3000):
        ids = [rng.randrange(32_000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(rng.randint(0, 12))]
        assert model.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_word_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(pieces, "WORDS_KEPT", 10)
    model = PieceModel(FILE)
    for k in range(5):
        same(model, library, [f"some words of text number {k} " + " ".join(str(i) for i in range(20))])
        assert len(model.known) <= 60


def test_messy_rows(documents, library):
    rows = [(1, None), (2, ""), (3, "  two  spaces "), (3, "  two  spaces "), (None, "no key"), (4, "word " * 100_000)]
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in token_digests(documents(rows)).collect()), key=str)
    want = []
    for key, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty_table_and_small_batches(documents):
    assert token_digests(documents([])).collect() == []
    got = encode_texts(documents([(i, "ab " * i) for i in range(50)]), batch_chars=10).collect()
    assert sorted(r.doc_id for r in got) == list(range(50)) and all(r.decoded == "ab " * r.doc_id for r in got)
