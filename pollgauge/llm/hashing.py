"""Vectorised hashing of segments of text, for batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
# A random number for each byte value, from a fixed seed.
BYTE = np.random.default_rng(20_240_101).integers(1, 2**63, 256, dtype=np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        p = np.full(max(n, 2 * len(_powers[name])), base, np.uint64)
        p[0] = 1
        _powers[name] = np.cumprod(p)
    return _powers[name][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end] of a byte array; equal segments have equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum(BYTE[data] * _power("up", BASE, len(data)))]
    return mixed((sums[ends] - sums[starts]) * _power("down", INVERSE, len(data))[starts])


def shingle_digests(text: str | None, shingle: int, seed: int = 42) -> bytes:
    """The 8-byte hashes of a text's shingles of words, one after the other; a shorter text is one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return b""
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle, len(words))
    digest = xxhash.xxh64_digest
    return b"".join([digest(line[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist())])


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edges[::2], edges[1::2]


def joined(texts: list[str | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """All texts as bytes, a line feed behind each, and where each text ends; nulls are empty."""
    parts = [((t or "").lower() if lower else (t or "")).encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, np.int64)
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), ends


def sliced(batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = 300_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cut batches into pieces of about `chars` characters (one text at least), each with its texts."""
    for batch in batches:
        column, start, held, size = batch.column(text), 0, [], 0
        for i in range(batch.num_rows):
            held.append(column[i].as_py())
            size += len(held[-1] or "")
            if size >= chars or i == batch.num_rows - 1:
                yield batch.slice(start, i + 1 - start), held
                start, held, size = i + 1, [], 0
