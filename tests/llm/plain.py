"""Plain forms of the hashes that operators vectorise, one byte at a time."""

from pollgauge.llm.hashing import BASE, BYTE

WORD = (1 << 64) - 1


def spread(h: int) -> int:
    # The multipliers of the 64-bit finaliser.
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> 33)) * factor & WORD
    return h ^ (h >> 33)


def plain_hash(data: bytes) -> int:
    return spread(sum(int(BYTE[b]) * pow(int(BASE), i, 1 << 64) for i, b in enumerate(data)) & WORD)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h
