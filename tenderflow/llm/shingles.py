"""Hashed word shingles of many texts at once, in numpy.

Words are the runs of other bytes between the six ASCII white space characters, A to Z taken as a to z. A word's hash is a polynomial over a
random table of its bytes; a shingle's hash mixes those of its words. All hashes have 64 bits, so two different
shingles of a pair of documents practically never share one.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
#: Bits of the parity signature, a multiple of 64.
BITS = 1024

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """base**i and base**-i modulo 2**64, as far as they were needed."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_BASE, 1 << 16), _powers(_BACK, 1 << 16)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << n.bit_length()
            self.up, self.down = _powers(_BASE, size), _powers(_BACK, size)
        return self.up, self.down


POWERS = Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and for each one the number of its text.

    A text of fewer than five words is one shingle, the whole sequence; a text without words has none.
    """
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    blank = _BLANK[joined]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    first, last = edge[0::2], edge[1::2]
    first = first[: len(last)]
    if len(first) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = POWERS.upto(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTE[joined] * up[: len(joined)], out=sums[1:])
    words = mixed((sums[last] - sums[first]) * down[first])
    doc = np.searchsorted(ends, first, side="right")
    n = np.bincount(doc, minlength=len(texts))
    begin = np.cumsum(n) - n
    # Every word starts a shingle, except the last four of a text; a short text's first word starts its only one.
    place = np.arange(len(words)) - begin[doc]
    size = np.minimum(n, WIDTH)[doc]
    at = np.flatnonzero(place <= n[doc] - size)
    h = size[at].astype(np.uint64) * _MIX
    for j in range(WIDTH):
        step = np.minimum(at + j, len(words) - 1)
        h = np.where(j < size[at], mixed(h ^ words[step]) + np.uint64(j), h)
    own = doc[at]
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[fresh], own[fresh]


def signature(h: np.ndarray) -> np.ndarray:
    """Parity bits of a set: each member flips one. Two sets that differ in k members differ in at most k bits."""
    flips = np.bincount((mixed(h) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def big_signature(h: np.ndarray) -> bytes:
    """Parity bits like those of `signature`, two to four of them for each member."""
    bits = 1 << (2 * len(h) - 1).bit_length()
    flips = np.bincount((mixed(h) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two long signatures differ; the longer one is folded, which keeps it a parity signature."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def least_prefix(n: int, percent: int) -> int:
    """Members in the prefix: any set of at least that similarity shares one of them, whatever the common order."""
    return n - -(-percent * n // 100) + 1 if n else 0
