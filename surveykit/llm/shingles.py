"""Hashed word shingles of whole texts, by numpy on the bytes of a text.

A word's hash has 64 bits, a shingle's mixes those of its words. Two different shingles of a corpus share a hash with
odds of n**2 / 2**65; results are exact up to that.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: bytes for which powers are kept; longer texts have their own
_KEPT = 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)) | np.uint64(1)


#: a factor for each place in a shingle; no sums and differences of them are equal, as those of multiples would be
_ODD = _odd(64, 1)
#: a number for each byte, A-Z as a-z; 0 for the six ASCII blanks alone
_VALUE = _odd(256, 2)
_VALUE[65:91] = _VALUE[97:123]
_VALUE[[0x20, *range(0x09, 0x0E)]] = 0


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BACK, np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_UP, _DOWN = _powers(_KEPT)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word, runs of bytes other than blanks: its bytes as digits of a number, wherever it stands."""
    raw = np.frombuffer(b" %b " % (text or "").encode("utf-8", "surrogatepass"), np.uint8)
    up, down = (_UP, _DOWN) if len(raw) <= _KEPT else _powers(len(raw))
    values = _VALUE[raw]
    inside = values != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    sums = np.cumsum(values * up[: len(raw)], dtype=np.uint64)
    return mixed((sums[edges[1::2]] - sums[edges[::2]]) * down[edges[::2]])


def shingles_of_words(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, in order; of the whole sequence where it is shorter, none without words."""
    if not len(h):
        return np.zeros(0, np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), np.uint64)
    for k in range(min(width, len(h))):
        out += h[k : k + n] * _ODD[k]
    return mixed(out)


def shingles(text: str | None, width: int) -> np.ndarray:
    """``shingles_of_words`` of the words of a text."""
    return shingles_of_words(word_hashes(text), width)
