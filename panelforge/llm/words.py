"""Words of texts as bytes and their hashes, vectorised per document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_MASK = (1 << 64) - 1
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Entries of a worker's word cache before it starts afresh (bounds memory, not results).
CACHE_ENTRIES = 100_000


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(i: int) -> np.uint64:
    z = (0x9E3779B97F4A7C15 * (i + 1)) & _MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    return np.uint64(z | 1)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k consecutive word hashes (empty if fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, (int(_GOLDEN) * k) & _MASK, np.uint64)
    for j in range(k):
        out += h[j : j + n] * _odd(j + 64 * (k % 1024))
    return mix(out)


def rolling_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k word hashes by prefix sums of powers: O(n) for any k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = 0xD1342543DE82EF95
    inv = pow(base, -1, 1 << 64)
    up = _powers(base, len(h))
    down = _powers(inv, len(h))
    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + _GOLDEN) * up)])
    return mix((s[k:] - s[:-k]) * down[:n])


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        full = np.full(size, base, np.uint64)
        full[0] = 1
        have = np.cumprod(full)
        if size <= 1 << 20:
            _POWERS[base] = have
    return have[:n]


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; fewer words make one shingle; none make none."""
    if not len(h):
        return np.empty(0, np.uint64)
    got = np.sort(window_hashes(h, min(k, len(h))))
    return got[np.concatenate([[True], got[1:] != got[:-1]])]


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
