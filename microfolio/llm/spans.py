"""Content-chosen spans of byte strings.

Every ``width``-byte window of a text is assigned to the place of its smallest ``seed``-byte hash
(ties: the leftmost). The choice depends on the bytes of the window alone, so equal windows choose
equal places. Neighbouring windows mostly share their place; a run of them is one span. A text of
n bytes has about 2 n / (width - seed) spans instead of n windows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

PLACE_BITS = np.uint64(30)


class _Roll:
    """Polynomial hashes of all substrings of one buffer, modulo 2^64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, salt: int) -> None:
        table, base = self._constants(salt)
        power, inverse = self._power(salt, base, len(data) + 1)
        self.inverse = inverse
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * power[: len(data)], out=self.prefix[1:])

    @staticmethod
    @lru_cache(8)
    def _constants(salt: int) -> tuple[np.ndarray, int]:
        rng = np.random.default_rng(salt)
        return rng.integers(0, 2**64, 256, dtype=np.uint64), int(rng.integers(1, 2**62)) * 2 + 1

    @classmethod
    def _power(cls, salt: int, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(salt)
        if have is None or len(have[0]) < n:
            n = max(n, 1 << 20)
            grow = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64)
            have = cls._powers[salt] = (grow(base), grow(pow(base, -1, 2**64)))
        return have

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def all(self, k: int) -> np.ndarray:
        n = len(self.prefix) - k
        return (self.prefix[k:] - self.prefix[:n]) * self.inverse[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by prefix and suffix minima of blocks of w."""
    n = len(values) - w + 1
    blocks = -(-len(values) // w)
    padded = np.full(blocks * w, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def find(data: np.ndarray, starts: np.ndarray, width: int, seed: int):
    """Spans of the texts that lie one after another in ``data``; ``starts`` has their bounds.

    Returns (text number, first window's place in the text, windows, place of the seed after the
    first window's start, seed hash, content hash); a span covers windows + width - 1 bytes.
    """
    none = (np.zeros(0, np.int64),) * 6
    lengths = np.diff(starts)
    if not (lengths >= width).any():
        return none
    one, two = _Roll(data, 11), _Roll(data, 23)
    seeds = mixed(one.all(seed))
    place = np.arange(len(seeds), dtype=np.uint64)
    chosen = sliding_min((seeds >> PLACE_BITS << PLACE_BITS) | place, width - seed + 1) & np.uint64((1 << 30) - 1)
    text = np.repeat(np.arange(len(lengths)), np.maximum(lengths - width + 1, 0))
    windows = np.arange(len(text)) + (starts[:-1] - np.r_[0, np.cumsum(np.maximum(lengths - width + 1, 0))[:-1]])[text]
    at = chosen[windows].astype(np.int64)
    edge = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    count = np.diff(np.r_[edge, len(at)])
    first = windows[edge]
    end = first + count + width - 1
    content = mixed(two.of(first, end) + (count.astype(np.uint64) << np.uint64(40))) ^ mixed(one.of(first, end))
    return text[edge], first - starts[text[edge]], count, at[edge] - first, one.of(at[edge], at[edge] + seed).view(np.int64), content.view(np.int64)
