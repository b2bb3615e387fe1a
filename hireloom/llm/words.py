"""Words of whole texts and their hashes, computed over a block of texts at once.

A word is a maximal run of bytes outside space and 0x09-0x0D. In UTF-8 these
bytes never lie inside a character, so the words equal those of the pattern
``[^\\x20\\x09-\\x0D]+`` on the text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes or words hashed at once; the tables of powers are kept and have about as many entries.
_SLICE = 1 << 17


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240613).integers(1, 2**63, 256, dtype=np.uint64)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, modulo 2**64."""
    base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 2**64))
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, int(n).bit_length()))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """``starts``/``ends`` are byte offsets in ``buffer``; the words of row r are ``first[r]:first[r + 1]``."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(texts: list[bytes | None], lower: bool = False) -> Words:
    """Words of each text, nulls as empty texts. ``lower``: A-Z become a-z first."""
    texts = [t or b"" for t in texts]
    joined = b" ".join(texts) + b" "
    if lower:
        joined = joined.lower()
    buffer = np.frombuffer(joined, np.uint8)
    gap = _SEPARATOR[buffer]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    if len(gap) and not gap[0]:
        starts = np.concatenate([[0], starts])
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    rows_at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=rows_at[1:])
    return Words(buffer, starts, ends, np.searchsorted(starts, rows_at))


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit polynomial hash of the bytes of each word, mixed."""
    out = np.empty(len(w.starts), np.uint64)
    values, at = _byte_values(), 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(w.starts, w.starts[at] + _SLICE)))
        low, high = int(w.starts[at]), int(w.ends[to - 1])
        up, down = powers(high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[w.buffer[low:high]] * up[: high - low], out=sums[1:])
        s, e = w.starts[at:to] - low, w.ends[at:to] - low
        out[at:to] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The rolling (Rabin-Karp) hash of every run of ``size`` hashes, by its first place."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, _SLICE):
        part = hashes[at : min(n, at + _SLICE) + size - 1]
        up, down = powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        m = len(part) - size + 1
        out[at : at + m] = mixed((sums[size:] - sums[:m]) * down[:m])
    return out


def row_windows(w: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of ``size`` words that lies in one row."""
    found = window_hashes(hashes, size)
    ends = np.repeat(w.first[1:], w.counts)[: len(found)]
    inside = np.flatnonzero(np.arange(len(found)) + size <= ends)
    return inside, found[inside]
