"""Words of many texts at once: boundaries and 64-bit hashes as numpy arrays.

Both word classes treat every byte of 0x80 and above as a word character, so splitting the UTF-8 bytes
gives the same words as splitting the code points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
ALNUM = np.ones(256, dtype=bool)
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


@dataclass
class Words:
    """`start`/`end`: byte ranges in `buf` (lower-cased); `first[d]:first[d + 1]`: the words of text d."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()

    def hashes(self) -> np.ndarray:
        """A 64-bit polynomial hash of each word's bytes, finalised so that all bits are mixed."""
        out = np.empty(len(self), dtype=np.uint64)
        i = 0
        while i < len(self):
            lo = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, lo + _BLOCK, side="right")))
            part = self.buf[lo : self.end[j - 1]]
            powers, inverses = _tables(len(part) + 1)
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers[: len(part)], out=sums[1:])
            s, e = self.start[i:j] - lo, self.end[i:j] - lo
            out[i:j] = (sums[e] - sums[s]) * inverses[s]
            i = j
        return mixed(out)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, _BLOCK + 256)
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            table = np.full(n, base, dtype=np.uint64)
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)
    return _powers, _inverses


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def split(texts: list[bytes], kind: np.ndarray) -> Words:
    """The words of `texts`, A-Z lower-cased."""
    blob = b" ".join(texts).lower()
    buf = np.frombuffer(blob, dtype=np.uint8)
    mask = np.zeros(len(buf) + 2, dtype=np.int8)
    mask[1:-1] = kind[buf]
    edges = np.flatnonzero(np.diff(mask))
    start, end = edges[0::2], edges[1::2]
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return Words(buf, start, end, np.searchsorted(start, offsets))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words starting at each place (places with fewer words after them are left out)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = h[:m].copy()
    for k in range(1, n):
        out *= np.uint64(_BASE)
        out += h[k : k + m]
    return mixed(out)
