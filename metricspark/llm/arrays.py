"""Whole batches of texts as numpy arrays: code points, runs, hashes, ragged joins.

Tasks work on slices of some million characters, so memory stays bounded whatever
the length of a batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Code points below this have their class in a table; others are told apart by Python.
KNOWN = 0x3000
#: Characters that a task works on at once, unless one text is longer.
SLICE = 1_000_000

#: The code points with Unicode's White_Space property.
WHITE_SPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680\u2000"
    "\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def kind_of(ch: str) -> int:
    if ch in WHITE_SPACE:
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(ch)[0], OTHER)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Class of every code point of the basic plane."""
    return np.array([kind_of(chr(c)) for c in range(0x10000)], dtype=np.uint8)


def slices(texts: list[str], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts with about ``most`` characters."""
    first = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= most:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def offsets(lengths) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after the other, and where each text begins."""
    raw = "".join(texts).encode("utf-32-le", errors="surrogatepass")
    return np.frombuffer(raw, dtype="<u4"), offsets([len(t) for t in texts])


def classes(cp: np.ndarray) -> np.ndarray:
    """Class of each code point; distinct ones beyond the basic plane are looked up one by one."""
    table = kinds()
    if not len(cp) or int(cp.max()) < len(table):
        return table[cp]
    out = table[np.minimum(cp, len(table) - 1)]
    beyond = np.flatnonzero(cp >= len(table))
    found, back = np.unique(cp[beyond], return_inverse=True)
    out[beyond] = np.array([kind_of(chr(int(c))) for c in found], dtype=np.uint8)[back]
    return out


def ragged(pool: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """pool[start:start + count] of every row, one after the other."""
    ends = np.cumsum(count)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    at = np.repeat(start - (ends - count), count)
    at += np.arange(int(ends[-1]))
    return pool[at]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class SpanHash:
    """64-bit hashes of spans of an array of code points.

    A span's hash is a polynomial in a fixed odd base over its code points' random
    values, modulo 2**64, so all spans cost one running sum.
    """

    def __init__(self, seed: int):
        self.seed = np.uint64(seed * 0x5851F42D4C957F2D % 2**64)
        self.base = int(mix(np.array([seed + 1], dtype=np.uint64))[0]) | 5
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.zeros(0, dtype=np.uint64)
        self.values = mix(np.arange(0x10000, dtype=np.uint64) + self.seed)

    def powers(self, n: int) -> None:
        if n <= len(self.up):
            return
        n = max(n, 1 << 16)
        for name, base in (("up", self.base), ("down", self.inverse)):
            out = np.ones(n, dtype=np.uint64)
            done = 1
            while done < n:
                step = min(done, n - done)
                out[done : done + step] = out[:step] * np.uint64(pow(base, done, 2**64))
                done += step
            setattr(self, name, out)

    def prepare(self, cp: np.ndarray) -> None:
        self.powers(len(cp) + 1)
        if len(cp) and int(cp.max()) >= len(self.values):
            v = mix(cp.astype(np.uint64) + self.seed)
        else:
            v = self.values[cp]
        self.sums = np.zeros(len(cp) + 1, dtype=np.uint64)
        np.cumsum(v * self.up[: len(cp)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


class PieceHash:
    """64-bit hashes of disjoint spans of an array of code points, in order.

    A span's hash is the sum of a mixed value for each code point and its place in the
    span. Unlike a polynomial modulo 2**64, which strings of one form defeat whatever its
    base is, sums of mixed values collide by chance only.
    """

    STEP = np.uint64(0xA0761D6478BD642F)

    def __init__(self, seed: int):
        self.seed = np.uint64(seed * 0x5851F42D4C957F2D % 2**64)
        self.values = mix(np.arange(0x10000, dtype=np.uint64) + self.seed)

    def __call__(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0, dtype=np.uint64)
        beyond = int(cp.max()) >= len(self.values)
        x = np.zeros(len(cp) + 1, dtype=np.uint64)
        x[:-1] = mix(cp.astype(np.uint64) + self.seed) if beyond else self.values[cp]
        first = np.zeros(len(cp) + 1, dtype=np.int64)
        first[start] = start
        np.maximum.accumulate(first, out=first)
        np.subtract(np.arange(len(first)), first, out=first)
        x += first.view(np.uint64) * self.STEP
        edges = np.empty(2 * len(start), dtype=np.int64)
        edges[0::2], edges[1::2] = start, end
        return mix(np.add.reduceat(mix(x), edges)[::2] + (end - start).astype(np.uint64))


@lru_cache(maxsize=8)
def piece_hash(seed: int) -> PieceHash:
    return PieceHash(seed)


@lru_cache(maxsize=8)
def span_hash(seed: int) -> SpanHash:
    return SpanHash(seed)


def words(texts: list[str], seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin.

    A word is a maximal run of letters, marks left out, and digits, in lower case.
    """
    cp, at = code_points([t.lower() for t in texts])
    k = classes(cp)
    inside = (k == LETTER) | (k == NUMBER)
    edge = np.zeros(len(cp) + 1, dtype=bool)
    edge[at] = True
    before, after = np.zeros(len(cp) + 1, dtype=bool), np.zeros(len(cp) + 1, dtype=bool)
    before[1:], after[:-1] = inside, inside
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return piece_hash(seed)(cp, start, end), np.searchsorted(start, at).astype(np.int64)
