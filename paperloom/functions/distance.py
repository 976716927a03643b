"""Levenshtein distances of many pairs of short texts at once, and of one text to many."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of 64 bits in a table of where characters stand, at most.
_TABLE = 1 << 20


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points in rows of equal width, and lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), int(size.max(initial=1)) or 1), np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


def _blocks(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, width: int, letters: int) -> np.ndarray:
    """Myers' bit vectors in Hyyrö's blocks: rows of a fill ``width`` words of 64 bits, rows of b come longest first."""
    one, rows = np.uint64(1), len(a)
    p, i = np.nonzero(np.arange(a.shape[1]) < m[:, None])
    table = np.zeros(rows * width * letters, np.uint64)
    np.add.at(table, (p * width + i // 64) * letters + a[p, i], one << (i % 64).astype(np.uint64))
    table = table.reshape(rows, width, letters)
    up, down = np.full((width, rows), ~np.uint64(0)), np.zeros((width, rows), np.uint64)
    high, score, at = ((m - 1) % 64).astype(np.uint64), m.copy(), np.arange(rows)
    for j in range(int(n[0])):
        k = int(np.searchsorted(-n, -j, "left"))  # those that have a character here
        h = high[:k]
        plus, minus = np.full(k, one), np.zeros(k, np.uint64)
        for w in range(width):
            pv, mv, eq = up[w, :k], down[w, :k], table[at[:k], w, b[:k, j]]
            xv = eq | mv
            eq |= minus
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            shift = h if w == width - 1 else np.uint64(63)
            more, less = ph >> shift & one, mh >> shift & one
            ph, mh = ph << one | plus, mh << one | minus
            up[w, :k], down[w, :k] = mh | ~(xv | ph), ph & xv
            plus, minus = more, less
        score[:k] += plus.astype(np.int64) - minus.astype(np.int64)
    return score


def distances(left: list[str], right: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs, by code points."""
    a, m = _codes(left)
    b, n = _codes(right)
    letters, back = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    back = back.astype(np.int32)
    a, b = back[: a.size].reshape(a.shape), back[a.size :].reshape(b.shape)
    out = np.maximum(m, n)  # right where one is empty
    width = (m + 63) // 64
    for w in np.unique(width[(m > 0) & (n > 0)]):
        rows = np.flatnonzero((width == w) & (n > 0))
        rows = rows[np.argsort(-n[rows], kind="stable")]
        step = max(1, _TABLE // (int(w) * len(letters)))
        for k in range(0, len(rows), step):
            own = rows[k : k + step]
            out[own] = _blocks(a[own], m[own], b[own], n[own], int(w), len(letters))
    return out


@F.pandas_udf(T.IntegerType())
def levenshtein(a, b):
    """As Spark's own, an order of magnitude faster over texts of some hundred characters; no nulls."""
    return pd.Series(distances(a.tolist(), b.tolist()), dtype="int32")


class Patterns:
    """Texts laid end to end in one integer with a bit between them, so that one pass over another text measures its distance to all.

    Myers' bit vectors over Python's integers; the bit between two texts stays clear and stops the carries.
    """

    def __init__(self, texts: list[str]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.r_[0, np.cumsum(size + 1)]
        between = np.zeros(self.at[-1], bool)
        between[self.at[1:] - 1] = True
        codes = np.frombuffer("".join(t + " " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.zeros(len(between), bool)
        first[self.at[:-1][size > 0]] = True
        self.inside, self.first = self._number(~between), self._number(first)
        self.of = {chr(c): self._number((codes == c) & ~between) for c in np.unique(codes[~between])}

    @staticmethod
    def _number(bits: np.ndarray) -> int:
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def distances(self, text: str, lo: int, hi: int) -> np.ndarray:
        """From ``text`` to each of the texts lo to hi - 1, by code points."""
        a, width = int(self.at[lo]), int(self.at[hi] - self.at[lo])
        full = (1 << width) - 1
        inside, first = self.inside >> a & full, self.first >> a & full
        of = {c: self.of.get(c, 0) >> a & full for c in set(text)}
        up, down = inside, 0
        for c in text:
            eq = of[c]
            d = ((((eq & up) + up) ^ up) | eq | down) & inside
            more, less = down | (inside ^ (d | up)), d & up
            more, less = (more << 1 | first) & inside, (less << 1) & inside
            up, down = less | (inside ^ (d | more)), more & d
        sums = (
            np.add.reduceat(np.unpackbits(np.frombuffer(x.to_bytes((width + 7) // 8, "little"), np.uint8), count=width, bitorder="little").astype(np.int64), self.at[lo:hi] - a)
            for x in (up, down)
        )
        return len(text) + next(sums) - next(sums)
