"""Parity bitmaps of sets, and all pairs of two blocks of sets that may reach a Jaccard similarity.

A bitmap holds the parity of the number of elements in each hash bucket. Two bitmaps differ in at most as many bits as
the sets differ in elements, so what the bitmaps rule out is never a pair: the filter is exact. Its length follows from
the size of the set; a bitmap folded in half is the bitmap of half as many buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache

import numpy as np

#: Bitmaps compared in one step.
_PROBES, _STEP = 32, 4096


@cache
def _bits_per_difference(t: float) -> float:
    """So many bits, for each element that sets at ``t`` differ in, that sets 0.2 below ``t`` are expected 15 % above the bound."""
    if t >= 1:
        return 4.0
    low = max(t - 0.2, 0.0)
    k, x = (1 - low) / (1 + low) * (1 + t) / (1 - t), 1.0
    while x < 16 and x * -math.expm1(-2 * k / x) / 2 < 1.15:
        x += 0.25
    return x


def words(size: np.ndarray, t: float) -> np.ndarray:
    """64-bit words of the bitmap of a set of each size, a power of two."""
    differ = 2.0 * np.asarray(size) * (1 - t) / (1 + t)
    return np.int64(1) << (np.ceil(np.log2(np.maximum(differ * _bits_per_difference(t) / 64, 1))).astype(np.int64))


def bitmaps(start: np.ndarray, hashes: np.ndarray, t: float) -> list[bytes]:
    """The bitmap of each set ``hashes[start[i]:start[i + 1]]``."""
    size = np.diff(start)
    wide = words(size, t)
    out: list[bytes] = [b""] * len(size)
    for w in np.unique(wide):
        at, bits = np.flatnonzero(wide == w), 64 * int(w)
        step = max(1, (1 << 20) // bits)
        for c in range(0, len(at), step):
            part = at[c : c + step]
            n = size[part]
            owner = np.repeat(np.arange(len(part)), n)
            flat = np.arange(n.sum()) + np.repeat(start[part] - (np.cumsum(n) - n), n)
            bucket = (hashes[flat] % np.uint64(bits)).astype(np.int64)
            odd = (np.bincount(owner * bits + bucket, minlength=len(part) * bits) & 1).astype(np.uint8)
            packed = np.packbits(odd.reshape(len(part), bits), axis=1)
            for i, row in zip(part, packed):
                out[i] = row.tobytes()
    return out


def _folded(maps: np.ndarray, w: int) -> np.ndarray:
    while maps.shape[0] > w:
        half = maps.shape[0] // 2
        maps = maps[:half] ^ maps[half:]
    return np.ascontiguousarray(maps)


class _Sorted:
    """Sets by size, in runs of bitmaps of one width; words first, so that one word of many bitmaps is contiguous."""

    def __init__(self, maps: Sequence[bytes], size: np.ndarray):
        self.by = np.argsort(size, kind="stable")
        self.size = size[self.by].astype(np.int64)
        wide = np.fromiter((len(m) // 8 for m in maps), dtype=np.int64, count=len(maps))[self.by]
        cut = np.flatnonzero(np.diff(wide)) + 1
        self.runs = []
        for lo, hi in zip([0, *cut], [*cut, len(wide)]):
            whole = np.frombuffer(b"".join(maps[i] for i in self.by[lo:hi]), dtype=np.uint64).reshape(hi - lo, wide[lo])
            self.runs.append((int(lo), int(hi), np.ascontiguousarray(whole.T)))


def may_reach(a: Sequence[bytes], size_a: np.ndarray, b: Sequence[bytes], size_b: np.ndarray, t: float, upward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) whose sizes and bitmaps allow sets a[i] and b[j] a similarity of ``t``; with ``upward`` only those where a[i] isn't smaller."""
    found_i, found_j = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    if len(a) and len(b):
        x, y = _Sorted(a, np.asarray(size_a)), _Sorted(b, np.asarray(size_b))
        least = y.size if upward else np.ceil(t * y.size - 1e-9)
        low, high = np.searchsorted(x.size, least), np.searchsorted(x.size, np.floor(y.size / t + 1e-9), side="right")
        for xl, xh, xm in x.runs:
            for yl, yh, ym in y.runs:
                if low[yl] < xh and high[yh - 1] > xl:
                    for i, j in _run_pairs(x.size[xl:xh], xm, np.maximum(low[yl:yh] - xl, 0), np.minimum(high[yl:yh], xh) - xl, y.size[yl:yh], ym, t):
                        found_i.append(x.by[i + xl])
                        found_j.append(y.by[j + yl])
    return np.concatenate(found_i), np.concatenate(found_j)


@cache
def _plan(differ: float, wide: int, t: float) -> tuple[int, int]:
    """(folded to so many words, words compared first) of bitmaps of ``wide`` words: the fewest that set apart what is 0.3 below ``t``."""
    low = max(t - 0.3, 0.0)
    far = max(differ, 1) * ((1 - low) / (1 + low) * (1 + t) / (1 - t) if t < 1 else 16)
    best, w = (wide, wide), wide
    while w:
        share = -math.expm1(-2 * far / (64 * w)) / 2
        q = next((q for q in range(1, w + 1) if 64 * q * share - 2 * math.sqrt(64 * q * share * (1 - share)) > differ), wide + 1)
        best = min(best, (w, q), key=lambda x: x[1])
        w //= 2
    return best


def _run_pairs(size_x, xm, low, high, size_y, ym, t):  # noqa: ANN001, ANN202
    full = min(len(xm), len(ym))
    xf, yf = _folded(xm, full).T.copy(), _folded(ym, full).T.copy()
    share = (1 - t) / (1 + t)
    halves: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    differ, ones = np.empty((_PROBES, _STEP), dtype=np.uint64), np.empty((_PROBES, _STEP), dtype=np.uint8)
    sums = {k: np.empty((_PROBES, _STEP), dtype=k) for k in (np.uint8, np.uint16)}
    near = np.empty((_PROBES, _STEP), dtype=bool)
    for p in range(0, len(size_y), _PROBES):
        q = min(p + _PROBES, len(size_y))
        for c in range(int(low[p]), int(high[q - 1]), _STEP):
            d = min(c + _STEP, int(high[q - 1]))
            bound = np.floor((size_x[c:d] + size_y[q - 1]) * share + 1e-6)
            w, first = _plan(float(bound[-1]), full, t)
            if w not in halves:
                halves[w] = _folded(xm, w), _folded(ym, w)
            xh, yh = halves[w]
            kind = np.uint8 if first <= 4 else np.uint16  # sums that wrap are looked at again below
            v, n, s, ok = (z.reshape(-1)[: (q - p) * (d - c)].reshape(q - p, d - c) for z in (differ, ones, sums[kind], near))
            for k in range(first):
                np.bitwise_xor(xh[k, None, c:d], yh[k, p:q, None], out=v)
                np.bitwise_count(v, out=n if k else s)
                if k:
                    np.add(s, n, out=s)
            np.less_equal(s, np.minimum(bound, np.iinfo(kind).max).astype(kind), out=ok)
            at = np.flatnonzero(ok)
            if len(at):
                j, i = at // (d - c) + p, at % (d - c) + c
                inside = (i >= low[j]) & (i < high[j])
                i, j = i[inside], j[inside]
                for k in range(0, len(i), 100_000):
                    u, r = i[k : k + 100_000], j[k : k + 100_000]
                    both = size_x[u] + size_y[r]
                    can = np.bitwise_count(xf[u] ^ yf[r]).sum(axis=1, dtype=np.int64) <= both - 2 * np.ceil(t / (1 + t) * both - 1e-9)
                    if can.any():
                        yield u[can], r[can]
