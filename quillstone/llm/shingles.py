"""Character shingles of whole Arrow batches in numpy.

All texts of a batch are laid out as one array of code points; hashes of every window of ``k`` code
points are computed at once, and one sort of (text, hash) yields the distinct shingles of each text.
"""

from __future__ import annotations

import numpy as np

from quillstone.llm.looks import looks

K = 5
#: Texts that are sorted together: their numbers take 16 bits, which leaves 48 for the hashes in every batch.
SLICE = 1 << 16
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _odd(i: int) -> int:
    """Independent odd multipliers: a window's hash depends on every code point at its place."""
    return int(mix(np.array([0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0]) | 1


def plain(text: str | None) -> str:
    """As it looks, lower-cased, each run of white space as one blank."""
    if not text:
        return ""
    t = looks(text).lower()
    body = " ".join(t.split())
    if not body:
        return " " if t else ""
    return (" " if t[0].isspace() else "") + body + (" " if t[-1].isspace() else "")


def letters(text: str | None) -> str:
    """As it looks, lower-cased, only letters and digits: equality without case, spacing and punctuation."""
    return "".join(c for c in looks(text or "").lower() if c.isalnum())


def hash_text(text: str, seed: int = 0) -> int:
    """A signed 64-bit hash of a text that is the same in every process; hashes of two seeds are independent."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed)
    return h - (1 << 64) if h >> 63 else h


def shingles(texts: list[str], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-character shingles of each text.

    Returns (start, hashes): the hashes of text i are ``hashes[start[i]:start[i + 1]]``, ascending.
    A non-empty text shorter than ``k`` has itself as its one shingle; an empty text has none.
    """
    n = len(texts)
    if n > SLICE:
        parts = [shingles(texts[c : c + SLICE], k) for c in range(0, n, SLICE)]
        sizes = np.concatenate([np.diff(s) for s, _ in parts])
        return np.append(np.int64(0), np.cumsum(sizes)), np.concatenate([h for _, h in parts])
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=n)
    if not n or not lens.sum():
        return np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    short = (lens > 0) & (lens < k)
    if short.any():  # padded with a noncharacter so that each has exactly one window
        texts = [t + "﷐" * (k - len(t)) if s else t for t, s in zip(texts, short)]
        lens = np.where(short, k, lens)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    wins = np.maximum(lens - k + 1, 0)
    owner = np.repeat(np.arange(n, dtype=np.int64), wins)
    first = np.cumsum(lens) - lens
    at = np.arange(wins.sum(), dtype=np.int64) + np.repeat(first - (np.cumsum(wins) - wins), wins)
    h = np.zeros(len(codes) - k + 1, dtype=np.uint64)
    for i in range(k):
        h += codes[i : len(codes) - k + 1 + i] * np.uint64(_odd(i))
    h = mix(h)[at]
    # 16 bits of owner and 48 of hash in every call, so a text has the same hashes whatever stands beside it
    keyed = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    keep = np.ones(len(keyed), dtype=bool)
    keep[1:] = keyed[1:] != keyed[:-1]
    keyed = keyed[keep]
    who = (keyed >> np.uint64(48)).astype(np.int64)
    hashes = keyed & np.uint64((1 << 48) - 1)
    start = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.bincount(who, minlength=n), out=start[1:])
    return start, hashes


def jaccard(a: list[str], b: list[str], k: int = K) -> np.ndarray:
    """Jaccard similarity of the shingle sets of a[i] and b[i]; equal texts, empty ones included, have 1."""
    n = len(a)
    if not n:
        return np.zeros(0)
    if n > SLICE:
        return np.concatenate([jaccard(a[c : c + SLICE], b[c : c + SLICE], k) for c in range(0, n, SLICE)])
    start, h = shingles([*a, *b], k)
    size = np.diff(start)
    owner = np.repeat(np.arange(2 * n) % n, size).astype(np.uint64)
    keyed = np.sort((owner << np.uint64(48)) | h)
    both = np.bincount((keyed[1:][keyed[1:] == keyed[:-1]] >> np.uint64(48)).astype(np.int64), minlength=n)
    either = size[:n] + size[n:] - both
    same = np.fromiter((x == y for x, y in zip(a, b)), dtype=bool, count=n)
    return np.where(same, 1.0, both / np.maximum(either, 1))
