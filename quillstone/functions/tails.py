"""Tail probabilities in numpy: binomial by the incomplete beta function, chi-square by its recurrence in the degrees of freedom."""

from __future__ import annotations

import math

import numpy as np

_log_gamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
_TINY = 1e-300


def _fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, evaluated backwards from depths that are doubled until nothing moves.

    Its partial numerators are ``d(2m) = m (b - m) x / ((a + 2m - 1)(a + 2m))`` and
    ``d(2m + 1) = -(a + m)(a + b + m) x / ((a + 2m)(a + 2m + 1))``.
    """

    def at(depth: int) -> np.ndarray:
        f = np.ones_like(x)
        for j in range(depth, 0, -1):
            m = j // 2
            d = m * (b - m) * x / ((a + j - 1) * (a + j)) if j % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + j - 1) * (a + j))
            f = 1.0 + d / np.where(np.abs(f) < _TINY, _TINY, f)
        return f

    depth, f = 32, at(32)
    while depth < 1 << 17:
        depth *= 2
        g = at(depth)
        if (np.abs(f - g) <= 1e-14 * np.abs(g)).all():
            return g
        f = g
    return f


def incomplete_beta(x, a, b) -> np.ndarray:
    """The regularised incomplete beta function for 0 <= x <= 1 and positive a and b."""
    x, a, b = (np.array(v, dtype=float) for v in np.broadcast_arrays(x, a, b))
    out = np.where(x >= 1, 1.0, 0.0)
    inner = (x > 0) & (x < 1)
    if inner.any():
        x, a, b = x[inner], a[inner], b[inner]
        swap = x * (a + b + 2) > a + 1  # the fraction converges fast on one side of the mean
        x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
        log_front = (_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)) + a * np.log(x) + b * np.log1p(-x)
        part = np.exp(log_front) / a / _fraction(x, a, b)
        out[inner] = np.clip(np.where(swap, 1 - part, part), 0.0, 1.0)
    return out


def binomial_tail(n, k, p=0.5) -> np.ndarray:
    """P(X >= k) for X ~ Binomial(n, p), elementwise, in a time that grows with the square root of n."""
    n, k, p = (np.array(v, dtype=float) for v in np.broadcast_arrays(n, k, p))
    inside = (k > 0) & (k <= n)
    tail = incomplete_beta(np.where(inside, p, 0.5), np.where(inside, k, 1.0), np.where(inside, n - k + 1, 1.0))
    return np.where(inside, tail, (k <= 0).astype(float))


def sign_test(losses, gains) -> np.ndarray:
    """Two-sided exact p of as uneven a split of discordant pairs: twice the tail of the larger side, at most 1."""
    losses, gains = np.asarray(losses, dtype=float), np.asarray(gains, dtype=float)
    return np.minimum(1.0, 2 * binomial_tail(losses + gains, np.maximum(losses, gains)))


def least_significant_loss(n: int, discordant: int, alpha: float) -> float | None:
    """The smallest net loss per item that is significant, given the number of discordant pairs; found by bisection."""
    if not n or not discordant or float(binomial_tail(discordant, discordant)) > alpha:
        return None
    lo, hi = discordant // 2, discordant  # the tail falls with the number of losses
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if float(binomial_tail(discordant, mid)) <= alpha else (mid, hi)
    return (2 * hi - discordant) / n


def zero_event_half_width(n: int, confidence: float = 0.95) -> float:
    """How large a proportion can be of which none of n items shows a case: the exact upper bound."""
    return -math.expm1(math.log((1 - confidence) / 2) / n) if n else 1.0


def chi_square_tail(df, x) -> np.ndarray:
    """P(X >= x) for a chi-square variable with whole degrees of freedom; NaN where df or x makes no sense.

    Two more degrees of freedom add ``(x / 2)^(df / 2) exp(-x / 2) / Gamma(df / 2 + 1)``; one degree has
    ``erfc(sqrt(x / 2))``, two have ``exp(-x / 2)``.
    """
    df, x = (np.array(v, dtype=float) for v in np.broadcast_arrays(df, x))
    good = (df >= 1) & (df == np.floor(df)) & (x >= 0)
    half = np.where(good, x, 0.0) / 2
    odd = np.where(good, df, 2) % 2 == 1
    out = np.where(odd, _erfc(np.sqrt(half)), np.exp(-half))
    log_half = np.log(np.maximum(half, _TINY))
    top = int(np.where(good, df, 0).max(initial=0))
    for step in range(1, (top + 1) // 2):
        s = np.where(odd, step - 0.5, float(step))
        term = np.exp(s * log_half - half - _log_gamma(s + 1))
        out = out + np.where(2 * s + 2 <= df + 1e-9, term, 0.0)
    return np.where(good, np.minimum(out, 1.0), np.nan)
