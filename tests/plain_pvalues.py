"""Two-sided p-values from test statistics, one at a time: what the expressions of functions.distributions are held against."""

from __future__ import annotations

import math

import numpy as np

# Sample sizes below this use the exact distribution if nothing is tied.
EXACT_BELOW = 50


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) as a regularised incomplete beta function."""
    return _incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    # Continued fraction, evaluated from its far end.
    tail = 0.0
    for m in range(400, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        tail = even / (1.0 + odd / (1.0 + tail))
    first = -(a + b) * x / (a + 1.0)
    return math.exp(log_front) / a / (1.0 + first / (1.0 + tail))


# Counts that have been worked out.
_KNOWN: dict[tuple[int, ...], np.ndarray] = {}


def signed_rank_counts(n: int) -> np.ndarray:
    """How many sign patterns of ranks 1..n give each positive rank sum."""
    if (n,) in _KNOWN:
        return _KNOWN[n,]
    counts = np.ones(1)
    for rank in range(1, n + 1):
        longer = np.zeros(len(counts) + rank)
        longer[: len(counts)] += counts
        longer[rank:] += counts
        counts = longer
    return _KNOWN.setdefault((n,), counts)


def rank_sum_counts(m: int, n: int) -> np.ndarray:
    """How many ways m of m+n ranks give each U = 0..m*n."""
    if (m, n) in _KNOWN:
        return _KNOWN[m, n]
    counts = np.zeros(m * n + 1)
    counts[0] = 1.0
    # Gaussian binomial: multiply by (1 - q^(n+k)) and divide by (1 - q^k).
    for k in range(1, m + 1):
        top = n + k
        if top <= m * n:
            counts[top:] -= counts[:-top].copy()
        # Dividing is a running sum in each class of places that are k apart.
        padded = np.zeros(-(-len(counts) // k) * k)
        padded[: len(counts)] = counts
        counts = np.cumsum(padded.reshape(-1, k), axis=0).ravel()[: m * n + 1]
    return _KNOWN.setdefault((m, n), counts)


def _exact(counts: np.ndarray, statistic: float) -> float:
    """Twice the smaller tail, at most 1. Both distributions are symmetric, and the
    counts are most precise at their low end, so that is the tail to sum."""
    k = int(round(min(statistic, len(counts) - 1 - statistic)))
    return float(min(1.0, 2.0 * counts[: k + 1].sum() / counts.sum()))


def _corrected(statistic: float, mean: float, variance: float) -> float:
    """Normal approximation with continuity correction."""
    if variance <= 0:
        return math.nan
    shift = statistic - mean
    return normal_two_sided((shift - math.copysign(0.5, shift) * (shift != 0)) / math.sqrt(variance))


def signed_rank_p(v: float, n: int, zeros: int, ties: float) -> float:
    """`ties` is the sum of t^3 - t over tie groups of the absolute differences."""
    if n == 0:
        return math.nan
    if n + zeros < EXACT_BELOW and zeros == 0 and ties == 0:
        return _exact(signed_rank_counts(n), v)
    return _corrected(v, n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48)


def rank_sum_p(w: float, m: int, n: int, ties: float) -> float:
    """`ties` is the sum of t^3 - t over tie groups of both samples together."""
    if m == 0 or n == 0:
        return math.nan
    if m < EXACT_BELOW and n < EXACT_BELOW and ties == 0:
        return _exact(rank_sum_counts(m, n), w)
    total = m + n
    spread = (total + 1) - ties / (total * (total - 1))
    return _corrected(w, m * n / 2, m * n / 12 * spread)
