"""Tail probabilities and p-value adjustment for small result tables on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np

norm_ppf = NormalDist().inv_cdf
norm_cdf = NormalDist().cdf


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function (Lentz's continued fraction)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_i(df / 2, 0.5, df / (df + t * t))


def norm_sf2(z: float) -> float:
    """Both tails of the normal distribution beyond ``z``."""
    return math.erfc(z / math.sqrt(2))


def t_ppf(p: float, df: float) -> float:
    lo, hi = -1e6, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        below = 1 - t_sf2(mid, df) / 2 if mid > 0 else t_sf2(mid, df) / 2
        lo, hi = (mid, hi) if below < p else (lo, mid)
    return (lo + hi) / 2


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def binom_half_upper(k: int, n: int) -> float:
    """P(X >= k) for X binomial(n, 1/2)."""
    return beta_i(k, n - k + 1, 0.5) if k > 0 else 1.0


def hyper_upper_log(k: int, white: int, black: int, draws: int) -> float:
    """log P(X >= k) for X hypergeometric."""
    top = min(white, draws)
    if k > top:
        return -math.inf
    logs = np.array([log_choose(white, i) + log_choose(black, draws - i) for i in range(max(k, draws - black, 0), top + 1)]) - log_choose(white + black, draws)
    m = logs.max()
    return min(0.0, float(m + np.log(np.exp(logs - m).sum())))


def p_adjust(p: Sequence[float | None], method: str = "holm") -> list[float | None]:
    """holm, hochberg, hommel, bonferroni, BH (fdr), BY or none; missing values stay and don't count."""
    at = [i for i, x in enumerate(p) if x is not None]
    x = np.array([p[i] for i in at], float)
    n = len(x)
    out: list[float | None] = list(p)
    if n == 0 or method == "none":
        return out
    up, down = np.argsort(x, kind="stable"), np.argsort(-x, kind="stable")
    new = np.empty(n)
    i = np.arange(1, n + 1)
    if method == "bonferroni":
        new = np.minimum(1, n * x)
    elif method == "holm":
        new[up] = np.minimum(1, np.maximum.accumulate((n - i + 1) * x[up]))
    elif method == "hochberg":
        new[down] = np.minimum(1, np.minimum.accumulate(i * x[down]))
    elif method in ("BH", "fdr"):
        new[down] = np.minimum(1, np.minimum.accumulate(n / (n - i + 1) * x[down]))
    elif method == "BY":
        new[down] = np.minimum(1, np.minimum.accumulate((1 / i).sum() * n / (n - i + 1) * x[down]))
    elif method == "hommel":
        s = x[up]
        q = pa = np.full(n, (n * s / i).min())
        for m in range(n - 1, 1, -1):
            a, b = np.arange(n - m + 1), np.arange(n - m + 1, n)
            q1 = (m * s[b] / np.arange(2, m + 1)).min()
            q = q.copy()
            q[a] = np.minimum(m * s[a], q1)
            q[b] = q[n - m]
            pa = np.maximum(pa, q)
        new[up] = np.minimum(1, np.maximum(pa, s))
    else:
        raise ValueError(f"unknown adjustment {method!r}")
    for k, v in zip(at, new.tolist(), strict=True):
        out[k] = v
    return out
