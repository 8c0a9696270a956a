"""Gaussian kernel densities of binned values, and their peaks."""

from __future__ import annotations

import math

import numpy as np


def bandwidth(n: float, sd: float, iqr: float) -> float:
    """Silverman's rule; zero where nothing varies."""
    spread = min((v for v in (sd, iqr / 1.34) if v > 0), default=0.0)
    return 0.9 * spread * n**-0.2 if n else 0.0


def density(mid: np.ndarray, count: np.ndarray, h: float, lo: float, hi: float, grid: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The density of counts at bin middles, on a grid that goes three bandwidths beyond the ends."""
    at = np.linspace(lo - 3 * h, hi + 3 * h, grid)
    y = np.exp(-(((at[:, None] - mid) / h) ** 2) / 2) @ count / (count.sum() * h * math.sqrt(2 * math.pi))
    return at, y


def peaks(y: np.ndarray) -> int:
    """Peaks above a tenth of the highest, parted by a valley below half of the lower one."""
    if len(y) < 3:
        return min(1, len(y))
    top = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] >= y[2:])) + 1
    top = [i for i in top if y[i] > 0.1 * y.max()]
    kept: list[int] = []
    for i in top:
        while kept and y[kept[-1] : i].min() >= 0.5 * min(y[kept[-1]], y[i]) and y[i] > y[kept[-1]]:
            kept.pop()
        if not kept or y[kept[-1] : i].min() < 0.5 * min(y[kept[-1]], y[i]):
            kept.append(i)
    return len(kept)
