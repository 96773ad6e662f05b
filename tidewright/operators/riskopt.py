"""Covariances and long-only optimisers over a handful of tickers."""

from __future__ import annotations

import numpy as np


def ledoit_wolf(block: np.ndarray) -> np.ndarray:
    """Shrinkage towards a multiple of the identity with the optimal intensity (Ledoit and Wolf, 2004)."""
    x = block - block.mean(axis=0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    delta = ((s**2).sum() - 2 * mu * np.trace(s) + p * mu**2) / p
    beta = min(delta, ((x**2).T @ (x**2) / n - s**2).sum() / (n * p))
    weight = beta / delta if beta > 0 and delta > 0 else 0.0
    return (1 - weight) * s + weight * mu * np.eye(p)


def shrunk_cov(block: np.ndarray, shrinkage: str = "ledoit_wolf") -> np.ndarray:
    cov = ledoit_wolf(block) if shrinkage == "ledoit_wolf" else np.cov(block, rowvar=False).reshape(block.shape[1], -1)
    return cov + 1e-10 * np.eye(len(cov))


def trailing_cov(block: np.ndarray, least: int, shrinkage: str = "ledoit_wolf") -> tuple[np.ndarray | None, np.ndarray]:
    """Covariance of the columns with at least ``least`` values, missing ones as zero; None with fewer than two."""
    kept = np.flatnonzero((~np.isnan(block)).sum(axis=0) >= least)
    return (shrunk_cov(np.nan_to_num(block[:, kept]), shrinkage) if len(kept) > 1 else None), kept


def on_simplex(w: np.ndarray, low: float = 0.0) -> np.ndarray:
    """The nearest weights that sum to one with a floor."""
    m = len(w)
    if m * low >= 1:
        return np.full(m, 1 / m)
    u = np.sort(w - low)[::-1]
    total = np.cumsum(u) - (1 - m * low)
    k = np.flatnonzero(u - total / np.arange(1, m + 1) > 0)[-1]
    return np.maximum(w - low - total[k] / (k + 1), 0) + low


def min_variance(cov: np.ndarray, low: float = 0.0) -> np.ndarray:
    """The long-only minimum-variance weights by an active set: the problem is strictly convex."""
    m = len(cov)
    if m * low >= 1:
        return np.full(m, 1 / m)
    fixed = np.zeros(m, bool)
    for _ in range(4 * m + 4):
        free = np.flatnonzero(~fixed)
        inner = cov[np.ix_(free, free)]
        pull = cov[np.ix_(free, np.flatnonzero(fixed))].sum(axis=1) * low
        one, two = np.linalg.solve(inner, np.ones(len(free))), np.linalg.solve(inner, pull)
        scale = (1 - low * fixed.sum() + two.sum()) / one.sum()
        w = np.full(m, low)
        w[free] = scale * one - two
        if (w[free] < low - 1e-12).any():
            fixed[free[np.argmin(w[free])]] = True
            continue
        slope = cov @ w
        level = slope[free].mean()
        if not fixed.any() or (slope[fixed] >= level - 1e-12).all():
            return on_simplex(w, low)
        held = np.flatnonzero(fixed)
        fixed[held[np.argmin(slope[held])]] = False
    return on_simplex(w, low)


def equal_risk(cov: np.ndarray, steps: int = 500) -> np.ndarray:
    """Long-only weights of equal risk contributions by cyclical coordinate descent."""
    m = len(cov)
    w = 1 / np.sqrt(np.diag(cov))
    for _ in range(steps):
        before = w.copy()
        for i in range(m):
            rest = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (-rest + np.sqrt(rest**2 + 4 * cov[i, i] / m)) / (2 * cov[i, i])
        if np.abs(w - before).max() < 1e-12 * np.abs(w).max():
            break
    return w / w.sum()
