"""Gradient-boosted trees for one bounded sample inside one task: the fits of a ladder or a search are groups of a table, so
Spark runs them side by side; a training set that does not fit a task goes to Spark ML instead (ladder.fitted)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 63


@dataclass(frozen=True)
class Size:
    """The capacity of a model, as its candidates state it."""

    leaves: int = 31
    rate: float = 0.1
    least: int = 20
    alpha: float = 0.0
    ridge: float = 0.0
    rows: float = 0.8
    columns: float = 0.8


def binned(x: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each value as a number that is its feature's own, first bin of each feature): quantiles of the training
    values; a missing value has the first bin of its feature."""
    out, starts = np.zeros(x.shape, np.int64), [0]
    for f in range(x.shape[1]):
        known = x[train, f][~np.isnan(x[train, f])]
        edges = np.unique(np.quantile(known, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) if len(known) else np.zeros(0)
        out[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(edges, x[:, f], side="left")) + starts[-1]
        starts.append(starts[-1] + len(edges) + 2)
    return out, np.array(starts)


def best_split(bins: np.ndarray, g: np.ndarray, w: np.ndarray, starts: np.ndarray, open_: np.ndarray, size: Size) -> tuple[float, int, int]:
    """(gain, feature, last bin on the left) of a leaf; the gain is 0 where nothing splits."""
    flat = bins.ravel()
    total = starts[-1]
    gs = np.bincount(flat, np.repeat(g * w, bins.shape[1]), total)
    ns = np.bincount(flat, np.repeat(w, bins.shape[1]), total)
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    before = lambda c: np.concatenate([[0.0], np.cumsum(c)])
    left_g, left_n = before(gs)[1:] - before(gs)[starts[of]], before(ns)[1:] - before(ns)[starts[of]]
    all_g, all_n = (g * w).sum(), w.sum()
    score = lambda s, n: np.maximum(np.abs(s) - size.alpha, 0) ** 2 / (n + size.ridge + 1e-12)
    gain = score(left_g, left_n) + score(all_g - left_g, all_n - left_n) - score(all_g, all_n)
    gain[(left_n < size.least) | (all_n - left_n < size.least) | ~open_[of]] = 0
    at = int(np.argmax(gain))
    return float(gain[at]), int(of[at]), at


def boosted(x: np.ndarray, y: np.ndarray, train: np.ndarray, size: Size, seed: int, rounds: int, patience: int | None = None) -> tuple[np.ndarray, int, float]:
    """(predictions of all rows, trees used, mean absolute error of the rows outside train).

    With patience, the trees are those up to the least error outside train, once that many further trees brought none."""
    rng, n = np.random.default_rng(seed), len(y)
    bins, starts = binned(x, train)
    pred = np.full(n, y[train].mean())
    error = lambda: float(np.abs(y[~train] - pred[~train]).mean()) if (~train).any() else float("nan")
    best, used, kept = (error(), 0, pred.copy()) if patience else (float("nan"), rounds, pred)
    for k in range(rounds):
        w = train * (rng.random(n) < size.rows).astype(float)
        open_ = rng.random(x.shape[1]) < size.columns
        open_[rng.integers(x.shape[1])] = True
        g, leaves = y - pred, [np.arange(n)]
        splits = [best_split(bins, g, w, starts, open_, size)]
        while len(leaves) < size.leaves:
            at = max(range(len(leaves)), key=lambda i: splits[i][0])
            gain, f, edge = splits[at]
            if gain <= 1e-12:
                break
            goes = bins[leaves[at], f] <= edge
            parts = leaves[at][goes], leaves[at][~goes]
            leaves[at : at + 1], splits[at : at + 1] = parts, [best_split(bins[i], g[i], w[i], starts, open_, size) for i in parts]
        for i in leaves if len(leaves) > 1 else []:  # a tree without a split says nothing
            s, m = (g[i] * w[i]).sum(), w[i].sum()
            pred[i] += size.rate * np.sign(s) * max(abs(s) - size.alpha, 0) / (m + size.ridge) if m else 0.0
        if patience:
            now = error()
            if now < best:
                best, used, kept = now, k + 1, pred.copy()
            elif k + 1 - used >= patience:
                break
    return (kept, used, best) if patience else (pred, rounds, error())
