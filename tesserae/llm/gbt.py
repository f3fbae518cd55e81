"""Gradient-boosted trees in numpy: histogram split search, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class FlatForest:
    """All trees as one set of node arrays; a leaf points to itself, so that scoring is ``depth`` gathers."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float
    calibration: tuple[float, float] = (1.0, 0.0)
    monotone: dict = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)
        if not len(x):
            return np.zeros(0)
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for root in self.roots:
            node = np.full(len(x), root, np.int32)
            for _ in range(self.depth):
                right = x[rows, self.feature[node]] > self.threshold[node]
                node = np.where(right, self.right[node], self.left[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability (Platt's scaling of the margin)."""
        a, b = self.calibration
        return _sigmoid(a * self.margin(x) + b)


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Fit sigmoid(a * margin + b) by Newton steps on smoothed targets, with a ridge that draws ``a`` to 1."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    def loss(a, b):
        z = a * margin + b
        return (np.logaddexp(0, z) - t * z).sum() + 0.5 * (a - 1) ** 2 + 5e-3 * b * b

    a, b = 1.0, 0.0
    best = loss(a, b)
    for _ in range(60):
        p = _sigmoid(a * margin + b)
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * margin).sum() + (a - 1), (p - t).sum() + 1e-2 * b])
        h = np.array([[(w * margin * margin).sum() + 1, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-2]])
        step, size = np.linalg.solve(h, g), 1.0
        # A step that doesn't lower the loss is halved.
        while size > 1e-4 and not loss(a - size * step[0], b - size * step[1]) < best:
            size /= 2
        if size <= 1e-4:
            break
        a, b = a - size * step[0], b - size * step[1]
        best = loss(a, b)
    return (float(a), float(b)) if a > 0 and np.isfinite(a + b) else (1.0, 0.0)


def train(x, y, *, rounds=60, depth=3, rate=0.2, bins=64, min_rows=5, l2=1.0, monotone=None, holdout=0.2, seed=7) -> FlatForest:
    """Boosted trees for the logistic loss.

    ``monotone`` maps a feature's index to +1 or -1: the score never falls (rises) as that feature grows. A split
    on it needs children in that order, and the middle of their values bounds both subtrees. The share ``holdout``
    of the rows, drawn by ``seed``, only calibrates.
    """
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    monotone = dict(monotone or {})
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < holdout
    if min(y[~held].sum(), (1 - y[~held]).sum(), y[held].sum(), (1 - y[held]).sum()) < 1:
        held[:] = False
    cal_x, cal_y = (x[held], y[held]) if held.any() else (x, y)
    x, y = x[~held], y[~held]
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1) if n else np.zeros((0, width), int)
    rate0 = (y.sum() + 1) / (n + 2)
    base = float(np.log(rate0 / (1 - rate0)))
    score = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v):
        k = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(k), right.append(k), value.append(v)
        return k

    def grow(rows, g, h, level, lo, hi):
        gs, hs = g[rows].sum(), h[rows].sum()
        weight = float(np.clip(-gs / (hs + l2), lo, hi))
        best = (1e-6, None)
        if level and len(rows) >= 2 * min_rows:
            for j in range(width):
                if not len(cuts[j]):
                    continue
                size = len(cuts[j]) + 1
                b = binned[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], None))
                gr, hr, nr = gs - gl, hs - hl, len(rows) - nl
                vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
                gain = -(gl * vl + 0.5 * (hl + l2) * vl**2) - (gr * vr + 0.5 * (hr + l2) * vr**2) + (gs * weight + 0.5 * (hs + l2) * weight**2)
                ok = (nl >= min_rows) & (nr >= min_rows)
                if j in monotone:
                    ok &= monotone[j] * (vr - vl) >= 0
                gain = np.where(ok, gain, -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, float(vl[k]), float(vr[k])))
        if best[1] is None:
            k = leaf(rate * weight)
            score[rows] += rate * weight
            return k
        j, k, vl, vr = best[1]
        me = leaf(0.0)
        feature[me], threshold[me] = j, float(cuts[j][k])
        goes = binned[rows, j] <= k
        l_bounds, r_bounds = (lo, hi), (lo, hi)
        if j in monotone:
            mid = (vl + vr) / 2
            l_bounds, r_bounds = ((lo, mid), (mid, hi)) if monotone[j] > 0 else ((mid, hi), (lo, mid))
        left[me] = grow(rows[goes], g, h, level - 1, *l_bounds)
        right[me] = grow(rows[~goes], g, h, level - 1, *r_bounds)
        return me

    for _ in range(rounds if n else 0):
        p = _sigmoid(score)
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-9), depth, -8.0, 8.0))
    if not roots:
        roots.append(leaf(0.0))
    forest = FlatForest(np.array(feature, np.int32), np.array(threshold), np.array(left, np.int32), np.array(right, np.int32), np.array(value), np.array(roots, np.int32), depth, base, monotone=monotone)
    if len(cal_y) and 0 < cal_y.sum() < len(cal_y):
        forest.calibration = platt(forest.margin(cal_x), cal_y)
    return forest
