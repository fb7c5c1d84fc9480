"""Gradient-boosted trees in numpy, with monotonic constraints, flattened for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees as node arrays: a node's feature (-1: leaf), threshold, children and value."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log odds of each row; rows step down all trees at once."""
        out = np.full(len(x), self.base)
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            row = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                f = self.feature[node]
                down = np.where(part[row, np.maximum(f, 0)] <= self.threshold[node], self.left[node], self.right[node])
                node = np.where(f < 0, node, down)
            out[at : at + 4096] += self.value[node].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Forest:
    """Boost log-loss trees on histograms.

    ``monotone`` has -1, 0 or 1 for each feature: the score never rises, is free, or never falls
    as the feature grows.  A split that breaks a constraint isn't made, and both sides' values
    are held on their side of the middle between them, which keeps whole trees monotonic.
    """
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(x), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        for column, item in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, v)):
            column.append(item)
        return len(feature) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        own = float(np.clip(-total_g / (total_h + ridge), low, high))
        best = (1e-6, None)
        if level < depth and len(rows) > 1:
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, g[rows], len(cut) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(cut) + 1))[:-1]
                gr, hr = total_g - gl, total_h - hl
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                # What the loss falls by with these (possibly clipped) values.
                gain = -(gl * vl + (hl + ridge) * vl * vl / 2 + gr * vr + (hr + ridge) * vr * vr / 2) + (total_g * own + (total_h + ridge) * own * own / 2)
                gain[(hl < least) | (hr < least) | (monotone[f] * (vr - vl) < 0)] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, float(vl[k]), float(vr[k])))
        node = leaf(own * rate)
        if best[1] is None:
            margin[rows] += own * rate
            return node
        f, k, vl, vr = best[1]
        middle = (vl + vr) / 2
        bounds = [(low, high), (low, high)]
        if monotone[f] > 0:
            bounds = [(low, min(high, middle)), (max(low, middle), high)]
        elif monotone[f] < 0:
            bounds = [(max(low, middle), high), (low, min(high, middle))]
        goes = binned[rows, f] <= k
        feature[node], threshold[node] = f, float(cuts[f][k])
        left[node] = grow(rows[goes], g, h, level + 1, *bounds[0])
        right[node] = grow(rows[~goes], g, h, level + 1, *bounds[1])
        return node

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(x)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    return Forest(*(np.array(c) for c in (roots, feature, threshold, left, right, value)), depth, base)
