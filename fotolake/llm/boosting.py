"""Gradient-boosted regression trees on the logistic loss over binned dense features, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 64


class Boosted:
    """Trees of fixed depth, grown level by level from histograms. Deterministic: no sampling, ties go to the first split."""

    def __init__(self, trees: int = 120, depth: int = 4, rate: float = 0.1, least: float = 20.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.least, self.ridge = trees, depth, rate, least, ridge

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, width = x.shape
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(width)]
        b = self._binned(x)
        flat = b + np.arange(width) * BINS
        prior = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(prior / (1 - prior)))
        self.splits: list[tuple[np.ndarray, np.ndarray]] = []
        self.leaves: list[np.ndarray] = []
        raw = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            features, cuts = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, BINS, np.int64)
            for level in range(self.depth):
                nodes, first = 2**level, 2**level - 1
                at = (node[:, None] * (width * BINS) + flat).ravel()
                gs = np.bincount(at, np.repeat(g, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(2)
                hs = np.bincount(at, np.repeat(h, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(2)
                ns = np.bincount(at, minlength=nodes * width * BINS).reshape(nodes, width, BINS).cumsum(2)
                gt, ht, nt = gs[:, :, -1:], hs[:, :, -1:], ns[:, :, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain = np.where((ns >= self.least) & (nt - ns >= self.least), gain, 0.0).reshape(nodes, -1)
                best = gain.argmax(1)
                use = gain[np.arange(nodes), best] > 1e-9
                features[first : first + nodes] = np.where(use, best // BINS, 0)
                cuts[first : first + nodes] = np.where(use, best % BINS, BINS)
                node = node * 2 + (b[np.arange(n), features[first + node]] > cuts[first + node])
            leaf = np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + self.ridge)
            self.splits.append((features, cuts))
            self.leaves.append(self.rate * leaf)
            raw += self.leaves[-1][node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for (features, cuts), leaves in zip(self.splits, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (b[rows, features[at]] > cuts[at])
            out += leaves[node]
        return out


class Isotonic:
    """Least-squares rising step function by pooling neighbours that fall, linear between the pools' centres."""

    def fit(self, raw: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []
        for x, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
            pools.append([v, 1.0, x])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                v2, n2, x2 = pools.pop()
                pools[-1][0] += v2
                pools[-1][1] += n2
                pools[-1][2] += x2
        self.x = np.array([p[2] / p[1] for p in pools])
        self.y = np.array([p[0] / p[1] for p in pools])
        return self

    def of(self, raw: np.ndarray) -> np.ndarray:
        # A trace of the raw score keeps the order within a pool.
        return 0.998 * np.interp(raw, self.x, self.y) + 0.002 / (1 + np.exp(-np.clip(raw, -30, 30)))
