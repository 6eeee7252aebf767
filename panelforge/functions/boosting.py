"""Histogram gradient boosting in numpy: quantile and logistic loss, missing values kept.

Features are cut into at most ``BINS`` bins at their quantiles, one more bin is for
missing values. Trees grow level by level to a fixed depth; a split sends missing
values to the side where they gain more. For quantile loss a leaf's value is the
quantile of its residuals.
"""

from __future__ import annotations

import numpy as np

BINS = 64


class Booster:
    def __init__(
        self,
        loss: str = "logistic",
        level: float = 0.5,
        rounds: int = 200,
        rate: float = 0.05,
        depth: int = 3,
        min_leaf: int = 200,
        l2: float = 1.0,
    ):
        if loss not in ("logistic", "quantile"):
            raise ValueError(f"unknown loss {loss!r}")
        self.loss, self.level, self.rounds, self.rate = loss, level, rounds, rate
        self.depth, self.min_leaf, self.l2 = depth, min_leaf, l2
        self.edges: list[np.ndarray] = []
        self.start = 0.0
        #: Per tree: feature, last bin that goes left, missing goes left (per inner node), leaf values.
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.int64)
        for f, edges in enumerate(self.edges):
            out[:, f] = np.searchsorted(edges, x[:, f], side="left")
            out[np.isnan(x[:, f]), f] = BINS
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.edges, self.trees = [], []
        for f in range(x.shape[1]):
            known = x[~np.isnan(x[:, f]), f]
            cuts = np.unique(np.quantile(known, np.linspace(0, 1, BINS + 1)[1:-1])) if len(known) else np.zeros(0)
            self.edges.append(cuts)
        if self.loss == "quantile":
            self.start = float(np.quantile(y, self.level)) if len(y) else 0.0
        else:
            p = (y.sum() + 1) / (len(y) + 2)
            self.start = float(np.log(p / (1 - p)))
        bins, raw = self._binned(x), np.full(len(y), self.start)
        for _ in range(self.rounds):
            if self.loss == "quantile":
                gradient, hessian = np.where(y > raw, -self.level, 1 - self.level), np.ones(len(y))
            else:
                p = 1 / (1 + np.exp(-raw))
                gradient, hessian = p - y, np.maximum(p * (1 - p), 1e-6)
            tree, leaf = self._grow(bins, gradient, hessian, y - raw)
            self.trees.append(tree)
            raw += tree[3][leaf]
        return self

    def _grow(self, bins, gradient, hessian, residual):
        inner = 2**self.depth - 1
        feature, cut = np.full(inner, -1), np.zeros(inner, np.int64)
        missing_left = np.zeros(inner, bool)
        node = np.zeros(len(bins), np.int64)
        features, width = bins.shape[1], BINS + 1
        for level in range(self.depth):
            first, nodes = 2**level - 1, 2**level
            local = node - first
            key = ((local[:, None] * features + np.arange(features)) * width + bins).ravel()
            size = nodes * features * width
            shape = (nodes, features, width)
            g = np.bincount(key, np.repeat(gradient, features), size).reshape(shape)
            h = np.bincount(key, np.repeat(hessian, features), size).reshape(shape)
            n = np.bincount(key, minlength=size).reshape(shape)
            self._split(g, h, n, first, feature, cut, missing_left)
            at = feature[node]
            value = bins[np.arange(len(bins)), np.maximum(at, 0)]
            left = np.where(value == BINS, missing_left[node], value <= cut[node]) | (at < 0)
            node = 2 * node + np.where(left, 1, 2)
        leaf = node - inner
        values = np.zeros(2**self.depth)
        if self.loss == "quantile":
            order = np.argsort(leaf, kind="stable")
            bounds = np.searchsorted(leaf[order], np.arange(2**self.depth + 1))
            for k in range(2**self.depth):
                own = residual[order[bounds[k] : bounds[k + 1]]]
                if len(own):
                    values[k] = np.quantile(own, self.level)
        else:
            g = np.bincount(leaf, gradient, 2**self.depth)
            h = np.bincount(leaf, hessian, 2**self.depth)
            values = -g / (h + self.l2)
        return (feature, cut, missing_left, self.rate * values), leaf

    def _split(self, g, h, n, first, feature, cut, missing_left) -> None:
        total_g, total_h, total_n = (a.sum(axis=2, keepdims=True) for a in (g, h, n))
        best = np.full(len(g), 1e-9)
        for goes_left in (False, True):
            parts = []
            for a in (g, h, n):
                left = np.cumsum(a[:, :, :BINS], axis=2)
                parts.append(left + a[:, :, BINS:] if goes_left else left)
            lg, lh, ln = parts
            rg, rh, rn = total_g - lg, total_h - lh, total_n - ln
            gain = (
                lg**2 / (lh + self.l2) + rg**2 / (rh + self.l2) - total_g**2 / (total_h + self.l2)
            )
            gain = np.where((ln >= self.min_leaf) & (rn >= self.min_leaf), gain, -1.0)
            flat = gain.reshape(len(g), -1)
            top = flat.argmax(axis=1)
            for k, t in enumerate(top):
                if flat[k, t] > best[k]:
                    best[k] = flat[k, t]
                    feature[first + k], cut[first + k] = divmod(int(t), BINS)
                    missing_left[first + k] = goes_left

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = self._binned(np.asarray(x, float))
        out = np.full(len(bins), self.start)
        rows = np.arange(len(bins))
        for feature, cut, missing_left, values in self.trees:
            node = np.zeros(len(bins), np.int64)
            for _ in range(self.depth):
                at = feature[node]
                value = bins[rows, np.maximum(at, 0)]
                left = np.where(value == BINS, missing_left[node], value <= cut[node]) | (at < 0)
                node = 2 * node + np.where(left, 1, 2)
            out += values[node - (2**self.depth - 1)]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Quantiles, or probabilities of label 1."""
        raw = self.raw(x)
        return raw if self.loss == "quantile" else 1 / (1 + np.exp(-raw))
