"""A generative label model: accuracies and correlations of voting functions, learned without labels."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np


class LabelModel:
    """Votes of -1, 0, 1 by ``n`` functions on pairs that match or don't.

    Within each class the votes form a dependency tree (each function given one
    other), so correlated functions don't count twice.  The tree is that of most
    conditional mutual information (Chow and Liu) under the current posteriors and
    is learned with the tables by EM over counts of vote patterns - at most 3**n of
    them, whatever the number of pairs.
    """

    def __init__(self, n: int, prior: float = 0.5, smooth: float = 0.5):
        self.n, self.prior, self.smooth = n, prior, smooth
        self.parent: list[int] = [-1] * n
        self.tables: list[np.ndarray] = []

    def fit(self, patterns: np.ndarray, counts: np.ndarray, weights: np.ndarray, steps: int = 60) -> np.ndarray:
        """Posterior of a match per pattern; ``weights``: how strongly each function's vote for (first row) and against (second) counts in the first guess."""
        v = patterns.astype(int) + 1
        c = counts.astype(float)
        post = 1 / (1 + np.exp(-2 * (np.maximum(patterns, 0) @ weights[0] - np.maximum(-patterns, 0) @ weights[1])))
        for step in range(steps):
            if step in (0, 5, 15):
                self._tree(v, c, post)
            self._tables(v, c, post)
            new = self.posterior(patterns)
            if np.abs(new - post).max() < 1e-7 and step > 16:
                post = new
                break
            post = new
        return post

    def _tree(self, v: np.ndarray, c: np.ndarray, post: np.ndarray) -> None:
        gain = {}
        for i, j in combinations(range(self.n), 2):
            total = 0.0
            for w in (c * post, c * (1 - post)):
                t = np.full((3, 3), self.smooth)
                np.add.at(t, (v[:, i], v[:, j]), w)
                p = t / t.sum()
                total += w.sum() / max(c.sum(), 1e-9) * float((p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))).sum())
            gain[i, j] = total
        self.parent, inside = [-1] * self.n, {0}
        while len(inside) < self.n:
            i, j = max(((i, j) for i in inside for j in range(self.n) if j not in inside), key=lambda x: gain[min(x), max(x)])
            self.parent[j] = i
            inside.add(j)

    def _tables(self, v: np.ndarray, c: np.ndarray, post: np.ndarray) -> None:
        self.prior = float(np.clip((c * post).sum() / max(c.sum(), 1e-9), 1e-4, 1 - 1e-4))
        self.tables = []
        for j, p in enumerate(self.parent):
            t = np.full((2, 3, 3), self.smooth)
            up = v[:, p] if p >= 0 else np.zeros(len(v), int)
            np.add.at(t, (1, up, v[:, j]), c * post)
            np.add.at(t, (0, up, v[:, j]), c * (1 - post))
            self.tables.append(t / t.sum(2, keepdims=True))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        v = patterns.astype(int) + 1
        odds = np.full(len(v), math.log(self.prior / (1 - self.prior)))
        for j, p in enumerate(self.parent):
            up = v[:, p] if p >= 0 else np.zeros(len(v), int)
            odds += np.log(self.tables[j][1, up, v[:, j]] / self.tables[j][0, up, v[:, j]])
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
