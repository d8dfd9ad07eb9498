"""A small random forest in numpy, for features that a driver can hold: rows of a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while (inner := self.feature[at] >= 0).any():
            k = at[inner]
            at[inner] = np.where(x[inner, self.feature[k]] <= self.cut[k], self.left[k], self.right[k])
        return self.value[at]


@dataclass
class Forest:
    """Mean of the class shares that the trees give."""

    trees: list[Tree]
    classes: list[str]

    def shares(self, x: np.ndarray) -> np.ndarray:
        return sum(t.predict(x) for t in self.trees) / len(self.trees)

    def predict(self, x: np.ndarray) -> list[str]:
        return [self.classes[k] for k in self.shares(x).argmax(axis=1)] if len(x) else []


def best_cut(x: np.ndarray, y: np.ndarray, least: int) -> tuple[float, float]:
    """(Gini gain, cut) of the best split of one feature; classes are one-hot rows ``y`` with weights."""
    order = np.argsort(x, kind="stable")
    xs, acc = x[order], np.cumsum(y[order], axis=0)
    total = acc[-1]
    ok = np.flatnonzero(xs[:-1] < xs[1:])
    ok = ok[(ok >= least - 1) & (ok < len(xs) - least)]
    if not len(ok):
        return 0.0, 0.0
    left = acc[ok]
    right = total - left
    nl, nr = left.sum(axis=1), right.sum(axis=1)
    gain = (left**2).sum(axis=1) / nl + (right**2).sum(axis=1) / nr - (total**2).sum() / total.sum()
    k = int(gain.argmax())
    return float(gain[k]), float((xs[ok[k]] + xs[ok[k] + 1]) / 2)


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int, tried: int) -> Tree:
    nodes: list[list] = []

    def build(rows: np.ndarray, d: int) -> int:
        at = len(nodes)
        own = y[rows].sum(axis=0)
        nodes.append([-1, 0.0, 0, 0, own / own.sum()])
        if d and (own > 0).sum() > 1 and len(rows) >= 2 * least:
            found = [(*best_cut(x[rows, f], y[rows], least), int(f)) for f in rng.permutation(x.shape[1])[:tried]]
            gain, cut, f = max(found)
            if gain > 1e-9:
                below = x[rows, f] <= cut
                nodes[at][0], nodes[at][1] = f, cut
                nodes[at][2] = build(rows[below], d - 1)
                nodes[at][3] = build(rows[~below], d - 1)
        return at

    build(np.arange(len(x)), depth)
    f, c, lo, hi, v = zip(*nodes, strict=True)
    return Tree(np.array(f), np.array(c), np.array(lo), np.array(hi), np.array(v))


def fit(x: np.ndarray, labels: list[str], trees: int = 12, depth: int = 10, least: int = 3, seed: int = 5) -> Forest:
    """Trees over bootstrap samples, each split over a random third of the features; classes weigh the square root of their size."""
    classes = sorted(set(labels))
    rng = np.random.default_rng(seed)
    k = np.array([classes.index(c) for c in labels])
    weight = np.bincount(k, minlength=len(classes)) ** -0.5
    y = np.eye(len(classes))[k] * weight[k][:, None]
    made = []
    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x))
        made.append(grow(x[rows], y[rows], rng, depth, least, max(3, x.shape[1] // 3)))
    return Forest(made, classes)
