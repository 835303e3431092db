"""Numeric core of the boosted trees: bins, gradients, splits and scores.

Gradients are rounded to whole multiples of a small unit. Their sums are exact, so a tree
doesn't depend on the order of rows or on how many tasks add them up. The trees of all outcomes
grow together. They are complete: a node that isn't split sends its rows to its left child, which
can't be split either.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

# Gradients up to 1 as whole numbers. A weight holds the hessian above the gradient; both are
# read from sums of a chunk of weights, which stay below 2^53.
UNIT = 2.0**15
ABOVE = 2.0**28
CHUNK = 4_095


@dataclass(frozen=True)
class Options:
    trees: int
    max_depth: int
    learning_rate: float
    subsample: float
    column_share: float
    min_child_weight: float
    min_gain: float
    l1: float
    l2: float
    bins: int
    seed: int

    def drawn(self, position: np.ndarray, tree: int) -> np.ndarray:
        """Rows of a tree, by a hash of their position."""
        if self.subsample >= 1:
            return np.ones(len(position), dtype=bool)
        start = np.random.default_rng([self.seed, tree]).integers(2**63, dtype="uint64")
        x = position.astype("uint64") * np.uint64(0x9E3779B97F4A7C15) + start
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) < np.uint64(int(self.subsample * 2**64))

    def columns(self, m: int, tree: int) -> np.ndarray:
        many = max(1, int(self.column_share * m))
        return np.sort(np.random.default_rng([self.seed, tree, 1]).permutation(m)[:many])


@dataclass(frozen=True)
class Tree:
    """One tree per outcome: ``feature`` and ``cut`` of the inner nodes, ``value`` of the leaves."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def step(self, codes: np.ndarray, level: int, at: np.ndarray) -> np.ndarray:
        """Places in the next level of rows at ``at`` in this one, a row per outcome; those of an outcome follow those of the one before."""
        here = slice(2**level - 1, 2 ** (level + 1) - 1)
        feature, cut = self.feature[:, here].ravel(), self.cut[:, here].ravel()
        code = codes.ravel().take(feature.take(at) + np.arange(0, codes.size, codes.shape[1]))
        return 2 * at + (code > cut.take(at))

    def added(self, codes: np.ndarray, raw: np.ndarray) -> np.ndarray:
        at = roots(len(raw), len(codes))
        for level in range(int(np.log2(self.value.shape[1]))):
            at = self.step(codes, level, at)
        return raw + self.value.ravel().take(at)


def roots(outcomes: int, rows: int) -> np.ndarray:
    return np.repeat(np.arange(outcomes)[:, None], rows, axis=1)


def quantiles(bins: int) -> list[float]:
    return [k / bins for k in range(1, bins)]


def edges_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    if not len(x):
        return [np.empty(0)] * x.shape[1]
    cuts = np.quantile(x, quantiles(bins), axis=0, method="inverted_cdf")
    return [np.unique(c) for c in cuts.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    codes = [np.searchsorted(e, x[:, j], side="left").astype("uint8") for j, e in enumerate(edges)]
    return np.stack(codes, axis=1)


def prior(counts: np.ndarray) -> np.ndarray:
    """Log odds of the outcomes, of which ``counts`` are known."""
    share = (counts + 0.5) / (counts.sum() + 1.0)
    return np.log(share / (1.0 - share))


def chances(raw: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-raw))


def weights(raw: np.ndarray, happened: np.ndarray) -> np.ndarray:
    """Gradient and hessian of the logistic loss in one number."""
    p = chances(raw)
    return np.rint((p - happened) * UNIT) + np.rint(p * (1.0 - p) * UNIT) * ABOVE


def picked(mask: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Rows of the mask, outcome by outcome, and their values."""
    rows = [np.flatnonzero(m) for m in mask]
    return [np.concatenate(rows), *(np.concatenate([v.take(r) for v, r in zip(value, rows)]) for value in values)]


def cells_of(codes: np.ndarray, columns: np.ndarray, bins: int) -> np.ndarray:
    """Bins of each column counted on from those of the column before."""
    return codes.take(columns, axis=1) + np.arange(len(columns), dtype="int32") * bins


def histograms(cells: np.ndarray, rows: np.ndarray, at: np.ndarray, many: int, bins: int, weight: np.ndarray) -> np.ndarray:
    """Sums of gradient and hessian per place, column and bin, over ``rows`` at ``at`` of that ``weight``."""
    m = cells.shape[1]
    width = m * bins
    sums = np.zeros((2, many * width))
    for begin in range(0, len(rows), CHUNK):
        part = slice(begin, begin + CHUNK)
        cell = cells.take(rows[part], axis=0) + (at[part] * width)[:, None]
        total = np.bincount(cell.ravel(), np.repeat(weight[part], m), many * width)
        hessian = np.rint(total / ABOVE)
        sums[0] += total - hessian * ABOVE
        sums[1] += hessian
    return sums.reshape(2, many, m, bins)


#: Level, splits so far and whether the right child of a node above is the smaller one -> sums of a level:
#: (gradient or hessian, outcome, place, column, bin).
Measure = Callable[[int, Tree, np.ndarray], np.ndarray]


def grow(measure: Measure, outcomes: int, m: int, columns: np.ndarray, options: Options) -> tuple[Tree, np.ndarray]:
    """The next tree of each outcome, and what each column gained."""
    depth, inner = options.max_depth, 2**options.max_depth - 1
    tree = Tree(np.zeros((outcomes, inner), dtype="int64"), np.full((outcomes, inner), options.bins), np.zeros((outcomes, inner + 1)))
    gained, smaller = np.zeros((outcomes, m)), np.zeros((outcomes, 0), dtype=bool)

    def strength(g: np.ndarray) -> np.ndarray:
        return np.maximum(np.abs(g) - options.l1, 0.0)

    for level in range(depth):
        many, first = 2**level, 2**level - 1
        left_g, left_h = measure(level, tree, smaller).cumsum(axis=-1) / UNIT
        all_g, all_h = left_g[..., -1:], left_h[..., -1:]
        right_g, right_h = all_g - left_g, all_h - left_h
        gain = (
            strength(left_g) ** 2 / (left_h + options.l2)
            + strength(right_g) ** 2 / (right_h + options.l2)
            - strength(all_g) ** 2 / (all_h + options.l2)
        )
        gain[(left_h < options.min_child_weight) | (right_h < options.min_child_weight)] = -np.inf
        gain[..., -1] = -np.inf
        flat = gain.reshape(outcomes, many, -1)
        best = flat.argmax(axis=2)[..., None]
        most = np.take_along_axis(flat, best, 2)[..., 0]
        split = (most >= options.min_gain) & (most > 1e-6)
        column = columns[best[..., 0] // options.bins]
        here = slice(first, first + many)
        tree.feature[:, here] = np.where(split, column, 0)
        tree.cut[:, here] = np.where(split, best[..., 0] % options.bins, options.bins)
        for outcome in range(outcomes):
            np.add.at(gained[outcome], column[outcome][split[outcome]], most[outcome][split[outcome]])

        def of_children(left: np.ndarray, whole: np.ndarray) -> np.ndarray:
            whole = whole[:, :, 0, 0]
            own = np.where(split, np.take_along_axis(left.reshape(outcomes, many, -1), best, 2)[..., 0], whole)
            return np.stack([own, whole - own], axis=-1)

        g, h = of_children(left_g, all_g), of_children(left_h, all_h)
        smaller = h[..., 1] <= h[..., 0]
    g, h = g.reshape(outcomes, -1), h.reshape(outcomes, -1)
    tree.value[:] = -options.learning_rate * np.sign(g) * strength(g) / (h + options.l2)
    return tree, gained


def shares(gained: np.ndarray) -> np.ndarray:
    whole = gained.sum(axis=1, keepdims=True)
    return np.divide(gained, whole, out=np.zeros_like(gained), where=whole > 0)


def boosted(codes: np.ndarray, happened: np.ndarray, train: int, options: Options) -> tuple[np.ndarray, np.ndarray]:
    """Chances of the rows from ``train`` on, by trees of the rows before it, and the share of each column in the gain.

    ``codes`` has a row per fixture in order, ``happened`` a row per outcome.
    """
    (n, m), outcomes, bins = codes.shape, len(happened), options.bins
    raw = np.repeat(prior(happened[:, :train].sum(axis=1))[:, None], n, axis=1)
    position, gained = np.arange(1, n + 1), np.zeros((outcomes, m))
    for number in range(options.trees if train else 0):
        columns = options.columns(m, number)
        cells, weight = cells_of(codes, columns, bins), weights(raw, happened)
        drawn = options.drawn(position, number)
        drawn[train:] = False
        at = roots(outcomes, n)
        above = np.empty(0)

        def measure(level: int, tree: Tree, smaller: np.ndarray) -> np.ndarray:
            """Only the smaller child of a node is added up, the other is the rest."""
            nonlocal at, above
            if level:
                at = tree.step(codes, level - 1, at)
            wanted = np.stack([~smaller, smaller], axis=-1).ravel() if level else np.ones(outcomes, dtype=bool)
            rows, place, heavy = picked(wanted.take(at) & drawn, at, weight)
            parents = outcomes * 2 ** max(level - 1, 0)
            part = histograms(cells, rows, place >> 1 if level else place, parents, bins, heavy)
            if level:
                right, other = smaller.reshape(1, -1, 1, 1), above - part
                part = np.stack([np.where(right, other, part), np.where(right, part, other)], axis=2)
            above = part.reshape(2, -1, len(columns), bins)
            return above.reshape(2, outcomes, -1, len(columns), bins)

        tree, gain = grow(measure, outcomes, m, columns, options)
        gained += gain
        raw += tree.value.ravel().take(tree.step(codes, options.max_depth - 1, at))
    return chances(raw[:, train:]), shares(gained)
