"""What tasks compute on blocks of rows: places in trees, seeded draws, impurities, subtrees on exact values.

NumPy alone, so that a Python worker loads little more than that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa


def bin_place(bins: np.ndarray, tree: tuple) -> np.ndarray:
    """The node of every row."""
    feature, cut, left, right, _, depth = tree
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        inner = feature[at] >= 0
        goes = bins[rows, np.maximum(feature[at], 0)] <= cut[at]
        at = np.where(inner, np.where(goes, left[at], right[at]), at)
    return at


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def chance(row: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 that depends on the row and the salt alone."""
    with np.errstate(over="ignore"):
        x = (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt & 0xFFFFFFFFFFFFFFFF) * np.uint64(0xBF58476D1CE4E5B9)
        for shift in (30, 27, 31):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def impurity_of(weights: np.ndarray, criterion: str) -> np.ndarray:
    """Gini impurity or entropy (in bits, as Spark's) of class weights along the last axis."""
    total = weights.sum(-1, keepdims=True)
    share = np.divide(weights, total, out=np.zeros_like(weights), where=total > 0)
    if criterion == "gini":
        return 1 - (share**2).sum(-1)
    return -(share * np.log2(share, out=np.zeros_like(share), where=share > 0)).sum(-1)


def mixed(a: np.ndarray, b: np.ndarray, criterion: str) -> np.ndarray:
    """Weight times impurity of two classes, as :func:`impurity_of` gives it."""
    total = a + b
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = a / total, b / total
        if criterion == "gini":
            out = total * (1 - (p * p + q * q))
        else:
            out = total * -(np.where(p > 0, p * np.log2(p), 0.0) + np.where(q > 0, q * np.log2(q), 0.0))
    return np.where(total > 0, out, 0.0)


def draw(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a row is in a tree's bootstrap sample: Poisson with mean 1, from the row and the tree alone."""
    drawn, out, term, total = chance(row, (seed << 24) + tree), np.zeros(len(row), np.int64), np.exp(-1.0), np.exp(-1.0)
    for k in range(1, 16):
        out += drawn >= total
        term /= k
        total += term
    return out


@dataclass(frozen=True)
class Growth:
    """What all nodes share: criterion, features tried per node, least rows of a leaf, seed."""

    criterion: str
    tried: int
    least: int
    seed: int


def grow_local(x: np.ndarray, y: np.ndarray, w: np.ndarray, rows: np.ndarray, growth: Growth, tree: int, root: int) -> list[tuple]:
    """Subtree on exact values: (feature, threshold, left, right, class weights, rows) per node, children after parents.

    Features are tried in a seeded order until ``tried`` of them vary, so a node is a leaf only if its rows are of one class,
    are equal in all features, or are too few. A threshold lies halfway between two neighbouring values.
    """
    rng = np.random.default_rng([growth.seed, tree, root])
    out: list[tuple] = [()]
    waiting = [(0, np.arange(len(y)))]
    while waiting:
        place, at = waiting.pop()
        mine, weight = y[at], w[at]
        stats = np.bincount(mine, weight, 2)
        n = int(rows[at].sum())
        best = None
        if (stats > 0).all() and n >= 2 * growth.least:
            turn = rng.permutation(x.shape[1])
            values = x[at]
            vary = np.fmax.reduce(values, 0) > np.fmin.reduce(values, 0)
            tried = turn[vary[turn]][: growth.tried]
            if len(tried):
                # All tried features side by side, (rows, features): most nodes are small, so calls count more than rows.
                values = values[:, tried]
                order = values.argsort(0, kind="stable")
                values = np.take_along_axis(values, order, 0)
                weights, classes = weight[order], mine[order]
                left = [np.where(classes == c, weights, 0.0).cumsum(0)[:-1] for c in (0, 1)]
                count = rows[at][order].cumsum(0)[:-1]
                fits = (values[1:] > values[:-1]) & (count >= growth.least) & (n - count >= growth.least)
                below = mixed(*left, growth.criterion) + mixed(*(total - side for total, side in zip(stats, left, strict=True)), growth.criterion)
                below = np.where(fits, below, np.inf)
                cuts = below.argmin(0)
                for place_of, (j, k) in enumerate(zip(tried.tolist(), cuts.tolist(), strict=True)):
                    least = below[k, place_of]
                    if np.isfinite(least) and (best is None or least < best[0] - 1e-12):
                        low, high = values[k, place_of], values[k + 1, place_of]
                        middle = low + (high - low) / 2
                        best = least, j, float(middle if middle < high else low)
        if best is None:
            out[place] = (-1, 0.0, -1, -1, stats, n)
            continue
        _, j, threshold = best
        goes = x[at, j] <= threshold
        first = len(out)
        out[place] = (j, threshold, first, first + 1, stats, n)
        out += [(), ()]
        waiting += [(first, at[goes]), (first + 1, at[~goes])]
    return out


def value_place(x: np.ndarray, tree: tuple[np.ndarray, ...], depth: int) -> np.ndarray:
    """The node of every row, at most ``depth`` below the root."""
    feature, threshold, left, right = tree
    at, moving = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        moving = moving[feature[at[moving]] >= 0]
        if not len(moving):
            break
        here = at[moving]
        at[moving] = np.where(x[moving, feature[here]] <= threshold[here], left[here], right[here])
    return at


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees, one tree after another. Values up to the threshold go left; a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray  # by class and node
    roots: np.ndarray
    depth: int

    def step(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.where(value <= self.threshold[at], self.left[at], self.right[at])

    def ways(self, x: np.ndarray) -> list[np.ndarray]:
        """The nodes (rows, trees) that rows pass on every level, the leaves last."""
        first = (np.arange(len(x)) * x.shape[1])[:, None]
        out = [np.broadcast_to(self.roots, (len(x), len(self.roots)))]
        for _ in range(self.depth):
            out.append(self.step(out[-1], x.ravel()[first + self.feature[out[-1]]]))
        return out

    def answers(self, x: np.ndarray) -> np.ndarray:
        """The class of each row; votes are added tree by tree, as Spark does, and the first class wins a tie."""
        leaves = self.ways(x)[-1]
        low, high = (self.share[k][leaves].cumsum(1)[:, -1] for k in (0, 1))
        return high > low


#: Votes closer than this are counted again tree by tree, since their sum may be off by rounding.
NEAR_TIE = 1e-9


def swapped_answers(forest: Forest, own: np.ndarray, donor: np.ndarray) -> np.ndarray:
    """The class (rows, features) of each row with one feature taken from its donor.

    A tree answers otherwise only if a node on the row's own way asks for that feature and sends the donor's value to the
    other side. So the row goes down once, and again only below the first such node of a feature.
    """
    n, size = own.shape
    trees = len(forest.roots)
    ways = forest.ways(own)
    gain = forest.share[1] - forest.share[0]
    first = (np.arange(n) * size)[:, None]
    own_flat, donor_flat = own.ravel(), donor.ravel()
    leaf = ways[-1].ravel()
    votes = np.repeat(gain[ways[-1]].sum(1), size)
    done = np.zeros(n * trees * size, bool)
    for level in range(forest.depth):
        at, after = ways[level], ways[level + 1]
        other = forest.step(at, donor_flat[first + forest.feature[at]])
        pair = np.flatnonzero(other != after)  # row and tree
        asked = forest.feature[at].ravel()[pair]
        fresh = ~done[pair * size + asked]
        pair, asked = pair[fresh], asked[fresh]
        done[pair * size + asked] = True
        place, base = other.ravel()[pair], pair // trees * size
        for _ in range(level + 1, forest.depth):
            feature = forest.feature[place]
            cell = base + feature
            place = forest.step(place, np.where(feature == asked, donor_flat[cell], own_flat[cell]))
        votes += np.bincount(base + asked, gain[place] - gain[leaf[pair]], n * size)
    out = votes > 0
    near = np.flatnonzero(np.abs(votes) < NEAR_TIE)
    for at in (near[k : k + len(own)] for k in range(0, len(near), max(len(own), 1))):
        row, feature = at // size, at % size
        x = own[row]
        x[np.arange(len(at)), feature] = donor[row, feature]
        out[at] = forest.answers(x)
    return out.reshape(n, size)
