"""Isolation trees: grown on small samples, scored as a projection.

A tree cuts a sample of at most `SAMPLE` rows by random features at random places until rows are alone; rows that are
soon alone are unusual. Only the samples reach the driver (trees x SAMPLE rows of a few numbers, a stated bound), where
the trees are grown; they then are flat arrays inside one column expression, so that every row is scored where it is,
without a shuffle, a join or Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the method: trees, and rows that a tree is grown on.
TREES, SAMPLE = 100, 256


def mean_path(n: int) -> float:
    """The mean depth of an unsuccessful search in a binary tree over n rows: what a leaf of n rows still stands for."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


@dataclass(frozen=True)
class Forest:
    """All trees in one set of arrays: a node's feature (-1: leaf), threshold or path length, and left child.

    The right child follows the left one; tree i starts at roots[i].
    """

    feature: list[int]
    value: list[float]
    left: list[int]
    roots: list[int]
    rows: int

    def depth(self) -> int:
        return math.ceil(math.log2(max(self.rows, 2)))

    def paths(self, x: list[float]) -> list[float]:
        """A row's path length in each tree, step by step."""
        out = []
        for at in self.roots:
            while self.feature[at] >= 0:
                at = self.left[at] + (x[self.feature[at]] > self.value[at])
            out.append(self.value[at])
        return out


def grow(sample: np.ndarray, trees: int = TREES, rows: int = SAMPLE, seed: int = 0) -> Forest:
    """A forest over the sample (n x d): each tree on at most `rows` rows of it, drawn without replacement."""
    rng = np.random.default_rng(seed)
    n = min(rows, len(sample))
    limit = math.ceil(math.log2(max(n, 2)))
    feature, value, left, roots = [], [], [], []

    def node() -> int:
        feature.append(-1), value.append(0.0), left.append(-1)
        return len(feature) - 1

    for _ in range(trees):
        root = node()
        roots.append(root)
        work = [(root, sample[rng.permutation(len(sample))[:n]], 0)]
        while work:
            at, here, depth = work.pop()
            low, high = here.min(axis=0), here.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= limit or len(here) <= 1 or not len(usable):
                value[at] = depth + mean_path(len(here))
                continue
            f = int(rng.choice(usable))
            # below the highest value, so that both sides have a row
            cut = min(float(rng.uniform(low[f], high[f])), float(np.nextafter(high[f], low[f])))
            feature[at], value[at], left[at] = f, cut, node()
            node()
            right = here[:, f] > cut
            work += [(left[at], here[~right], depth + 1), (left[at] + 1, here[right], depth + 1)]
    return Forest(feature, value, left, roots, n)


def _literal(values: list, kind: str) -> Column:
    # one constant, which the optimizer folds, instead of an expression for each element
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def score(forest: Forest, features: list[Column]) -> Column:
    """Within (0, 1]: 2 ^ -(mean path / the mean path of a sample's tree); higher is more unusual."""
    feature, value, left, roots = _literal(forest.feature, "int"), _literal(forest.value, "double"), _literal(forest.left, "int"), _literal(forest.roots, "int")
    x = F.array(*[f.cast("double") for f in features])
    steps = F.sequence(F.lit(1), F.lit(max(1, forest.depth())))

    def down(at: Column, _: Column) -> Column:
        f = F.get(feature, at)
        return F.when(f < 0, at).otherwise(F.get(left, at) + (F.get(x, f) > F.get(value, at)).cast("int"))

    total = F.aggregate(roots, F.lit(0.0), lambda s, root: s + F.get(value, F.aggregate(steps, root, down)))
    return F.pow(F.lit(2.0), -total / len(forest.roots) / (mean_path(forest.rows) or 1.0))


def sampled(rows: DataFrame, key: str, features: list[str], trees: int = TREES, each: int = SAMPLE) -> np.ndarray:
    """The trees' sample: the trees x each rows of smallest key hash, the same on every run. A row with a null counts 0 there."""
    got = rows.select(F.xxhash64(key).alias("_h"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]).orderBy("_h", *features).limit(trees * each).drop("_h").collect()
    return np.array([list(r) for r in got], float).reshape(-1, len(features))


def isolation(rows: DataFrame, key: str, features: list[str], least: int = 8, seed: int = 0) -> tuple[Column, bool]:
    """The isolation of rows by `features`, and whether there were enough of them; with fewer than `least` it is 0."""
    sample = sampled(rows, key, features)
    if len(sample) < least:
        return F.lit(0.0), False
    return score(grow(sample, seed=seed), [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]), True
