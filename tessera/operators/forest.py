"""Random forests over counted cells (M1, M2, M7, M8).

A forest looks at a feature through at most ``BINS`` ranges, so rows that fall into the same ranges and class are
one cell with a count. Spark counts the cells in one pass, and a bag drawn for a cell is the sum of
the bags of its rows (Poisson). Trees are grown from the cells in tasks of their own, so their cost does not grow with the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of a feature, and cells that trees are grown from; with more, the rows go to Spark's forest.
BINS, CELLS = 32, 1 << 18


def edges(rows: DataFrame, features: list[str]) -> list[list[float]]:
    """The quantiles of each feature that bound its ranges."""
    at = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    row = rows.agg(*[F.percentile_approx(c, at, 10_000).alias(c) for c in features]).first()
    return [sorted(set(row[c] or [])) for c in features]


def ranges(feature: str, cuts: list[float]) -> Column:
    """The number of cuts below the value."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in cuts]), lambda e: e < F.col(feature))) if cuts else F.lit(0)


def grown(bins: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray, classes: int, depth: int, least: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """One tree by Gini impurity, level by level: (feature or -1, cut, left child, class weights) of its nodes, and the features' gains.

    ``n`` counts the bagged rows of each cell, ``w`` weighs one. A node looks at sqrt(features) features drawn for it.
    """
    d, take = bins.shape[1], int(np.ceil(np.sqrt(bins.shape[1])))
    feature, cut, child, gains = [-1], [0], [0], np.zeros(d)
    cells = np.flatnonzero(n)
    node = np.zeros(len(cells), np.int64)
    bins, y, n, weight = bins[cells], y[cells], n[cells].astype(float), (n * w)[cells]
    stats = [np.bincount(y, weight, classes)]
    first, level = 0, 1
    for _ in range(depth):
        impurity = lambda s: s.sum(-1) - (s * s).sum(-1) / np.maximum(s.sum(-1), 1e-300)
        best, at, where = np.zeros(level), np.full(level, -1), np.zeros(level, np.int64)
        drawn = rng.random((level, d)).argsort(axis=1) < take
        live = node >= first
        own = node[live] - first
        for f in range(d):
            key = (own * BINS + bins[live, f]) * classes + y[live]
            h = np.bincount(key, weight[live], level * BINS * classes).reshape(level, BINS, classes).cumsum(axis=1)
            m = np.bincount(own * BINS + bins[live, f], n[live], level * BINS).reshape(level, BINS).cumsum(axis=1)
            gain = impurity(h[:, -1])[:, None] - impurity(h) - impurity(h[:, -1:] - h)
            gain[(m < least) | (m[:, -1:] - m < least) | ~drawn[:, f : f + 1]] = -1.0
            top = gain.argmax(axis=1)
            value = gain[np.arange(level), top]
            better = value > np.maximum(best, 1e-9)
            best[better], at[better], where[better] = value[better], f, top[better]
        split = np.flatnonzero(at >= 0)
        if not len(split):
            break
        start = len(feature)
        to = np.full(level, -1)
        to[split] = start + 2 * np.arange(len(split))
        for k in split.tolist():
            feature[first + k], cut[first + k], child[first + k] = int(at[k]), int(where[k]), int(to[k])
            gains[at[k]] += best[k]
        feature += [-1] * (2 * len(split))
        cut += [0] * (2 * len(split))
        child += [0] * (2 * len(split))
        go = np.flatnonzero(live)[to[own] >= 0]
        k = node[go] - first
        node[go] = to[k] + (bins[go, at[k]] > where[k])
        first, level = start, 2 * len(split)
        new = np.zeros((level, classes))
        np.add.at(new, (node[go] - first, y[go]), weight[go])
        stats += list(new)
    return np.array(feature), np.array(cut), np.array(child), np.array(stats), gains


def voted(bins: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """The class shares of the leaf of each row of ranges."""
    feature, cut, child, stats, _ = tree
    node = np.zeros(len(bins), np.int64)
    while True:
        f = feature[node]
        go = np.flatnonzero(f >= 0)
        if not len(go):
            break
        node[go] = child[node[go]] + (bins[go, f[go]] > cut[node[go]])
    s = stats[node]
    return s / np.maximum(s.sum(axis=1, keepdims=True), 1e-300)


def forest(counts, spots: np.ndarray, classes: int, trees: int, depth: int, least: int, seed: int, spark) -> tuple[np.ndarray, np.ndarray]:
    """The forest's class shares at ``spots`` (rows of ranges), summed over the trees, and the features' importances.

    ``counts`` are the cells: ranges, class, count, weight of one row. Tasks take trees, and each sends one array.
    """
    bins, y, n, w = counts
    d = bins.shape[1]
    cells, at = spark.sparkContext.broadcast((bins, y, n, w)), spark.sparkContext.broadcast(spots)

    def run(batches):
        votes, told = np.zeros((len(at.value), classes)), np.zeros(d)
        b, c, m, v = cells.value
        for t in (t for batch in batches for t in batch.column(0).to_pylist()):
            rng = np.random.default_rng([seed, t])
            tree = grown(b, c, rng.poisson(m), v, classes, depth, least, rng)
            votes += voted(at.value, tree)
            told += tree[-1] / max(tree[-1].sum(), 1e-300)
        yield pa.RecordBatch.from_arrays([pa.array([votes.tobytes()], pa.binary()), pa.array([told.tobytes()], pa.binary())], names=["votes", "told"])

    tasks = min(trees, spark.sparkContext.defaultParallelism)
    got = spark.range(0, trees, 1, tasks).mapInArrow(run, "votes binary, told binary").toLocalIterator()
    votes, told = np.zeros((len(spots), classes)), np.zeros(d)
    for r in got:
        votes += np.frombuffer(r["votes"]).reshape(votes.shape)
        told += np.frombuffer(r["told"])
    return votes, told / max(told.sum(), 1e-300)
