"""Boosted trees and forests on the different rows of a training fold.

Trees see a row only by its features' bins, its target and its weight, so equal
rows are one row with a count: sums over a bag of rows are sums over different
rows times the counts drawn.  Nothing is left out.  Bins, splits, gains, draws
and losses are MLlib's (32 bins, its thresholds, variance, which for labels of 0
and 1 is half of Gini; a first boosted tree of weight 1); only the random numbers
differ, and quantiles are taken over all rows.  The fits are for tables whose
different rows fit the driver; learners and policy leave others to MLlib.
Functions are pickled by value, so executors need not have this repository."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Different rows with which the trees are fitted here; with more, by MLlib.
MOST = 100_000
BINS = 32


def different(train: DataFrame, target: str, most: int = MOST):
    """(x, target, weight, count) of the different rows of train (x a vector,
    weight), or None if there are more than ``most`` or none."""
    t = train.groupBy(vector_to_array("x").alias("x"), F.col(target).cast("double").alias("t"), F.col("weight").cast("double").alias("w")).agg(F.count("*").alias("n")).limit(most + 1).toArrow()
    if not 0 < t.num_rows <= most:
        return None
    x = t["x"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    t, w, n = (t[c].to_numpy() for c in "twn")
    order = np.lexsort((w, t, *x.T))  # Spark's order is not fixed, draws are
    return x[order], t[order], w[order], n[order]


def thresholds(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """MLlib's candidate splits of a feature: all midpoints, or those nearest to
    equal shares of the weight."""
    v, at = np.unique(values, return_inverse=True)
    middle = (v[:-1] + v[1:]) / 2
    if len(middle) < bins:
        return middle
    upto = np.cumsum(np.bincount(at, weights))
    step, out = upto[-1] / bins, []
    goal = step
    for i in range(len(middle)):
        if abs(upto[i] - goal) < abs(upto[i + 1] - goal):
            out.append(middle[i])
            goal += step
    return np.array(out)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], 1).astype(np.uint8)


def prepare(rows) -> tuple[list[np.ndarray], tuple]:
    """Splits of the features, and the rows by bins, those now equal made one."""
    x, t, w, n = rows
    cuts = [thresholds(c, w * n) for c in x.T]
    keys, at = np.unique(np.column_stack((binned(x, cuts), t, w)), axis=0, return_inverse=True)
    return cuts, (keys[:, :-2].astype(np.uint8), keys[:, -2], keys[:, -1], np.bincount(at.ravel(), n).astype(np.int64))


def grow(b, t, w, n, depth: int, features: int, least: int, rng) -> tuple[np.ndarray, ...]:
    """One tree, level by level: (feature or -1 in a leaf, last bin that goes left,
    left child, mean) of each node; a right child follows the left one.  n: rows
    of the bag."""
    rows = np.flatnonzero(n)
    if not len(rows):  # an empty bag
        return np.array([-1]), np.zeros(1, int), np.zeros(1, int), np.zeros(1)
    b, n, w = b[rows], n[rows].astype(float), (w * n)[rows]
    s, width, wide = w * t[rows], int(b.max()) + 1, b.shape[1]
    base = b + np.arange(wide) * width
    levels, first = [(np.array([-1]), np.array([0]), np.array([0]), np.array([s.sum() / w.sum()]))], 0
    node = np.zeros(len(b), int)
    for _ in range(depth if width > 1 else 0):
        feature, cut, left, value = levels[-1]
        m = len(feature)
        key = (node[:, None] * (wide * width) + base).ravel()
        cn, cw, cs = (np.bincount(key, np.repeat(a, wide), m * wide * width).reshape(m, wide, width).cumsum(2) for a in (n, w, s))
        tn, tw, ts = (c[:, :1, -1:] for c in (cn, cw, cs))
        cn, cw, cs = (c[:, :, :-1] for c in (cn, cw, cs))
        drawn = rng.random((m, wide)).argsort(1).argsort(1) < features
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = cs * cs / cw + (ts - cs) ** 2 / (tw - cw) - ts * ts / tw
        gain = np.where((cn >= least) & (tn - cn >= least) & (cw > 0) & (tw > cw) & drawn[:, :, None], gain, -np.inf).reshape(m, -1)
        best = gain.argmax(1)
        split = gain[np.arange(m), best] > 1e-12 * np.abs(ts * ts / tw)[:, 0, 0]
        k = int(split.sum())
        if not k:
            break
        at, best = np.flatnonzero(split), best[split]
        f, c = best // (width - 1), best % (width - 1)
        feature[at], cut[at], left[at] = f, c, first + m + 2 * np.arange(k)
        ls, lw = cs[at, f, c], cw[at, f, c]
        means = np.stack((ls / lw, (ts[at, 0, 0] - ls) / (tw[at, 0, 0] - lw)), 1).ravel()
        stay = split[node]
        node, base, b, n, w, s = (a[stay] for a in (node, base, b, n, w, s))
        node = left[node] - first - m + (b[np.arange(len(b)), feature[node]] > cut[node])
        levels.append((np.full(2 * k, -1), np.zeros(2 * k, int), np.zeros(2 * k, int), means))
        first += m
    return tuple(np.concatenate(x).astype(d) for x, d in zip(zip(*levels, strict=True), (np.int16, np.uint8, np.int32, float), strict=True))


def pruned(tree):
    """Leaves that vote for the same class become their parent, as in MLlib."""
    feature, cut, left, value = tree
    for i in np.flatnonzero(feature >= 0)[::-1]:
        j = left[i]
        if feature[j] < 0 and feature[j + 1] < 0 and (value[j] > 0.5) == (value[j + 1] > 0.5):
            feature[i] = -1
    return tree


def values(tree, b: np.ndarray) -> np.ndarray:
    feature, cut, left, value = tree
    node, rows = np.zeros(len(b), int), np.arange(len(b))
    while len(rows):
        f = feature[node[rows]]
        rows, f = rows[f >= 0], f[f >= 0]
        at = node[rows]
        node[rows] = left[at] + (b[rows, f] > cut[at])
    return value[node]


def boosted(rows, trees: int, seed: int, logistic: bool = False, step: float = 0.05, depth: int = 6, least: int = 5, part: float = 0.8):
    """Splits, trees and their weights.  ``logistic``: targets of 0 and 1 and the
    loss 2 ln(1 + exp(-2yF)), y of -1 and 1; else squares."""
    cuts, (b, t, w, n) = prepare(rows)
    t = 2 * t - 1 if logistic else t
    out, f, r = [], np.zeros(len(b)), t
    for k in range(trees):
        rng = np.random.default_rng((seed, k))
        tree = grow(b, r, w, rng.binomial(n, part), depth, -(-b.shape[1] * 8 // 10), least, rng)
        out.append(tree)
        f += (step if k else 1.0) * values(tree, b)
        r = 4 * t / (1 + np.exp(np.minimum(2 * t * f, 700))) if logistic else 2 * (t - f)
    return cuts, out, [1.0] + [step] * (trees - 1)


def forest(spark, rows, trees: int, seed: int, depth: int = 10):
    """Trees on bootstrap samples, grown in tasks."""
    cuts, data = prepare(rows)
    shared = spark.sparkContext.broadcast(data)

    def one(k):
        b, t, w, n = shared.value
        rng = np.random.default_rng((seed, k))
        return k, pruned(grow(b, t, w, rng.poisson(n), depth, int(np.ceil(np.sqrt(b.shape[1]))), 1, rng))

    slices = min(trees, 4 * spark.sparkContext.defaultParallelism)
    grown = spark.sparkContext.parallelize(range(trees), slices).map(one).collect()
    shared.unpersist()
    return cuts, [tree for _, tree in sorted(grown, key=lambda p: p[0])], [1 / trees] * trees


def score(spark, model, x: Column, logistic: bool = False) -> Column:
    """The weighted sum of the trees at the vector x (``logistic``: 1 / (1 +
    exp(-2 sum))).  A batch's different rows are scored once."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cuts, trees, weights = shared.value
        seen: dict[bytes, float] = {}
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=float)
                continue
            b, at = np.unique(binned(np.stack(batch.to_numpy()), cuts), axis=0, return_inverse=True)
            keys = [r.tobytes() for r in b]
            new = [i for i, key in enumerate(keys) if key not in seen]
            if len(seen) > MOST:
                seen, new = {}, list(range(len(keys)))
            total = np.zeros(len(new))
            for tree, weight in zip(trees, weights, strict=True):
                total += weight * values(tree, b[new])
            for i, v in zip(new, 1 / (1 + np.exp(np.clip(-2 * total, -700, 700))) if logistic else total, strict=True):
                seen[keys[i]] = v
            yield pd.Series(np.array([seen[key] for key in keys])[at.ravel()])

    return run(vector_to_array(x))
