"""Regression trees over binned rows, grown a level at a time by Spark for all folds and trees at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.sinks.steps import forget, materialize

#: Sums are kept in whole billionths, so that no order of rows changes a split.
UNIT = 10**9
_TREE = ("fold", "tree")
_NODE = (*_TREE, "node")
#: Levels between two writes of where the rows are.
_WRITE = 4
#: Rows that a task sums at once: a bound on its table of (node, feature, bin).
_ROWS = 8192
#: Sums that a task holds before it adds up those of one key, or passes them on.
_HELD = 1 << 19


@dataclass(frozen=True)
class Shape:
    """How trees grow: levels, bins of a feature, weight a leaf has at least, what is added to it, share of the features a tree may use."""

    depth: int = 6
    bins: int = 16
    least: int = 1
    reg: float = 0.0
    columns: float = 1.0
    seed: int = 42


def binned(features: list[str], bins: int) -> Column:
    """Features in [-1, 1] as an array of equal bins; a null is in the middle."""
    cell = lambda c: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.coalesce(F.col(c), F.lit(0.0)) + 1) / 2 * bins))).cast("int")
    return F.array(*[cell(c) for c in features])


def _summed(bins: int, width: int):
    """From rows (fold, tree, node, g, w, x): a task's sums of w and of g * w by (fold, tree, node, feature, bin), passed on where a task has many."""

    def added(parts: list[np.ndarray]) -> np.ndarray:
        keys, sums = np.concatenate([p[:5] for p in parts], axis=1), np.concatenate([p[5:] for p in parts], axis=1)
        order = np.lexsort(keys[::-1])
        keys, sums = keys[:, order], sums[:, order]
        first = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
        return np.concatenate([keys[:, first], np.add.reduceat(sums, first, axis=1)])

    def out(p: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in p], [*_NODE, "feature", "bin", "n", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                b = batch.slice(at, _ROWS)
                keys, k = np.unique(np.stack([b.column(j).to_numpy() for j in range(3)]), axis=1, return_inverse=True)
                w = b.column(4).to_numpy()
                g = (np.rint(b.column(3).to_numpy() * UNIT) * w).astype(np.int64)
                x = b.column(5).flatten().to_numpy().reshape(-1, width)
                cell = (((k.ravel() * width)[:, None] + np.arange(width)) * bins + x).ravel()
                used, cell = np.unique(cell, return_inverse=True)
                n, s = np.zeros(len(used), np.int64), np.zeros(len(used), np.int64)
                np.add.at(n, cell, np.repeat(w, width))
                np.add.at(s, cell, np.repeat(g, width))
                node, feature = used // bins // width, used // bins % width
                held.append(np.stack([*(keys[j][node] for j in range(3)), feature, used % bins, n, s]))
                if sum(p.shape[1] for p in held) > _HELD:
                    held = [added(held)]
                    if held[0].shape[1] > _HELD // 2:
                        yield out(held.pop())
        if held:
            yield out(added(held))

    return run


def best_splits(rows: DataFrame, shape: Shape, width: int) -> DataFrame:
    """The best split of each node of rows (fold, tree, node, g, w, x): feature and bin (rows up to the bin go left), gain, and the values of both
    sides. A node without a split of some gain has no row. The first feature, then bin, wins among equals."""
    sums = rows.where("w > 0").select(*_NODE, "g", "w", "x").mapInArrow(_summed(shape.bins, width), ", ".join(f"{c} long" for c in (*_NODE, "feature", "bin", "n", "s")))
    if shape.columns < 1:  # every tree draws its features by hash; the first in the draw's order are its own
        drawn = max(1, round(shape.columns * width))
        order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda f: F.struct(F.xxhash64(F.lit(shape.seed), "fold", "tree", f).alias("h"), f.cast("long").alias("f"))))
        sums = sums.withColumn("_own", F.transform(F.slice(order, 1, drawn), lambda x: x["f"])).where(F.array_contains("_own", F.col("feature")))
    sums = sums.repartition(*_NODE).groupBy(*_NODE, "feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    by_feature = Window.partitionBy(*_NODE, "feature")
    so_far = by_feature.orderBy("bin")
    sides = sums.select(*_NODE, "feature", "bin", F.sum("n").over(so_far).alias("ln"), F.sum("s").over(so_far).alias("ls"), F.sum("n").over(by_feature).alias("n"), F.sum("s").over(by_feature).alias("s"))
    sides = sides.withColumns({"rn": F.col("n") - F.col("ln"), "rs": F.col("s") - F.col("ls")}).where((F.col("ln") >= shape.least) & (F.col("rn") >= shape.least) & (F.col("rn") > 0))
    part = lambda s, n: F.pow(F.col(s) / UNIT, F.lit(2)) / (F.col(n) + shape.reg)
    mean = lambda s, n: F.col(s) / UNIT / (F.col(n) + shape.reg)
    gain = F.round(part("ls", "ln") + part("rs", "rn") - part("s", "n"), 12)
    sides = sides.withColumns({"gain": gain, "low": mean("ls", "ln"), "high": mean("rs", "rn")}).where("gain > 0")
    best = F.max_by(F.struct("feature", "bin", "gain", "low", "high"), F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("b")
    return sides.groupBy(*_NODE).agg(best).select(*_NODE, F.col("b.feature").cast("int").alias("feature"), F.col("b.bin").cast("int").alias("bin"), "b.gain", "b.low", "b.high")


def _routed(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows of a split node go to its child, with the child's value."""
    columns = rows.columns
    right = F.get("x", F.col("feature")) > F.col("bin")
    moved = rows.join(splits.select(*_NODE, "feature", "bin", "low", "high"), [*_NODE], "left")
    split = F.col("feature").isNotNull()
    out = {"node": F.when(split, F.col("node") * 2 + right.cast("long")).otherwise(F.col("node")), "value": F.when(split, F.when(right, F.col("high")).otherwise(F.col("low"))).otherwise(F.col("value"))}
    return moved.select(*[out.get(c, F.col(c)).alias(c) for c in columns])


def grow(rows: DataFrame, shape: Shape, width: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Rows with the node (1, then 2 i and 2 i + 1 below i) and the value of the leaf each one ends in, the splits of each level, and the tables
    to be forgotten once the rows have been read.

    rows: fold and tree (long), g (what is fitted), w (long; 0: only routed), x (array<int> of `width` bins), and others; a written table. Each
    level is one aggregation: tasks sum their rows by (node, feature, bin), nodes take their best split from those sums, and rows are
    routed by a join with the splits, which Spark broadcasts where their size allows it. No node's rows meet in one task. Without any
    row that counts: a value of 0.
    """
    root = rows.where("w > 0").groupBy(*_TREE).agg((F.sum(F.round(F.col("g") * UNIT).cast("long") * F.col("w")) / UNIT / (F.sum("w") + shape.reg)).alias("value"))
    kept = rows.columns
    state = rows.join(root, [*_TREE], "left").select(*kept, F.lit(1).cast("long").alias("node"), F.coalesce("value", F.lit(0.0)).alias("value"))
    levels, tables = [], []
    written = None
    for level in range(shape.depth):
        inner = state.where(F.col("node") >= 1 << level)
        seen = Observation()
        found = materialize(best_splits(inner, shape, width).observe(seen, F.count("*").alias("n")), "tree-splits")
        if not seen.get["n"]:
            forget(found)
            break
        levels.append(found)
        tables.append(found)
        state = _routed(state, found)
        if level % _WRITE == _WRITE - 1 and level < shape.depth - 1:
            before, state = written, materialize(state, "tree-rows")
            written = state
            forget(before)
    return state, levels, [*tables, *([written] if written is not None else [])]


def boost(rows: DataFrame, shape: Shape, width: int, *, rounds: int, rate: float) -> DataFrame:
    """fold, the other columns of rows, and pred: the mean of the rows that count, and `rate` times the value of each of `rounds` trees, each
    fitted to what the ones before leave. rows: fold, y, w, x and others."""
    mean = rows.where("w > 0").groupBy("fold").agg((F.sum(F.round(F.col("y") * UNIT).cast("long") * F.col("w")) / UNIT / F.sum("w")).alias("pred"))
    columns = rows.columns
    now = materialize(rows.join(mean, "fold", "left").select(*columns, F.coalesce("pred", F.lit(0.0)).alias("pred")), "boosted")
    for k in range(rounds):
        state, levels, tables = grow(now.select(*columns, "pred", F.lit(k).cast("long").alias("tree"), (F.coalesce("y", F.lit(0.0)) - F.col("pred")).alias("g")), shape, width)
        if not levels:
            break
        before, now = now, materialize(state.select(*columns, (F.col("pred") + rate * F.col("value")).alias("pred")), "boosted")
        forget(before, *tables)
    return now


def poisson(key: list[Column | str], seed: int) -> Column:
    """How often a row is drawn in a sample of all rows with replacement: 0, 1, 2, ... with Poisson(1) chances, by hash of its key."""
    u = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / float(1 << 30)
    edges, total, p = [], 0.0, float(np.exp(-1))
    for k in range(7):
        total += p
        edges.append(total)
        p /= k + 1
    return sum((u >= e).cast("long") for e in edges)


def forest(rows: DataFrame, shape: Shape, width: int, *, trees: int, key: list[str]) -> DataFrame:
    """fold, the key and pred: the mean over `trees` trees, each of a sample of the rows with replacement and of its share of the features. rows:
    fold, y, w, x and the key, which names a row within its fold; every row is there once for each tree."""
    many = rows.select("fold", *key, F.coalesce("y", F.lit(0.0)).alias("g"), "w", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long"))).alias("tree"))
    many = materialize(many.withColumn("w", F.when(F.col("w") > 0, F.col("w") * poisson(["fold", "tree", *key], shape.seed)).otherwise(0).cast("long")), "forest-rows")
    state, _, tables = grow(many, shape, width)
    out = materialize(state.groupBy("fold", *key).agg((F.sum(F.round(F.col("value") * UNIT).cast("long")) / UNIT / trees).alias("pred")), "forest")
    forget(many, *tables)
    return out


def _products(bins: int, width: int):
    """From rows (fold, y, w, x): sums of products of the centred bins, and of them and y, by fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold, w = b.column(0).to_numpy(), b.column(2).to_numpy()
            y = np.rint(b.column(1).to_numpy() * UNIT).astype(np.int64)
            z = 2 * b.column(3).flatten().to_numpy().reshape(-1, width).astype(np.int64) + 1 - bins
            z = np.concatenate([z, np.ones((len(z), 1), np.int64)], axis=1)
            for f in np.unique(fold).tolist():
                m = fold == f
                a, t = (z[m] * w[m, None]).T @ z[m], (z[m] * w[m, None]).T @ y[m]
                i, j = np.indices(a.shape)
                columns = (np.full(a.size + t.size, f), np.concatenate([i.ravel(), np.arange(len(t))]), np.concatenate([j.ravel(), np.full(len(t), -1)]), np.concatenate([a.ravel(), t]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["fold", "i", "j", "s"])

    return run


def ridge(rows: DataFrame, shape: Shape, width: int, *, reg: float) -> DataFrame:
    """fold, weights (array<double>: for each feature's centred bin, then a constant) of a ridge line: sums of products are taken by Spark, exact
    in whole numbers, and each fold's `width` equations are solved by its own task."""
    sums = rows.where("w > 0").select("fold", "y", "w", "x").mapInArrow(_products(shape.bins, width), "fold long, i long, j long, s long")
    sums = sums.groupBy("fold", "i", "j").agg(F.sum("s").alias("s"))

    def solve(pdf):
        import pandas as pd

        a, t = np.zeros((width + 1, width + 1)), np.zeros(width + 1)
        for i, j, s in zip(pdf["i"], pdf["j"], pdf["s"], strict=True):
            if j < 0:
                t[i] = s / UNIT / shape.bins if i < width else s / UNIT
            else:
                a[i, j] = s / (shape.bins if i < width else 1) / (shape.bins if j < width else 1)
        a[np.arange(width), np.arange(width)] += reg
        return pd.DataFrame({"fold": [int(pdf["fold"].iloc[0])], "weights": [np.linalg.lstsq(a, t, rcond=None)[0].tolist()]})

    return sums.groupBy("fold").applyInPandas(solve, "fold long, weights array<double>")


def line(weights: str, x: str, bins: int) -> Column:
    """The value of a ridge line at binned features."""
    terms = F.transform(x, lambda v, k: F.get(F.col(weights), k) * (2 * v + 1 - bins) / bins)
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) + F.element_at(F.col(weights), -1)
