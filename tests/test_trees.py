"""Trees grown by Spark against trees grown row by row, and against what single cuts can't find."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import learning, trees
from tessera.operators.trees import Shape

U = trees.UNIT
ROW = "fold long, tree long, key long, g double, w long, x array<int>"


def brute_tree(rows, shape, allowed):
    """(leaf, value) of each (g, w, x), with the splits by the definition: the largest gain, the first feature and bin among equals."""
    fixed = [round(g * U) for g, _, _ in rows]
    out = [None] * len(rows)

    def value(ix):
        n = sum(rows[k][1] for k in ix)
        return sum(fixed[k] * rows[k][1] for k in ix) / U / (n + shape.reg) if n else 0.0

    def visit(node, ix, here, level):
        counted = [k for k in ix if rows[k][1]]
        part = lambda s, n: (s / U) ** 2 / (n + shape.reg)
        sums = lambda kk: (sum(fixed[k] * rows[k][1] for k in kk), sum(rows[k][1] for k in kk))
        best = (0.0, 0, 0)
        for f in sorted(allowed) if level < shape.depth else ():
            for b in range(shape.bins - 1):
                low, high = [k for k in counted if rows[k][2][f] <= b], [k for k in counted if rows[k][2][f] > b]
                if not low or not high or min(sums(low)[1], sums(high)[1]) < shape.least:
                    continue
                gain = round(part(*sums(low)) + part(*sums(high)) - part(*sums(counted)), 12)
                if gain > best[0] + 1e-13:
                    best = (gain, f, b)
        if not best[0]:
            for k in ix:
                out[k] = (node, here)
            return
        _, f, b = best
        for child, test in ((2 * node, lambda k: rows[k][2][f] <= b), (2 * node + 1, lambda k: rows[k][2][f] > b)):
            mine = [k for k in ix if test(k)]
            visit(child, mine, value([k for k in mine if rows[k][1]]), level + 1)

    visit(1, list(range(len(rows))), value(range(len(rows))), 0)
    return out


def cases(seed, bins, width, n=240):
    r = random.Random(seed)
    out = []
    for k in range(n):
        x = [r.randrange(bins) for _ in range(width)]
        g = (x[0] > 2) * (x[1] > 1) * 1.5 - (x[2] % 3) * 0.25 + round(r.gauss(0, 0.3), 3)
        out.append((k % 2, k % 3, k, g, r.choice([0, 1, 1, 2]), x))
    return [*out, (7, 7, 1, 1.0, 0, [0] * width)]  # a tree without a row that counts


@pytest.mark.parametrize("shape", [Shape(depth=3, bins=5, least=4), Shape(depth=6, bins=5, least=1, reg=1.0), Shape(depth=15, bins=5, least=3), Shape(depth=5, bins=5, least=2, columns=0.5)])
@pytest.mark.parametrize("held", [1 << 19, 8])
def test_trees_as_brute_force_grows_them(spark, tmp_path, monkeypatch, shape, held):
    monkeypatch.setattr(trees, "_HELD", held)
    rows = cases(shape.depth, 5, 4)
    spark.createDataFrame(rows, ROW).repartition(3).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    state, _, tables = trees.grow(df, shape, 4)
    got = {(x.fold, x.tree, x.key): (x.node, x.value) for x in state.collect()}
    if shape.columns < 1:  # which features a tree drew is seen in its splits
        used = {}
        for t in tables:
            for x in t.collect() if "feature" in t.columns else ():
                used.setdefault((x.fold, x.tree), set()).add(x.feature)
        assert all(len(v) <= 2 for v in used.values()) and len({tuple(v) for v in used.values()}) > 1
        return
    assert len(got) == len(rows)
    for fold, tree in {r[:2] for r in rows}:
        mine = [r for r in rows if r[:2] == (fold, tree)]
        for r, (node, value) in zip(mine, brute_tree([x[3:] for x in mine], shape, range(4)), strict=True):
            assert got[fold, tree, r[2]][0] == node and got[fold, tree, r[2]][1] == pytest.approx(value, abs=1e-12)


def test_boosting_as_brute_force(spark, tmp_path):
    shape = Shape(depth=3, bins=5, least=3, reg=1.0)
    rows = [(f, k, g, w, x) for f, _, k, g, w, x in cases(9, 5, 4)]
    spark.createDataFrame(rows, "fold long, key long, y double, w long, x array<int>").write.parquet(str(tmp_path / "rows"))
    got = {(x.fold, x.key): x.pred for x in trees.boost(spark.read.parquet(str(tmp_path / "rows")), shape, 4, rounds=4, rate=0.5).collect()}
    for fold in (0, 1):
        mine = [r for r in rows if r[0] == fold]
        n = sum(r[3] for r in mine)
        pred = [sum(round(r[2] * U) * r[3] for r in mine) / U / n] * len(mine)
        for _ in range(4):
            leaves = brute_tree([(r[2] - p, r[3], r[4]) for r, p in zip(mine, pred, strict=True)], shape, range(4))
            pred = [p + 0.5 * v for p, (_, v) in zip(pred, leaves, strict=True)]
        assert all(got[fold, r[1]] == pytest.approx(p, abs=1e-7) for r, p in zip(mine, pred, strict=True))
    assert got[7, 1] == 0.0


def test_ridge_as_normal_equations(spark):
    rows = [(f, g, w, x) for f, _, _, g, w, x in cases(3, 5, 4)]
    df = spark.createDataFrame(rows, "fold long, y double, w long, x array<int>")
    got = df.select("fold", "x").distinct().join(trees.ridge(df, Shape(bins=5), 4, reg=2.0), "fold").withColumn("p", trees.line("weights", "x", 5)).collect()
    for fold in (0, 1):
        mine = [r for r in rows if r[0] == fold]
        z = np.array([[*((2 * v + 1 - 5) / 5 for v in r[3]), 1.0] for r in mine])
        w, y = np.array([r[2] for r in mine], float), np.array([r[1] for r in mine])
        beta = np.linalg.solve((z * w[:, None]).T @ z + 2.0 * np.diag([1, 1, 1, 1, 0]), (z * w[:, None]).T @ y)
        for x in got:
            if x.fold == fold:
                assert x.p == pytest.approx(sum(b * (2 * v + 1 - 5) / 5 for b, v in zip(beta, x.x, strict=False)) + beta[-1])


def test_draws_with_replacement(spark):
    n = spark.range(20_000).select(trees.poisson(["id"], 3).alias("n")).groupBy("n").count().collect()
    share = {x.n: x["count"] / 20_000 for x in n}
    assert all(abs(share[k] - p) < 0.015 for k, p in ((0, 0.368), (1, 0.368), (2, 0.184), (3, 0.061)))


def test_an_interaction_that_single_cuts_miss(spark):
    r = random.Random(5)
    day = lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(k)
    rows = []
    for d in range(40):
        for t in range(30):
            a, b = 2 * r.random() - 1, 2 * r.random() - 1
            rows.append((day(d), f"n{t:02d}", a, b, (1.0 if a * b > 0 else -1.0) + r.gauss(0, 0.3)))
    df = spark.createDataFrame(rows, "d date, ticker string, a double, b double, y double")
    scores = learning.walk_forward(df, ["a", "b"], "y", train=30, test=10, rounds=4, rate=0.5, many=8, boosted=Shape(depth=4, least=20), forest=Shape(depth=8, least=10))
    ic = {x.model: x.mean for x in learning.learner_ics(scores, df.select("d", "ticker", F.col("y").alias("fwd"))).collect()}
    assert ic["boosted"] > 0.6 and ic["forest"] > 0.6 and abs(ic["ridge"]) < 0.3
