"""Quantiles by selection and along a series, against sorted values."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import quantiles


def linear(values, q):
    x = sorted(values)
    at = q * (len(x) - 1)
    low = int(at)
    return x[low] if low == at else (low + 1 - at) * x[low] + (at - low) * x[low + 1]


def groups(seed):
    r = random.Random(seed)
    return {
        "spread": [r.gauss(0, 1) for _ in range(700)], "heavy": [r.choice([0.0, 0.0, 0.0, 1.0, 1e300, -1e-300]) for _ in range(500)], "one": [3.5], "two": [2.0, 1.0],
        "same": [7.0] * 300, "far": [10.0**k for k in range(-150, 150)], "edge": [0.0] * 250 + [1.0] * 250, "none": [None] * 5, "mixed": [None, 4.0, None, 2.0, 9.0],
    }


@pytest.mark.parametrize(("room", "bins"), [(50_000, 32), (3, 4), (0, 8)])
def test_quantiles_by_selection(spark, room, bins):
    data, qs = groups(room), [0.0, 0.1, 0.5, 0.85, 0.99, 1.0]
    df = spark.createDataFrame([(g, v) for g, x in data.items() for v in x], "g string, value double")
    got = {(x.g, x["name"], x.q): (x.value, x.n) for x in quantiles.exact_quantiles(df, {"a": F.col("value"), "b": -F.col("value") / 2}, qs, "g", room=room, bins=bins).collect()}
    want = {}
    for g, x in data.items():
        x = [v for v in x if v is not None]
        for q in qs if x else ():
            want[g, "a", q] = (linear(x, q), len(x))
            want[g, "b", q] = (linear([-v / 2 for v in x], q), len(x))
    assert set(got) == set(want)
    for k, (v, n) in want.items():
        assert got[k][1] == n and got[k][0] == pytest.approx(v, rel=1e-12, abs=1e-320), k
    assert quantiles.exact_quantiles(df.where("false"), {"a": F.col("value")}, [0.5]).count() == 0


@pytest.mark.parametrize(("q", "least"), [(0.85, 20), (0.5, 1), (0.0, 3), (1.0, 2), (0.333, 5)])
def test_quantiles_so_far(q, least):
    r = random.Random(least)
    for n in (0, 1, 7, 300):
        x = np.array([r.choice([float("nan"), r.gauss(0, 1), 1.0, 2.0]) for _ in range(n)])
        got = quantiles.so_far(x, q, least)
        for t in range(n):
            past = [v for v in x[: t + 1].tolist() if v == v]
            assert (got[t] != got[t]) if len(past) < least else got[t] == pytest.approx(linear(past, q)), (n, t)


def test_a_long_series_takes_no_square_of_its_length(spark):
    x = np.random.default_rng(3).normal(size=200_000)
    got = quantiles.so_far(x, 0.85, 252)
    for t in (251, 5_000, 199_999):
        assert got[t] == pytest.approx(np.quantile(x[: t + 1], 0.85))


def test_series_are_apart(spark):
    day = lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(k)
    r = random.Random(2)
    rows = [(s, day(d), None if r.random() < 0.1 else round(r.gauss(0, 1), 3)) for s in "abc" for d in range(50)]
    df = spark.createDataFrame(rows, "s string, d date, x double").repartition(5)
    for x in quantiles.gate(df, "x", 0.8, 10, "s").collect():
        past = [v for s, d, v in rows if s == x.s and d <= x.d and v is not None]
        edge = linear(past, 0.8) if len(past) >= 10 else None
        assert x.edge == (edge if edge is None else pytest.approx(edge)) and x.panic == (edge is not None and x.x is not None and round(x.x, 9) > round(edge, 9))
