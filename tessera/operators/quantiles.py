"""Exact quantiles: of large groups by distributed selection, and of all values so far along a series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sinks.steps import forget, materialize

#: Distinct values of an interval that are sorted at once; bins that a larger one is cut into.
ROOM, BINS = 50_000, 32


def exact_quantiles(rows: DataFrame, values: dict[str, Column | str], quantiles: list[float], *keys: str, room: int = ROOM, bins: int = BINS) -> DataFrame:
    """keys, name, q, value, n: the quantiles of each named value in each group, interpolated between the two rows they lie between, as the built-in
    `percentile` does, whose buffer holds every distinct value of a group.

    Selection: each (group, name, quantile) has an interval that holds its two rows, at first all. Where more than `room` rows lie in it, a
    sketch of bounded size proposes `bins` edges, an exact count by bin (each edge's own value is a bin by itself, so every round gets on
    whatever the sketch's error) tells which bin or bins hold the rows, and the interval shrinks to them. What is left is counted by value,
    `room` values at most, and read off. All groups take each round together. Nulls are left out; a group or name without values has no row.
    No key may be named as a column of the result, or lo, hi, v, c, k, below, held, place, one, two.
    """
    name = "_q_name"
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("n"), F.expr(v).alias("v") if isinstance(v, str) else v.cast("double").alias("v")) for k, v in values.items()])).alias("_x"))
    long = materialize(long.select(*keys, F.col("_x.n").alias(name), F.col("_x.v").cast("double").alias("v")).where("v is not null"), "quantile-values")
    at = [*keys, name]
    place = F.col("q") * (F.col("n") - 1)
    state = long.groupBy(*at).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    state = state.select(*at, "q", "n", place.alias("place"), F.floor(place).alias("one"), F.ceil(place).alias("two"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("held"))
    state = materialize(state, "quantile-state")
    wide = (F.col("held") > max(room, 2)) & (F.col("lo") < F.col("hi"))
    grid = [j / bins for j in range(bins + 1)]
    while not state.where(wide).isEmpty():
        opened = state.where(wide)
        inside = long.join(opened.select(*at, "q", "lo", "hi"), at).where("v between lo and hi").select(*at, "q", "v")
        edges = inside.groupBy(*at, "q").agg(F.array_distinct(F.percentile_approx("v", grid, 1000)).alias("edges"))
        number = F.aggregate("edges", F.lit(0), lambda s, e: s + F.when(e < F.col("v"), 2).when(e == F.col("v"), 1).otherwise(0))
        counts = inside.join(edges, [*at, "q"]).groupBy(*at, "q", number.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        counts = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*at, "q").orderBy("bin")))
        counts = counts.join(opened.drop("lo", "hi", "held"), [*at, "q"]).withColumn("first", F.col("below") + F.col("upto") - F.col("c"))
        mine = counts.where("first <= two and first + c > one")  # the one or two bins that the rows are in
        shrunk = mine.groupBy(*at, "q", "n", "place", "one", "two").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("below"), F.sum("c").alias("held"), F.count("*").alias("k"), F.max_by("hi", -F.col("bin")).alias("a"), F.max_by("lo", "bin").alias("b"))
        # two bins: the rows are the last of the first one and the first of the second
        apart = F.col("k") == 2
        shrunk = shrunk.withColumns({"below": F.when(apart, F.col("one")).otherwise(F.col("below")), "held": F.when(apart, 2).otherwise(F.col("held")), "lo": F.when(apart, F.col("a")).otherwise(F.col("lo")), "hi": F.when(apart, F.col("b")).otherwise(F.col("hi"))})
        before, state = state, materialize(state.where(~wide).unionByName(shrunk.select(*state.columns)), "quantile-state")
        forget(before)
    # an interval of two rows with different values is solved, like one of a single value; the others are counted by value
    solved = (F.col("lo") == F.col("hi")) | ((F.col("held") == 2) & (F.col("below") == F.col("one")) & (F.col("two") > F.col("one")))
    between = lambda a, b: F.when(F.col("one") == F.col("two"), a).otherwise((F.col("two") - F.col("place")) * a + (F.col("place") - F.col("one")) * b)
    done = state.where(solved).select(*at, "q", between(F.col("lo"), F.col("hi")).alias("value"), "n")
    rest = state.where(~solved)
    listed = long.join(rest, at).where("v between lo and hi").groupBy(*at, "q", "n", "place", "one", "two", "below", "v").agg(F.count("*").alias("c"))
    listed = listed.withColumn("last", F.col("below") + F.sum("c").over(Window.partitionBy(*at, "q").orderBy("v")) - 1)
    pick = lambda r: F.min(F.when(F.col("last") >= F.col(r), F.col("v")))
    read = listed.groupBy(*at, "q", "n", "place", "one", "two").agg(pick("one").alias("a"), pick("two").alias("b"))
    out = done.unionByName(read.select(*at, "q", between(F.col("a"), F.col("b")).alias("value"), "n")).withColumnRenamed(name, "name")
    out = materialize(out, "quantiles")
    forget(long, state)
    return out


def spread_out(found: DataFrame, *keys: str, names: dict[str, tuple[str, float]]) -> DataFrame:
    """One row for each group of exact_quantiles: a column for each (name, quantile)."""
    return found.groupBy(*keys).agg(*[F.max(F.when((F.col("name") == n) & (F.col("q") == float(q)), F.col("value"))).alias(c) for c, (n, q) in names.items()])


def so_far(values: np.ndarray, q: float, least: int) -> np.ndarray:
    """At each place the q-quantile of all values up to it, NaN being none; NaN before there are `least` of them.

    The values are sorted once into a linked list; from the last place back each one is taken out and the pointer to the quantile's
    lower neighbour moves by a step or two, so a series of T values takes T log T for the sort and T for the rest.
    """
    out = np.full(len(values), np.nan)
    there = np.flatnonzero(~np.isnan(values))
    n = len(there)
    if not n:
        return out
    order = there[np.argsort(values[there], kind="stable")]
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(n)
    ranks, sorted_ = rank.tolist(), values[order].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    at = place = int(math.floor(q * (n - 1)))  # the element, and how many come before it
    edge = np.nan
    current = there.tolist()
    result = out.tolist()
    for t in range(len(values) - 1, -1, -1):
        if n >= least:
            exact = q * (n - 1)
            low = int(math.floor(exact))
            while place > low:
                at, place = before[at], place - 1
            while place < low:
                at, place = after[at], place + 1
            edge = sorted_[at] if low == exact else (low + 1 - exact) * sorted_[at] + (exact - low) * sorted_[after[at]]
            result[t] = edge
        if current and current[-1] == t:
            current.pop()
            r = ranks[t]
            b, a = before[r], after[r]
            if b >= 0:
                after[b] = a
            if a < len(sorted_):
                before[a] = b
            n -= 1
            if r == at:
                at, place = (b, place - 1) if b >= 0 else (a, place)
            elif r < at:
                place -= 1
            if n < max(1, least):
                break
    return np.array(result)


def expanding_quantile(rows: DataFrame, value: str, q: float, least: int, *keys: str, order: str = "d", name: str = "edge") -> DataFrame:
    """rows with `name`: the q-quantile of the value over the series' rows up to this one; null with fewer than `least` values. A series, which
    the keys name (none: one series), is one group, of a row for each bar of its axis; series go to tasks by their keys."""
    held = [c for c in rows.columns if c != name]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in held) + f", {name} double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        found = so_far(pdf[value].to_numpy(float, na_value=np.nan), q, least)
        return pdf[held].assign(**{name: found})

    return rows.select(*held).groupBy(*keys).applyInPandas(run, schema).withColumn(name, F.nanvl(name, F.lit(None)))


def gate(rows: DataFrame, value: str, q: float, least: int, *keys: str, order: str = "d") -> DataFrame:
    """rows with edge and panic: whether the value is above the quantile of all of its series' values so far, at nine digits."""
    out = expanding_quantile(rows, value, q, least, *keys, order=order)
    return out.withColumn("panic", F.coalesce(F.round(value, 9) > F.round("edge", 9), F.lit(False)))
