"""Window and rank expressions that the panel operators share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Agg = Callable[[Column], Column]


def r6(c: Column | str) -> Column:
    """Six digits, and no negative zero: what results are compared at."""
    return F.round(c, 6) + F.lit(0.0)


def by_name(order: str = "d") -> WindowSpec:
    return Window.partitionBy("ticker").orderBy(order)


def median(c: Column | str) -> Column:
    return F.percentile(c, F.lit(0.5))


def middle(ordered: Column | str) -> Column:
    """The median of an array that is in order and has no nulls; null if it is empty. Over short arrays it is far cheaper than `median`,
    which keeps a map of counts for each window or group."""
    ordered = F.col(ordered) if isinstance(ordered, str) else ordered
    n = F.size(ordered)
    return (F.get(ordered, F.shiftright(n - 1, 1)) + F.get(ordered, F.shiftright(n, 1))) / 2


def trailing(agg: Agg, value: Column | str, n: int, *, least: int | None = None, lag: int = 0, order: str = "d") -> Column:
    """agg of the value over the name's last n rows, ending `lag` rows before this one; null with fewer than `least` (n) values."""
    value = F.col(value) if isinstance(value, str) else value
    w = by_name(order).rowsBetween(-(n - 1 + lag), -lag)
    return F.when(F.count(value).over(w) >= (n if least is None else least), agg(value).over(w))


def full_windows(rows: DataFrame, wanted: dict[str, tuple[str, str, int]], order: str = "d") -> DataFrame:
    """rows with a column for each wanted name: (how, value, n) is the mean, max or sample variance of the value over the name's last n
    rows, null unless all n have one.

    A frame of n rows costs n steps a row. Here statistics of 2, 4, 8... rows come each from two of half the length, one of them lagged,
    and n rows are put together from powers of two: some log n lags a row. Sums are pairwise and squares are merged about the means of
    the parts, so nothing cancels, however long the series. All lags are over the name's own rows: one exchange, one sort.
    """
    w = by_name(order)
    kept, values = rows.columns, sorted({value for _, value, _ in wanted.values()})
    most = {}  # the longest power of two that a statistic of a value needs
    for how, value, n in wanted.values():
        for stat in {"mean": ["sum"], "max": ["max"], "var": ["sum", "sq"]}[how]:
            most[stat, value] = max(most.get((stat, value), 1), 1 << (n.bit_length() - 1))
    col = lambda stat, value, size: F.col(f"_{stat}_{value}_{size}")
    known = {value: F.col(value).cast("double") for value in values}
    start = {"sum": lambda v: known[v], "max": lambda v: F.col(v), "sq": lambda v: F.when(F.col(v).isNotNull(), F.lit(0.0))}
    rows = rows.withColumns({f"_{stat}_{value}_1": start[stat](value) for stat, value in most})

    def larger(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))

    def squares(a: tuple, b: tuple) -> Column:
        (n, sum_a, sq_a), (m, sum_b, sq_b) = a, b
        far = sum_a / n - sum_b / m
        return sq_a + sq_b + far * far * (n * m / (n + m))

    def lagged(rows: DataFrame, parts: set[tuple[str, str, int, int]]) -> DataFrame:
        return rows.withColumns({f"_{s}_{v}_{size}_{k}": F.lag(col(s, v, size), k).over(w) for s, v, size, k in sorted(parts)})

    old = lambda s, v, size, k: F.col(f"_{s}_{v}_{size}_{k}") if k else col(s, v, size)
    size = 1
    while size < max(most.values(), default=1):
        grown = [(s, v) for s, v in most if most[s, v] > size]
        rows = lagged(rows, {(s, v, size, size) for s, v in grown})
        now = lambda s, v: (col(s, v, size), old(s, v, size, size))  # noqa: B023, E731
        out = {}
        for s, v in grown:
            if s == "sum":
                out[s, v] = now(s, v)[0] + now(s, v)[1]
            elif s == "max":
                out[s, v] = larger(*now(s, v))
            else:
                out[s, v] = squares(*[(size, *pair) for pair in zip(now("sum", v), now("sq", v), strict=True)])
        rows = rows.withColumns({f"_{s}_{v}_{2 * size}": c for (s, v), c in out.items()})
        size *= 2

    def pieces(n: int) -> list[tuple[int, int]]:
        """Powers of two that add up to n, each with its lag."""
        sizes = [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]
        return [(p, sum(sizes[:k])) for k, p in enumerate(sizes)]

    need, result = set(), {}
    for name, (how, value, n) in wanted.items():
        if how == "max":
            top = 1 << (n.bit_length() - 1)
            need.add(("max", value, top, n - top))
            result[name] = larger(col("max", value, top), old("max", value, top, n - top))
            continue
        parts = pieces(n)
        need |= {(s, value, p, k) for s in (("sum", "sq") if how == "var" else ("sum",)) for p, k in parts}
        count, total, sq = parts[0][0], old("sum", value, *parts[0]), old("sq", value, *parts[0])
        for p, k in parts[1:]:
            if how == "var":
                sq = squares((count, total, sq), (p, old("sum", value, p, k), old("sq", value, p, k)))
            count, total = count + p, total + old("sum", value, p, k)
        result[name] = total / n if how == "mean" else sq / (n - 1)
    rows = lagged(rows, {x for x in need if x[3]})
    return rows.select(*kept, *[c.alias(name) for name, c in result.items()])


def expanding(agg: Agg, value: Column | str, least: int, w: WindowSpec) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.when(F.count(value).over(so_far) >= least, agg(value).over(so_far))


def expanding_z(value: str, least: int, w: WindowSpec) -> Column:
    """How far a value lies from the mean of all up to it, in deviations; null before `least` values or without spread."""
    spread = expanding(F.stddev_samp, value, least, w)
    return (F.col(value) - expanding(F.avg, value, least, w)) / F.when(spread > 0, spread)


def average_rank(value: str, *keys: str) -> Column:
    """Rank from 1 with the mean rank for ties, among the rows of the keys; the value must not be null. Rows of one value are the peers
    of the same window, so both parts take one sort."""
    w = Window.partitionBy(*keys).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2.0


def unit_rank(value: str, *keys: str) -> Column:
    """Average rank scaled to [-1, 1]; 0 for a single row."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return F.when(n == 1, F.lit(0.0)).otherwise(2 * (average_rank(value, *keys) - 1) / (n - 1) - 1)


def bucket(value: str, k: int, *keys: str, descending: bool = False) -> Column:
    """Bucket 1..k by average rank over the number of rows; the largest values are in k, or in 1 if descending."""
    n = F.count("*").over(Window.partitionBy(*keys))
    rank = average_rank(value, *keys)
    rank = n + 1 - rank if descending else rank
    return F.least(F.lit(k), F.greatest(F.lit(1), F.ceil(rank / n * k - 1e-9))).cast("long")


def first_rank(score: str, *keys: str, descending: bool) -> Column:
    """Rank from 1 in either direction; ties go by ticker upwards both ways."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score) if descending else F.asc(score), "ticker"))


def rolled(columns: Sequence[str]) -> list[Column]:
    return [r6(c).alias(c) for c in columns]
