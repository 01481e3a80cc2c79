"""Bars as long tables: resampling, calendars, dense panels, joins along time and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import by_name, median

#: Minute of the day at which a session opens.
OPENING = 9 * 60 + 15
PRICES = ("open", "high", "low", "close", "volume", "turnover")


def resample(ticks: DataFrame, minutes: int) -> DataFrame:
    """Session-aligned bars from ticks (ticker, ts, px, event_id): bins count from the opening, those before it have negative numbers;
    prices must be positive."""
    bin_ = F.floor((F.hour("ts") * 60 + F.minute("ts") - OPENING) / minutes).cast("long")
    return ticks.where("px > 0").groupBy("ticker", F.to_date("ts").alias("d"), bin_.alias("bin")).agg(
        F.min_by("px", "event_id").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "event_id").alias("close"), F.count("*").alias("volume"))


def bars_per_day(ticks: DataFrame, minutes: int) -> DataFrame:
    counts = resample(ticks, minutes).groupBy("ticker", "d").count()
    return counts.groupBy("ticker").agg(median("count").alias("median_bars"), F.max("count").alias("max_bars"))


def dedup(rows: DataFrame, keys: list[Column], order: str, keep: str) -> DataFrame:
    """One row for each value of the keys: the first or the last by order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order) if keep == "last" else F.asc(order))
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def calendar(bars: DataFrame) -> DataFrame:
    """d, pos (from 0) and n, the number of dates. One row per date, so its window in one task is small."""
    dates = bars.select("d").distinct()
    return dates.select("d", (F.row_number().over(Window.orderBy("d")) - 1).cast("long").alias("pos"), F.count("*").over(Window.partitionBy()).alias("n"))


def positioned(bars: DataFrame) -> DataFrame:
    """bars with the position of their date in the calendar, pos."""
    return bars.join(calendar(bars).select("d", "pos"), "d")


def densify(bars: DataFrame) -> DataFrame:
    """A row for each name and date of the calendar from the name's first bar on, with nulls where it has none, and pos.

    Gaps are filled by each bar exploding to the dates before the next one: no product of names and dates, and the result is
    partitioned by ticker as the windows over it are.
    """
    cal = calendar(bars)
    rest = [c for c in bars.columns if c not in ("ticker", "d")]
    placed = bars.join(cal, "d").withColumn("until", F.coalesce(F.lead("pos").over(by_name("pos")), F.col("n")) - 1)
    rows = placed.withColumn("at", F.explode(F.sequence("pos", "until")))
    kept = [F.when(F.col("at") == F.col("pos"), F.col(c)).alias(c) for c in rest]
    return rows.select("ticker", F.col("at").alias("pos"), *kept).join(cal.select("pos", "d"), "pos").select("ticker", "d", "pos", *rest)


def last_known(value: str, order: str = "d") -> Column:
    return F.last(value, ignorenulls=True).over(by_name(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def next_known(value: str, order: str = "d") -> Column:
    return F.first(value, ignorenulls=True).over(by_name(order).rowsBetween(1, Window.unboundedFollowing))


def filled(bars: DataFrame) -> DataFrame:
    return densify(bars).select("ticker", "d", last_known("close").alias("filled"), next_known("close").alias("next_quote"))


def missing_cells(bars: DataFrame) -> DataFrame:
    """Names and dates without a bar, from the name's first one on."""
    return densify(bars).join(bars.select("ticker", "d"), ["ticker", "d"], "left_anti").select("ticker", "d")


def business_days(start: str, end: str) -> Column:
    """Expression: array of the week days from start to end."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return F.filter(days, lambda d: F.weekday(d) < 5)


def as_of(bars: DataFrame, series: DataFrame, value: str) -> DataFrame:
    """ticker, d and the value last published at or before each date; before the first one the median of all.

    series (d, value) has a row per date at most. Both are put on one axis of dates, so no range join is needed.
    """
    days = bars.select("d").distinct().unionByName(series.select("d")).distinct().join(series.select("d", value), "d", "left")
    known = days.select("d", F.last(value, ignorenulls=True).over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("known"))
    middle = series.agg(median(value)).scalar()
    return bars.select("ticker", "d").join(known, "d").select("ticker", "d", F.coalesce("known", middle).alias(value))


def gate_to_ticks(ticks: DataFrame, gate: DataFrame) -> DataFrame:
    """A daily gate (d, open) reaches the next day in its own table; a day that it doesn't know is closed."""
    lagged = gate.select("d", F.lag("open").over(Window.orderBy("d")).alias("open"))
    days = ticks.select("ticker", F.to_date("ts").alias("d")).join(lagged, "d", "left")
    return days.groupBy("ticker", "d").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("open", F.lit(False))).alias("open"))


def lagged_daily(days: DataFrame, daily: DataFrame, value: str) -> DataFrame:
    """The row before of a name's own daily table joined to its days, then the last known one, then 0."""
    lagged = daily.select("ticker", "d", F.lag(value).over(by_name()).alias("_before"))
    return days.join(lagged, ["ticker", "d"], "left").select("ticker", "d", F.coalesce(last_known("_before"), F.lit(0)).alias("qty"))


def near_in_time(events: DataFrame, marks: DataFrame, within: int) -> DataFrame:
    """Events (ticker, pos, ...) with a mark (ticker, pos) of the same name at most `within` positions away: each mark stands for all
    positions near it, so the join is by equality."""
    near = marks.select("ticker", F.explode(F.sequence(F.col("pos") - within, F.col("pos") + within)).alias("pos"))
    return events.join(near, ["ticker", "pos"], "left_semi")


def fold_rows(bars: DataFrame, train: int, test: int) -> DataFrame:
    """Rows of each fold: fold k tests positions train + k * test on, and trains on the `train` positions before. A row goes to the folds
    that hold it by their numbers, without a range join."""
    rows = bars.join(calendar(bars), "d")
    last = F.floor((F.col("n") - 1 - train) / test)
    low = F.greatest(F.lit(0), F.ceil((F.col("pos") - train - test + 1) / test))
    high = F.least(last, F.floor(F.col("pos") / test))
    rows = rows.where(low <= high).withColumn("fold", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    return rows.withColumn("is_train", F.col("pos") < train + F.col("fold") * test)


def folds(bars: DataFrame, train: int = 104, test: int = 26) -> DataFrame:
    rows = fold_rows(bars, train, test)
    return rows.groupBy("fold").agg(F.count_if("is_train").alias("train_rows"), F.count_if(~F.col("is_train")).alias("test_rows"))


def compare_ledgers(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two ledgers (d, r) side by side: rows of one only, differing nulls, largest difference, and whether they are the same."""
    both = one.select("d", F.col("r").alias("a"), F.lit(True).alias("in_a")).join(two.select("d", F.col("r").alias("b"), F.lit(True).alias("in_b")), "d", "full_outer")
    out = both.agg(
        F.count_if(F.col("in_a").isNull()).alias("right_only"), F.count_if(F.col("in_b").isNull()).alias("left_only"),
        F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("null_differs"), F.max(F.abs(F.col("a") - F.col("b"))).alias("largest"),
    )
    return out.withColumn("identical", (F.col("right_only") + F.col("left_only") + F.col("null_differs") == 0) & (F.coalesce("largest", F.lit(0.0)) == 0))


def disambiguated(names: DataFrame) -> DataFrame:
    """Entities (entity, name) to tickers: of those that share a name the second and later ones get a number."""
    nth = F.row_number().over(Window.partitionBy("name").orderBy("entity"))
    return names.withColumn("nth", nth).select("entity", F.when(F.col("nth") > 1, F.concat("name", F.lit("."), F.col("nth").cast("string"))).otherwise(F.col("name")).alias("ticker"))


def wide(rows: DataFrame, key: list[str], by: str, values: list, column: str, how: str = "mean", order: str | None = None) -> DataFrame:
    """A column for each of the values of `by`: the mean, last or first (by order), any, sum or count of the column among the rows of the key. The values
    are given, so no pass looks for them."""
    x = lambda v: F.when(F.col(by) == v, F.col(column))
    at = lambda v: F.when((F.col(by) == v) & F.col(column).isNotNull(), F.col(order)) if order else None
    ways = {"mean": F.avg, "sum": F.sum, "count": F.count, "any": F.bool_or}
    pick = {"last": lambda v: F.max_by(x(v), at(v)), "first": lambda v: F.min_by(x(v), at(v))}
    if how not in ways and (how not in pick or order is None):
        raise ValueError(f"how must be one of {sorted(ways)}, or first or last with an order, not {how!r}")
    return rows.groupBy(*key).agg(*[(pick[how](v) if how in pick else ways[how](x(v))).alias(str(v)) for v in values])


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Values of a column with their counts and shares."""
    counts = rows.groupBy(column).count()
    return counts.select(column, F.col("count").alias("n"), (F.col("count") / F.sum("count").over(Window.partitionBy())).alias("share"))


def digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of rows, and a digest of the columns that any order of the rows gives, nulls told apart from values."""
    text = F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("\\N"))) for c in sorted(columns)])
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))
