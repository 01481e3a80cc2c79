"""Books over the bars of a day: one axis of bars, the gate of the day before, results compounded to days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import portfolio, universe
from tessera.operators.panel import resample
from tessera.sinks.steps import forget, materialize

#: Places of a day on the axis, and that of its opening: bars before it have negative numbers.
DAY, FIRST = 1 << 12, 1 << 11


def axis_bars(ticks: DataFrame, minutes: int) -> DataFrame:
    """Session-aligned bars of ticks with d, the bar's place on one axis of days and bars, so that operators along dates run along bars; the
    day since the epoch is d / DAY. Turnover is the close times the ticks."""
    bars = resample(ticks, minutes)
    d = F.unix_date("d").cast("long") * DAY + FIRST + F.col("bin")
    return bars.select("ticker", d.alias("d"), "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"), (F.col("close") * F.col("volume")).alias("turnover"))


def bar_gate(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """d, panic for each bar: the panic of the row before its day in the daily gate (d, panic); a day that the gate lacks is calm."""
    lagged = daily.select(F.unix_date("d").cast("long").alias("_day"), F.lag("panic").over(Window.orderBy("d")).alias("panic"))  # a row per day
    days = bars.select("d").distinct().withColumn("_day", F.floor(F.col("d") / DAY))
    return days.join(lagged, "_day", "left").select("d", F.coalesce("panic", F.lit(False)).alias("panic"))


def to_days(results: DataFrame) -> DataFrame:
    """d (date), bars, gross and net compounded, turnover and costs added up, of results per bar; bars without a return count as none."""
    day = F.date_from_unix_date(F.floor(F.col("d") / DAY).cast("int"))
    return results.groupBy(day.alias("d")).agg(
        F.count("*").alias("bars"), (F.product(1 + F.col("gross")) - 1).alias("gross"), (F.product(1 + F.col("net")) - 1).alias("net"),
        F.sum("turnover").alias("turnover"), F.sum("trade_cost").alias("trade_cost"), F.sum("borrow_cost").alias("borrow_cost"),
    )


def execute_bars(ticks: DataFrame, minutes: int, styles: list[str], daily_gate: DataFrame, *, lookback: int = 5, share: float = 0.1, costs: portfolio.Costs = portfolio.Costs()) -> DataFrame:
    """style, d (date), bars, gross, net, turnover, trade_cost, borrow_cost: books of the styles rebalanced at every bar, by momentum over `lookback`
    bars. The panel of scores and costs is computed once for all styles; costs.bars_per_year is that of the bars."""
    bars = materialize(axis_bars(ticks, minutes), "intraday-bars")
    panel = materialize(portfolio.forward_returns(portfolio.momentum(universe.cost_panel(bars), lookback)).where("score is not null"), "intraday-panel")
    gate = bar_gate(bars, daily_gate)
    out = None
    for style in styles:
        days = to_days(portfolio.execute(panel, style, gate, share=share, costs=costs)).select(F.lit(style).alias("style"), "*")
        out = days if out is None else out.unionByName(days)
    out = materialize(out, "intraday-days")
    forget(bars, panel)
    return out
