"""What can be borrowed: the mask from derivatives archives, its coverage, and what a restricted short leg is worth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import by_name, first_rank
from tessera.operators.panel import calendar


def symbol_map(panel: DataFrame) -> DataFrame:
    """(d, symbol) to ticker, the first ticker of a symbol on a date; symbols trimmed and in capitals, so that a name keeps its history
    through a change of symbol."""
    rows = panel.select("d", F.upper(F.trim("symbol")).alias("symbol"), "ticker")
    return rows.groupBy("d", "symbol").agg(F.min("ticker").alias("ticker"))


def shortable(panel: DataFrame, futures: DataFrame) -> DataFrame:
    """ticker, d, shortable on the calendar of the panel (d, ticker, symbol), from (d, symbol) with a stock future.

    On a date with an archive a name without a future can't be borrowed; a date without any archive takes the name's last known state;
    before the first archive nothing can be. Only names that ever had a future have rows.
    """
    symbols = futures.select("d", F.upper(F.trim("symbol")).alias("symbol")).distinct()
    flags = symbols.join(symbol_map(panel), ["d", "symbol"]).select("ticker", "d").distinct().withColumn("flag", F.lit(True))
    sessions = symbols.select("d").distinct().withColumn("known", F.lit(True))
    # each name's flags on the dates with an archive, then on all dates: both by filling forward along the name
    axis = calendar(panel).join(sessions, "d", "left").select("d", "pos", "known")
    names = flags.select("ticker").distinct()
    dates = axis.agg(F.sort_array(F.collect_list(F.struct("pos", "d", "known"))).alias("a")).select(F.col("a")).scalar()  # the calendar: a value per date
    grid = names.select("ticker", F.explode(dates).alias("x")).select("ticker", "x.pos", "x.d", "x.known")
    rows = grid.join(flags, ["ticker", "d"], "left").withColumn("state", F.when(F.col("known"), F.coalesce("flag", F.lit(False))))
    so_far = by_name().rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("ticker", "d", F.coalesce(F.last("state", ignorenulls=True).over(so_far), F.lit(False)).alias("shortable"))


def coverage_by_year(members: DataFrame, mask: DataFrame) -> DataFrame:
    """year, in_universe, shortable, pct: means over the year's dates; members that never had a future count as not shortable."""
    rows = members.select("ticker", "d").join(mask.where("shortable").select("ticker", "d", F.lit(True).alias("ok")), ["ticker", "d"], "left")
    days = rows.groupBy("d").agg(F.count("*").alias("n"), F.count("ok").alias("ok"))
    return days.groupBy(F.year("d").cast("long").alias("year")).agg(F.avg("n").alias("in_universe"), F.avg("ok").alias("shortable"), F.avg(F.col("ok") / F.col("n")).alias("pct"))


def short_book_coverage(scored: DataFrame, share: float = 0.1) -> DataFrame:
    """d, wanted, borrowable, pct of the unrestricted worst names (scored: ticker, d, score, shortable)."""
    rows = scored.where("score is not null")
    k = F.greatest(F.lit(1), F.floor(F.round(F.count("*").over(Window.partitionBy("d")) * share, 9)))
    rows = rows.withColumns({"k": k, "lo": first_rank("score", "d", descending=False)}).where("lo <= k")
    out = rows.groupBy("d").agg(F.count("*").alias("wanted"), F.count_if(F.coalesce("shortable", F.lit(False))).alias("borrowable"))
    return out.withColumn("pct", F.col("borrowable") / F.col("wanted"))
