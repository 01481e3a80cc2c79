"""Point-in-time universe, liquidity, spreads and capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import bucket, by_name, median, middle, trailing
from tessera.operators.panel import calendar, densify, last_known
from tessera.operators.quantiles import exact_quantiles, spread_out
from tessera.sinks.steps import materialize


def selections(bars: DataFrame, *, top: int = 500, lookback: int = 252, every: int = 63, least: int = 200) -> DataFrame:
    """(r, ticker): at every `every`-th date from `lookback` on, the `top` names by median positive turnover over the `lookback` dates
    before it, of those with `least` traded ones. A bar goes to the selections that see it by their numbers, without a range join.

    A bar is moved once, to its name; there those that the same selections see become one array, and only arrays go to each selection.
    """
    cal = F.broadcast(calendar(bars))  # a row per date
    low, high = F.greatest(F.lit(0), F.floor((F.col("pos") - lookback) / every) + 1), F.least(F.floor(F.col("pos") / every), F.floor((F.col("n") - 1 - lookback) / every))
    seen = bars.where("turnover > 0").join(cal, "d").where(low <= high).select("ticker", low.alias("low"), high.alias("high"), F.col("turnover").cast("double").alias("turnover"))
    blocks = seen.repartition("ticker").groupBy("ticker", "low", "high").agg(F.collect_list("turnover").alias("block"))
    sets = blocks.select("ticker", F.explode(F.sequence("low", "high")).alias("k"), "block").groupBy("ticker", "k").agg(F.flatten(F.collect_list("block")).alias("all"))
    sets = sets.where(F.size("all") >= least).select((F.col("k") * every + lookback).alias("r"), "ticker", F.sort_array("all").alias("all"))
    medians = sets.select("r", "ticker", F.round(middle("all"), 6).alias("m"))
    best = F.row_number().over(Window.partitionBy("r").orderBy(F.desc("m"), "ticker"))
    return medians.withColumn("k", best).where(F.col("k") <= top).select("r", "ticker")


def universe(bars: DataFrame, *, every: int = 63, **options: int) -> DataFrame:
    """(ticker, d): each selection, held until the next one."""
    held = selections(bars, every=every, **options).withColumn("pos", F.explode(F.sequence(F.col("r"), F.col("r") + every - 1)))
    return held.join(calendar(bars).select("pos", "d"), "pos").select("ticker", "d")


def churn(bars: DataFrame, *, every: int = 63, **options: int) -> DataFrame:
    """Of each selection but the first: how many names it has and how many, and what share, are new."""
    now = selections(bars, every=every, **options)
    both = F.explode(F.array(F.struct("r", F.lit(True).alias("is")), F.struct((F.col("r") + every).alias("r"), F.lit(False).alias("is"))))  # its own and the next one
    rows = now.select("ticker", both.alias("x")).groupBy("x.r", "ticker").agg(F.bool_or("x.is").alias("now"), F.bool_or(~F.col("x.is")).alias("was"))
    out = rows.groupBy(F.col("r").alias("pos")).agg(F.count_if("now").alias("names"), F.count_if(F.col("now") & ~F.col("was")).alias("entered"), F.bool_or("was").alias("known"))
    return out.where("names > 0 and known").select("pos", "names", "entered", (F.col("entered") / F.col("names")).alias("churn"))


def export(bars: DataFrame, mask: DataFrame) -> DataFrame:
    """The whole history of every name that the mask ever holds."""
    return bars.join(mask.select("ticker").distinct(), "ticker", "left_semi")


def names_ever(mask: DataFrame) -> DataFrame:
    """year, names, dates: exact distinct counts of members (ticker, d) and of dates by year, and over all (year 0)."""
    rows = mask.select("ticker", "d", F.year("d").cast("long").alias("year"))
    return rows.rollup("year").agg(F.countDistinct("ticker").alias("names"), F.countDistinct("d").alias("dates")).withColumn("year", F.coalesce("year", F.lit(0).cast("long")))


def liquidity(panel: DataFrame, n: int = 21, least: int = 10) -> DataFrame:
    """A dense panel with adv (median of the positive turnovers of the n dates before) and sigma (deviation of returns over them; a date
    without a bar counts as unchanged)."""
    rows = panel.withColumns({"traded": F.when(F.col("turnover") > 0, F.col("turnover")), "known": last_known("close")})
    rows = rows.withColumn("ret", F.col("known") / F.lag("known").over(by_name()) - 1)
    return rows.withColumns({"adv": trailing(median, "traded", n, least=least, lag=1), "sigma": trailing(F.stddev_samp, "ret", n, lag=1)}).drop("traded", "known", "ret")


def spreads(panel: DataFrame, n: int = 63, least: int = 30) -> DataFrame:
    """A dense panel with half-spreads in basis points: cs from the high-low ranges of one date and of two, ar from closes against the
    middle of the range. Means over the n dates before come first, then the one clip at 0."""
    w = by_name()
    lag = lambda c: F.lag(c).over(w)
    both = F.col("high").isNotNull() & lag("high").isNotNull()
    wide = F.when(both, F.ln(F.greatest(F.col("high"), lag("high")) / F.least(F.col("low"), lag("low"))))
    middle = lambda hi, lo: (F.ln(hi) + F.ln(lo)) / 2
    rows = panel.withColumns({
        "beta": F.pow(F.ln(F.col("high") / F.col("low")), 2) + F.pow(F.ln(lag("high") / lag("low")), 2), "gamma": wide * wide,
        "eta": (F.ln(lag("close")) - middle(lag("high"), lag("low"))) * (F.ln(lag("close")) - middle(F.col("high"), F.col("low"))),
    })
    rows = rows.withColumns({c: trailing(F.avg, c, n, least=least, lag=1) for c in ("beta", "gamma", "eta")})
    k = 3 - 2 * 2**0.5
    alpha = F.when(F.col("beta").isNotNull() & F.col("gamma").isNotNull(), F.greatest(F.lit(0.0), (F.sqrt(2 * F.col("beta")) - F.sqrt("beta")) / k - F.sqrt(F.col("gamma") / k)))
    rows = rows.withColumn("alpha", alpha)
    cs = 1e4 * (F.exp("alpha") - 1) / (1 + F.exp("alpha"))
    ar = F.when(F.col("eta").isNotNull(), 1e4 * F.sqrt(F.greatest(F.lit(0.0), 4 * F.col("eta"))) / 2)
    return rows.withColumns({"cs": cs, "ar": ar}).drop("beta", "gamma", "eta", "alpha")


def cost_panel(bars: DataFrame) -> DataFrame:
    """ticker, d, pos, the prices, adv, sigma, cs and ar: one pass over each name's dense rows."""
    return spreads(liquidity(densify(bars)))


def spread_by_bucket(panel: DataFrame, k: int = 5) -> DataFrame:
    """Spreads pooled by bucket of turnover within the date (1: the largest), and over all (bucket 0)."""
    rows = panel.where("cs is not null and turnover is not null").withColumn("turnover", F.round("turnover", 6))
    rows = rows.select("cs", bucket("turnover", k, "d", descending=True).alias("q"))
    rows = materialize(rows, "spread-buckets")
    both = rows.select("cs", F.explode(F.array("q", F.lit(0).cast("long"))).alias("fifth"))
    middle = spread_out(exact_quantiles(both, {"cs": F.col("cs")}, [0.5], "fifth"), "fifth", names={"median_cs": ("cs", 0.5)}).withColumnRenamed("fifth", "q")
    out = rows.rollup("q").agg(F.count("*").alias("n"), F.avg("cs").alias("mean_cs"), F.avg((F.col("cs") == 0).cast("double")).alias("zero_share"))
    return out.withColumn("q", F.coalesce("q", F.lit(0).cast("long"))).join(middle, "q", "left").select("q", "n", "mean_cs", "median_cs", "zero_share")


def monotone(buckets: DataFrame, value: str) -> DataFrame:
    """Whether the value rises from each bucket (more than 0) to the next."""
    rises = buckets.where("q > 0").select((F.col(value) > F.lag(value).over(Window.orderBy("q"))).alias("rises"))  # a row per bucket
    return rises.agg(F.bool_and(F.coalesce("rises", F.lit(True))).alias("rises_throughout"))


def pooled_mean(buckets: DataFrame, value: str) -> DataFrame:
    """Mean over all rows from the means of buckets and their counts n."""
    return buckets.where("q > 0").agg((F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("pooled"))


def ranked_turnover(bars: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("d").orderBy(F.desc(F.round("turnover", 6)), "ticker"))
    return bars.withColumn("k", rank.cast("long"))


def rank_curve(bars: DataFrame) -> DataFrame:
    """Median turnover of each place in the date's order."""
    return ranked_turnover(bars).groupBy("k").agg(median("turnover").alias("median_turnover"))


def capacity(bars: DataFrame, sizes: list[tuple[float, int]], ceiling: float = 0.1) -> DataFrame:
    """Participation of an equal-weight book in the n largest names, for each (size, n); feasible where the median is under the ceiling."""
    rows = ranked_turnover(bars).where(F.col("k") <= max(n for _, n in sizes))
    within = F.explode(F.array(*[F.lit(n).cast("long") for n in sorted({n for _, n in sizes})])).alias("top")
    rows = rows.select("k", "turnover", within).where("k <= top and turnover > 0")
    # a participation is a unit one times the size, and so are its quantiles
    unit = exact_quantiles(rows, {"unit": 1.0 / F.col("top") / F.col("turnover")}, [0.5], "top")
    grid = bars.sparkSession.createDataFrame([(float(a), n) for a, n in sizes], "aum double, top long")
    out = grid.join(unit, "top").select("aum", F.col("top").alias("n"), (F.col("aum") * F.col("value")).alias("participation"), F.col("n").alias("bars"))
    return out.withColumn("feasible", F.round("participation", 9) <= ceiling)


def capacity_curve(panel: DataFrame, sizes: list[float], *, names: int, share: float = 0.1, ceiling: float = 0.1, coef: float = 0.5, least: int = 50) -> DataFrame:
    """For each size of the book: position, participation at three quantiles, share of bars beyond the ceiling, impact, and the largest
    number of names of which the last one's median turnover still carries its position; 0 if none from `least` on does."""
    book = max(1, round(share * names))
    rows = panel.where("turnover > 0 and sigma is not null").select((1.0 / book / F.col("turnover")).alias("unit"), "sigma")
    rows = materialize(rows.withColumn("impact", 1e4 * coef * F.col("sigma") * F.sqrt("unit")), "capacity")
    # participation grows with the size and impact with its root, and so do their quantiles and means: one pass serves all sizes
    names_of = {"part_median": ("unit", 0.5), "part_p90": ("unit", 0.9), "part_p99": ("unit", 0.99), "impact_median": ("impact", 0.5)}
    at_one = spread_out(exact_quantiles(rows, {"unit": F.col("unit"), "impact": F.col("impact")}, [0.5, 0.9, 0.99]).where("name = 'unit' or q = 0.5"), names=names_of)
    over = [F.avg((F.round(float(a) * F.col("unit"), 12) > ceiling).cast("double")) for a in sizes]
    means = rows.agg(F.avg("impact").alias("impact_mean"), F.array(*[F.struct(F.lit(float(a)).alias("aum"), o.alias("over_ceiling")) for a, o in zip(sizes, over, strict=True)]).alias("s"))
    both = means.crossJoin(F.broadcast(at_one)).select("*", F.explode("s").alias("x"))  # a row each
    size = F.col("x.aum")
    out = both.select(
        size.alias("aum"), *[(size * F.col(c)).alias(c) for c in ("part_median", "part_p90", "part_p99")], "x.over_ceiling", (F.sqrt(size) * F.col("impact_median")).alias("impact_median"), (F.sqrt(size) * F.col("impact_mean")).alias("impact_mean")
    )
    curve = rank_curve(panel.where("turnover > 0")).select("k", "median_turnover", F.explode(F.array(*[F.lit(float(a)) for a in sizes])).alias("aum")).where(F.col("k") >= least)
    held = F.greatest(F.lit(1.0), F.bround(F.col("k") * share, 0))  # halves to the even side
    fits = F.round(F.col("aum") / held / F.col("median_turnover"), 12) <= ceiling
    most = curve.groupBy("aum").agg(F.coalesce(F.max(F.when(fits, F.col("k"))), F.lit(0)).alias("max_names"))
    return out.join(most, "aum", "left").withColumn("max_names", F.coalesce("max_names", F.lit(0)))
