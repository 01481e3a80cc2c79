"""What swaps, short legs and trend tilts are worth: measurements on finished books."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.functions.columns import average_rank, by_name, r6
from tessera.operators.evaluation import rank_ic, sharpe
from tessera.operators.portfolio import deciles
from tessera.operators.quantiles import exact_quantiles
from tessera.sinks.steps import materialize


def _dates() -> WindowSpec:
    """Along a series of one row per date."""
    return Window.orderBy("d")


def swap_pairs(held: DataFrame, scored: DataFrame, gate: DataFrame, costs: DataFrame, horizon: int, *, leg: str = "long") -> DataFrame:
    """d, z_gap, realised_gap, roundtrip_cost of each swap of a leg: the n-th best entrant of a date against the n-th worst exit.

    held: (d, ticker). scored: a dense panel (ticker, d, pos, score, close). Gaps are signed so that positive is good for the leg. Dates in
    panic or right after it are left out: there the book is liquidated or rebuilt, not rotated.
    """
    sign = 1.0 if leg == "long" else -1.0
    date = Window.partitionBy("d")
    z = (F.col("score") - F.avg("score").over(date)) / F.when(F.stddev_samp("score").over(date) > 0, F.stddev_samp("score").over(date))
    rows = scored.withColumns({"z": F.when(F.col("score").isNotNull(), z), "fwd_h": F.ln(F.lead("close", horizon).over(by_name()) / F.col("close"))})
    rows = rows.join(held.select("ticker", "d", F.lit(True).alias("in_book")), ["ticker", "d"], "left").withColumn("in_book", F.coalesce("in_book", F.lit(False)))
    rows = rows.withColumn("was", F.coalesce(F.lag("in_book").over(by_name()), F.lit(False)))
    calm = scored.select("d").distinct().join(gate, "d", "left").withColumn("panic", F.coalesce("panic", F.lit(False)))
    calm = calm.withColumn("quiet", ~F.col("panic") & ~F.coalesce(F.lag("panic").over(_dates()), F.lit(True))).where("quiet").select("d")
    moves = rows.where(F.col("in_book") != F.col("was")).join(costs, ["ticker", "d"], "left").join(calm, "d", "left_semi").where("z is not null")
    entry = F.row_number().over(Window.partitionBy("d").orderBy(F.round(-sign * F.col("z"), 9), "ticker"))
    leaving = F.row_number().over(Window.partitionBy("d").orderBy(F.round(sign * F.col("z"), 9), "ticker"))
    ins = moves.where("in_book").select("d", entry.alias("k"), F.col("z").alias("zi"), F.col("fwd_h").alias("ri"), F.col("cost").alias("ci"))
    outs = moves.where("was").select("d", leaving.alias("k"), F.col("z").alias("zo"), F.col("fwd_h").alias("ro"), F.col("cost").alias("co"))
    pairs = ins.join(outs, ["d", "k"])
    return pairs.select("d", "k", (sign * (F.col("zi") - F.col("zo"))).alias("z_gap"), (sign * (F.col("ri") - F.col("ro"))).alias("realised_gap"), ((F.col("ci") + F.col("co")) / 1e4).alias("roundtrip_cost"))


def quantile_cut(column: str, edges: list[float], k: int) -> Column:
    """Bucket 1..k of equal population: the first whose upper edge the value doesn't pass."""
    return sum(((F.col(column) > e).cast("int") for e in edges), F.lit(1))


def swap_rollup(pairs: DataFrame, k: int = 5) -> DataFrame:
    """By fifth of z_gap, and over all (bucket 0): swaps, mean gaps and cost, share that paid, mean net. Pairs are written, since the edges of
    the fifths read them first."""
    clean = pairs.dropna().withColumns({"z": F.round("z_gap", 9), "net": F.col("realised_gap") - F.col("roundtrip_cost")})
    clean = materialize(clean, "swaps")
    edges = [x["value"] for x in exact_quantiles(clean, {"z": F.col("z")}, [j / k for j in range(1, k)]).orderBy("q").collect()]  # k - 1 numbers
    rows = clean.withColumn("bucket", quantile_cut("z", edges, k))
    return rows.rollup("bucket").agg(
        F.count("*").alias("n"), F.avg("z_gap").alias("z_gap"), F.avg("realised_gap").alias("realised_gap"), F.avg("roundtrip_cost").alias("roundtrip_cost"),
        F.avg((F.round("net", 12) > 0).cast("double")).alias("share_paid"), F.avg("net").alias("mean_net"),
    ).withColumn("bucket", F.coalesce("bucket", F.lit(0)).cast("long"))


def short_leg_return(book: DataFrame) -> DataFrame:
    """d, leg: return of the short leg alone (book: d, wt, fwd); null where no short has a price."""
    return book.groupBy("d").agg(F.sum(F.when(F.col("wt") < 0, F.col("wt") * F.col("fwd"))).alias("leg"))


def oracle_scales(leg: DataFrame) -> DataFrame:
    """d, always_on, always_off, oracle_daily (on where the leg gains, or has no return), oracle_monthly (on in months it gains)."""
    gain = F.round("leg", 12)
    month = F.sum("leg").over(Window.partitionBy(F.trunc("d", "month")))
    daily = F.when(F.coalesce(gain, F.lit(0.0)) == 0, 1.0).when(gain > 0, 1.0).otherwise(0.0)
    return leg.select("d", F.lit(1.0).alias("always_on"), F.lit(0.0).alias("always_off"), daily.alias("oracle_daily"), F.when(F.round(month, 12) > 0, 1.0).otherwise(0.0).alias("oracle_monthly"))


def scaled_shorts(book: DataFrame, scales: DataFrame, name: str) -> DataFrame:
    """book with the short weights times the scale of the date (between 0 and 1; d, scale columns)."""
    return book.join(scales.select("d", F.col(name).alias("_scale")), "d").withColumn("wt", F.when(F.col("wt") < 0, F.col("wt") * F.col("_scale")).otherwise(F.col("wt"))).drop("_scale")


def short_leg_value(book: DataFrame, year: float) -> DataFrame:
    """One row: yearly Sharpe ratio of the short leg alone, of the long leg, of both, and what the short leg adds."""
    part = lambda c: F.sum(F.when(c, F.col("wt") * F.col("fwd")))
    legs = book.groupBy("d").agg(part(F.col("wt") < 0).alias("short"), part(F.col("wt") > 0).alias("long"), part(F.col("wt") != 0).alias("both"))
    out = legs.agg(*[sharpe(c, year).alias(c) for c in ("short", "long", "both")], F.count("both").alias("n"))
    return out.withColumn("added", F.col("both") - F.col("long"))


def borrowable_short_leg(scored: DataFrame, year: float, share: float = 0.1) -> DataFrame:
    """One row: yearly Sharpe ratio of the short leg as it would be, of that of names that can be borrowed alone (scored: ticker, d, score, fwd,
    shortable; as many names as of the whole cross-section), of both books with the long leg, and what the restriction costs each."""
    rows = scored.withColumn("borrowed", F.when(F.coalesce("shortable", F.lit(False)), F.col("score")))
    free, bound = deciles(rows, share), deciles(rows, share, short_score="borrowed")
    legs = lambda df, s: df.groupBy("d").agg(F.sum(F.when(F.col("sh") > 0, -F.col("sh") * F.col("fwd"))).alias(s), F.sum(F.when(F.col("l") != F.col("sh"), (F.col("l") - F.col("sh")) * F.col("fwd"))).alias(f"{s}_book"))
    both = legs(free, "whole").join(legs(bound, "borrowable"), "d", "full_outer")
    out = both.agg(*[sharpe(c, year).alias(c) for c in ("whole", "borrowable", "whole_book", "borrowable_book")], F.count("borrowable").alias("n"))
    return out.withColumns({"leg_cost": F.col("whole") - F.col("borrowable"), "book_cost": F.col("whole_book") - F.col("borrowable_book")})


TRENDS = ("mom_12_1", "mom_63", "mom_21", "px_v_200", "sortino_63")


def trend_measures(panel: DataFrame, *, month: int = 21, quarter: int = 63, long: int = 200, year: int = 252) -> DataFrame:
    """A dense panel with the trends of each name, of windows that end at d and are full."""
    w, c = by_name(), F.ln("close")
    rows = panel.withColumn("lr", c - F.lag(c).over(w))
    over = lambda agg, x, n: F.when(F.count(x).over(w.rowsBetween(-(n - 1), 0)) == n, agg(x).over(w.rowsBetween(-(n - 1), 0)))
    down = F.pow(F.least("lr", F.lit(0.0)), 2)
    rows = rows.withColumn("down", F.when(F.col("lr").isNotNull(), down))
    risk = F.sqrt(over(F.avg, "down", quarter))
    return rows.withColumns({
        "mom_12_1": F.lag(c, month).over(w) - F.lag(c, year).over(w), "mom_63": c - F.lag(c, quarter).over(w), "mom_21": c - F.lag(c, month).over(w),
        "px_v_200": c - F.ln(over(F.avg, "close", long)), "sortino_63": over(F.avg, "lr", quarter) / F.when(risk > 0, risk),
    }).drop("lr", "down")


def orthogonality(rows: DataFrame, least: int = 10) -> DataFrame:
    """trend, part, rho, n: mean over dates of the rank correlation of score and each trend, inside all names, the best (l > 0) and the
    worst (sh > 0). The trends are unpivoted, so all are ranked at once."""
    parts = F.explode(F.array(F.struct(F.lit("all").alias("part"), F.lit(True).alias("ok")), F.struct(F.lit("best").alias("part"), (F.col("l") > 0).alias("ok")), F.struct(F.lit("worst").alias("part"), (F.col("sh") > 0).alias("ok"))))
    long = rows.select("d", "ticker", "score", parts.alias("p"), *TRENDS).where("p.ok").unpivot(["d", "ticker", "score", "p"], list(TRENDS), "trend", "fwd")
    long = long.select("d", F.col("p.part").alias("part"), "trend", "score", "fwd")
    return rank_ic(long, "trend", "part", "d", least=least).groupBy("trend", "part").agg(F.avg("ic").alias("rho"), F.count("ic").alias("n"))


def _normalised(weight: Column) -> Column:
    whole = F.sum(weight).over(Window.partitionBy("d"))
    return F.when(whole > 0, weight / whole).otherwise(F.lit(0.0))


def tilted(leg: DataFrame, trend: str, *, high: bool, strength: float = 1.0) -> DataFrame:
    """A leg (ticker, d, trend) with w in proportion to 1 + strength * (2 * percent rank - 1) towards high or low trends; all names stay."""
    rows = leg.where(F.col(trend).isNotNull()).withColumn("_t", F.round(trend, 9))
    pct = average_rank("_t", "d") / F.count("*").over(Window.partitionBy("d"))
    signed = 2 * pct - 1 if high else 1 - 2 * pct
    rows = rows.withColumn("_w", F.greatest(F.lit(0.0), 1 + strength * signed))
    return rows.withColumn("w", _normalised(F.col("_w"))).drop("_t", "_w")


def hard_cut(leg: DataFrame, trend: str, *, high: bool, keep: float = 0.5) -> DataFrame:
    """A leg with equal w for the names of the right half of trends, and 0 for the others."""
    rows = leg.where(F.col(trend).isNotNull()).withColumn("_t", F.round(trend, 9))
    pct = F.round(average_rank("_t", "d") / F.count("*").over(Window.partitionBy("d")), 9)
    rows = rows.withColumn("_w", F.when((pct >= 1 - keep) if high else (pct <= keep), 1.0).otherwise(0.0))
    return rows.withColumn("w", _normalised(F.col("_w"))).drop("_t", "_w")


def tilt_table(legs: DataFrame, trend: str, year: float) -> DataFrame:
    """variant, ann, sharpe, max_fall, worst_month, long_names, short_names of books whose legs are tilted by a trend; legs: ticker, d, l,
    sh, fwd (log return to the next date), and the trend."""
    best, worst = legs.where("l > 0"), legs.where("sh > 0")
    equal = lambda df: df.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("d")))
    variants = {
        "equal": (equal(best), equal(worst)), "smooth_half": (tilted(best, trend, high=True, strength=0.5), tilted(worst, trend, high=False, strength=0.5)),
        "smooth": (tilted(best, trend, high=True), tilted(worst, trend, high=False)), "hard_cut": (hard_cut(best, trend, high=True), hard_cut(worst, trend, high=False)),
        "reversed": (tilted(best, trend, high=False), tilted(worst, trend, high=True)),
    }
    pick = lambda name, df, side: df.select(F.lit(name).alias("variant"), "d", "fwd", (F.lit(side) * F.col("w")).alias("w"))
    rows = reduce(DataFrame.unionByName, [pick(name, df, side) for name, (a, b) in variants.items() for df, side in ((a, 1.0), (b, -1.0))])
    part = lambda c: F.sum(F.when(c, F.col("w") * F.col("fwd")))
    days = rows.groupBy("variant", "d").agg((part(F.col("w") > 0) + part(F.col("w") < 0)).alias("ret"), F.count_if(F.col("w") > 0).alias("nl"), F.count_if(F.col("w") < 0).alias("ns"))
    w = Window.partitionBy("variant").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    days = days.where("ret is not null").withColumn("total", F.sum("ret").over(w)).withColumn("fall", F.col("total") - F.max("total").over(w))
    days = days.withColumn("month", F.sum("ret").over(Window.partitionBy("variant", F.trunc("d", "month"))))
    return days.groupBy("variant").agg((F.avg("ret") * year).alias("ann"), sharpe("ret", year).alias("sharpe"), F.min("fall").alias("max_fall"), F.min("month").alias("worst_month"), F.avg("nl").alias("long_names"), F.avg("ns").alias("short_names"))


def turnover_attribution(buffered: DataFrame, raw: DataFrame, gate: DataFrame) -> DataFrame:
    """One row: turnover of the buffered and of the raw book (d, turnover), what the buffer removes, what falls on dates at which the gate
    flips, and the rest."""
    flips = buffered.join(gate, "d", "left").withColumn("panic", F.coalesce("panic", F.lit(False)))
    flips = flips.withColumn("flip", F.col("panic") != F.lag("panic", 1, False).over(_dates()))
    one = flips.agg(F.sum("turnover").alias("buffered"), F.sum(F.when(F.col("flip"), F.col("turnover")).otherwise(0.0)).alias("at_flips"), F.count_if("flip").alias("flips"), F.count("*").alias("bars"))
    out = one.withColumn("raw", raw.agg(F.sum("turnover")).scalar())
    return out.select(
        r6("buffered").alias("buffered"), r6("raw").alias("raw"), r6(1 - F.col("buffered") / F.col("raw")).alias("removed_share"), r6("at_flips").alias("at_flips"),
        r6(1 - F.col("at_flips") / F.col("buffered")).alias("rotation_share"), "flips", "bars",
    )


def scrambled(rows: DataFrame, columns: list[str], after: Column, seed: int = 7) -> DataFrame:
    """rows whose columns, where `after` holds, are noise: what a causal result before that must not feel."""
    return rows.withColumns({c: F.when(after, F.rand(seed + k)).otherwise(F.col(c)) for k, c in enumerate(columns)})
