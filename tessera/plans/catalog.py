"""All queries over bars, with the parameters that keep the small test tables busy; the operators take any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.columns import by_name, expanding_z, r6, trailing
from tessera.operators import attribution, buffers, corporate, evaluation, intraday, learning, panel, portfolio, quantiles, regime, shorting, universe
from tessera.operators import features as feats
from tessera.plans.oracles import ORACLES, given_states
from tessera.sources.bars import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WEEKS = 52
#: A book of this size, and a year of weekly bars.
COSTS = portfolio.Costs(aum=1e5, bars_per_year=WEEKS)
UNIVERSE = {"top": 25, "lookback": 252, "every": 63, "least": 40}


def query(*sources: str, name: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function of source tables as a query."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name or f.__name__] = lambda spark, sf_dir: f(*[stored(spark, sf_dir, s) for s in sources])
        return f

    return register


def six(df: DataFrame, *keys: str, **renamed: str) -> DataFrame:
    """df with its fractional columns at six digits; keys are left as they are."""
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).alias(renamed.get(c, c)) if kinds[c] != "double" or c in keys else r6(c).alias(renamed.get(c, c)) for c in df.columns])


# ---- bars ----
query("tk", name="resample_30m")(lambda tk: panel.resample(tk, 30))
query("tk", name="resample_60m")(lambda tk: panel.resample(tk, 60))
query("tk", name="bars_per_day")(lambda tk: panel.bars_per_day(tk, 30))


def _once(tk: DataFrame, keep: str) -> DataFrame:
    return panel.dedup(tk, [F.col("ticker"), F.to_date("ts"), F.hour("ts"), F.minute("ts")], "event_id", keep).select("ticker", "event_id", "px")


query("tk", name="dedup_keep_last")(lambda tk: _once(tk, "last"))
query("tk", name="dedup_keep_first")(lambda tk: _once(tk, "first"))
query("wx", name="fill_within_name")(panel.filled)
query("wk", name="calendar_ordinal")(lambda wk: panel.calendar(wk).select("d", "pos"))
query("wk", name="business_days")(lambda wk: wk.sparkSession.range(1).select(F.explode(panel.business_days("1996-01-01", "1996-12-31")).alias("d")))
query("wx", name="anti_missing")(panel.missing_cells)
query("wk", name="panel_count")(lambda wk: panel.digest(wk.select("ticker", "d", F.round(F.col("close") * 1e6).cast("long").alias("close")), ["ticker", "d", "close"]))


# ---- features ----
@query("dy")
def raw_features(dy: DataFrame) -> DataFrame:
    h = feats.Horizons()
    rows = feats.features(dy, h)
    return rows.select("ticker", "d", *[r6(F.col(c) * 1e9 if c == "amihud" else c).alias(c) for c in h.features])


@query("dy")
def forward_targets(dy: DataFrame) -> DataFrame:
    h = feats.Horizons()
    return six(feats.features(dy, h).select("ticker", "d", *h.labels))


query("tk", name="session_targets")(lambda tk: six(feats.session_targets(panel.resample(tk, 30), 2)))
query("dy", name="feature_matrix")(lambda dy: six(feats.feature_matrix(dy)))


def delivery_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q = F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")))
    delivered = lines.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("d")).agg(q.alias("delivery_qty"), (q / F.sum("l_quantity")).alias("delivery_pct"))
    bars = stored(spark, sf_dir, "dy").join(delivered, ["ticker", "d"], "left")
    h = feats.Horizons(momenta=(1,), averages=(), vols=(), targets=())
    names = ["mom_1", *feats.INSTITUTIONAL]
    rows = feats.features(bars, h).dropna("any", subset=names)
    return six(feats.rank_normalised(rows, names).select("ticker", "d", *names))


QUERIES["delivery_features"] = delivery_features


# ---- universe, liquidity, spreads, capacity ----
query("dy", name="universe_topn")(lambda dy: universe.universe(dy, **UNIVERSE).select("d", "ticker"))
query("dy", name="universe_churn")(lambda dy: six(universe.churn(dy, **UNIVERSE)))


@query("dy")
def universe_masked_rank(dy: DataFrame) -> DataFrame:
    rows = feats.features(dy, feats.Horizons()).select("ticker", "d", "mom_20").dropna()
    return six(feats.rank_normalised(feats.masked(rows, universe.universe(dy, **UNIVERSE)), ["mom_20"]))


query("dy", name="universe_names_ever")(lambda dy: universe.names_ever(universe.universe(dy, **UNIVERSE)))


@query("wk")
def wide_marks(wk: DataFrame) -> DataFrame:
    """By date, columns of two names: mean and last close, and whether any trade moved the bar by a tenth."""
    rows = wk.withColumn("month", F.trunc("d", "month")).withColumn("moved", F.col("high") > F.col("low") * 1.1).withColumn("close", F.floor(F.col("close") * 4) / 4)
    names = ["Brand#11", "Brand#22"]
    parts = [panel.wide(rows, ["month"], "ticker", names, c, how, "d").toDF("month", f"{how}_11", f"{how}_22") for c, how in (("close", "mean"), ("close", "last"), ("moved", "any"))]
    return six(parts[0].join(parts[1], "month").join(parts[2], "month"))


query("dy", name="universe_export")(lambda dy: universe.export(dy, universe.universe(dy, **UNIVERSE)).select("ticker", "d", "close"))
query("wx", name="liquidity_panels")(lambda wx: six(universe.liquidity(panel.densify(wx)).select("ticker", "d", "adv", "sigma")))
query("wx", name="spread_panels")(lambda wx: six(universe.spreads(panel.densify(wx)).select("ticker", "d", "cs", "ar").dropna()))


def _by_bucket(wx: DataFrame) -> DataFrame:
    return universe.spread_by_bucket(universe.spreads(panel.densify(wx)))


query("wx", name="liquidity_quintile_spread")(lambda wx: six(_by_bucket(wx)))
query("wx", name="spread_monotone_gate")(lambda wx: universe.monotone(_by_bucket(wx), "mean_cs"))
query("wx", name="spread_pooled_mean")(lambda wx: six(universe.pooled_mean(_by_bucket(wx), "mean_cs")))
query("wk", name="rank_turnover_curve")(lambda wk: six(universe.rank_curve(wk)))
query("wk", name="capacity_sweep")(lambda wk: six(universe.capacity(wk, [(1e5, 5), (1e5, 10), (1e6, 5), (1e6, 10), (1e6, 20)]), "aum"))
query("wx", name="capacity_curve")(lambda wx: six(universe.capacity_curve(universe.liquidity(panel.densify(wx)), [1e4, 1e5, 1e6], names=25, share=0.2, least=5), "aum"))


@query("tk")
def gate_by_series(tk: DataFrame) -> DataFrame:
    """Each name's quarter hours with a range beyond 0.85 of all of its ranges so far."""
    bars = panel.resample(tk, 15).withColumn("range", F.round(F.col("high") / F.col("low") - 1, 9))
    bars = bars.withColumn("at", F.unix_date("d") * 1000 + F.col("bin"))
    return six(quantiles.gate(bars, "range", 0.85, 20, "ticker", order="at").select("ticker", "d", "bin", "range", "edge", "panic"))


# ---- scores and books ----
def scored(bars: DataFrame) -> DataFrame:
    """Five-week momentum and the next week's return on the dense panel."""
    return portfolio.forward_returns(portfolio.momentum(panel.densify(bars)), bridge=False)


def _side() -> Column:
    return (F.col("hi") <= F.col("k")).cast("int") - (F.col("lo") <= F.col("k")).cast("int")


def _ls(rows: DataFrame) -> DataFrame:
    on = F.col("l") != F.col("sh")
    return rows.groupBy("d").agg(F.sum(F.when(on, (F.col("l") - F.col("sh")) * F.col("fwd"))).alias("ret"), F.count_if(on & F.col("fwd").isNull()).alias("unpriced"))


def ledger(wk: DataFrame) -> DataFrame:
    """Returns of the best decile alone."""
    return portfolio.deciles(scored(wk)).where("l > 0").groupBy("d").agg(F.sum(F.col("l") * F.col("fwd")).alias("ret"))


query("wk", name="momentum_rank")(lambda wk: portfolio.deciles(scored(wk)).select("ticker", "d", F.col("hi").cast("long").alias("rank_desc"), F.col("lo").cast("long").alias("rank_asc"), _side().alias("side")))
query("wk", name="top_bottom_n")(lambda wk: portfolio.fixed_legs(scored(wk), 3))
query("wk", name="long_short_returns")(lambda wk: six(_ls(portfolio.deciles(scored(wk))), ret="gross"))


def gate_of(bars: DataFrame) -> DataFrame:
    """The gate of the bars, kept: a row per date that many books read."""
    return regime.panic_gate(regime.regime_inputs(bars), least=WEEKS).persist(StorageLevel.DISK_ONLY)


query("wx", name="avg_pairwise_corr")(lambda wx: six(regime.pairwise_correlation(wx)))
query("wx", name="regime_inputs")(lambda wx: six(regime.regime_inputs(wx)))
query("wx", name="panic_gate")(lambda wx: six(gate_of(wx)))
query("wx", name="vol_tripwire")(lambda wx: six(regime.vol_tripwire(wx, least=WEEKS)))


def _weights(style: str) -> Callable[[DataFrame], DataFrame]:
    def run(wx: DataFrame) -> DataFrame:
        book = portfolio.styled(portfolio.deciles(scored(wx)), style, regime.known_before(gate_of(wx)))
        return book.groupBy("d").agg(r6(F.sum("wt")).alias("net"), r6(F.sum(F.abs("wt"))).alias("gross"), F.count("*").alias("names"))

    return run


for _style in portfolio.STYLES:
    query("wx", name=f"weights_{_style}")(_weights(_style))


def execution_panel(wx: DataFrame) -> DataFrame:
    """One pass over each name's dense rows: scores, returns to the next quote or the exit, cost inputs, what can be borrowed. Kept, since
    the styles and the medians of their gaps read it again."""
    rows = portfolio.forward_returns(portfolio.momentum(universe.cost_panel(wx)))
    rows = portfolio.with_exits(rows, corporate.lifecycle(wx, quiet=4))
    return rows.withColumn("shortable", F.substring("ticker", -1, 1).isin("2", "4")).where("score is not null").persist(StorageLevel.DISK_ONLY)


def executed(wx: DataFrame, style: str, **options) -> DataFrame:
    return portfolio.execute(execution_panel(wx), style, regime.known_before(gate_of(wx)), **{"costs": COSTS} | options)


for _style in ("long_only", "long_short_slb", "dynamic_tilt"):
    query("wx", name=f"execute_{_style}")(lambda wx, s=_style: six(executed(wx, s)))
def busy_days(tk: DataFrame) -> DataFrame:
    """A daily gate: days of many ticks, but not every fifth one."""
    return tk.groupBy(F.to_date("ts").alias("d")).agg((F.count("*") > 300).alias("panic")).where(F.dayofmonth("d") % 5 != 0)


def intraday_days(tk: DataFrame, minutes: int, styles: list[str]) -> DataFrame:
    """The ticks' values, which jump about, as prices that move by some percent."""
    costs = portfolio.Costs(aum=1e2, bars_per_year=252 * 375 / minutes)
    calm = tk.where("px > 0").withColumn("px", F.round(100 * F.pow(F.col("px") / 100, F.lit(0.01)), 6))
    return intraday.execute_bars(calm, minutes, styles, busy_days(tk), share=0.3, costs=costs)


for _m in (30, 60):
    query("tk", name=f"execute_intraday_{_m}m")(lambda tk, m=_m: six(intraday_days(tk, m, ["dynamic_tilt"]).drop("style")))


@query("tk")
def frequency_grid(tk: DataFrame) -> DataFrame:
    """Every frequency with every style: yearly Sharpe ratios of its days before and after costs, and what a day costs."""
    cells = [intraday_days(tk, m, list(portfolio.STYLES)).withColumn("minutes", F.lit(m).cast("long")) for m in (30, 60)]
    days = cells[0].unionByName(cells[1]).where("net is not null")
    return six(days.groupBy("minutes", "style").agg(evaluation.sharpe("gross", 252).alias("gross_sharpe"), evaluation.sharpe("net", 252).alias("net_sharpe"), F.avg("trade_cost").alias("day_cost"), F.count("*").alias("days")))


query("wx", name="execute_capped")(lambda wx: six(executed(wx, "long_only", costs=portfolio.Costs(aum=2e5, bars_per_year=WEEKS), capped_at=0.1)))
query("wx", name="implicit_exits")(lambda wx: six(portfolio.implicit_exits(scored(wx), "dynamic_tilt", regime.known_before(gate_of(wx)))))


@query("wx")
def tiered_borrow(wx: DataFrame) -> DataFrame:
    book = portfolio.deciles(execution_panel(wx), 0.3).withColumn("wt", -F.col("sh")).where("adv is not null")
    return portfolio.with_fees(book.where("wt < 0"), COSTS).select("d", "ticker", "tier", "fee")


@query("wk")
def cap_water_fill(wk: DataFrame) -> DataFrame:
    legs = portfolio.deciles(scored(wk), 0.5).withColumn("cap", 0.1 * F.col("turnover") / 2e5).where("l > 0")
    return portfolio.cap_leg(legs, "l", "cap").select("d", "ticker", r6("l").alias("weight"))


def decision(wk: DataFrame) -> DataFrame:
    return portfolio.decision_costs(portfolio.momentum(universe.cost_panel(wk)), COSTS, 0.2)


query("wk", name="decision_costs")(lambda wk: six(decision(wk)))


# ---- evaluation ----
def ics(wk: DataFrame) -> DataFrame:
    return evaluation.rank_ic(scored(wk), "d")


query("wk", name="daily_ic")(lambda wk: six(ics(wk)))
query("wk", name="ic_summary")(lambda wk: six(evaluation.ic_summary(ics(wk))))
query("wk", name="ic_by_year")(lambda wk: six(evaluation.ic_summary(ics(wk), F.year("d").cast("long").alias("year"))))
query("wk", name="ic_by_quintile")(lambda wk: six(evaluation.ic_by_bucket(scored(wk))))


def trailing_of(wk: DataFrame) -> DataFrame:
    return evaluation.trailing_ic(ics(wk).join(panel.calendar(wk), "d").select("d", "pos", "ic"), 1, WEEKS, WEEKS // 2)


query("wk", name="trailing_ic")(lambda wk: six(trailing_of(wk), trailing="trailing_ic"))
query("wk", name="expected_return")(lambda wk: six(portfolio.expected_return(portfolio.momentum(universe.liquidity(panel.densify(wk))), trailing_of(wk).dropna(), 5)))
query("wx", name="rolling_beta")(lambda wx: six(evaluation.rolling_beta(wx, WEEKS, WEEKS // 2)))
query("wk", name="performance")(lambda wk: six(evaluation.performance(ledger(wk), WEEKS)))
query("wk", name="variance_ratio")(lambda wk: six(evaluation.variance_ratio(ledger(wk), 5)))
query("wk", name="yearly_compounded")(lambda wk: six(evaluation.yearly(ledger(wk), WEEKS)))


@query("tk")
def daily_compounded(tk: DataFrame) -> DataFrame:
    bars = panel.resample(tk, 30)
    ret = F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("d", "bin")) - 1
    return six(evaluation.to_daily(bars.select(F.col("ticker").alias("strategy"), F.col("d").alias("ts"), ret.alias("ret"))))


def books(wx: DataFrame, wk: DataFrame) -> DataFrame:
    """Returns of three strategies."""
    rows = ledger(wk).select(F.lit("long_short").alias("strategy"), "ret")
    for style in ("long_only", "dynamic_tilt"):
        rows = rows.unionByName(executed(wx, style).select(F.lit(style).alias("strategy"), F.col("net").alias("ret")))
    return rows


@query("wx", "wk")
def psr_dsr(wx: DataFrame, wk: DataFrame) -> DataFrame:
    return six(evaluation.deflated_sharpe(books(wx, wk), 42, year=WEEKS).withColumn("min_track", F.when(F.col("min_track") < 1e6, F.col("min_track"))))


@query("wx", "wk")
def frozen_benchmark(wx: DataFrame, wk: DataFrame) -> DataFrame:
    """The strategies against a ratio of 0.05 a week that isn't derived from them."""
    return six(evaluation.deflated_sharpe(books(wx, wk), 42, year=WEEKS, benchmark=0.05).select("strategy", "n", "sharpe", "psr", "dsr"))


@query("wx", "wk")
def required_ratio(wx: DataFrame, wk: DataFrame) -> DataFrame:
    return six(evaluation.required_ratios(books(wx, wk), 42, year=WEEKS))


# ---- joins along time ----
def yields(wk: DataFrame) -> DataFrame:
    """A yield that is published every fourth week from the eighth on."""
    return panel.positioned(wk).where("pos + 1 > 6 and (pos + 1) % 4 = 0").groupBy("d").agg(F.round(F.avg("close") / 1000, 9).alias("y"))


query("wk", name="asof_yield")(lambda wk: six(panel.as_of(wk, yields(wk), "y")))


@query("wk")
def dividend_accrual(wk: DataFrame) -> DataFrame:
    exposure = portfolio.deciles(scored(wk)).groupBy("d").agg(F.sum("l").alias("net_exposure"))
    known = panel.as_of(wk, yields(wk), "y").groupBy("d").agg(F.first("y").alias("y"))
    return six(portfolio.accrual(exposure, known, WEEKS))


@query("tk")
def gate_broadcast_lagged(tk: DataFrame) -> DataFrame:
    busy = tk.groupBy(F.to_date("ts").alias("d")).agg((F.count("*") > 300).alias("open")).where(F.dayofmonth("d") % 5 != 0)
    return panel.gate_to_ticks(tk, busy)


@query("tk")
def delivery_lag_broadcast(tk: DataFrame) -> DataFrame:
    days = tk.groupBy("ticker", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    return panel.lagged_daily(days, days.where("n % 3 <> 0"), "n")


@query("wx")
def proximity_semi(wx: DataFrame) -> DataFrame:
    rows = panel.positioned(wx).withColumn("r", F.ln(F.col("close") / F.lag("close").over(by_name())))
    return panel.near_in_time(rows.where("abs(r) > 0.25"), rows.where("high / low > 1.55"), 3).select("ticker", "d")


query("wx", name="fold_range_join")(lambda wx: panel.folds(wx))


@query("wk")
def ledger_compare(wk: DataFrame) -> DataFrame:
    base = panel.densify(wk)
    one, two = (portfolio.forward_returns(portfolio.momentum(base, n), bridge=False).groupBy("d").agg(F.avg(F.when(F.col("score") > 0, F.col("fwd"))).alias("r")) for n in (5, 6))
    return six(panel.compare_ledgers(one, two.where("r is not null")))


@query("wx")
def set_operations(wx: DataFrame) -> DataFrame:
    a, b = (wx.where(F.substring("ticker", -1, 1) == x).select("d").distinct() for x in "53")
    count = lambda df: df.agg(F.count("*")).scalar()
    return wx.sparkSession.range(1).select(count(a.union(b).distinct()).alias("either"), count(a.intersect(b)).alias("both_"), count(b.exceptAll(a)).alias("only_second"))


# ---- corporate actions and gates ----
query("ri", name="corporate_actions")(lambda ri: six(corporate.action_ledger(ri)))


@query("ri")
def back_adjust(ri: DataFrame) -> DataFrame:
    rows = corporate.back_adjusted(ri)
    return rows.select("ticker", "d", r6(F.ln("adj")).alias("log_factor"), r6(F.ln("close")).alias("log_close"), r6(F.ln("volume")).alias("log_volume"))


query("ri", name="returns_preserved")(lambda ri: corporate.returns_preserved(corporate.back_adjusted(ri)).select("actions", "preserved"))
query("ri", name="action_audit")(lambda ri: six(corporate.largest_actions(corporate.action_ledger(ri))))
query("wx", name="lifecycle")(lambda wx: six(corporate.lifecycle(wx, quiet=4)))
query("wx", name="lifecycle_counts")(lambda wx: six(panel.value_counts(corporate.lifecycle(wx, quiet=4), "kind")))


@query("wk")
def isin_chain(wk: DataFrame) -> DataFrame:
    rows = wk.groupBy(F.concat(F.substring("ticker", 1, 7), F.date_format("d", "yyyyMM")).alias("isin")).agg(F.min("d").alias("first"), F.max("d").alias("last"))
    return buffers.chained_ids(rows.withColumn("last", F.date_add("last", 20 * (F.month("first") % 3))))


query("wk", name="ticker_disambiguation")(lambda wk: panel.disambiguated(wk.select(F.col("ticker").alias("entity"), F.substring("ticker", 1, 7).alias("name")).distinct()))


def reference_panel(wk: DataFrame) -> DataFrame:
    """A reference that misses a consolidation of the names that end in 1."""
    return wk.withColumn("close", F.when((F.substring("ticker", -1, 1) == "1") & (F.col("d") >= "1995-01-01"), F.col("close") * 3).otherwise(F.col("close")))


query("wk", name="reproduction")(lambda wk: six(corporate.reproduction(wk, reference_panel(wk))))


@query("wk")
def acceptance_gates(wk: DataFrame) -> DataFrame:
    register = wk.select("ticker", "d").where("ticker = 'Brand#11'")
    mask = universe.universe(wk, top=10, lookback=WEEKS, every=13, least=40)
    return six(corporate.gates(wk, reference_panel(wk), mask, register, lookback=WEEKS, every=13))


# ---- windows ----
@query("wk")
def expanding_zscore(wk: DataFrame) -> DataFrame:
    rows = wk.withColumn("r", F.ln(F.col("close") / F.lag("close").over(by_name())))
    return rows.select("ticker", "d", r6(expanding_z("r", WEEKS, by_name())).alias("z"))


@query("wx")
def rolling_sum(wx: DataFrame) -> DataFrame:
    rows = wx.withColumn("r", F.ln(F.col("close") / F.lag("close").over(by_name())))
    return rows.select("ticker", "d", r6(F.coalesce(trailing(F.sum, "r", 20), F.lit(0.0))).alias("sum20"))


@query("wk")
def sweep_bands(wk: DataFrame) -> DataFrame:
    """All swept lookbacks in one pass over the names."""
    swept = (3, 5, 10, 20)
    base = portfolio.forward_returns(panel.densify(wk), bridge=False)
    base = base.withColumns({f"s{n}": F.round(F.col("close") / F.lag("close", n).over(by_name()) - 1, 9) for n in swept})
    rows = base.unpivot(["d", "fwd"], [f"s{n}" for n in swept], "n", "score").where("score > 0").groupBy("n", "d").agg(F.avg("fwd").alias("r"))
    return six(evaluation.sweep_bands(rows.groupBy("n").agg(evaluation.sharpe("r", WEEKS).alias("sharpe"))))


# ---- state along the dates ----
def ranked(wk: DataFrame) -> DataFrame:
    rows = scored(wk).where("score is not null").select(F.lit("long").alias("strategy"), "d", "ticker", "score")
    rank = F.row_number().over(Window.partitionBy("d").orderBy(F.desc("score"), "ticker"))
    return buffers.widths(rows.withColumn("rank", rank), 0.2, 2.0)


query("wk", name="rebalance_buffer")(lambda wk: buffers.rebalance_buffer(ranked(wk)))
query("wk", name="cost_band_buffer")(lambda wk: buffers.rebalance_buffer(buffers.cost_scaled(ranked(wk).join(decision(wk), ["ticker", "d"]), 2.0, 0.2)))


@query("wk")
def cost_swap_buffer(wk: DataFrame) -> DataFrame:
    er = portfolio.expected_return(portfolio.momentum(universe.liquidity(panel.densify(wk))), trailing_of(wk), 5).withColumnRenamed("er", "value")
    return buffers.swap_if_pays(ranked(wk).join(decision(wk), ["ticker", "d"]).join(er, ["ticker", "d"], "left"))


@query("wk")
def turnover_attribution(wk: DataFrame) -> DataFrame:
    rows = ranked(wk)
    dates = rows.select("d").distinct()
    held, raw = buffers.rebalance_buffer(rows), rows.where("rank <= enter")
    return attribution.turnover_attribution(buffers.book_turnover(held, dates), buffers.book_turnover(raw, dates), regime.known_before(gate_of(wk)))


# ---- shorts, swaps, tilts ----
def _named(wk: DataFrame) -> DataFrame:
    return wk.select("d", "ticker", F.col("ticker").alias("symbol"))


query("wk", "fo", name="shortable_mask")(lambda wk, fo: shorting.shortable(_named(wk), fo))
query("wk", "fo", name="shortable_coverage")(lambda wk, fo: six(shorting.coverage_by_year(universe.universe(wk, top=10, lookback=WEEKS, every=13, least=40), shorting.shortable(_named(wk), fo))))
query("wk", name="short_book_coverage")(lambda wk: six(shorting.short_book_coverage(scored(wk).withColumn("shortable", F.substring("ticker", -1, 1).isin("2", "4")), 0.3)))


@query("wk")
def swap_rollup(wk: DataFrame) -> DataFrame:
    rows = scored(wk)
    held = portfolio.deciles(rows, 0.2).where("l > 0").select("ticker", "d")
    return six(attribution.swap_rollup(attribution.swap_pairs(held, rows, regime.known_before(gate_of(wk)), decision(wk), 5)))


def _book(wk: DataFrame) -> DataFrame:
    return portfolio.deciles(scored(wk)).withColumn("wt", F.col("l") - F.col("sh"))


query("wk", name="oracle_scales")(lambda wk: attribution.oracle_scales(attribution.short_leg_return(_book(wk).withColumn("wt", -F.col("sh")))))
query("wk", name="short_leg_value")(lambda wk: six(attribution.short_leg_value(_book(wk), WEEKS), both="both_"))


query("wk", name="short_leg_borrowable")(lambda wk: six(attribution.borrowable_short_leg(scored(wk).withColumn("shortable", F.substring("ticker", -1, 1).isin("2", "4")).where("score is not null"), WEEKS, 0.3)))


def _trends(wk: DataFrame) -> DataFrame:
    return attribution.trend_measures(scored(wk), month=4, quarter=13, long=40, year=WEEKS)


@query("wk")
def trend_orthogonality(wk: DataFrame) -> DataFrame:
    return six(attribution.orthogonality(portfolio.deciles(_trends(wk), 0.5)))


@query("wk")
def tilt_table(wk: DataFrame) -> DataFrame:
    rows = _trends(wk).withColumn("lr", F.ln(F.col("close") / F.lag("close").over(by_name())))
    rows = rows.withColumn("fwd", F.lead("lr").over(by_name()))
    return six(attribution.tilt_table(portfolio.deciles(rows, 0.5), "mom_12_1", WEEKS))


# ---- learners ----
LEARNED = feats.Horizons(momenta=(1, 5, 20), averages=(20,), vols=(20,), year=52, targets=(1, 5))


def learned(matrix: DataFrame) -> DataFrame:
    return learning.walk_forward(matrix, LEARNED.features, "fwd_1", train=104, test=26, rounds=4, rate=0.3, many=6)


@query("wk")
def walk_forward_alpha(wk: DataFrame) -> DataFrame:
    return learned(feats.feature_matrix(wk, LEARNED))


@query("wk")
def learner_ics(wk: DataFrame) -> DataFrame:
    matrix = feats.feature_matrix(wk, LEARNED)
    return learning.learner_ics(learned(matrix), matrix.select("ticker", "d", F.col("fwd_1").alias("fwd")))


@query("wx")
def hmm_filter(wx: DataFrame) -> DataFrame:
    z = regime.standardised(regime.regime_inputs(wx), WEEKS)
    return regime.hmm_filter(z, ["mkt_ret", "avg_corr", "log_vol"], train=104, test=26, rounds=60)


#: A calm and a stressed state of standardised inputs, as a fit would give them.
GIVEN = regime.States(
    (0.6, 0.4), ((0.95, 0.05), (0.1, 0.9)), ((0.1, -0.4, -0.6), (-0.2, 0.6, 0.9)),
    (((1.0, 0.1, -0.1), (0.1, 0.8, 0.2), (-0.1, 0.2, 0.7)), ((1.6, -0.2, 0.1), (-0.2, 1.1, 0.3), (0.1, 0.3, 1.2))),
)
AXES = ["mkt_ret", "avg_corr", "log_vol"]


@query("wx")
def hmm_given(wx: DataFrame) -> DataFrame:
    found = regime.state_chances(regime.standardised(regime.regime_inputs(wx), WEEKS), AXES, GIVEN)
    return found.select("d", r6(F.element_at("chances", 2)).alias("high_state"))


query("wx", name="viterbi_path")(lambda wx: regime.state_path(regime.standardised(regime.regime_inputs(wx), WEEKS), AXES, GIVEN))


ORACLES |= given_states(GIVEN, WEEKS)
ORACLES = {k: v for k, v in ORACLES.items() if k in QUERIES}
FLAGSHIP = QUERIES["long_short_returns"]
