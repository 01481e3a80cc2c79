"""From scores to books, costs and returns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import bucket, by_name, first_rank, median
from tessera.operators.panel import next_known
from tessera.operators.quantiles import exact_quantiles

STYLES = ("long_only", "long_short", "dynamic_tilt")
_BORROWABLE = "_slb"


@dataclass(frozen=True)
class Costs:
    """Cost model. All rates in basis points."""

    # Statutory items of a trade, borrow fees and limits.
    brokerage: float = 3.0
    transaction_tax: float = 10.0
    exchange: float = 0.30
    regulator: float = 0.01
    stamp_buy: float = 1.5
    service_tax_pct: float = 18.0
    impact: float = 0.5
    max_participation: float = 0.10
    borrow_tiers: tuple[float, ...] = (25.0, 50.0, 100.0, 200.0)
    calm: tuple[float, float] = (1.3, 0.3)
    panic: tuple[float, float] = (1.0, 1.0)
    aum: float = 1e7
    bars_per_year: float = 252.0

    def one_way(self) -> float:
        """Statutory cost of a side: mean of buying and selling, service tax on the fees."""
        fees = self.brokerage + self.exchange + self.regulator
        return fees * (1 + self.service_tax_pct / 100) + self.transaction_tax + self.stamp_buy / 2

    def impact_bps(self, sigma: Column, participation: Column) -> Column:
        """Square-root law; 0 where either isn't positive."""
        return F.when((sigma > 0) & (participation > 0), 1e4 * self.impact * sigma * F.sqrt(participation)).otherwise(F.lit(0.0))


def style_of(name: str) -> tuple[str, bool]:
    """A style's name without its suffix, and whether the suffix restricts the short leg to borrowable names."""
    base = name.removesuffix(_BORROWABLE)
    if base not in STYLES:
        raise ValueError(f"unknown style {name!r}; one of {STYLES}, with {_BORROWABLE} or without")
    return base, base != name


def momentum(panel: DataFrame, n: int = 5) -> DataFrame:
    """A dense panel with score: simple return over n dates, to nine digits."""
    return panel.withColumn("score", F.round(F.col("close") / F.lag("close", n).over(by_name()) - 1, 9))


def forward_returns(panel: DataFrame, *, bridge: bool = True) -> DataFrame:
    """A dense panel with fwd: return to the next date, or, bridging halts, to the next quote that there is."""
    nxt = next_known("close") if bridge else F.lead("close").over(by_name())
    return panel.withColumn("fwd", nxt / F.col("close") - 1)


def with_exits(panel: DataFrame, exits: DataFrame) -> DataFrame:
    """fwd of a name's last quote becomes its terminal return (exits: ticker, terminal), if the quote is before the calendar's end."""
    quoted = Window.partitionBy("ticker")
    last = F.max(F.when(F.col("close").isNotNull(), F.col("pos"))).over(quoted)
    end = F.max("pos").over(quoted)  # a dense panel goes to the end of the calendar
    rows = panel.withColumns({"_last": last, "_end": end}).join(exits.select("ticker", "terminal"), "ticker", "left")
    gone = (F.col("pos") == F.col("_last")) & (F.col("_last") < F.col("_end")) & F.col("terminal").isNotNull()
    return rows.withColumn("fwd", F.when(gone, F.col("terminal")).otherwise(F.col("fwd"))).drop("_last", "_end", "terminal")


def deciles(scored: DataFrame, share: float = 0.1, *, short_score: str = "score") -> DataFrame:
    """Scored rows with hi and lo (ranks from either end), k (names of a leg, one at least), and l and sh: equal weights of the best k and
    the worst k. short_score is null for names that can't be shorted; k counts all scored ones."""
    rows = scored.where("score is not null")
    k = F.greatest(F.lit(1), F.floor(F.round(F.count("*").over(Window.partitionBy("d")) * share, 9)).cast("int"))
    low = F.row_number().over(Window.partitionBy("d").orderBy(F.asc_nulls_last(short_score), "ticker"))
    rows = rows.withColumns({"hi": first_rank("score", "d", descending=True), "lo": F.when(F.col(short_score).isNotNull(), low), "k": k})
    shorts = F.count_if(F.col("lo") <= F.col("k")).over(Window.partitionBy("d"))
    return rows.withColumns({
        "l": F.when(F.col("hi") <= F.col("k"), 1.0 / F.col("k")).otherwise(0.0), "sh": F.when(F.col("lo") <= F.col("k"), F.lit(1.0) / shorts).otherwise(0.0)
    })


def fixed_legs(scored: DataFrame, n: int) -> DataFrame:
    """ticker, d, side of the n best and the n worst of each date; of few names one may be both, with side 0."""
    rows = scored.where("score is not null").withColumns({"hi": first_rank("score", "d", descending=True), "lo": first_rank("score", "d", descending=False)})
    side = (F.col("hi") <= n).cast("int") - (F.col("lo") <= n).cast("int")
    return rows.where((F.col("hi") <= n) | (F.col("lo") <= n)).select("ticker", "d", side.alias("side"))


def _filling(weight: str, cap: str) -> Column:
    """Of each name of a leg its cap, the factor of the others if all names before it in order of cap over weight are at theirs, and
    whether all are."""
    held = F.col(weight) > 0
    ceiling = F.when(held, F.coalesce(F.col(cap), F.lit(1e300)))
    order = Window.partitionBy("d").orderBy(F.asc_nulls_last(ceiling / F.col(weight)), "ticker")
    whole, date = F.sum(F.when(held, F.col(weight))), Window.partitionBy("d")
    before = F.coalesce(F.sum(ceiling).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum(F.when(held, F.col(weight))).over(order.rowsBetween(0, Window.unboundedFollowing))
    return F.struct(ceiling.alias("cap"), ((whole.over(date) - before) / after).alias("k"), (F.sum(F.least(ceiling, F.lit(1e6))).over(date) <= whole.over(date)).alias("full"))


def cap_leg(legs: DataFrame, weight: str, cap: str) -> DataFrame:
    """legs with the weight under caps: min(cap, k * weight) with k such that the leg adds up to what it did; where the caps are too small
    all are at theirs; a null cap is none. In closed form: names are capped in order of cap over weight, up to where the rest fits."""
    rows = legs.withColumn("_c", _filling(weight, cap))
    fits = F.max(F.when(F.col("_c.k") * F.col(weight) <= F.col("_c.cap") + 1e-12, F.col("_c.k"))).over(Window.partitionBy("d"))  # the first in order
    value = F.when(F.col("_c.full") | fits.isNull(), F.col("_c.cap")).otherwise(F.least(F.col("_c.cap"), fits * F.col(weight)))
    return rows.withColumn(weight, F.when(F.col(weight) > 0, value).otherwise(F.lit(0.0))).drop("_c")


def styled(legs: DataFrame, style: str, gate: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """legs (l, sh) with wt by style; panic is known from the date before. long_only and long_short hold cash in panic; dynamic_tilt holds
    1.3 of the best less 0.3 of the worst, one to one in panic. A date that the gate lacks is calm."""
    base, _ = style_of(style)
    panic = F.coalesce("panic", F.lit(False))
    tilt = F.when(panic, costs.panic[0] * F.col("l") - costs.panic[1] * F.col("sh")).otherwise(costs.calm[0] * F.col("l") - costs.calm[1] * F.col("sh"))
    wt = {"long_only": F.when(panic, 0.0).otherwise(F.col("l")), "long_short": F.when(panic, 0.0).otherwise(F.col("l") - F.col("sh")), "dynamic_tilt": tilt}[base]
    return legs.join(gate, "d", "left").withColumn("wt", wt).withColumn("panic", panic)


def traded(book: DataFrame, dates: DataFrame) -> DataFrame:
    """Books (ticker, d, wt and more; a row for each name of a scored date) with dw, the change of weight from the scored date before. The
    first date buys its whole book; a name that leaves the scored ones is sold on the next scored date, by a row of its own with
    nulls. dates: the scored dates (d)."""
    along = Window.orderBy("d")
    axis = dates.select("d").distinct().select("d", F.row_number().over(along).alias("_t"), F.lead("d").over(along).alias("_after"))
    w = Window.partitionBy("ticker").orderBy("_t")
    rest = [c for c in book.columns if c not in ("ticker", "d", "wt")]
    rows = book.join(axis, "d").withColumns({"_before": F.lag("wt").over(w), "_was": F.lag("_t").over(w), "_next": F.lead("_t").over(w)})
    change = F.col("wt") - F.when(F.col("_was") == F.col("_t") - 1, F.col("_before")).otherwise(0.0)
    stays = F.coalesce(F.col("_next") == F.col("_t") + 1, F.lit(False))
    own = F.struct("d", F.col("wt").cast("double").alias("wt"), change.alias("dw"), *rest)
    sale = F.struct(F.col("_after").alias("d"), F.lit(0.0).alias("wt"), (-F.col("wt")).alias("dw"), *[F.lit(None).cast(book.schema[c].dataType).alias(c) for c in rest])
    both = F.when((F.col("wt") != 0) & F.col("_after").isNotNull() & ~stays, F.array(own, sale)).otherwise(F.array(own))
    return rows.select("ticker", F.explode(both).alias("_x")).select("ticker", "_x.*")


def gap_filled(rows: DataFrame, columns: list[str], *, whole: bool = True) -> DataFrame:
    """Missing cost inputs take the date's median over the rows, then, if whole, the median of all."""
    date = Window.partitionBy("d")
    if not whole:
        return rows.withColumns({c: F.coalesce(c, median(c).over(date)) for c in columns})
    all_ = {x["name"]: x["value"] for x in exact_quantiles(rows, {c: F.col(c) for c in columns}, [0.5]).collect()}  # a number for each column
    return rows.withColumns({c: F.coalesce(F.col(c), median(c).over(date), F.lit(all_.get(c)).cast("double")) for c in columns})


def name_costs(rows: DataFrame, costs: Costs, *, amount: str = "dw", spread: str = "cs") -> DataFrame:
    """rows with part (participation of the traded amount) and bps (statutory, half-spread and impact)."""
    part = F.coalesce(F.abs(amount) * costs.aum / F.when(F.col("adv") > 0, F.col("adv")), F.lit(0.0))
    return rows.withColumn("part", part).withColumn("bps", F.lit(costs.one_way()) + F.col(spread) + costs.impact_bps(F.col("sigma"), F.col("part")))


def with_fees(rows: DataFrame, costs: Costs) -> DataFrame:
    """rows with tier, the quarter of adv among the names held short on the date (1: the most liquid), and fee, a year's; null for others."""
    rows = rows.withColumns({"_short": F.col("wt") < 0, "_adv": F.round("adv", 6)})
    tier = F.when(F.col("_short"), bucket("_adv", len(costs.borrow_tiers), "d", "_short", descending=True))
    fee = F.get(F.array(*[F.lit(x) for x in costs.borrow_tiers]), F.col("tier").cast("int") - 1)
    return rows.withColumn("tier", tier).withColumn("fee", fee).drop("_short", "_adv")


def execute(panel: DataFrame, style: str, gate: DataFrame, *, share: float = 0.1, costs: Costs = Costs(), capped_at: float | None = None) -> DataFrame:
    """d, gross, turnover, trade_cost, borrow_cost, net, net_exposure, short_gross of a style.

    panel: rows with ticker, d, score, fwd, adv, sigma, cs, and shortable for the styles that need it; it is read for the books, the median
    of all gaps and the dates. One exchange by date gives books, one by ticker their changes, one by date costs and sums. Cash earns
    0; a date of which no held name has a next price is null.
    """
    _, restricted = style_of(style)
    scored = panel.where("score is not null").select("ticker", "d", "score", "fwd", "adv", "sigma", "cs", *(["shortable"] if restricted else []))
    scored = gap_filled(scored, ["adv", "sigma", "cs"])
    if restricted:
        scored = scored.withColumn("short_score", F.when(F.coalesce("shortable", F.lit(False)), F.col("score")))
    legs = deciles(scored, share, short_score="short_score" if restricted else "score")
    if capped_at is not None:
        legs = legs.withColumn("ceiling", capped_at * F.col("adv") / costs.aum)
        legs = cap_leg(cap_leg(legs, "l", "ceiling"), "sh", "ceiling")
    book = styled(legs, style, gate, costs)
    moves = traded(book.select("ticker", "d", "wt", "fwd", "adv", "sigma", "cs"), scored)
    # names sold after they left the scored ones have no inputs of their own
    priced = name_costs(with_fees(gap_filled(moves, ["adv", "sigma", "cs"], whole=False), costs), costs)
    fee = F.coalesce("fee", F.lit(0.0))
    held = F.col("wt") != 0
    out = priced.groupBy("d").agg(
        F.when(F.count_if(held) == 0, F.lit(0.0)).otherwise(F.sum(F.when(held, F.col("wt") * F.col("fwd")))).alias("gross"), F.sum(F.abs("dw")).alias("turnover"),
        (F.sum(F.abs("dw") * F.col("bps")) / 1e4).alias("trade_cost"), (F.sum(F.when(F.col("wt") < 0, -F.col("wt") * fee).otherwise(0.0)) / 1e4 / costs.bars_per_year).alias("borrow_cost"),
        F.sum("wt").alias("net_exposure"), F.sum(F.when(F.col("wt") < 0, -F.col("wt")).otherwise(0.0)).alias("short_gross"),
    )
    return out.withColumn("net", F.col("gross") - F.col("trade_cost") - F.col("borrow_cost"))


def implicit_exits(panel: DataFrame, style: str, gate: DataFrame, share: float = 0.1) -> DataFrame:
    """Names held without a next price on a date before the last: each would leave the book at no gain or loss."""
    book = styled(deciles(panel, share), style, gate)
    return book.where((F.col("wt") != 0) & F.col("fwd").isNull() & (F.col("d") < book.agg(F.max("d")).scalar())).select("ticker", "d", "wt")


def decision_costs(panel: DataFrame, costs: Costs = Costs(), share: float = 0.1) -> DataFrame:
    """ticker, d, cost: one way, of trading a whole position of the date's book in a name."""
    rows = gap_filled(panel.where("score is not null").select("ticker", "d", "adv", "sigma", "cs"), ["adv", "sigma", "cs"])
    k = F.greatest(F.lit(1), F.floor(F.round(F.count("*").over(Window.partitionBy("d")) * share, 9)))
    return name_costs(rows.withColumn("dw", 1.0 / k), costs).select("ticker", "d", F.col("bps").alias("cost"))


def expected_return(panel: DataFrame, ic: DataFrame, horizon: int) -> DataFrame:
    """ticker, d, er: the trailing IC (not below 0; d, trailing) times sigma, the root of the horizon and the z-score of the score within
    the date, to twelve digits."""
    date = Window.partitionBy("d")
    sd = F.stddev_samp("score").over(date)
    z = (F.col("score") - F.avg("score").over(date)) / F.when(sd > 0, sd)
    rows = panel.where("score is not null").withColumn("z", z).join(ic, "d")
    return rows.select("ticker", "d", F.round(F.greatest(F.when(F.col("trailing").isNotNull(), 0.0), F.col("trailing")) * F.col("sigma") * horizon**0.5 * F.col("z"), 12).alias("er"))


def accrual(exposure: DataFrame, yields: DataFrame, bars_per_year: float = 252.0) -> DataFrame:
    """d, income of a book (d, net_exposure) from a yearly yield in percent (d, y), known as of each date."""
    rows = exposure.join(yields, "d")
    return rows.select("d", (F.col("net_exposure") * F.col("y") / 100 / bars_per_year).alias("income"))

