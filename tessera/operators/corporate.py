"""Corporate actions, adjustment of prices, life of names, and the acceptance gates of a rebuilt panel."""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import by_name, median, middle
from tessera.operators.panel import calendar, near_in_time, positioned

# Ratios of splits and consolidations (1 to k, k to 1) and of bonus issues (n for m up to 12), none between 1 and 2.
SPLITS = (2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 25, 50, 100)
MOST_BONUS = 12


def ratio_grid() -> list[float]:
    whole = {round(x, 12) for k in SPLITS for x in (1 / k, float(k))}
    return sorted(whole | {round(n / (n + m), 12) for n in range(1, MOST_BONUS + 1) for m in range(1, MOST_BONUS + 1)})


@dataclass(frozen=True)
class ActionRules:
    """Thresholds of the detector."""

    # Fixed values.
    jump: float = 0.25
    snap: float = 0.10
    review: float = 0.05
    turnover_low: float = 0.2
    turnover_high: float = 20.0
    witness_bars: int = 3
    window: int = 20
    seasoned: int = 5
    gap_days: int = 7
    floor: float = 20.0


def snapped(ratio: Column, tolerance: float) -> Column:
    """The nearest ratio of the grid in logarithms, the lower one on a tie; null if the value is further from it than the tolerance.

    Logarithms are cut into slots narrower than any step of the grid, so a slot has one ratio at most: a row looks up its slot in an array
    literal and is compared with that ratio and those beside it, not with all.
    """
    grid = ratio_grid()
    width = 0.9 * min(math.log(b / a) for a, b in zip(grid, grid[1:]))
    low = math.log(grid[0]) / width
    # of each slot the last ratio before it, a little earlier than its edge, which may be computed otherwise elsewhere
    before = [max(0, bisect_right(grid, math.exp((low + k - 0.01) * width)) - 1) for k in range(math.ceil(math.log(grid[-1]) / width - low) + 1)]
    slot = F.greatest(F.lit(0), F.least(F.lit(len(before) - 1), F.floor(F.ln(ratio) / width - low))).cast("int")
    first, ratios = F.get(_literal(before, "int"), slot), _literal(grid, "double")
    candidates = [F.get(ratios, first + k) for k in range(3)]
    near = F.least(*[F.when(g.isNotNull(), F.struct(F.round(F.abs(F.ln(ratio / g)), 9).alias("far"), g.alias("g"))) for g in candidates])["g"]
    return F.get(F.transform(F.array(near), lambda x: F.when(F.abs(ratio / x - 1) <= tolerance, x)), F.lit(0))  # near is found once


def _literal(values: list, kind: str) -> Column:
    """An array of constants from one string, which the optimizer folds."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def detect_actions(bars: DataFrame, rules: ActionRules = ActionRules()) -> DataFrame:
    """bars (ticker, d, prices, isin if known) with ratio, factor, turnover_ratio, witness: factor is null but on the dates of actions.

    A seasoned name that traded shortly before, at a price above the floor, jumps to near a ratio of the grid; and either its
    turnover is as before, or its ISIN changes within a few bars. All windows are over the name's rows: one exchange, one sort.
    """
    w = by_name()
    rows = bars.withColumns({
        "before": F.lag("close").over(w), "gap": F.date_diff("d", F.lag("d").over(w)), "prior": F.row_number().over(w) - 1,
        "usual": F.sort_array(F.collect_list("turnover").over(w.rowsBetween(-rules.window, -1))),
    })
    rows = rows.withColumn("usual", F.when(F.size("usual") >= rules.seasoned, middle("usual")))
    if "isin" in bars.columns:
        rows = rows.withColumn("reissued", F.coalesce(F.col("isin") != F.lag("isin").over(w), F.lit(False)))
        rows = rows.withColumn("witnessed", F.max("reissued").over(w.rowsBetween(-rules.witness_bars, rules.witness_bars)))
    else:
        rows = rows.withColumn("witnessed", F.lit(False))
    rows = rows.withColumn("ratio", F.round(F.col("close") / F.when(F.col("before") > 0, F.col("before")), 9))
    likely = (F.col("prior") >= rules.seasoned) & (F.col("before") >= rules.floor) & (F.col("gap") <= rules.gap_days) & (F.abs(F.col("ratio") - 1) > rules.jump)
    share = F.col("turnover") / F.when(F.col("usual") > 0, F.col("usual"))
    rows = rows.withColumns({"turnover_ratio": share, "calm": F.coalesce(share.between(rules.turnover_low, rules.turnover_high), F.lit(True))})
    rows = rows.withColumn("factor", F.when(likely & (F.col("calm") | F.col("witnessed")), snapped(F.col("ratio"), rules.snap)))
    names = F.when(F.col("witnessed") & ~F.col("calm"), "isin_reissue").when(F.col("witnessed"), "isin_reissue+turnover").otherwise("turnover")
    return rows.withColumn("witness", F.when(F.col("factor").isNotNull(), names)).drop("before", "gap", "prior", "usual", "witnessed", "reissued", "calm")


def action_ledger(bars: DataFrame, rules: ActionRules = ActionRules()) -> DataFrame:
    """The actions, with what is left of the jump as the date's own return, and a mark where that is large."""
    found = detect_actions(bars, rules).where("factor is not null")
    left = F.col("ratio") / F.col("factor") - 1
    return found.select("ticker", "d", "ratio", "factor", "turnover_ratio", "witness", left.alias("ex_ret"), (F.abs(F.round(left, 9)) > rules.review).alias("review"))


def back_adjusted(bars: DataFrame, rules: ActionRules = ActionRules()) -> DataFrame:
    """ticker, d, adj (product of the factors of all later actions), close and volume as adjusted, raw_close: the detector's windows and
    one more over the same rows."""
    later = by_name().rowsBetween(1, Window.unboundedFollowing)
    rows = detect_actions(bars, rules).withColumn("adj", F.coalesce(F.product(F.coalesce("factor", F.lit(1.0))).over(later), F.lit(1.0)))
    return rows.select("ticker", "d", "adj", (F.col("close") * F.col("adj")).alias("close"), (F.col("volume") / F.col("adj")).alias("volume"), F.col("close").alias("raw_close"), "factor")


def returns_preserved(adjusted: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row: dates of actions, the largest relative change of a return on any other date, and whether it is within the tolerance."""
    w = by_name()
    rows = adjusted.withColumns({"a": F.col("close") / F.lag("close").over(w), "b": F.col("raw_close") / F.lag("raw_close").over(w)})
    worst = F.max(F.when(F.col("factor").isNull(), F.abs(F.col("a") / F.col("b") - 1)))
    out = rows.agg(F.count("factor").alias("actions"), F.coalesce(worst, F.lit(0.0)).alias("worst"))
    return out.withColumn("preserved", F.col("worst") < tolerance)


def largest_actions(ledger: DataFrame, most: int = 20) -> DataFrame:
    """The actions of the largest factors: a report of the `most` first."""
    size = F.round(F.abs(F.ln("factor")), 9)
    return ledger.withColumn("size", size).orderBy(F.desc("size"), "d", "ticker").limit(most).select("ticker", "d", "factor", "ratio", "review")


def lifecycle(bars: DataFrame, *, quiet: int = 20, back: int = 20, loss: float = -0.30) -> DataFrame:
    """Per name: first, last, n, exit_ret, suspended, kind, terminal. Gone if its last bar is `quiet` positions before the calendar's end:
    acquired after a rise over its last `back` bars, else delisted; suspended where it lacks `quiet` positions between its ends."""
    rows = bars.join(calendar(bars), "d")
    from_end = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("d")))
    n = F.count("*").over(Window.partitionBy("ticker"))
    rows = rows.withColumns({"from_end": from_end, "of": n})
    base = F.max(F.when(F.col("from_end") == F.least(F.lit(back + 1), F.col("of")), F.col("close")))
    out = rows.groupBy("ticker").agg(
        F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("n"), (F.max("pos") - F.min("pos") + 1 - F.count("*") >= quiet).alias("suspended"),
        (F.max(F.when(F.col("from_end") == 1, F.col("close"))) / F.when(base > 0, base) - 1).alias("exit_ret"), (F.max("pos") > F.max(F.col("n")) - 1 - quiet).alias("live"),
    )
    rose = F.round("exit_ret", 9) > 0
    kind = F.when(F.col("live"), "live").when(rose, "acquired").otherwise("delisted")
    return out.select("ticker", "first", "last", "n", "exit_ret", "suspended", kind.alias("kind"), F.when(F.col("live"), None).when(rose, 0.0).otherwise(loss).alias("terminal"))


def returns_of(bars: DataFrame) -> DataFrame:
    """ticker, d, ret, gap (days since the bar before)."""
    w = by_name()
    return bars.select("ticker", "d", (F.col("close") / F.lag("close").over(w) - 1).alias("ret"), F.date_diff("d", F.lag("d").over(w)).alias("gap"))


def reproduction(ours: DataFrame, reference: DataFrame, *, material: float = 0.01, impossible: float = 0.5, step: float = 0.02, drift: float = 0.02, tick: float = 0.05, least: int = 100, ticks: float = 3.0, floor: float = 1e-4) -> DataFrame:
    """Per name of both panels: bars compared, correlation of returns, median and largest difference, how many are material, how often the
    ratio of levels steps, whether the reference disqualifies itself, and whether ours passes."""
    w = by_name()
    a = ours.select("ticker", "d", "close").join(reference.select("ticker", "d", F.col("close").alias("ref")), ["ticker", "d"])
    a = a.withColumns({"r": F.col("close") / F.lag("close").over(w) - 1, "q": F.col("ref") / F.lag("ref").over(w) - 1})
    a = a.withColumns({"far": F.abs(F.col("r") - F.col("q")), "level": F.abs((F.col("ref") / F.col("close")) / (F.lag("ref").over(w) / F.lag("close").over(w)) - 1)})
    big = F.round("far", 9) > material
    out = a.groupBy("ticker").agg(
        F.count("far").alias("bars"), F.corr("r", "q").alias("corr"), median("far").alias("median_diff"), F.max("far").alias("largest_diff"), F.count_if(big).alias("n_material"),
        F.coalesce(F.bool_or(big & (F.abs("r") > impossible)), F.lit(False)).alias("ours_impossible"), F.coalesce(F.bool_or(big & (F.abs("q") > impossible)), F.lit(False)).alias("ref_impossible"),
        F.avg((F.round("level", 9) > step).cast("double")).alias("drift"), median("close").alias("price"),
    )
    out = out.withColumn("disqualified", F.col("ref_impossible") | (F.col("drift") > drift) | (F.col("bars") < least))
    return out.withColumn("passes", ~F.col("disqualified") & (F.col("median_diff") < F.greatest(F.lit(floor), ticks * tick / F.col("price")))).drop("price")


def unexplained(bars: DataFrame, mask: DataFrame, actions: DataFrame, register: DataFrame, *, impossible: float = 0.5, gap: int = 7, within: int = 3) -> DataFrame:
    """Impossible returns of members on consecutive bars that neither an action near them nor the audited register (ticker, d) explains."""
    events = positioned(returns_of(bars)).where((F.abs("ret") > impossible) & (F.col("gap") <= gap)).join(mask.select("ticker", "d"), ["ticker", "d"], "left_semi")
    marks = actions.select("ticker", "d").join(calendar(bars).select("d", "pos"), "d").select("ticker", "pos")
    near = near_in_time(events, marks, within).select("ticker", "d")
    return events.join(near, ["ticker", "d"], "left_anti").join(register.select("ticker", "d"), ["ticker", "d"], "left_anti").select("ticker", "d", "ret")


def gates(
    bars: DataFrame, reference: DataFrame, mask: DataFrame, register: DataFrame, *, lookback: int, every: int, rules: ActionRules = ActionRules(), share: float = 0.95, disagree: float = 0.001,
    impossible: float = 0.5, extreme: float = 0.4,
) -> DataFrame:
    """The six acceptance gates as rows (gate, metric, value, passes); passes is null where a metric is only reported.

    1 reproduces a reference panel, 2 counts the names that left, 3 the actions, 4 the extreme returns left after adjustment, 5 checks that
    adjustment keeps returns and that membership changes on selection dates after a full lookback only, 6 that every impossible return
    of a member is explained.
    """
    number = lambda c: c.cast("double")
    adjusted = back_adjusted(bars, rules)
    rep = reproduction(adjusted, reference)
    good = rep.where("not disqualified")
    one = good.agg(F.coalesce(F.avg(number(F.col("passes"))), F.lit(0.0)).alias("a"), number(F.count_if("ours_impossible")).alias("b"), (F.coalesce(F.sum("n_material"), F.lit(0)) / F.greatest(F.lit(1), F.coalesce(F.sum("bars"), F.lit(0)))).alias("c"))
    life, ledger = lifecycle(bars), action_ledger(bars, rules)
    row = lambda gate, metric, value, passes: F.struct(F.lit(gate).alias("gate"), F.lit(metric).alias("metric"), number(value).alias("value"), passes.alias("passes"))
    none = F.lit(None).cast("boolean")
    explode = lambda df, *rows: df.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    parts = [explode(one, row(1, "share_of_names", F.col("a"), F.round("a", 9) >= share), row(1, "ours_impossible", F.col("b"), F.col("b") == 0), row(1, "disagreement", F.col("c"), F.round("c", 9) <= disagree))]
    counts = life.agg(F.count("*").alias("all"), F.count_if(F.col("kind") != "live").alias("gone"), F.count_if("suspended").alias("suspended"))
    parts.append(explode(counts, row(2, "names", F.col("all"), none), row(2, "left", F.col("gone"), none), row(2, "suspended", F.col("suspended"), none)))
    acts = ledger.agg(F.count("*").alias("n"), F.count_if("review").alias("review"))
    parts.append(explode(acts, row(3, "actions", F.col("n"), none), row(3, "to_review", F.col("review"), none)))
    wild = returns_of(adjusted.select("ticker", "d", "close")).agg(F.count("ret").alias("n"), F.count_if(F.abs(F.round("ret", 9)) > extreme).alias("wild"))
    parts.append(explode(wild, row(4, "returns", F.col("n"), none), row(4, "extreme", F.col("wild"), none)))
    kept = returns_preserved(adjusted)
    parts.append(explode(kept, row(5, "returns_changed_by", F.round("worst", 6), F.col("preserved"))))
    member = mask.join(calendar(bars), "d").withColumn("_was", F.lag("pos").over(Window.partitionBy("ticker").orderBy("pos")))
    off = member.agg(
        F.count_if(F.col("pos") < lookback).alias("early"), F.count_if(~F.coalesce(F.col("_was") == F.col("pos") - 1, F.lit(False)) & ((F.col("pos") - lookback) % every != 0)).alias("off"))
    parts.append(explode(off, row(5, "members_too_early", F.col("early"), F.col("early") == 0), row(5, "changes_off_selection", F.col("off"), F.col("off") == 0)))
    left = unexplained(adjusted.select("ticker", "d", "close"), mask, ledger, register, impossible=impossible).agg(F.count("*").alias("n"))
    parts.append(explode(left, row(6, "unexplained", F.col("n"), F.col("n") == 0)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
