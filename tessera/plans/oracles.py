"""SQL for an independent engine, by query: each is written from the meaning of the operator, not from its DataFrame code."""

from __future__ import annotations

# ---- bars ----
_PX = "l_extendedprice / l_quantity"
_KEY = "(l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_AGG = f"""arg_min({_PX}, {_KEY}) as open, max({_PX}) as high, min({_PX}) as low, arg_max({_PX}, {_KEY}) as close,
  sum(l_quantity) as volume, sum(l_extendedprice) as turnover"""
DY = f"dy as (select l_suppkey as ticker, cast(l_shipdate as date) as d, {_AGG} from lineitem group by all)"
WK = f"wk as (select p_brand as ticker, cast(date_trunc('week', l_shipdate) as date) as d, {_AGG} from lineitem join part on p_partkey = l_partkey group by all)"
WX = f"""{WK}, wx as (select * from wk where not (ticker like '%5' and d >= date '1997-06-01')
  and not (ticker like '%3' and d between date '1996-03-01' and date '1996-05-31'))"""
RI = f"{DY}, ri as (select *, 'INE' || lpad(cast(ticker as varchar), 5, '0') || year(d) as isin from dy)"
TK = "tk as (select event_type as ticker, ts, value as px, event_id from events)"
FO = """fo as (select distinct cast(date_trunc('week', l_shipdate) as date) as d, p_brand as symbol from lineitem join part on p_partkey = l_partkey
  where l_returnflag = 'R' and week(date_trunc('week', l_shipdate)) % 4 <> 0)"""


def r6(x: str) -> str:
    return f"round({x}, 6) + 0e0"


def full(agg: str, value: str, n: int, least: int | None = None, lag: int = 0) -> str:
    """agg of the value over n rows of a name that end `lag` rows before, if `least` of them (all) have one."""
    w = f"over (partition by ticker order by d rows between {n - 1 + lag} preceding and {lag} preceding)"
    return f"case when count({value}) {w} >= {n if least is None else least} then {agg.replace('@', value)} {w} end"


def mean_rank(value: str, by: str, desc: bool = False) -> str:
    return f"(rank() over (partition by {by} order by {value}{' desc' if desc else ''}) + (count(*) over (partition by {by}, {value}) - 1) / 2e0)"


def bucket(value: str, k: int, by: str) -> str:
    """1 holds the largest."""
    return f"cast(least({k}, greatest(1, ceil({mean_rank(value, by, True)} / count(*) over (partition by {by}) * {k} - 1e-9))) as bigint)"


def unit(value: str) -> str:
    n = "count(*) over (partition by d)"
    return f"case when {n} = 1 then 0e0 else 2 * ({mean_rank(value, 'd')} - 1) / ({n} - 1) - 1 end"


def grid(bars: str) -> str:
    """g: a row per name and date of the calendar from the name's first bar on."""
    return f"""cal as (select d, row_number() over (order by d) - 1 as pos, count(*) over () as n from (select distinct d from {bars})),
names as (select ticker, min(d) as lo from {bars} group by ticker),
g as (select names.ticker, cal.d, cal.pos, b.open, b.high, b.low, b.close, b.volume, b.turnover
  from names join cal on cal.d >= names.lo left join {bars} b on b.ticker = names.ticker and b.d = cal.d)"""


LIQ = f"""lq0 as (select *, last_value(close ignore nulls) over (partition by ticker order by d) as known from g),
lq1 as (select *, known / lag(known) over (partition by ticker order by d) - 1 as ret, case when turnover > 0 then turnover end as pos_turn from lq0),
lq as (select ticker, d, {full('quantile_cont(@, 0.5)', 'pos_turn', 21, 10, 1)} as adv, {full('stddev_samp(@)', 'ret', 21, None, 1)} as sigma from lq1)"""
_K = "(3 - 2 * sqrt(2e0))"
SPR = f"""sp0 as (select ticker, d, turnover, ln(high / low) as hl, lag(ln(high / low)) over w as hl1,
  case when high is not null and lag(high) over w is not null then ln(greatest(high, lag(high) over w) / least(low, lag(low) over w)) end as wide,
  ln(lag(close) over w) as c1, (ln(high) + ln(low)) / 2 as eta, lag((ln(high) + ln(low)) / 2) over w as eta1 from g window w as (partition by ticker order by d)),
sp1 as (select ticker, d, turnover, hl ** 2 + hl1 ** 2 as b, wide ** 2 as y, (c1 - eta1) * (c1 - eta) as p from sp0),
sp2 as (select ticker, d, turnover, {full('avg(@)', 'b', 63, 30, 1)} as b, {full('avg(@)', 'y', 63, 30, 1)} as y, {full('avg(@)', 'p', 63, 30, 1)} as p from sp1),
sp3 as (select *, case when b is not null and y is not null then greatest(0e0, (sqrt(2 * b) - sqrt(b)) / {_K} - sqrt(y / {_K})) end as a from sp2),
sp as (select ticker, d, turnover, 1e4 * (exp(a) - 1) / (1 + exp(a)) as cs, case when p is not null then 1e4 * sqrt(greatest(0e0, 4 * p)) / 2 end as ar from sp3)"""


def scores(n: int = 5) -> str:
    return f"""s as (select ticker, d, pos, close, turnover, round(close / lag(close, {n}) over w - 1, 9) as score, lead(close) over w / close - 1 as fwd
  from g window w as (partition by ticker order by d))"""


DEC = """dk as (select *, greatest(1, floor(round(count(*) over (partition by d) * 0.1, 9))) as k, row_number() over (partition by d order by score desc, ticker) as hi,
  row_number() over (partition by d order by score, ticker) as lo from s where score is not null),
dw as (select *, case when hi <= k then 1e0 / k else 0e0 end as l, case when lo <= k then 1e0 / k else 0e0 end as sh from dk)"""
MOM = f"{WK}, {grid('wk')}, {scores()}"


def regime(bars: str) -> str:
    """ri0: mkt_ret, log_vol, avg_corr by date, by all pairs of names."""
    return f"""mk as (select d, avg(ln(close)) as lc from {bars} group by d), mr as (select d, lc - lag(lc) over (order by d) as mkt_ret from mk),
mv as (select *, case when count(mkt_ret) over w = 20 then ln(nullif(stddev_samp(mkt_ret) over w, 0)) end as log_vol from mr window w as (order by d rows between 19 preceding and current row)),
rr as (select ticker, d, pos, ln(close / lag(close) over (partition by ticker order by d)) as r from g),
rw as (select e.pos as t, e.d as td, rr.ticker, rr.pos, rr.r from cal e join rr on rr.pos between e.pos - 19 and e.pos where rr.r is not null),
ok as (select t, ticker from rw group by t, ticker having count(*) = 20),
pc as (select a.t, a.td, corr(a.r, b.r) as c from rw a join rw b on b.t = a.t and b.pos = a.pos and b.ticker > a.ticker
  where (a.t, a.ticker) in (select t, ticker from ok) and (b.t, b.ticker) in (select t, ticker from ok) group by a.t, a.td, a.ticker, b.ticker),
pm as (select td as d, avg(case when isnan(c) then 0e0 else coalesce(c, 0e0) end) as avg_corr from pc group by td),
ri0 as (select coalesce(mv.d, pm.d) as d, mkt_ret, log_vol, avg_corr from mv full join pm on pm.d = mv.d)"""


def _z(c: str, least: int) -> str:
    w = "over (order by d rows between unbounded preceding and current row)"
    return f"case when count({c}) {w} >= {least} then ({c} - avg({c}) {w}) / nullif(stddev_samp({c}) {w}, 0) end"


GATE = f"""zz as (select d, {_z('mkt_ret', 52)} as a, {_z('log_vol', 52)} as b, {_z('avg_corr', 52)} as c from ri0),
st as (select d, (b + c) / 2 as stress from zz where a is not null and b is not null and c is not null),
sq as (select *, case when count(stress) over w >= 52 then quantile_cont(stress, 0.85) over w end as edge from st window w as (order by d rows between unbounded preceding and current row)),
gt as (select d, stress, coalesce(round(stress, 9) > round(edge, 9), false) as panic from sq),
gate as (select d, coalesce(lag(panic) over (order by d), false) as panic from gt)"""


def lifecycle(bars: str, quiet: int, back: int = 20) -> str:
    return f"""lf0 as (select b.ticker, b.d, b.close, c.pos, c.n as dates, row_number() over (partition by b.ticker order by b.d desc) as back, count(*) over (partition by b.ticker) as n
  from {bars} b join (select d, row_number() over (order by d) - 1 as pos, count(*) over () as n from (select distinct d from {bars})) c using (d)),
lf1 as (select ticker, min(d) as first, max(d) as last, count(*) as n, max(pos) - min(pos) + 1 as span, max(pos) as pos, max(dates) as dates,
  max(close) filter (where back = 1) / max(close) filter (where back = least({back + 1}, n)) - 1 as exit_ret from lf0 group by ticker),
lf as (select ticker, first, last, n, exit_ret, span - n >= {quiet} as suspended, case when pos > dates - 1 - {quiet} then 'live' when round(exit_ret, 9) > 0 then 'acquired' else 'delisted' end as kind,
  case when pos > dates - 1 - {quiet} then null when round(exit_ret, 9) > 0 then 0e0 else -0.3e0 end as terminal from lf1)"""


# ---- execution ----
EXEC_PANEL = f"""{WX}, {grid('wx')}, {LIQ}, {SPR}, {lifecycle('wx', 4)},
ends as (select ticker, max(d) as last from g where close is not null group by ticker),
s as (select g.ticker, g.d, g.pos, g.close, round(g.close / lag(g.close, 5) over w - 1, 9) as score, first_value(g.close ignore nulls) over (partition by g.ticker order by g.d rows between 1 following and unbounded following) / g.close - 1 as raw
  from g window w as (partition by g.ticker order by g.d)),
x as (select s.ticker, s.d, s.score, case when s.d = ends.last and ends.last < (select max(d) from cal) and lf.terminal is not null then lf.terminal else s.raw end as fwd,
  lq.adv, lq.sigma, sp.cs, right(s.ticker, 1) in ('2', '4') as shortable from s join ends using (ticker) join lf using (ticker) join lq on lq.ticker = s.ticker and lq.d = s.d join sp on sp.ticker = s.ticker and sp.d = s.d where s.score is not null),
{regime('wx')}, {GATE}"""
_MED = "coalesce({t}.{c}, (select quantile_cont(m.{c}, 0.5) from {t} m where m.d = {t}.d), (select quantile_cont({c}, 0.5) from {t})) as {c}"


def executed(style: str, restricted: bool = False, cap: float | None = None, aum: float = 1e5, raw: bool = False, panel: str | None = None, share: float = 0.1, year: float = 52) -> str:
    calm = {"long_only": "l", "long_short": "l - sh", "dynamic_tilt": "1.3e0 * l - 0.3e0 * sh"}[style]
    panic = "l - sh" if style == "dynamic_tilt" else "0e0"
    fill = ", ".join(_MED.format(t="x", c=c) for c in ("adv", "sigma", "cs"))
    refill = ", ".join(_MED.format(t="mv1", c=c) for c in ("adv", "sigma", "cs"))
    short = "case when shortable then score end" if restricted else "score"

    def leg(w: str, src: str) -> str:  # what the leg holds if all go to a name's threshold tells which are capped
        return f"""c_{w} as (select *, case when {w} > 0 then {cap} * adv / {aum} end as cap_{w} from {src}),
h_{w} as (select a.d, a.cap_{w} / a.{w} as ratio, a.cap_{w} as cap, a.{w} as w, (select sum(least(b.cap_{w}, a.cap_{w} / a.{w} * b.{w})) from c_{w} b where b.d = a.d and b.{w} > 0) as held,
  sum(a.{w}) over (partition by a.d) as whole, sum(a.cap_{w}) over (partition by a.d) as room from c_{w} a where a.{w} > 0),
m_{w} as (select *, max(ratio) filter (where held < whole - 1e-12) over (partition by d) as below from h_{w}),
k_{w} as (select d, (max(whole) - coalesce(sum(cap) filter (where ratio <= below), 0)) / sum(w) filter (where below is null or ratio > below) as k, max(room) <= max(whole) as fully from m_{w} group by d),
f_{w} as (select c.* exclude ({w}), case when c.{w} = 0 then 0e0 when k.fully then c.cap_{w} else least(c.cap_{w}, k.k * c.{w}) end as {w} from c_{w} c left join k_{w} k using (d))"""

    shown = ", ".join(["d", *(f"{r6(c)} as {c}" for c in ("gross", "turnover", "trade_cost", "borrow_cost", "net_exposure", "short_gross")), f"{r6('gross - trade_cost - borrow_cost')} as net"])
    if raw:
        shown = "d, gross, turnover, trade_cost, borrow_cost, gross - trade_cost - borrow_cost as net"
    caps, src = "", "bk"
    if cap is not None:
        caps = leg("l", "bk") + ", " + leg("sh", "f_l") + ", "
        src = "f_sh"
    return f"""with {panel or EXEC_PANEL}, xf as (select ticker, d, score, fwd, shortable, {fill} from x),
ra as (select *, {short} as ss from xf),
rk as (select *, greatest(1, floor(round(count(*) over (partition by d) * {share}, 9))) as k, row_number() over (partition by d order by score desc, ticker) as hi,
  case when ss is not null then row_number() over (partition by d order by ss nulls last, ticker) end as lo from ra),
bk as (select *, case when hi <= k then 1e0 / k else 0e0 end as l, case when lo <= k then 1e0 / count(*) filter (where lo <= k) over (partition by d) else 0e0 end as sh from rk),
{caps}wt as (select b.ticker, b.d, b.fwd, b.adv, b.sigma, b.cs, case when coalesce(gate.panic, false) then {panic} else {calm} end as wt from {src} b left join gate on gate.d = b.d),
dd as (select d, row_number() over (order by d) as t from (select distinct d from wt)),
cells as (select n.ticker, dd.d, dd.t, wt.wt, wt.fwd, wt.adv, wt.sigma, wt.cs, coalesce(wt.wt, 0) - coalesce(lag(wt.wt) over (partition by n.ticker order by dd.t), 0) as dw
  from (select distinct ticker from wt) n cross join dd left join wt on wt.ticker = n.ticker and wt.d = dd.d),
mv1 as (select ticker, d, coalesce(wt, 0e0) as wt, fwd, adv, sigma, cs, dw from cells where wt is not null or dw <> 0),
mv2 as (select ticker, d, wt, fwd, dw, {refill} from mv1),
fee as (select ticker, d, [25e0, 50e0, 100e0, 200e0][{bucket('round(adv, 6)', 4, 'd')}] as fee from mv1 where wt < 0),
pr as (select m.*, coalesce(fee.fee, 0e0) as fee, 14.6558e0 + cs + 1e4 * 0.5e0 * sigma * sqrt(abs(dw) * {aum} / adv) as bps from mv2 m left join fee on fee.ticker = m.ticker and fee.d = m.d),
o as (select d, case when count(*) filter (where wt <> 0) = 0 then 0e0 else sum(wt * fwd) filter (where wt <> 0) end as gross, sum(abs(dw)) as turnover, sum(abs(dw) * bps) / 1e4 as trade_cost,
  sum(case when wt < 0 then -wt * fee else 0 end) / 1e4 / {year} as borrow_cost, sum(wt) as net_exposure, sum(case when wt < 0 then -wt else 0 end) as short_gross from pr group by d)
select {shown} from o"""


def intraday(minutes: int, style: str) -> str:
    """Days of a book over the bars of `minutes`, with the gate of the day before."""
    ticks = TK.replace("value as px, event_id from events", "round(100 * power(value / 100, 0.01e0), 6) as px, event_id from events where value > 0")
    panel = f"""{ticks}, b0 as ({resample(minutes)}),
wx as (select ticker, date_diff('day', date '1970-01-01', d) * 4096 + 2048 + bin as d, open, high, low, close, volume, close * volume as turnover from b0), {grid('wx')}, {LIQ}, {SPR},
s as (select g.ticker, g.d, round(g.close / lag(g.close, 5) over w - 1, 9) as score, first_value(g.close ignore nulls) over (partition by g.ticker order by g.d rows between 1 following and unbounded following) / g.close - 1 as fwd
  from g window w as (partition by g.ticker order by g.d)),
x as (select s.ticker, s.d, s.score, s.fwd, lq.adv, lq.sigma, sp.cs, false as shortable from s join lq on lq.ticker = s.ticker and lq.d = s.d join sp on sp.ticker = s.ticker and sp.d = s.d where s.score is not null),
bz as (select cast(ts as date) as day, count(*) > 300 as panic from events where day(ts) % 5 <> 0 group by 1), bl as (select date_diff('day', date '1970-01-01', day) as k, lag(panic) over (order by day) as panic from bz),
gate as (select distinct wx.d, coalesce(bl.panic, false) as panic from wx left join bl on bl.k = wx.d // 4096)"""
    per_bar = executed(style, aum=1e2, raw=True, panel=panel, share=0.3, year=252 * 375 / minutes)
    return f"""select date '1970-01-01' + cast(d // 4096 as integer) as d, count(*) as bars, product(1 + gross) - 1 as gross, product(1 + net) - 1 as net, sum(turnover) as turnover, sum(trade_cost) as trade_cost, sum(borrow_cost) as borrow_cost
  from ({per_bar}) group by 1"""


def _phi(x: str) -> str:
    """The normal distribution by its series of odd powers, of 8 deviations at most."""
    x = f"least(greatest({x}, -8e0), 8e0)"
    terms = f"list_reduce(list_concat([[{x}, {x}]], list_transform(range(1, 150), lambda i: [cast(i as double), 0e0])), lambda a, b: [a[1] * {x} * {x} / (2 * b[1] + 1), a[2] + a[1] * {x} * {x} / (2 * b[1] + 1)])[2]"
    return f"(0.5e0 + exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {terms})"


def _halving(test: str, low: str, high: str, rounds: int) -> str:
    """The point between low and high above which the test, in terms of `mid`, holds."""
    mid = "((s[1] + s[2]) / 2)"
    return f"list_reduce(list_concat([[{low}, {high}]], list_transform(range({rounds}), lambda k: [0e0, 0e0])), lambda s, k: case when {test.replace('mid', mid)} then [s[1], {mid}] else [{mid}, s[2]] end)[1]"


def judged(at: str) -> str:
    """jd: ratio, skew, kurt and at of three strategies; nq: the normal quantiles that the best of 42 tries and the confidence need."""
    quantiles = ", ".join(f"{_halving(f'{_phi("mid")} >= {p}', '0e0', '6e0', 55)} as {name}" for name, p in (("qa", "1 - 1 / 42e0"), ("qb", "1 - 1 / (42 * exp(1e0))"), ("qc", "0.95e0")))
    return f"""nq as (select {quantiles}),
bk as (select 'long_short' as strategy, ret from (with {LEDGER} select ret from lg) union all select 'long_only', net from ({executed("long_only", raw=True)}) union all select 'dynamic_tilt', net from ({executed("dynamic_tilt", raw=True)})),
mo as (select strategy, count(*) as n, avg(ret) as m, stddev_samp(ret) as sd, stddev_pop(ret) as sp from bk where ret is not null group by strategy),
mm as (select mo.strategy, any_value(n) as n, any_value(m / sd) as ratio, avg(((ret - m) / sp) ** 3) as skew, avg(((ret - m) / sp) ** 4) as kurt from bk join mo using (strategy) where ret is not null group by mo.strategy),
jd as (select *, {at} as held, sqrt(greatest(1e-12, 1 - skew * ratio + (kurt - 1) / 4 * ratio * ratio)) as dev from mm, nq)"""


_BEST = "(stddev_samp(ratio) over ()) * (0.4227843350984671e0 * qa + 0.5772156649015329e0 * qb)"


# ---- features ----
def features(bars: str, momenta: tuple[int, ...], averages: tuple[int, ...], vols: tuple[int, ...], short: int, year: int, targets: tuple[int, ...]) -> str:
    by = "over (partition by ticker order by d)"
    cols = [f"ln(close / lag(close, {h}) {by}) as mom_{h}" for h in momenta] + [f"close / {full('avg(@)', 'close', n)} as sma_{n}" for n in averages]
    cols += [f"{full('max(@)', 'r1', short)} as max_ret_{short}"] + [f"{full('stddev_samp(@)', 'r1', n)} as vol_{n}" for n in vols]
    cols += [
        f"sqrt({full('avg(@)', 'hl', short)} / (4 * ln(2e0))) as parkinson_{short}", f"close / {full('max(@)', 'close', year)} - 1 as drawdown_{year}", "abs(r1) / nullif(close * volume, 0) as amihud",
        f"{full('var_samp(@)', 'volume', short)} as vol_var_{short}", f"volume / nullif({full('avg(@)', 'volume', short)}, 0) as turn_{short}",
    ]
    cols += [f"ln(lead(close, {h}) {by} / close) as fwd_{h}" for h in targets]
    return f"f0 as (select *, ln(close / lag(close) {by}) as r1, ln(high / low) ** 2 as hl from {bars}), f as (select ticker, d, {', '.join(cols)} from f0)"


FULL = ((1, 5, 20, 60, 120, 252), (20, 50, 200), (20, 60), 20, 252, (1, 5, 21))
FEATURES = ("mom_1", "mom_5", "mom_20", "mom_60", "mom_120", "mom_252", "sma_20", "sma_50", "sma_200", "max_ret_20", "vol_20", "vol_60", "parkinson_20", "drawdown_252", "amihud", "vol_var_20", "turn_20")


def _six(c: str) -> str:
    return f"{r6(f'amihud * {1e9}' if c == 'amihud' else c)} as {c}"


def _matrix() -> str:
    digits = {"amihud": 15}
    rounded = ", ".join(f"round({c}, {digits.get(c, 9)}) as {c}" for c in FEATURES)
    whole = " and ".join(f"{c} is not null" for c in FEATURES)
    ranks = ", ".join(f"{r6(unit(c))} as {c}" for c in FEATURES)
    return f"""with {DY}, {features('dy', *FULL)}, k as (select ticker, d, {rounded}, fwd_1, fwd_5, fwd_21 from f where {whole} and (fwd_1 is not null or fwd_5 is not null or fwd_21 is not null))
select ticker, d, {ranks}, {r6('fwd_1')} as fwd_1, {r6('fwd_5')} as fwd_5, {r6('fwd_21')} as fwd_21 from k"""


def universe(bars: str, top: int, lookback: int, every: int, least: int) -> str:
    return f"""uc as (select d, row_number() over (order by d) - 1 as pos from (select distinct d from {bars})),
reb as (select pos as r from uc where pos >= {lookback} and (pos - {lookback}) % {every} = 0),
med as (select reb.r, w.ticker, round(quantile_cont(w.turnover, 0.5), 6) as m, count(*) as n from reb join uc on uc.pos between reb.r - {lookback} and reb.r - 1 join {bars} w on w.d = uc.d where w.turnover > 0 group by all),
pick as (select r, ticker from med where n >= {least} qualify row_number() over (partition by r order by m desc, ticker) <= {top}),
u as (select uc.d, uc.pos, pick.ticker from pick join uc on uc.pos between pick.r and pick.r + {every - 1})"""


UNI = universe("dy", 25, 252, 63, 40)

IC = f"""{MOM}, iv as (select d, ticker, turnover, score, round(fwd, 9) as fwd from s where score is not null and fwd is not null),
ir as (select d, {mean_rank('score', 'd')} as a, {mean_rank('fwd', 'd')} as b from iv),
ic as (select d, case when count(*) >= 5 and stddev_pop(a) > 0 and stddev_pop(b) > 0 then round(corr(a, b), 12) end as ic, count(*) as n from ir group by d)"""
LEDGER = f"{MOM}, {DEC}, lg as (select d, sum(l * fwd) filter (where l > 0) as ret from dw group by d)"


def _summary(key: str = "", group: str = "") -> str:
    return f"""with {IC} select {key}{r6('avg(ic)')} as mean, {r6('avg(ic) / stddev_samp(ic)')} as ir, {r6('avg(ic) / stddev_samp(ic) * sqrt(count(*))')} as t,
  {r6('count(*) filter (where ic > 0) / cast(count(*) as double)')} as hit, count(*) as n from ic where ic is not null{group}"""


TRAIL = """tr as (select ic.d, cal.pos, ic.ic from ic join cal on cal.d = ic.d),
tl as (select a.d, case when count(b.ic) >= 26 then avg(b.ic) end as tic from tr a left join lateral (select ic from tr v where v.ic is not null and v.pos <= a.pos - 2 order by v.pos desc limit 52) b on true group by a.d)"""

_BIN = "cast(floor((hour(ts) * 60 + minute(ts) - 555) / {m}e0) as bigint)"


def resample(minutes: int) -> str:
    b = _BIN.format(m=minutes)
    return f"select ticker, cast(ts as date) as d, {b} as bin, arg_min(px, event_id) as open, max(px) as high, min(px) as low, arg_max(px, event_id) as close, count(*) as volume from tk where px > 0 group by all"


# The same ratios as the detector's, from their rule.
_GRID = """rg as (select distinct round(v, 12) as v from (select unnest([2,3,4,5,6,8,10,12,15,20,25,50,100]) * 1e0 as v union all select 1e0 / unnest([2,3,4,5,6,8,10,12,15,20,25,50,100])
  union all select n / (n + m * 1e0) from range(1, 13) a(n), range(1, 13) b(m)))"""
_ACTIONS = f"""{_GRID},
a0 as (select *, lag(close) over w as c1, lag(d) over w as d1, row_number() over w - 1 as prior, {full('quantile_cont(@, 0.5)', 'turnover', 20, 5, 1)} as tm, coalesce(isin <> lag(isin) over w, false) as re from ri window w as (partition by ticker order by d)),
a1 as (select *, bool_or(re) over (partition by ticker order by d rows between 3 preceding and 3 following) as wit, round(close / c1, 9) as ratio, turnover / nullif(tm, 0) as tr from a0),
a2 as (select *, coalesce(tr between 0.2 and 20, true) as calm from a1),
a3 as (select a2.ticker, a2.d, arg_min(rg.v, (round(abs(ln(ratio / rg.v)), 9), rg.v)) as near from a2, rg where prior >= 5 and c1 >= 20 and d - d1 <= 7 and abs(ratio - 1) > 0.25 and (calm or wit) group by all),
act as (select a2.*, near as factor, case when wit and not calm then 'isin_reissue' when wit then 'isin_reissue+turnover' else 'turnover' end as witness from a2 join a3 using (ticker, d) where abs(ratio / near - 1) <= 0.1),
adj as (select ri.*, act.factor, coalesce(sum(ln(act.factor)) over (partition by ri.ticker order by ri.d rows between 1 following and unbounded following), 0e0) as la from ri left join act using (ticker, d))"""
ACT = f"{RI}, {_ACTIONS}"

TREND = """tm0 as (select *, ln(close) as lc, ln(close / lag(close) over (partition by ticker order by d)) as lr from g),
tm1 as (select *, case when lr is not null then least(lr, 0e0) ** 2 end as dn from tm0),
tm as (select ticker, d, lc, lr, lag(lc, 4) over w - lag(lc, 52) over w as mom_12_1, lc - lag(lc, 13) over w as mom_63, lc - lag(lc, 4) over w as mom_21,
  lc - ln({sma}) as px_v_200, ({mean}) / nullif(sqrt({down}), 0) as sortino_63 from tm1 window w as (partition by ticker order by d))""".format(
    sma=full("avg(@)", "close", 40), mean=full("avg(@)", "lr", 13), down=full("avg(@)", "dn", 13)
)
TRENDS = ("mom_12_1", "mom_63", "mom_21", "px_v_200", "sortino_63")


def _ortho() -> str:
    parts = []
    for t in TRENDS:
        for part, where in (("all", "true"), ("best", "l > 0"), ("worst", "sh > 0")):
            parts.append(f"select '{t}' as trend, '{part}' as part, d, score, round({t}, 9) as x from legs where {where} and {t} is not null")
    return f"""with {MOM}, dk as (select *, greatest(1, floor(round(count(*) over (partition by d) * 0.5, 9))) as k, row_number() over (partition by d order by score desc, ticker) as hi,
  row_number() over (partition by d order by score, ticker) as lo from s where score is not null), {TREND},
legs as (select dk.*, case when hi <= k then 1e0 / k else 0e0 end as l, case when lo <= k then 1e0 / k else 0e0 end as sh, {', '.join('tm.' + t for t in TRENDS)} from dk join tm on tm.ticker = dk.ticker and tm.d = dk.d),
p as ({' union all '.join(parts)}),
r as (select trend, part, d, {mean_rank('score', 'trend, part, d')} as a, {mean_rank('x', 'trend, part, d')} as b from p),
i as (select trend, part, d, case when count(*) >= 10 and stddev_pop(a) > 0 and stddev_pop(b) > 0 then round(corr(a, b), 12) end as ic from r group by all)
select trend, part, {r6('avg(ic)')} as rho, count(ic) as n from i group by all"""


def _tilts() -> str:
    pct = "{r} / count(*) over (partition by d)"
    up, down = pct.format(r=mean_rank("x", "d")), pct.format(r=mean_rank("x", "d"))
    smooth = lambda side, sign, k: f"select '{{v}}' as variant, d, fwd, {side} * w / nullif(sum(w) over (partition by d), 0) as w from (select d, fwd, greatest(0e0, 1 + {k} * {sign} * (2 * {up} - 1)) as w from {{leg}})"
    cut = lambda side, c: f"select '{{v}}' as variant, d, fwd, coalesce({side} * w / nullif(sum(w) over (partition by d), 0), 0) as w from (select d, fwd, case when round({down}, 9) {c} 0.5 then 1e0 else 0e0 end as w from {{leg}})"
    equal = lambda side: f"select '{{v}}' as variant, d, fwd, {side} / cast(count(*) over (partition by d) as double) as w from {{leg}}"
    variants = [("equal", equal(1), equal(-1)), ("smooth_half", smooth(1, 1, 0.5), smooth(-1, -1, 0.5)), ("smooth", smooth(1, 1, 1.0), smooth(-1, -1, 1.0)), ("hard_cut", cut(1, ">="), cut(-1, "<=")), ("reversed", smooth(1, -1, 1.0), smooth(-1, 1, 1.0))]
    rows = " union all ".join(q.format(v=v, leg="lb0" if v == "equal" and leg == "lb" else "ls0" if v == "equal" else leg) for v, a, b in variants for q, leg in ((a, "lb"), (b, "ls")))
    return f"""with {MOM}, dk as (select *, greatest(1, floor(round(count(*) over (partition by d) * 0.5, 9))) as k, row_number() over (partition by d order by score desc, ticker) as hi,
  row_number() over (partition by d order by score, ticker) as lo from s where score is not null), {TREND},
nx as (select ticker, d, lead(lr) over (partition by ticker order by d) as fwd from tm),
lg0 as (select dk.ticker, dk.d, hi, lo, k, round(tm.mom_12_1, 9) as x, nx.fwd from dk join tm using (ticker, d) join nx using (ticker, d)),
lb0 as (select d, fwd, x from lg0 where hi <= k), ls0 as (select d, fwd, x from lg0 where lo <= k), lb as (select * from lb0 where x is not null), ls as (select * from ls0 where x is not null),
v as ({rows}),
dy0 as (select variant, d, sum(w * fwd) filter (where w > 0) + sum(w * fwd) filter (where w < 0) as ret, count(*) filter (where w > 0) as nl, count(*) filter (where w < 0) as ns from v group by all),
dy1 as (select *, sum(ret) over (partition by variant order by d) as total, sum(ret) over (partition by variant, date_trunc('month', d)) as month from dy0 where ret is not null),
dy2 as (select *, total - max(total) over (partition by variant order by d) as fall from dy1)
select variant, {r6('avg(ret) * 52')} as ann, {r6('avg(ret) / stddev_samp(ret) * sqrt(52e0)')} as sharpe, {r6('min(fall)')} as max_fall, {r6('min(month)')} as worst_month,
  {r6('avg(nl)')} as long_names, {r6('avg(ns)')} as short_names from dy2 group by variant"""


BUFFER = f"""{MOM}, rk0 as (select d, ticker, row_number() over (partition by d order by score desc, ticker) as rank, count(*) over (partition by d) as n from s where score is not null),
rk1 as (select *, greatest(1, floor(round(n * 0.2, 9))) as enter, dense_rank() over (order by d) as t from rk0),
rk as (select *, greatest(enter, least({{leave}}, floor(n / 2))) as leave from rk1{{extra}}),
walk as (select t, list(ticker order by rank)[1:cast(any_value(enter) as int)] as held from rk where t = 1 and rank <= enter group by t
  union all select rk.t, list(rk.ticker order by list_contains(walk.held, rk.ticker) and rank <= leave desc, rank)[1:cast(any_value(enter) as int)]
  from walk join rk on rk.t = walk.t + 1 where rank <= enter or (rank <= leave and list_contains(walk.held, rk.ticker)) group by rk.t)"""
COST = """dc0 as (select s.ticker, s.d, lq.adv, lq.sigma, sp.cs, greatest(1, floor(round(count(*) over (partition by s.d) * 0.2, 9))) as k from s join lq on lq.ticker = s.ticker and lq.d = s.d join sp on sp.ticker = s.ticker and sp.d = s.d where s.score is not null),
dc1 as (select ticker, d, k, {fill} from dc0), dcost as (select ticker, d, 14.6558e0 + cs + 1e4 * 0.5e0 * sigma * sqrt(1e5 / k / adv) as cost from dc1)""".format(
    fill=", ".join(_MED.format(t="dc0", c=c) for c in ("adv", "sigma", "cs"))
)

ORACLES: dict[str, str] = {
    "resample_30m": f"with {TK} {resample(30)}",
    "resample_60m": f"with {TK} {resample(60)}",
    "bars_per_day": f"with {TK}, b as ({resample(30)}), c as (select ticker, d, count(*) as n from b group by all) select ticker, quantile_cont(n, 0.5) as median_bars, max(n) as max_bars from c group by ticker",
    "gate_by_series": f"""with {TK}, b as ({resample(15)}), r as (select ticker, d, bin, round(high / low - 1, 9) as range from b),
e as (select *, case when count(*) over w >= 20 then quantile_cont(range, 0.85) over w end as edge from r window w as (partition by ticker order by d, bin rows between unbounded preceding and current row))
select ticker, d, bin, round(range, 6) + 0.0 as range, round(edge, 6) + 0.0 as edge, coalesce(round(range, 9) > round(edge, 9), false) as panic from e""",
    "dedup_keep_last": f"with {TK} select ticker, event_id, px from tk qualify row_number() over (partition by ticker, date_trunc('minute', ts) order by event_id desc) = 1",
    "dedup_keep_first": f"with {TK} select ticker, event_id, px from tk qualify row_number() over (partition by ticker, date_trunc('minute', ts) order by event_id) = 1",
    "fill_within_name": f"""with {WX}, {grid('wx')} select ticker, d, last_value(close ignore nulls) over (partition by ticker order by d) as filled,
  first_value(close ignore nulls) over (partition by ticker order by d rows between 1 following and unbounded following) as next_quote from g""",
    "calendar_ordinal": f"with {WK} select d, row_number() over (order by d) - 1 as pos from (select distinct d from wk)",
    "business_days": "select cast(d as date) as d from range(date '1996-01-01', date '1997-01-01', interval 1 day) t(d) where dayofweek(d) between 1 and 5",
    "raw_features": f"with {DY}, {features('dy', *FULL)} select ticker, d, {', '.join(_six(c) for c in FEATURES)} from f",
    "forward_targets": f"with {DY}, {features('dy', *FULL)} select ticker, d, {r6('fwd_1')} as fwd_1, {r6('fwd_5')} as fwd_5, {r6('fwd_21')} as fwd_21 from f",
    "session_targets": f"""with {TK}, b as ({resample(30)}), x as (select *, lead(close, 2) over w as nc, lead(d, 2) over w as nd from b window w as (partition by ticker order by d, bin))
select ticker, d, bin, {r6('case when nd = d then ln(nc / close) end')} as fwd from x""",
    "feature_matrix": _matrix(),
    "delivery_features": f"""with {DY}, q as (select l_suppkey as ticker, cast(l_shipdate as date) as d, sum(l_quantity) filter (where l_returnflag = 'N') as delivery_qty, sum(l_quantity) filter (where l_returnflag = 'N') / sum(l_quantity) as delivery_pct from lineitem group by all),
k as (select dy.ticker, dy.d, round(ln(close / lag(close) over (partition by dy.ticker order by dy.d)), 9) as mom_1, round(delivery_qty, 9) as delivery_qty, round(delivery_pct, 9) as delivery_pct from dy left join q on q.ticker = dy.ticker and q.d = dy.d),
j as (select * from k where mom_1 is not null and delivery_qty is not null and delivery_pct is not null) select ticker, d, {r6(unit('mom_1'))} as mom_1, {r6(unit('delivery_qty'))} as delivery_qty, {r6(unit('delivery_pct'))} as delivery_pct from j""",
    "universe_topn": f"with {DY}, {UNI} select d, ticker from u",
    "universe_churn": f"""with {DY}, {UNI}, v as (select *, exists (select 1 from pick p where p.r = pick.r - 63 and p.ticker = pick.ticker) as old from pick where r - 63 in (select r from pick))
select r as pos, count(*) as names, count(*) filter (where not old) as entered, {r6('avg(case when old then 0e0 else 1e0 end)')} as churn from v group by r""",
    "universe_masked_rank": f"with {DY}, {UNI}, {features('dy', *FULL)}, k as (select f.ticker, f.d, round(f.mom_20, 9) as mom_20 from f semi join u using (ticker, d) where f.mom_20 is not null) select ticker, d, {r6(unit('mom_20'))} as mom_20 from k",
    "universe_export": f"with {DY}, {UNI} select ticker, d, close from dy where ticker in (select ticker from u)",
    "liquidity_panels": f"with {WX}, {grid('wx')}, {LIQ} select ticker, d, {r6('adv')} as adv, {r6('sigma')} as sigma from lq",
    "spread_panels": f"with {WX}, {grid('wx')}, {SPR} select ticker, d, {r6('cs')} as cs, {r6('ar')} as ar from sp where cs is not null and ar is not null",
    "liquidity_quintile_spread": f"""with {WX}, {grid('wx')}, {SPR}, b as (select cs, {bucket('t', 5, 'd')} as q from (select d, cs, round(turnover, 6) as t from sp where cs is not null and turnover is not null))
select q, count(*) as n, {r6('avg(cs)')} as mean_cs, {r6('quantile_cont(cs, 0.5)')} as median_cs, {r6('count(*) filter (where cs = 0) / cast(count(*) as double)')} as zero_share from b group by q
union all select 0, count(*), {r6('avg(cs)')}, {r6('quantile_cont(cs, 0.5)')}, {r6('count(*) filter (where cs = 0) / cast(count(*) as double)')} from b""",
    "spread_monotone_gate": f"""with {WX}, {grid('wx')}, {SPR}, b as (select cs, {bucket('t', 5, 'd')} as q from (select d, cs, round(turnover, 6) as t from sp where cs is not null and turnover is not null)),
m as (select q, avg(cs) as m from b group by q) select count(*) = 0 as rises_throughout from m a join m b on b.q = a.q + 1 where b.m <= a.m""",
    "spread_pooled_mean": f"with {WX}, {grid('wx')}, {SPR} select {r6('avg(cs)')} as pooled from sp where cs is not null and turnover is not null",
    "rank_turnover_curve": f"with {WK}, x as (select turnover, row_number() over (partition by d order by round(turnover, 6) desc, ticker) as k from wk) select k, {r6('quantile_cont(turnover, 0.5)')} as median_turnover from x group by k",
    "capacity_sweep": f"""with {WK}, x as (select turnover, row_number() over (partition by d order by round(turnover, 6) desc, ticker) as k from wk), z(aum, n) as (values (1e5, 5), (1e5, 10), (1e6, 5), (1e6, 10), (1e6, 20))
select cast(aum as double) as aum, cast(n as bigint) as n, {r6('quantile_cont(aum / n / turnover, 0.5)')} as participation, count(*) as bars, round(quantile_cont(aum / n / turnover, 0.5), 9) <= 0.1 as feasible from z join x on x.k <= z.n group by aum, n""",
    "capacity_curve": f"""with {WX}, {grid('wx')}, {LIQ}, z(aum) as (values (1e4), (1e5), (1e6)), b as (select aum, g.turnover, sigma, aum / 5 / g.turnover as part from z, g join lq using (ticker, d) where g.turnover > 0 and sigma is not null),
k as (select k, quantile_cont(turnover, 0.5) as m from (select turnover, row_number() over (partition by d order by round(turnover, 6) desc, ticker) as k from g where turnover > 0) group by k),
f as (select aum, max(k) filter (where round(aum / greatest(1, round_even(k * 0.2, 0)) / m, 12) <= 0.1) as most from z, k where k >= 5 group by aum)
select cast(aum as double) as aum, {r6('quantile_cont(part, 0.5)')} as part_median, {r6('quantile_cont(part, 0.9)')} as part_p90, {r6('quantile_cont(part, 0.99)')} as part_p99, {r6('avg(case when round(part, 12) > 0.1 then 1e0 else 0e0 end)')} as over_ceiling,
  {r6('quantile_cont(1e4 * 0.5 * sigma * sqrt(part), 0.5)')} as impact_median, {r6('avg(1e4 * 0.5 * sigma * sqrt(part))')} as impact_mean, coalesce(max(most), 0) as max_names from b left join f using (aum) group by aum""",
    "momentum_rank": f"with {MOM}, {DEC} select ticker, d, hi as rank_desc, lo as rank_asc, cast(hi <= k as int) - cast(lo <= k as int) as side from dw",
    "top_bottom_n": f"with {MOM}, t as (select ticker, d, row_number() over (partition by d order by score desc, ticker) as hi, row_number() over (partition by d order by score, ticker) as lo from s where score is not null) select ticker, d, cast(hi <= 3 as int) - cast(lo <= 3 as int) as side from t where hi <= 3 or lo <= 3",
    "long_short_returns": f"with {MOM}, {DEC} select d, {r6('sum((l - sh) * fwd) filter (where l <> sh)')} as gross, count(*) filter (where l <> sh and fwd is null) as unpriced from dw group by d",
    "avg_pairwise_corr": f"with {WX}, {grid('wx')}, {regime('wx')}, nm as (select t, count(*) as names from ok group by t) select cal.d, {r6('pm.avg_corr')} as avg_corr, nm.names from pm join cal on cal.d = pm.d join nm on nm.t = cal.pos",
    "regime_inputs": f"with {WX}, {grid('wx')}, {regime('wx')} select d, {r6('mkt_ret')} as mkt_ret, {r6('log_vol')} as log_vol, {r6('avg_corr')} as avg_corr from ri0",
    "panic_gate": f"with {WX}, {grid('wx')}, {regime('wx')}, {GATE} select d, {r6('stress')} as stress, panic from gt",
    "vol_tripwire": f"""with {WX}, {grid('wx')}, {regime('wx')}, n as (select d, log_vol, case when count(mkt_ret) over w = 21 then stddev_samp(mkt_ret) over w end as naive from mv window w as (order by d rows between 20 preceding and current row)),
z as (select {_z('log_vol', 52)} as a, {_z('naive', 52)} as b from n) select {r6('corr(a, b)')} as rho, count(*) as n, corr(a, b) > 0.8 as fails from z where a is not null and b is not null""",
    "weights_long_only": "long_only",
    "weights_long_short": "long_short",
    "weights_dynamic_tilt": "dynamic_tilt",
    "execute_long_only": executed("long_only"),
    "execute_long_short_slb": executed("long_short", True),
    "execute_dynamic_tilt": executed("dynamic_tilt"),
    "execute_capped": executed("long_only", cap=0.1, aum=2e5),
    "implicit_exits": f"""with {WX}, {grid('wx')}, {scores()}, {DEC}, {regime('wx')}, {GATE} select ticker, dw.d, {r6('1.3e0 * l - 0.3e0 * sh')} as wt from dw left join gate on gate.d = dw.d
where not coalesce(panic, false) and l + sh > 0 and 1.3e0 * l <> 0.3e0 * sh and fwd is null and dw.d < (select max(d) from dw)
union all select ticker, dw.d, {r6('l - sh')} from dw join gate on gate.d = dw.d where panic and l <> sh and fwd is null and dw.d < (select max(d) from dw)""",
    "tiered_borrow": f"with {EXEC_PANEL}, h as (select *, row_number() over (partition by d order by score, ticker) as lo, greatest(1, floor(round(count(*) over (partition by d) * 0.3, 9))) as k from x), i as (select * from h where lo <= k and adv is not null) select d, ticker, {bucket('round(adv, 6)', 4, 'd')} as tier, [25e0, 50e0, 100e0, 200e0][{bucket('round(adv, 6)', 4, 'd')}] as fee from i",
    "cap_water_fill": f"""with {MOM}, h as (select *, count(*) over (partition by d) as n, row_number() over (partition by d order by score desc, ticker) as hi from s where score is not null),
leg as (select h.d, h.ticker, 1e0 / greatest(1, floor(n / 2)) as w, 0.1 * h.turnover / 2e5 as cap from h where hi <= greatest(1, floor(n / 2))),
o as (select a.d, a.ticker, a.w, a.cap, (select sum(least(b.cap, a.cap / a.w * b.w)) from leg b where b.d = a.d) as held, (select sum(cap) from leg b where b.d = a.d) as room from leg a),
m as (select d, max(cap / w) filter (where held < 1 - 1e-12) as below from o group by d),
k as (select o.d, (1 - coalesce(sum(cap) filter (where cap / w <= below), 0)) / sum(w) filter (where below is null or cap / w > below) as k from o join m using (d) group by o.d)
select d, ticker, {r6('case when room <= 1 then cap else least(cap, k.k * w) end')} as weight from o join k using (d)""",
    "decision_costs": f"with {MOM}, {LIQ}, {SPR}, {COST} select ticker, d, {r6('cost')} as cost from dcost",
    "daily_ic": f"with {IC} select d, {r6('ic')} as ic, n from ic",
    "ic_summary": _summary(),
    "ic_by_year": _summary("year(d) as year, ", " group by year(d)"),
    "ic_by_quintile": f"""with {IC}, q as (select d, score, fwd, {bucket('round(turnover, 6)', 5, 'd')} as q from iv), k as (select d, q, {mean_rank('score', 'd, q')} as a, {mean_rank('fwd', 'd, q')} as b from q),
c as (select d, q, case when count(*) >= 3 and stddev_pop(a) > 0 and stddev_pop(b) > 0 then round(corr(a, b), 12) end as ic from k group by d, q) select q, {r6('avg(ic)')} as mean, count(ic) as n from c group by q""",
    "trailing_ic": f"with {IC}, {TRAIL} select d, {r6('tic')} as trailing_ic from tl",
    "expected_return": f"""with {IC}, {TRAIL}, {LIQ}, z as (select ticker, d, (score - avg(score) over w) / nullif(stddev_samp(score) over w, 0) as z from s where score is not null window w as (partition by d))
select z.ticker, z.d, {r6('greatest(0e0, tic) * sigma * sqrt(5e0) * z')} as er from z join tl using (d) join lq on lq.ticker = z.ticker and lq.d = z.d where tic is not null""",
    "rolling_beta": f"""with {WX}, r as (select ticker, d, ln(close / lag(close) over (partition by ticker order by d)) as r from wx), j as (select *, avg(r) over (partition by d) as m from r where r is not null)
select ticker, d, {r6('case when count(*) over w >= 26 then covar_samp(r, m) over w / nullif(var_samp(m) over w, 0) end')} as beta from j window w as (partition by ticker order by d rows between 51 preceding and current row)""",
    "performance": f"""with {LEDGER}, p as (select *, lag(ret) over (order by d) as b, exp(sum(ln(1 + ret)) over (order by d)) as w, sum(ret) over (order by d) as t, sum(ret) over (partition by date_trunc('month', d)) as m from lg where ret is not null),
q as (select *, w / max(w) over (order by d) - 1 as dn, t - max(t) over (order by d) as fall, avg(ret) over () as mu, stddev_pop(ret) over () as sd from p)
select {r6('avg(ret) / stddev_samp(ret) * sqrt(52e0)')} as sharpe, {r6('avg(((ret - mu) / sd) ** 3)')} as skew, {r6('avg(((ret - mu) / sd) ** 4)')} as kurtosis, {r6('corr(ret, b)')} as autocorr, {r6('min(dn)')} as max_drawdown,
  {r6('min(fall)')} as max_fall, {r6('arg_max(w, d) ** (52e0 / count(*)) - 1')} as cagr, {r6('min(m)')} as worst_month, count(*) as n from q""",
    "variance_ratio": f"""with {LEDGER}, p as (select ret, row_number() over (order by d) as k from lg where ret is not null), m as (select avg(ret) as mu, var_samp(ret) as v, count(*) as n from p),
s5 as (select a.k, sum(b.ret) as s from p a join p b on b.k between a.k - 4 and a.k where a.k >= 5 group by a.k), o as (select sum((s - 5 * mu) ** 2) / (5 * (any_value(n) - 4) * (1 - 5e0 / any_value(n))) / any_value(v) as vr, any_value(n) as n from s5, m)
select n, {r6('vr')} as vr, {r6('1 / sqrt(vr)')} as lo from o""",
    "yearly_compounded": f"with {LEDGER} select year(d) as year, {r6('exp(sum(ln(1 + ret))) - 1')} as ret, {r6('min(ret)')} as worst, {r6('avg(ret) / stddev_samp(ret) * sqrt(52e0)')} as sharpe, count(*) as n from lg where ret is not null group by year(d)",
    "daily_compounded": f"with {TK}, b as ({resample(30)}), r as (select ticker, d, close / lag(close) over (partition by ticker order by d, bin) - 1 as ret from b) select ticker as strategy, d, {r6('exp(sum(ln(1 + ret))) - 1')} as ret from r where ret is not null group by all",
    "asof_yield": f"""with {WK}, c as (select d, row_number() over (order by d) as pos from (select distinct d from wk)), y as (select w.d, round(avg(w.close) / 1000, 9) as y from wk w join c using (d) where c.pos > 6 and c.pos % 4 = 0 group by w.d)
select w.ticker, w.d, {r6('coalesce(y.y, (select quantile_cont(y, 0.5) from y))')} as y from wk w asof left join y on w.d >= y.d""",
    "dividend_accrual": f"""with {LEDGER}, y as (select d, round(avg(close) / 1000, 9) as y from wk join (select d, row_number() over (order by d) as pos from (select distinct d from wk)) c using (d) where pos > 6 and pos % 4 = 0 group by d),
e as (select d, sum(l) as net_exposure from dw group by d) select e.d, {r6('net_exposure * coalesce(y.y, (select quantile_cont(y, 0.5) from y)) / 100 / 52')} as income from e asof left join y on e.d >= y.d""",
    "gate_broadcast_lagged": f"""with {TK}, n as (select cast(ts as date) as d, count(*) > 300 as open from tk group by all), o as (select d, lag(open) over (order by d) as open from n where day(d) % 5 <> 0)
select ticker, cast(ts as date) as d, count(*) as n, bool_and(coalesce(o.open, false)) as open from tk left join o on o.d = cast(ts as date) group by all""",
    "delivery_lag_broadcast": f"""with {TK}, b as (select ticker, cast(ts as date) as d, count(*) as n from tk group by all), l as (select ticker, d, lag(n) over (partition by ticker order by d) as q from b where n % 3 <> 0)
select b.ticker, b.d, coalesce(last_value(q ignore nulls) over (partition by b.ticker order by b.d), 0) as qty from b left join l on l.ticker = b.ticker and l.d = b.d""",
    "proximity_semi": f"""with {WX}, c as (select d, row_number() over (order by d) as pos from (select distinct d from wx)), a as (select ticker, pos from wx join c using (d) where high / low > 1.55),
e as (select ticker, d, pos, ln(close / lag(close) over (partition by ticker order by d)) as r from wx join c using (d)) select ticker, d from e where abs(r) > 0.25 and exists (select 1 from a where a.ticker = e.ticker and abs(a.pos - e.pos) <= 3)""",
    "fold_range_join": f"""with {WX}, c as (select d, row_number() over (order by d) - 1 as pos, count(*) over () as n from (select distinct d from wx)), f as (select fold from range(0, 1000) t(fold), (select max(n) as n from c) where 104 + fold * 26 < n)
select fold, count(*) filter (where pos < 104 + fold * 26) as train_rows, count(*) filter (where pos >= 104 + fold * 26) as test_rows from f join c on pos >= fold * 26 and pos < 130 + fold * 26 join wx using (d) group by fold""",
    "anti_missing": f"with {WX}, {grid('wx')} select ticker, d from g where close is null",
    "ledger_compare": f"""with {MOM}, a as (select d, avg(fwd) filter (where score > 0) as r from s group by d), s6 as (select d, round(close / lag(close, 6) over w - 1, 9) as score, lead(close) over w / close - 1 as fwd from g window w as (partition by ticker order by d)),
b as (select d, avg(fwd) filter (where score > 0) as r from s6 group by d having avg(fwd) filter (where score > 0) is not null)
select count(*) filter (where a.d is null) as right_only, count(*) filter (where b.d is null) as left_only, count(*) filter (where (a.r is null) <> (b.r is null)) as null_differs, {r6('max(abs(a.r - b.r))')} as largest, false as identical from a full join b on a.d = b.d""",
    "corporate_actions": f"with {ACT} select ticker, d, {r6('ratio')} as ratio, {r6('factor')} as factor, {r6('tr')} as turnover_ratio, witness, {r6('ratio / factor - 1')} as ex_ret, abs(round(ratio / factor - 1, 9)) > 0.05 as review from act",
    "back_adjust": f"with {ACT} select ticker, d, {r6('la')} as log_factor, {r6('ln(close) + la')} as log_close, {r6('ln(volume) - la')} as log_volume from adj",
    "returns_preserved": f"with {ACT} select count(factor) as actions, true as preserved from adj",
    "action_audit": f"with {ACT} select ticker, d, {r6('factor')} as factor, {r6('ratio')} as ratio, abs(round(ratio / factor - 1, 9)) > 0.05 as review from act order by round(abs(ln(factor)), 9) desc, d, ticker limit 20",
    "lifecycle": f"with {WX}, {lifecycle('wx', 4)} select ticker, first, last, n, {r6('exit_ret')} as exit_ret, suspended, kind, terminal from lf",
    "lifecycle_counts": f"with {WX}, {lifecycle('wx', 4)} select kind, count(*) as n, {r6('count(*) / sum(count(*)) over ()')} as share from lf group by kind",
    "isin_chain": f"""with recursive {WK}, li as (select left(ticker, 7) || strftime(d, '%Y%m') as isin, min(d) as first, max(d) + cast(20 * (month(min(d)) % 3) as integer) as last from wk group by left(ticker, 7) || strftime(d, '%Y%m')),
o as (select *, left(isin, 7) as stem, row_number() over (partition by left(isin, 7) order by first, last, isin) as rn from li),
w as (select stem, rn, isin, isin as entity, isin as head, last as fin from o where rn = 1
  union all select o.stem, o.rn, o.isin, case when o.first > w.fin then w.head else o.isin end, w.head, case when o.first > w.fin then o.last else w.fin end from w join o on o.stem = w.stem and o.rn = w.rn + 1)
select isin, entity from w""",
    "ticker_disambiguation": f"with {WK}, e as (select distinct ticker as entity, left(ticker, 7) as name from wk), k as (select *, row_number() over (partition by name order by entity) as rn from e) select entity, case when rn > 1 then name || '.' || rn else name end as ticker from k",
    "expanding_zscore": f"with {WK}, r as (select ticker, d, ln(close / lag(close) over (partition by ticker order by d)) as r from wk) select ticker, d, {r6('case when count(r) over w >= 52 then (r - avg(r) over w) / nullif(stddev_samp(r) over w, 0) end')} as z from r window w as (partition by ticker order by d rows between unbounded preceding and current row)",
    "rolling_sum": f"with {WX}, r as (select ticker, d, ln(close / lag(close) over (partition by ticker order by d)) as r from wx) select ticker, d, {r6('coalesce(' + full('sum(@)', 'r', 20) + ', 0)')} as sum20 from r",
    "sweep_bands": f"""with {MOM}, n(n) as (values (3), (5), (10), (20)), c as (select n, a.d, (select b.close from g b where b.ticker = a.ticker and b.pos = a.pos - n) as was, a.close, (select b.close from g b where b.ticker = a.ticker and b.pos = a.pos + 1) as nxt from n, g a),
r as (select n, d, avg(nxt / close - 1) filter (where round(close / was - 1, 9) > 0) as r from c group by n, d), sb as (select n, avg(r) / stddev_samp(r) * sqrt(52e0) as sharpe from r group by n)
select {r6('avg(sharpe)')} as mean, {r6('min(sharpe)')} as least, {r6('max(sharpe)')} as most, count(*) as n from sb""",
    "set_operations": f"""with {WX}, a as (select distinct d from wx where ticker like '%5'), b as (select distinct d from wx where ticker like '%3')
select (select count(*) from (select d from a union select d from b)) as either, (select count(*) from (select d from a intersect select d from b)) as both_, (select count(*) from (select d from b except select d from a)) as only_second""",
    "rebalance_buffer": f"with recursive {BUFFER.format(leave='floor(round(n * 0.4, 9))', extra='')} select 'long' as strategy, d, unnest(held) as ticker from walk join (select distinct t, d from rk) using (t)",
    "cost_band_buffer": f"with recursive {BUFFER.format(leave='floor(round(n * 0.4 * power(c.cost / quantile_cont(c.cost, 0.5) over (partition by rk1.d), 1e0 / 3), 9))', extra=' join dcost c using (ticker, d)').replace('rk as (select', f'{LIQ}, {SPR}, {COST}, rk as (select', 1)} select 'long' as strategy, d, unnest(held) as ticker from walk join (select distinct t, d from rk) using (t)",
    "turnover_attribution": f"""with recursive {BUFFER.format(leave='floor(round(n * 0.4, 9))', extra='')}, {regime('wk')}, {GATE},
hb as (select t, unnest(held) as ticker, 1e0 / len(held) as w from walk), hr as (select t, ticker, 1e0 / enter as w from rk where rank <= enter), ts as (select distinct t, d from rk),
mb as (select coalesce(a.t, b.t + 1) as t, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) as x from hb a full join hb b on b.t = a.t - 1 and b.ticker = a.ticker group by 1),
mr2 as (select coalesce(a.t, b.t + 1) as t, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) as x from hr a full join hr b on b.t = a.t - 1 and b.ticker = a.ticker group by 1),
j as (select ts.t, ts.d, mb.x, mr2.x as rx, coalesce(gate.panic, false) as panic from ts left join mb using (t) left join mr2 using (t) left join gate using (d)),
k as (select *, panic <> lag(panic, 1, false) over (order by d) as flip from j)
select {r6('sum(x)')} as buffered, {r6('sum(rx)')} as raw, {r6('1 - sum(x) / sum(rx)')} as removed_share, {r6('coalesce(sum(x) filter (where flip), 0)')} as at_flips, {r6('1 - coalesce(sum(x) filter (where flip), 0) / sum(x)')} as rotation_share, count(*) filter (where flip) as flips, count(*) as bars from k""",
    "shortable_mask": f"""with {WK}, {FO}, c as (select distinct d from wk), have as (select distinct d from fo), nm as (select distinct symbol as ticker from fo join wk on wk.d = fo.d and wk.ticker = fo.symbol),
f as (select distinct wk.ticker, fo.d from fo join wk on wk.d = fo.d and wk.ticker = fo.symbol)
select nm.ticker, c.d, coalesce((select exists (select 1 from f where f.ticker = nm.ticker and f.d = l.d) from (select max(h.d) as d from have h where h.d <= c.d) l where l.d is not null), false) as shortable from nm, c""",
    "shortable_coverage": f"""with {WK}, {FO}, have as (select distinct d from fo), {universe('wk', 10, 52, 13, 40)},
m as (select u.ticker, u.d, coalesce((select exists (select 1 from fo join wk on wk.d = fo.d and wk.ticker = fo.symbol where fo.symbol = u.ticker and fo.d = l.d) from (select max(h.d) as d from have h where h.d <= u.d) l where l.d is not null), false) as ok from u),
k as (select d, count(*) as n, count(*) filter (where ok) as s from m group by d) select year(d) as year, {r6('avg(n)')} as in_universe, {r6('avg(s)')} as shortable, {r6('avg(s / cast(n as double))')} as pct from k group by year(d)""",
    "short_book_coverage": f"""with {MOM}, h as (select ticker, d, row_number() over (partition by d order by score, ticker) as lo, greatest(1, floor(round(count(*) over (partition by d) * 0.3, 9))) as k from s where score is not null)
select d, count(*) as wanted, count(*) filter (where right(ticker, 1) in ('2', '4')) as borrowable, {r6("count(*) filter (where right(ticker, 1) in ('2', '4')) / cast(count(*) as double)")} as pct from h where lo <= k group by d""",
    "swap_rollup": f"""with {MOM}, {DEC}, {LIQ}, {SPR}, {regime('wk')}, {GATE}, {COST},
zs as (select ticker, d, (score - avg(score) over w) / nullif(stddev_samp(score) over w, 0) as z from s where score is not null window w as (partition by d)),
a as (select g.ticker, g.d, g.pos, zs.z, ln(lead(g.close, 5) over w / g.close) as r, h.ticker is not null as own, lag(h.ticker is not null, 1, false) over w as was from g left join zs on zs.ticker = g.ticker and zs.d = g.d left join (select ticker, d from (select *, greatest(1, floor(round(count(*) over (partition by d) * 0.2, 9))) as k2 from dk) where hi <= k2) h on h.ticker = g.ticker and h.d = g.d window w as (partition by g.ticker order by g.d)),
q as (select cal.d, not coalesce(gate.panic, false) as calm, not coalesce(lag(coalesce(gate.panic, false)) over (order by cal.d), true) as was from cal left join gate on gate.d = cal.d),
mvs as (select a.*, dcost.cost from a join q on q.d = a.d and q.calm and q.was left join dcost on dcost.ticker = a.ticker and dcost.d = a.d where own <> a.was and z is not null),
i as (select d, row_number() over (partition by d order by round(-z, 9), ticker) as k, z, r, cost from mvs where own), o as (select d, row_number() over (partition by d order by round(z, 9), ticker) as k, z, r, cost from mvs where not own),
p as (select i.z - o.z as zg, i.r - o.r as rg, (i.cost + o.cost) / 1e4 as c from i join o using (d, k)), pc2 as (select *, round(zg, 9) as zz, rg - c as net from p where zg is not null and rg is not null and c is not null),
e as (select quantile_cont(zz, [0.2, 0.4, 0.6, 0.8]) as e from pc2), b as (select *, 1 + len(list_filter(e.e, lambda v: zz > v)) as bucket from pc2, e)
select bucket, count(*) as n, {r6('avg(zg)')} as z_gap, {r6('avg(rg)')} as realised_gap, {r6('avg(c)')} as roundtrip_cost, {r6('avg(case when round(net, 12) > 0 then 1e0 else 0e0 end)')} as share_paid, {r6('avg(net)')} as mean_net from b group by bucket
union all select 0, count(*), {r6('avg(zg)')}, {r6('avg(rg)')}, {r6('avg(c)')}, {r6('avg(case when round(net, 12) > 0 then 1e0 else 0e0 end)')}, {r6('avg(net)')} from b""",
    "oracle_scales": f"""with {MOM}, {DEC}, b as (select d, sum(-sh * fwd) filter (where sh > 0) as leg from dw group by d), m as (select *, sum(leg) over (partition by date_trunc('month', d)) as m from b)
select d, 1e0 as always_on, 0e0 as always_off, case when coalesce(round(leg, 12), 0) >= 0 then 1e0 else 0e0 end as oracle_daily, case when round(m, 12) > 0 then 1e0 else 0e0 end as oracle_monthly from m""",
    "short_leg_value": f"""with {MOM}, {DEC}, w as (select d, fwd, l - sh as wt from dw), b as (select d, sum(wt * fwd) filter (where wt < 0) as s, sum(wt * fwd) filter (where wt > 0) as l, sum(wt * fwd) filter (where wt <> 0) as a from w group by d),
o as (select avg(s) / stddev_samp(s) * sqrt(52e0) as s, avg(l) / stddev_samp(l) * sqrt(52e0) as l, avg(a) / stddev_samp(a) * sqrt(52e0) as a, count(a) as n from b) select {r6('s')} as short, {r6('l')} as long, {r6('a')} as both_, n, {r6('a - l')} as added from o""",
    "trend_orthogonality": _ortho(),
    "tilt_table": _tilts(),
    "panel_count": f"""with {WK}, m as (select md5('close=' || cast(round(close * 1e6) as bigint) || '|d=' || d || '|ticker=' || ticker) as h from wk)
select count(*) as n, cast(sum(cast('0x' || substr(h, 1, 12) as bigint)) as varchar) as digest from m""",
    "reproduction": f"""with {WK}, rf as (select ticker, d, case when ticker like '%1' and d >= date '1995-01-01' then close * 3 else close end as ref from wk),
j as (select ticker, d, close, ref, close / lag(close) over w - 1 as r, ref / lag(ref) over w - 1 as q, abs((ref / close) / (lag(ref) over w / lag(close) over w) - 1) as lv from wk join rf using (ticker, d) window w as (partition by ticker order by d)),
k as (select *, abs(r - q) as far from j), o as (select ticker, count(far) as bars, {r6('corr(r, q)')} as corr, {r6('quantile_cont(far, 0.5)')} as median_diff, {r6('max(far)')} as largest_diff, count(*) filter (where round(far, 9) > 0.01) as n_material,
  coalesce(bool_or(round(far, 9) > 0.01 and abs(r) > 0.5), false) as ours_impossible, coalesce(bool_or(round(far, 9) > 0.01 and abs(q) > 0.5), false) as ref_impossible, {r6('avg(case when round(lv, 9) > 0.02 then 1e0 when lv is not null then 0e0 end)')} as drift from k group by ticker)
select *, ref_impossible or drift > 0.02 or bars < 100 as disqualified, not (ref_impossible or drift > 0.02 or bars < 100) and median_diff < 1e-4 as passes from o""",
}
for _name in ("weights_long_only", "weights_long_short", "weights_dynamic_tilt"):
    _calm = {"long_only": "l", "long_short": "l - sh", "dynamic_tilt": "1.3e0 * l - 0.3e0 * sh"}[ORACLES[_name]]
    _panic = "l - sh" if ORACLES[_name] == "dynamic_tilt" else "0e0"
    ORACLES[_name] = f"""with {WX}, {grid('wx')}, {scores()}, {DEC}, {regime('wx')}, {GATE}, b as (select dw.d, case when coalesce(panic, false) then {_panic} else {_calm} end as wt from dw left join gate on gate.d = dw.d)
select d, {r6('sum(wt)')} as net, {r6('sum(abs(wt))')} as gross, count(*) as names from b group by d"""

ORACLES |= {
    "psr_dsr": f"""with {judged(_BEST)} select strategy, n, {r6('ratio * sqrt(52e0)')} as sharpe, {r6(_phi('ratio * sqrt(n - 1) / dev'))} as psr, {r6(_phi('(ratio - held) * sqrt(n - 1) / dev'))} as dsr,
  case when ratio > held and 1 + (dev * qc / (ratio - held)) ** 2 < 1e6 then {r6('1 + (dev * qc / (ratio - held)) ** 2')} end as min_track from jd""",
    "frozen_benchmark": f"""with {judged('0.05e0')} select strategy, n, {r6('ratio * sqrt(52e0)')} as sharpe, {r6(_phi('ratio * sqrt(n - 1) / dev'))} as psr, {r6(_phi('(ratio - held) * sqrt(n - 1) / dev'))} as dsr from jd""",
    "required_ratio": f"""with {judged(_BEST)} select strategy, n, {r6('ratio * sqrt(52e0)')} as sharpe,
  {r6(_halving('(mid - held) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - skew * mid + (kurt - 1) / 4 * mid * mid)) >= qc', 'held', 'held + 5', 60) + ' * sqrt(52e0)')} as required from jd""",
}


def given_states(model, least: int) -> dict[str, str]:
    """The filter and the likeliest path of a model of two states and three axes, by recursion along the dates."""
    import numpy as np

    def log_density(j: int) -> str:
        inv, const = np.linalg.inv(np.array(model.covs[j])), float(np.linalg.slogdet(2 * np.pi * np.array(model.covs[j]))[1])
        e = [f"({c} - ({m!r}))" for c, m in zip("abc", model.means[j], strict=True)]
        return " - 0.5e0 * (" + " + ".join(f"({float(inv[x, y])!r}) * {e[x]} * {e[y]}" for x in range(3) for y in range(3)) + f" + ({const!r}))"

    (p0, p1), ((m00, m01), (m10, m11)) = model.start, model.move
    head = f"""with recursive {WX}, {grid('wx')}, {regime('wx')},
zg as (select d, {_z('mkt_ret', least)} as a, {_z('avg_corr', least)} as b, {_z('log_vol', least)} as c from ri0),
lp as (select d, row_number() over (order by d) as t, {log_density(0)} as l0, {log_density(1)} as l1 from zg where a is not null and b is not null and c is not null)"""
    grow = lambda a, b: f"({b}) * exp(l1 - greatest(l0, l1)) / (({a}) * exp(l0 - greatest(l0, l1)) + ({b}) * exp(l1 - greatest(l0, l1)))"
    return {
        "hmm_given": f"""{head}, f as (select t, d, {grow(p0, p1)} as high from lp where t = 1 union all
  select lp.t, lp.d, {grow(f'(1 - high) * {m00} + high * {m10}', f'(1 - high) * {m01} + high * {m11}')} from f join lp on lp.t = f.t + 1) select d, {r6('high')} as high_state from f""",
        "viterbi_path": f"""{head}, v as (select t, l0 + ln({p0}e0) as v0, l1 + ln({p1}e0) as v1, 0 as b0, 0 as b1 from lp where t = 1 union all
  select lp.t, l0 + greatest(v0 + ln({m00}e0), v1 + ln({m10}e0)), l1 + greatest(v0 + ln({m01}e0), v1 + ln({m11}e0)), (v1 + ln({m10}e0) > v0 + ln({m00}e0))::int, (v1 + ln({m11}e0) > v0 + ln({m01}e0))::int from v join lp on lp.t = v.t + 1),
w as (select t, (v1 > v0)::int as s from v where t = (select max(t) from lp) union all select w.t - 1, case when w.s = 0 then v.b0 else v.b1 end from w join v on v.t = w.t where w.t > 1)
select lp.d, cast(w.s as bigint) as state from w join lp using (t)""",
    }


def _six_days(days: str) -> str:
    return f"select d, bars, {', '.join(f'{r6(c)} as {c}' for c in ('gross', 'net', 'turnover', 'trade_cost', 'borrow_cost'))} from ({days})"


_CELLS = " union all ".join(f"select {m} as minutes, '{style}' as style, * from ({intraday(m, style)})" for m in (30, 60) for style in ("long_only", "long_short", "dynamic_tilt"))
ORACLES |= {f"execute_intraday_{m}m": _six_days(intraday(m, "dynamic_tilt")) for m in (30, 60)} | {
    "frequency_grid": f"""select minutes, style, {', '.join(f"{r6(f'case when stddev_samp({c}) > 0 then avg({c}) / stddev_samp({c}) * sqrt(252e0) else 0e0 end')} as {c}_sharpe" for c in ('gross', 'net'))}, {r6('avg(trade_cost)')} as day_cost, count(*) as days
  from ({_CELLS}) where net is not null group by all""",
}

_SHARPE = "avg({c}) / stddev_samp({c}) * sqrt(52e0)"
_LEGS = ("whole", "borrowable", "whole_book", "borrowable_book")
ORACLES |= {
    "universe_names_ever": f"with {DY}, {UNI} select year(d) as year, count(distinct ticker) as names, count(distinct d) as dates from u group by year(d) union all select 0, count(distinct ticker), count(distinct d) from u",
    "wide_marks": f"""with {WK}, r as (select ticker, d, floor(close * 4) / 4 as close, cast(date_trunc('month', d) as date) as month, high > low * 1.1 as moved from wk) select month,
  {', '.join(f"{r6(f"avg(close) filter (where ticker = 'Brand#{k}')")} as mean_{k}, {r6(f"arg_max(close, d) filter (where ticker = 'Brand#{k}')")} as last_{k}, bool_or(moved) filter (where ticker = 'Brand#{k}') as any_{k}" for k in (11, 22))} from r group by month""",
    "short_leg_borrowable": f"""with {MOM}, e as (select *, case when right(ticker, 1) in ('2', '4') then score end as ss from s where score is not null),
rk as (select d, fwd, greatest(1, floor(round(count(*) over (partition by d) * 0.3, 9))) as k, row_number() over (partition by d order by score desc, ticker) as hi, row_number() over (partition by d order by score, ticker) as lo,
  case when ss is not null then row_number() over (partition by d order by ss nulls last, ticker) end as lb from e),
w as (select d, fwd, case when hi <= k then 1e0 / k else 0e0 end as l, case when lo <= k then 1e0 / k else 0e0 end as sf, case when lb <= k then 1e0 / count(*) filter (where lb <= k) over (partition by d) else 0e0 end as sb from rk),
b as (select d, sum(-sf * fwd) filter (where sf > 0) as whole, sum(-sb * fwd) filter (where sb > 0) as borrowable, sum((l - sf) * fwd) filter (where l <> sf) as whole_book, sum((l - sb) * fwd) filter (where l <> sb) as borrowable_book from w group by d)
select {', '.join(f"{r6(_SHARPE.format(c=c))} as {c}" for c in _LEGS)}, count(borrowable) as n, {r6(f"{_SHARPE.format(c='whole')} - {_SHARPE.format(c='borrowable')}")} as leg_cost,
  {r6(f"{_SHARPE.format(c='whole_book')} - {_SHARPE.format(c='borrowable_book')}")} as book_cost from b""",
    "acceptance_gates": f"""with {WK}, ri as (select *, '' as isin from wk), {_ACTIONS}, {universe('wk', 10, 52, 13, 40)}, {lifecycle('wk', 20)},
dates as (select d, row_number() over (order by d) - 1 as pos from (select distinct d from wk)),
p as (select ticker, d, pos, close as raw, close * exp(la) as close, factor, lag(close) over w as raw1, lag(close * exp(la)) over w as c1, d - lag(d) over w as gap,
  case when ticker like '%1' and d >= date '1995-01-01' then close * 3 else close end as ref from adj join dates using (d) window w as (partition by ticker order by d)),
q as (select *, close / c1 - 1 as ret, ref / lag(ref) over w - 1 as rr, abs((ref / close) / lag(ref / close) over w - 1) as lv from p window w as (partition by ticker order by d)),
n as (select ticker, count(*) filter (where ret is not null and rr is not null) as bars, quantile_cont(abs(ret - rr), 0.5) as mid, quantile_cont(close, 0.5) as price, count(*) filter (where round(abs(ret - rr), 9) > 0.01) as material,
  count(*) filter (where round(abs(ret - rr), 9) > 0.01 and abs(ret) > 0.5) > 0 as ours, count(*) filter (where round(abs(ret - rr), 9) > 0.01 and abs(rr) > 0.5) > 0 as theirs,
  count(*) filter (where round(lv, 9) > 0.02) / cast(count(lv) as double) as drift from q group by ticker),
g1 as (select coalesce(avg(case when mid < greatest(1e-4, 3 * 0.05e0 / price) then 1e0 else 0e0 end), 0e0) as share, count(*) filter (where ours) as ours, coalesce(sum(material), 0) / cast(greatest(1, coalesce(sum(bars), 0)) as double) as apart
  from n where not (theirs or drift > 0.02 or bars < 100)),
m as (select ticker, pos, lag(pos) over (partition by ticker order by pos) as was from u),
g5 as (select coalesce(max(abs((close / c1) / (raw / raw1) - 1)) filter (where factor is null), 0e0) as worst from p),
g6 as (select count(*) as n from q semi join u using (ticker, d) where abs(ret) > 0.5 and gap <= 7 and ticker <> 'Brand#11'
  and not exists (select 1 from act join dates using (d) where act.ticker = q.ticker and abs(dates.pos - q.pos) <= 3)),
o(gate, metric, value, passes) as (
  select 1, 'share_of_names', share, round(share, 9) >= 0.95 from g1 union all select 1, 'ours_impossible', ours, ours = 0 from g1 union all select 1, 'disagreement', apart, round(apart, 9) <= 0.001 from g1
  union all select 2, 'names', count(*), null from lf union all select 2, 'left', count(*) filter (where kind <> 'live'), null from lf union all select 2, 'suspended', count(*) filter (where suspended), null from lf
  union all select 3, 'actions', count(*), null from act union all select 3, 'to_review', count(*) filter (where abs(round(ratio / factor - 1, 9)) > 0.05), null from act
  union all select 4, 'returns', count(ret), null from q union all select 4, 'extreme', count(*) filter (where abs(round(ret, 9)) > 0.4), null from q
  union all select 5, 'returns_changed_by', round(worst, 6), worst < 1e-9 from g5 union all select 5, 'members_too_early', count(*) filter (where pos < 52), count(*) filter (where pos < 52) = 0 from m
  union all select 5, 'changes_off_selection', count(*) filter (where was is distinct from pos - 1 and (pos - 52) % 13 <> 0), count(*) filter (where was is distinct from pos - 1 and (pos - 52) % 13 <> 0) = 0 from m
  union all select 6, 'unexplained', n, n = 0 from g6)
select gate, metric, {r6('cast(value as double)')} as value, passes from o""",
}
