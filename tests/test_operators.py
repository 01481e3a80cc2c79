"""Operators with planted answers, where no SQL gives one."""

import datetime
import math
import random
import statistics
import zipfile
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tessera.functions import columns, normal
from tessera.operators import attribution, buffers, corporate, evaluation, features, learning, panel, portfolio, regime, trees, universe
from tessera.plans import catalog
from tessera.sinks import tables
from tessera.sources import bars, files

D = datetime.date(2024, 1, 1)


def day(k):
    return D + datetime.timedelta(days=k)


def banded(spark, rows, enter, leave):
    return spark.createDataFrame(rows, "strategy string, d int, ticker string, rank int").withColumns({"enter": F.lit(enter), "leave": F.lit(leave)})


def held_by_day(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.d, set()).add(r.ticker)
    return out


def test_buffer_keeps_incumbents(spark):
    rows = [("s", d, t, r) for d, order in enumerate(["abcd", "bcad", "dcba"]) for r, t in enumerate(order, 1)]
    assert held_by_day(buffers.rebalance_buffer(banded(spark, rows, 2, 3))) == {0: {"a", "b"}, 1: {"a", "b"}, 2: {"b", "d"}}
    assert held_by_day(buffers.rebalance_buffer(banded(spark, rows, 2, 2))) == {0: {"a", "b"}, 1: {"b", "c"}, 2: {"d", "c"}}


def test_bands(spark):
    rows = spark.createDataFrame([("s", 0, f"n{k}", float(k)) for k in range(20)], "strategy string, d int, ticker string, score double")
    (w,) = buffers.widths(rows, 0.1, 9.0).select("enter", "leave").distinct().collect()
    assert tuple(w) == (2, 10)  # not beyond half of the names
    same = buffers.cost_scaled(buffers.widths(rows, 0.1, 2.0).withColumn("cost", F.lit(5.0)), 2.0, 0.1)
    assert {r.leave for r in same.collect()} == {4}


def test_swaps_as_brute_force(spark):
    r = random.Random(6)
    drift = [r.gauss(0, 3) for _ in range(40)]
    rows = []
    for d in range(30):
        names = [t for t in range(40) if r.random() < 0.9]
        value = {t: round(drift[t] + r.gauss(0, 1), 3) for t in names}
        for k, t in enumerate(sorted(names, key=lambda t: -value[t] + 0.3 * r.gauss(0, 1)), 1):
            rows.append(("s", d, f"n{t:02d}", k, 4, 8, None if d < 3 else value[t], r.choice([0.0, 2000.0, 5000.0])))
    df = spark.createDataFrame(rows, "strategy string, d int, ticker string, rank int, enter int, leave int, value double, cost double")
    held, want = [], {}
    for d in range(30):  # over all rows, as a list of cases
        now = {x[2]: x for x in rows if x[1] == d}
        stay = sorted((t for t in held if t in now and now[t][3] <= 8), key=lambda t: now[t][3])[:4]
        fresh = [t for t in sorted(now, key=lambda t: now[t][3]) if now[t][3] <= 4 and t not in stay]
        if d < 3:
            held = stay + fresh[: 4 - len(stay)]
        else:
            out = sorted((t for t in held if t in now and t not in stay), key=lambda t: -now[t][6])[: 4 - len(stay)]
            empty = 4 - len(stay) - len(out)
            book, rest = stay + fresh[:empty], [t for t in fresh[empty:] if t not in out]
            for old in reversed(out):
                if rest:
                    new = rest.pop(0)
                    if round(now[new][6] - now[old][6] - (now[new][7] + now[old][7]) / 1e4, 12) > 0:
                        book.append(new)
                        continue
                if old not in book:
                    book.append(old)
            held = book
        want[d] = set(held)
    assert held_by_day(buffers.swap_if_pays(df)) == want


def test_styles_and_costs(spark):
    assert portfolio.Costs().one_way() == pytest.approx(14.6558)
    assert portfolio.style_of("long_short_slb") == ("long_short", True)
    with pytest.raises(ValueError):
        portfolio.style_of("sideways")
    legs = spark.createDataFrame([(0, "a", 1.0, 0.0), (0, "b", 0.0, 1.0), (1, "a", 1.0, 0.0), (1, "b", 0.0, 1.0)], "d int, ticker string, l double, sh double")
    gate = spark.createDataFrame([(0, False), (1, True)], "d int, panic boolean")
    total = lambda style: {r.d: (round(r.n, 9), round(r.g, 9)) for r in portfolio.styled(legs, style, gate).groupBy("d").agg(F.sum("wt").alias("n"), F.sum(F.abs("wt")).alias("g")).collect()}
    assert total("long_only") == {0: (1.0, 1.0), 1: (0.0, 0.0)} and total("long_short") == {0: (0.0, 2.0), 1: (0.0, 0.0)} and total("dynamic_tilt") == {0: (1.0, 1.6), 1: (0.0, 2.0)}


def test_caps(spark):
    caps = [(0, "a", 0.25, 0.1), (0, "b", 0.25, 0.3), (0, "c", 0.25, None), (0, "d", 0.25, 0.9), (1, "a", 0.5, 0.2), (1, "b", 0.5, 0.3)]
    got = {(r.d, r.ticker): round(r.w, 9) for r in portfolio.cap_leg(spark.createDataFrame(caps, "d int, ticker string, w double, cap double"), "w", "cap").collect()}
    assert got == {(0, "a"): 0.1, (0, "b"): 0.3, (0, "c"): 0.3, (0, "d"): 0.3, (1, "a"): 0.2, (1, "b"): 0.3}


def test_psr_and_dsr(spark):
    r = random.Random(3)
    rows = [(s, r.gauss(m, 0.01)) for s, m in (("a", 0.001), ("bb", 0.0003), ("c", -0.0002)) for _ in range(300)]
    got = {g.strategy: g for g in evaluation.deflated_sharpe(spark.createDataFrame(rows, "strategy string, ret double"), 10).collect()}
    ratios = {}
    for s in ("a", "bb", "c"):
        x = [v for k, v in rows if k == s]
        m = sum(x) / 300
        c = [sum((v - m) ** p for v in x) / 300 for p in (2, 3, 4)]
        ratios[s] = (m / math.sqrt(c[0] * 300 / 299), c[1] / c[0] ** 1.5, c[2] / c[0] ** 2)
    mean = sum(x[0] for x in ratios.values()) / 3
    spread = math.sqrt(sum((x[0] - mean) ** 2 for x in ratios.values()) / 2)
    n, g = NormalDist(), 0.5772156649015329
    best = spread * ((1 - g) * n.inv_cdf(0.9) + g * n.inv_cdf(1 - 1 / (10 * math.e)))
    for s, (x, skew, kurt) in ratios.items():
        dev = math.sqrt(1 - skew * x + (kurt - 1) / 4 * x * x)
        assert got[s].psr == pytest.approx(n.cdf(x * math.sqrt(299) / dev)) and got[s].dsr == pytest.approx(n.cdf((x - best) * math.sqrt(299) / dev))
        need = 1 + (dev * n.inv_cdf(0.95) / (x - best)) ** 2 if x > best else math.inf
        assert got[s].min_track == pytest.approx(need)
    one = evaluation.deflated_sharpe(spark.createDataFrame(rows, "strategy string, ret double"), 1).collect()
    assert all(abs(r.psr - r.dsr) < 1e-12 for r in one)
    at = evaluation.required_sharpe(300, 0.0, 3.0, 0.05)
    assert evaluation.probabilistic_sharpe(at, 300, 0.0, 3.0, 0.05) == pytest.approx(0.95)


SHALLOW = {"boosted": trees.Shape(depth=4, least=2), "forest": trees.Shape(depth=4, least=2)}


def test_future_does_not_reach_the_scores(spark):
    r = random.Random(4)
    rows = [(day(d), f"n{t}", x, 0.5 * x + 0.1 * r.random()) for d in range(60) for t in range(12) for x in [2 * r.random() - 1]]
    df = spark.createDataFrame(rows, "d date, ticker string, x double, y double")
    score = lambda frame: {(g.d, g.ticker): g.score for g in learning.walk_forward(frame, ["x"], "y", train=20, test=10, rounds=3, rate=0.5, many=3, **SHALLOW).collect()}
    base = score(df)
    other = score(df.withColumn("y", F.when(F.col("d") < day(40), F.col("y")).otherwise(-F.col("y"))))
    assert all(other[k] == v for k, v in base.items() if k[0] < day(40)) and any(other[k] != v for k, v in base.items() if k[0] >= day(50))
    assert {k[0] for k in base} == {day(k) for k in range(20, 60)}
    labels = df.select("d", "ticker", F.col("y").alias("fwd"))
    ic = {g.model: g.mean for g in learning.learner_ics(learning.walk_forward(df, ["x"], "y", train=20, test=10, rounds=3, rate=0.5, many=3, **SHALLOW), labels).collect()}
    assert min(ic.values()) > 0.8


def test_hidden_states_are_found(spark):
    r = random.Random(8)
    state, rows = 0, []
    for k in range(240):
        state = 1 - state if r.random() < 0.03 else state
        rows.append((day(k), r.gauss(0, 1), r.gauss(3.0 if state else -3.0, 1.0), state))
    df = spark.createDataFrame(rows, "d date, a double, b double, truth int")
    got = regime.hmm_filter(df, ["a", "b"], train=120, test=30, rounds=40)
    both = got.join(df, "d").collect()
    assert len(both) == 120 and sum((x.high_state > 0.5) == bool(x.truth) for x in both) >= 110
    cut = regime.hmm_filter(df.where(F.col("d") < str(day(200))), ["a", "b"], train=120, test=30, rounds=40).collect()
    whole = {x.d: x.high_state for x in both}
    assert all(whole[x.d] == pytest.approx(x.high_state) for x in cut)  # what comes later changes nothing


def test_chain(spark):
    rows = [("INE000101011", 1, 5), ("INE000101029", 4, 6), ("INE000101037", 6, 9), ("INE999901011", 1, 2)]
    got = dict(map(tuple, buffers.chained_ids(spark.createDataFrame(rows, "isin string, first int, last int")).collect()))
    assert got == {"INE000101011": "INE000101011", "INE000101029": "INE000101029", "INE000101037": "INE000101011", "INE999901011": "INE999901011"}


def test_actions_of_planted_names(spark):
    rows = []
    for name in ("split", "crash", "reissue", "quiet"):
        for k in range(40):
            price, turn, isin = 100.0 + k % 3, 1000.0, f"{name}1"
            if name == "split" and k >= 20:
                price *= 0.1
            if name == "crash" and k >= 20:
                price, turn = price * 0.5, 1000.0 if k > 22 else 90_000.0
            if name == "reissue" and k >= 20:
                price, turn = price * 0.5, 1000.0 if k > 22 else 90_000.0
                isin = f"{name}2" if k >= 21 else isin
            rows.append((name, day(k), isin, price, turn / price, turn))
    bars = spark.createDataFrame(rows, "ticker string, d date, isin string, close double, volume double, turnover double")
    got = {r.ticker: (r.d, r.factor, r.witness) for r in corporate.action_ledger(bars).collect()}
    assert got == {"split": (day(20), 0.1, "turnover"), "reissue": (day(20), 0.5, "isin_reissue")}
    adjusted = corporate.back_adjusted(bars)
    assert corporate.returns_preserved(adjusted).first().preserved
    first = {r.ticker: r.close for r in adjusted.where(F.col("d") == str(D)).collect()}
    assert first == pytest.approx({"split": 10.0, "crash": 100.0, "reissue": 50.0, "quiet": 100.0})


def test_digest_and_empty_mask(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1.5)], "k int, s string, v double")
    same, other = df.orderBy(F.desc("k")), df.fillna(0.0)
    get = lambda x: panel.digest(x, ["k", "s", "v"]).first().digest
    assert get(df) == get(same) != get(other)
    with pytest.raises(ValueError):
        features.require_rows(df.limit(0), "the mask")


def test_scramble_is_felt_after_only(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(20)], "d int, x double")
    got = {r.d: r.x for r in attribution.scrambled(df, ["x"], F.col("d") >= 10).collect()}
    assert all(got[k] == k for k in range(10)) and any(got[k] != k for k in range(10, 20))


def test_streamed_bars(spark, tmp_path):
    from tessera.streaming.bars import streamed_bars

    rows = [(k, datetime.datetime(2024, 1, 1, 9, 15) + datetime.timedelta(minutes=7 * k), "a" if k % 2 else "b", float(k % 5)) for k in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, ticker string, px double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, ts timestamp, ticker string, px double").parquet(f"{tmp_path}/in")
    q = streamed_bars(stream).writeStream.outputMode("append").format("memory").queryName("bars").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from bars")
    assert got.count() > 5 and got.where(F.minute("window.start") % 30 != 15).count() == 0


def test_archives(spark, tmp_path):
    def put(folder, name, text):
        (tmp_path / folder).mkdir(exist_ok=True)
        with zipfile.ZipFile(tmp_path / folder / name, "w") as z:
            z.writestr("x.csv", text)

    head = "SYMBOL,SERIES,OPEN,HIGH,LOW,LAST,CLOSE,TOTTRDQTY,TOTTRDVAL,ISIN"
    put("old", "cm02JAN2024bhav.csv.zip", f"{head}\nAAA,EQ,1,2,1,2,1.5,10,15,INE001A01011\nBBB,EQ,1,2,1,0,1,1,1,INE002A01019\nCCC,GB,1,1,1,1,1,1,1,INE003A01017\nDDD,EQ,1,1,1,1,1,1,1,INE004A02015\n")
    (tmp_path / "old" / "broken.zip").write_bytes(b"no zip")
    new = "TckrSymb,SctySrs,OpnPric,HghPric,LwPric,LastPric,ClsPric,TtlTradgVol,TtlTrfVal,ISIN,FinInstrmTp"
    put("new", "cm_20240703_F.zip", f"{new}\nAAA,EQ,1,2,1,3,1.5,10,15,INE001A01011,STK\nFUT,EQ,1,2,1,3,1.5,10,15,INE009A01011,FUT\n")
    got, bad = files.exchange_archives(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    assert sorted((r.symbol, str(r.d), r.close, r.close_vwap) for r in got.collect()) == [("AAA", "2024-01-02", 2.0, 1.5), ("AAA", "2024-07-03", 3.0, 1.5)]
    assert [r.file for r in bad.collect()] == ["broken.zip"]
    put("fo", "fo02JAN2024bhav.csv.zip", "INSTRUMENT,SYMBOL\nFUTSTK,aaa \nOPTSTK,BBB\n")
    put("fo", "fo_20240703.zip", "FinInstrmTp,TckrSymb\nSTF,CCC\n")
    assert sorted((str(r.d), r.symbol) for r in files.traded_futures(spark, str(tmp_path / "fo")).collect()) == [("2024-01-02", "AAA"), ("2024-07-03", "CCC")]


def test_csv_binds_by_header(spark, tmp_path):
    (tmp_path / "AAA_15m.csv").write_text("timestamp,close,open,high,low,volume\n2024-01-01 09:15:00,x,1,2,1,5\n2024-01-01 09:30:00,1.5,1,2,0.5,5\n2024-01-01 09:30:00,1.7,1,2,0.5,6\n")
    (tmp_path / "NIFTY.csv").write_text("timestamp,open,high,low,close,volume\n2024-01-01 09:15:00,1,2,1,9,5\n")
    (tmp_path / "BAD.csv").write_text("timestamp,open\n1,2\n")
    assert [(r.ticker, r.close, r.low) for r in files.symbol_csv(spark, str(tmp_path), "stocks").collect()] == [("AAA", 1.7, 0.5)]
    assert [r.ticker for r in files.symbol_csv(spark, str(tmp_path), "indices").collect()] == ["NIFTY"]


def test_index_files(spark, tmp_path):
    text = "Index Name,Open Index Value,High Index Value,Low Index Value,Closing Index Value,Div Yield\nNifty Bank,1,1,1,1,1\n CNX Nifty ,10,12,9,{c},{y}\nNIFTY 50,0,0,0,0,0\n"
    (tmp_path / "ind_close_all_02012024.csv").write_text(text.format(c=11, y=1.3))
    (tmp_path / "ind_close_all_03012024.csv").write_text(text.format(c=12, y=9.9))
    assert sorted((str(r.d), r.close) for r in files.index_series(spark, str(tmp_path)).collect()) == [("2024-01-02", 11.0), ("2024-01-03", 12.0)]
    assert [(str(r.d), r.y) for r in files.index_yields(spark, str(tmp_path)).collect()] == [("2024-01-02", 1.3)]


def test_registry_and_gate(spark, tmp_path):
    known = files.registry(str(tmp_path))
    with pytest.raises(ValueError):
        files.frequency(known, "weekly")
    spark.createDataFrame([("a", day(0), 1.0)], "ticker string, timestamp date, close double").write.parquet(known["daily"].path)
    assert files.load_bars(spark, known, "daily").columns == ["ticker", "date", "close"]
    with pytest.raises(FileNotFoundError):
        files.cost_panels(spark, str(tmp_path))
    wide = spark.createDataFrame([(day(0), None, 1.0), (day(1), 2.0, 1.0), (day(2), None, 3.0)], "date date, a double, b double")
    assert sorted((r.date, r.ticker, r.close) for r in files.quality_gate(wide, ["a", "b"]).collect()) == [(day(1), "a", 2.0), (day(1), "b", 1.0), (day(2), "a", 2.0), (day(2), "b", 3.0)]
    with pytest.raises(ValueError):
        files.quality_gate(wide.fillna(0.0), ["a", "b"])
    with pytest.raises(ValueError):
        files.quality_gate(wide, ["a", "c"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(day(0), 0.1), (day(1), 0.2)], "d date, ret double")
    assert tables.write_checked(df, f"{tmp_path}/t").count() == 2
    at = f"{tmp_path}/ledger"
    tables.upsert_ledger(df, "one", at)
    tables.upsert_ledger(df.withColumn("ret", -F.col("ret")), "two", at)
    late = spark.createDataFrame([(day(1), 0.5), (day(9), 0.7)], "d date, ret double")
    out = tables.upsert_ledger(late, "one", at, align=True)
    assert sorted((r.strategy, r.d, r.ret) for r in out.collect() if r.ret is not None) == [("one", day(1), 0.5), ("two", day(0), -0.1), ("two", day(1), -0.2)]
    assert tables.wide_ledger(out, ["one", "two"]).count() == 2
    tables.append_union(spark.createDataFrame([(1, 2)], "a int, b int"), f"{tmp_path}/u")
    both = tables.append_union(spark.createDataFrame([(3, 4)], "a int, c int"), f"{tmp_path}/u")
    assert sorted((r.a, r.b, r.c) for r in both.collect()) == [(1, 2, None), (3, None, 4)]
    rows = spark.createDataFrame([(s, (k % 7 - 2.8) / 100) for s in ("a", "b") for k in range(60)], "strategy string, ret double")
    assert tables.write_verdicts(rows, f"{tmp_path}/v", 5).count() == 2
    with pytest.raises(ValueError):
        tables.write_verdicts(rows, f"{tmp_path}/w", 1)
    assert tables.reuse(df, "key", f"{tmp_path}/cache").count() == 2
    assert tables.reuse(df.limit(0), "key", f"{tmp_path}/cache").count() == 2


def test_normal_expressions(spark):
    n = NormalDist()
    xs = [-38.0, -9.0, -7.08, -7.0, -3.3, -1.0, -1e-9, 0.0, 0.5, 1.96, 5.5, 7.2, 37.0, 100.0]
    for x, got in spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal.cdf(F.col("x"))).collect():
        assert got == pytest.approx(n.cdf(x), rel=1e-12, abs=1e-15) or x < -37
    ps = [1e-300, 1e-16, 1e-9, 0.001, 0.074, 0.075, 0.3, 0.5, 0.92, 0.95, 1 - 1e-9]
    for p, got in spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal.inverse(F.col("p"))).collect():
        assert got == pytest.approx(n.inv_cdf(p), rel=1e-12, abs=1e-13)
    edge = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (None,)], "p double").select(normal.inverse(F.col("p")).alias("v"), normal.cdf(F.col("p")).alias("c")).collect()
    assert all(r.v is None for r in edge) and edge[3].c is None


def test_required_ratios_reach_the_confidence(spark):
    r = random.Random(11)
    rows = [(s, r.gauss(m, 0.01)) for s, m in (("a", 0.001), ("b", 0.0)) for _ in range(200)] + [("c", 0.1)]
    for x in evaluation.required_ratios(spark.createDataFrame(rows, "strategy string, ret double"), 10, year=1, benchmark=0.02).collect():
        if x.strategy == "c":
            assert x.required is None
            continue
        v = [b for a, b in rows if a == x.strategy]
        m = sum(v) / len(v)
        c = [sum((y - m) ** p for y in v) / len(v) for p in (2, 3, 4)]
        assert evaluation.probabilistic_sharpe(x.required, len(v), c[1] / c[0] ** 1.5, c[2] / c[0] ** 2, 0.02) == pytest.approx(0.95)


def test_gates_of_a_planted_panel(spark):
    """A is clean, B splits two for one on day 100, C stops on day 150, D nearly doubles on day 120 under a turnover that explains nothing."""
    close, rows = {}, []
    for k in range(200):
        for name in "ABCD":
            whole = 100 * 1.001**k * (0.999 if k % 2 else 1) * (1.9 if name == "D" and k >= 120 else 1)
            close[name, k] = whole * (0.5 if name == "B" else 1)
            raw = whole * (0.5 if name == "B" and k >= 100 else 1)
            if name != "C" or k < 150:
                rows.append((name, day(k), raw, 1e6 / raw, 1e8 if name == "D" and k == 120 else 1e6))
    bars = spark.createDataFrame(rows, "ticker string, d date, close double, volume double, turnover double").cache()
    frame = lambda rows, schema="ticker string, d date": spark.createDataFrame(rows, schema)
    same = [(n, day(k), c) for (n, k), c in close.items() if n != "C" or k < 150]
    members = [(n, d) for n, d, *_ in rows if d >= day(52)]

    def judged(reference, mask, register):
        got = corporate.gates(bars, frame(reference, "ticker string, d date, close double"), frame(mask), frame(register), lookback=52, every=13)
        return {(g.gate, g.metric): (round(g.value, 9), g.passes) for g in got.collect()}

    returns = 3 * 199 + 149
    want = {
        (1, "share_of_names"): (1, True), (1, "ours_impossible"): (0, True), (1, "disagreement"): (0, True), (2, "names"): (4, None), (2, "left"): (1, None), (2, "suspended"): (0, None),
        (3, "actions"): (1, None), (3, "to_review"): (0, None), (4, "returns"): (returns, None), (4, "extreme"): (1, None), (5, "returns_changed_by"): (0, True),
        (5, "members_too_early"): (0, True), (5, "changes_off_selection"): (0, True), (6, "unexplained"): (1, False),
    }
    assert judged(same, members, []) == want
    assert judged(same, members, [("D", day(120))]) == want | {(6, "unexplained"): (0, True)}
    assert judged(same, [m for m in members if m[0] != "D"], []) == want | {(6, "unexplained"): (0, True)}
    # A's reference is 3 % off on one day: two of its returns differ
    off = [(n, d, c * (1.03 if n == "A" and d == day(50) else 1)) for n, d, c in same]
    assert judged(off, members, []) == want | {(1, "disagreement"): (round(2 / returns, 9), False)}
    # a reference that misses B's split has an impossible return of its own: B is no judge, the other three pass
    assert judged([(n, d, c * (2 if n == "B" and d < day(100) else 1)) for n, d, c in same], members, [])[1, "share_of_names"] == (1, True)
    # a member before the first selection, who leaves between two
    assert judged(same, [*members, ("A", day(10))], []) == want | {(5, "members_too_early"): (1, False), (5, "changes_off_selection"): (1, False)}
    # ours jumps where the reference doesn't: D is impossible in ours
    calm = [(n, d, c / (1.9 if n == "D" and d >= day(120) else 1)) for n, d, c in same]
    assert judged(calm, members, [])[1, "ours_impossible"] == (1, False)
    bars.unpersist()


@pytest.mark.parametrize("style", ["long_only", "dynamic_tilt"])
def test_costs_by_name_are_flat_without_spread_and_rise_with_it(spark, style):
    """Without spread and impact the costs by name are the flat rate on the turnover; each half-spread stepped in lowers every net return
    by its part of the turnover, and changes nothing else."""
    wx = bars.stored(spark, "/root/testdata/sf0.001", "wx")
    panel_, gate = catalog.execution_panel(wx).withColumn("sigma", F.lit(0.0)), regime.known_before(catalog.gate_of(wx))
    runs = {s: {r.d: r for r in portfolio.execute(panel_.withColumn("cs", F.lit(s)), style, gate, costs=catalog.COSTS).collect()} for s in (0.0, 4.0, 15.0)}
    flat, traded = catalog.COSTS.one_way(), 0
    for d, free in runs[0.0].items():
        assert free.trade_cost == pytest.approx(free.turnover * flat / 1e4, abs=1e-12)
        for low, high in ((0.0, 4.0), (4.0, 15.0)):
            a, b = runs[low][d], runs[high][d]
            assert (a.gross, a.turnover, a.borrow_cost) == pytest.approx((b.gross, b.turnover, b.borrow_cost), abs=1e-12) if a.gross is not None else b.gross is None
            if a.net is not None:
                assert a.net - b.net == pytest.approx(a.turnover * (high - low) / 1e4, abs=1e-9)
                traded += a.turnover > 0 and b.net < a.net
    assert traded > 50


def test_snapped_is_the_nearest_of_the_grid(spark):
    """A row is compared with the ratios of its slot, not with all: the same as the whole grid gives, also beside the middles of its steps."""
    grid = corporate.ratio_grid()
    middles = [(a * b) ** 0.5 for a, b in zip(grid, grid[1:])]
    values = [round(x * (1 + e), 9) for x in [*grid, *middles] for e in (0, 1e-3, -1e-3, 1e-8, -1e-8, 0.12, -0.12)] + [0.0, -1.0, 1e-5, 200.0]

    def nearest(r):
        if r <= 0:
            return None
        x = min(grid, key=lambda g: (round(abs(math.log(r / g)), 9), g))
        return x if abs(r / x - 1) <= 0.1 else None

    df = spark.createDataFrame([(v,) for v in values], "r double")
    got = df.select("r", corporate.snapped(F.col("r"), 0.1).alias("x"))
    assert all(x == nearest(r) for r, x in map(tuple, got.collect()))
    bars = spark.createDataFrame([], "ticker string, d date, isin string, close double, volume double, turnover double")
    plan = corporate.action_ledger(bars)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_min" not in plan and "percentile" not in plan


def test_full_windows(spark):
    """Frames put together from powers of two: the same as frames of n rows, null unless all rows have a value, and no frame of n rows."""
    rng = random.Random(5)
    rows = [(t, day(k), None if t == "b" and k == 30 else rng.choice([7.0, 1e9 + rng.random(), rng.random()]) if t != "c" else 0.1) for t in "abc" for k in range(70)]
    df = spark.createDataFrame(rows, "ticker string, d date, x double")
    wanted = {f"{how}_{n}": (how, "x", n) for how in ("mean", "max", "var") for n in (1, 2, 5, 20, 32, 63) if (how, n) != ("var", 1)}
    out = columns.full_windows(df, wanted)
    ways = {"mean": statistics.fmean, "max": max, "var": statistics.variance}
    series = {t: [x for s, _, x in rows if s == t] for t in "abc"}
    for r in out.collect():
        at = (r.d - day(0)).days
        for name, (how, _, n) in wanted.items():
            part = series[r.ticker][at - n + 1 : at + 1] if at >= n - 1 else [None]
            want = None if None in part else ways[how](part)
            assert r[name] == (want if want is None else pytest.approx(want, rel=1e-12, abs=1e-18)), (r.ticker, at, name)
    bars = spark.createDataFrame([], "ticker string, d date, high double, low double, close double, volume double")
    plan = features.features(bars)._jdf.queryExecution().optimizedPlan().toString()
    assert "-251" not in plan and "-199" not in plan


def test_ranks_in_batches_are_those_of_windows(spark):
    rng = random.Random(6)
    rows = [(t, day(k), rng.choice([None, float("nan"), -0.0, 0.0, 1.5, rng.random()]), rng.random()) for k in range(40) for t in range(1 if k == 3 else 2 * k + 1)]
    df = spark.createDataFrame(rows, "ticker int, d date, x double, y double")
    want = df.withColumns({c: F.round(c, 9) for c in "xy"})
    want = sorted(map(tuple, want.select("ticker", "d", *[columns.unit_rank(c, "d").alias(c) for c in "xy"]).collect()))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "10000"):  # dates of several batches, batches of several dates
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = features.rank_normalised(df, ["x", "y"])
            assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_selections_with_any_lookback(spark):
    """Lookbacks that are no multiple of the step; a bar is moved once, before it goes to each selection."""
    rng = random.Random(7)
    rows = [(t, day(k), rng.choice([0.0, rng.random(), 2.0])) for t in range(12) for k in range(60) if rng.random() < 0.8]
    bars = spark.createDataFrame(rows, "ticker int, d date, turnover double")
    dates = sorted({d for _, d, _ in rows})
    sets = {}
    for r in range(17, len(dates), 7):
        seen = set(dates[r - 17 : r])
        by = {t: [x for s, d, x in rows if s == t and d in seen and x > 0] for t in range(12)}
        sets[r] = {t for _, t in sorted((-round(statistics.median(v), 6), t) for t, v in by.items() if len(v) >= 8)[:4]}
    how = {"top": 4, "lookback": 17, "every": 7, "least": 8}
    got = {}
    for r, t in map(tuple, universe.selections(bars, **how).collect()):
        got.setdefault(r, set()).add(t)
    assert got == {r: v for r, v in sets.items() if v}
    churn = {r.pos: (r.names, r.entered, r.churn) for r in universe.churn(bars, **how).collect()}
    assert churn == {r: (len(v), len(v - sets[r - 7]), len(v - sets[r - 7]) / len(v)) for r, v in sets.items() if v and sets.get(r - 7)}
    plan = universe.churn(bars, **how)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and plan.count("LogicalRDD") <= 2  # the bars, and their calendar
