"""Ingestion that goes on where it ended, and results reused by content."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sinks import tables
from tessera.sources import files
from tessera.streaming import ingest

OLD = "SYMBOL,SERIES,OPEN,HIGH,LOW,LAST,CLOSE,TOTTRDQTY,TOTTRDVAL,ISIN"
NEW = "TckrSymb,SctySrs,OpnPric,HghPric,LwPric,LastPric,ClsPric,TtlTradgVol,TtlTrfVal,ISIN,FinInstrmTp"


def row(symbol, close, kind="", isin="INE001A01011"):
    return f"{symbol},EQ,1,2,1,{close},1.5,10,15,{isin}{kind}"


def test_three_runs_over_a_growing_folder(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    table, at = str(tmp_path / "out"), str(tmp_path / "at")

    def put(name, text, inside="a.csv"):
        with zipfile.ZipFile(folder / name, "w") as z:
            z.writestr(inside, text)

    read = []
    take = ingest._take
    monkeypatch.setattr(ingest, "_take", lambda f, *a: (read.extend(sorted(x.path.rsplit("/", 1)[-1] for x in f.select("path").collect())), take(f, *a))[1])
    run = lambda: ingest.ingest(spark, str(folder), table, checkpoint=at, files_at_once=2)
    bad = lambda: {(x.file, x.reason) for x in spark.read.parquet(table + "-bad").collect()}
    have = lambda: sorted((str(x.d), x.symbol, x.close) for x in ingest.ingested(spark, table).collect())

    put("cm02JAN2024bhav.csv.zip", f"{OLD}\n{row('AAA', 2)}\n{row('GOV', 2, isin='INF001A01011')}\n")
    (folder / "cm03JAN2024bhav.csv.zip").write_bytes(b"no archive")
    put("cm04JAN2024bhav.csv.zip", "A,B\n1,2\n")
    run()
    assert have() == [("2024-01-02", "AAA", 2.0)] and bad() == {("cm03JAN2024bhav.csv.zip", "not an archive"), ("cm04JAN2024bhav.csv.zip", "unknown header")}
    put("cm_20240703_F.zip", f"{NEW}\n{row('AAA', 3, ',STK')}\n{row('FUT', 3, ',FUT', 'INE009A01011')}\n")
    put("nothing.zip", "x", inside="a.txt")
    run()
    assert have() == [("2024-01-02", "AAA", 2.0), ("2024-07-03", "AAA", 3.0)] and len(bad()) == 3 and ("nothing.zip", "no CSV inside") in bad()
    once = list(read)
    put("cm03JAN2024bhav.csv.zip", f"{OLD}\n{row('AAA', 2.5)}\n")
    later = os.path.getmtime(folder / "cm03JAN2024bhav.csv.zip") + 5
    os.utime(folder / "cm03JAN2024bhav.csv.zip", (later, later))
    put("undated.zip", f"{OLD}\n{row('AAA', 9)}\n")
    run()
    assert have() == [("2024-01-02", "AAA", 2.0), ("2024-01-03", "AAA", 2.5), ("2024-07-03", "AAA", 3.0)]
    assert bad() == {("cm04JAN2024bhav.csv.zip", "unknown header"), ("nothing.zip", "no CSV inside"), ("undated.zip", "no date in the name")}
    assert sorted(once) == sorted(set(once)) and sorted(read[len(once) :]) == ["cm03JAN2024bhav.csv.zip", "undated.zip"]
    run()
    assert len(read) == len(once) + 2


def test_symbols_by_file_name(spark, tmp_path):
    for name in ("AAA_B.NSE_15minute_ohlcv.csv", "BAJAJ-AUTO_15m.csv", "X.csv"):
        (tmp_path / name).write_text("timestamp,open,high,low,close,volume\n2024-01-01 09:15:00,1,2,1,9,5\n")
    assert sorted(x.ticker for x in files.symbol_csv(spark, str(tmp_path)).collect()) == ["AAA_B", "BAJAJ-AUTO", "X"]


def test_reuse_by_content(spark, tmp_path, monkeypatch):
    store = tables.Reuse(str(tmp_path / "kept"))
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "n int, s string")
    key = store.key({"in": df}, rate=0.1, names=["x"])
    assert key == store.key({"in": df.orderBy(F.desc("n"))}, names=["x"], rate=0.1)
    others = [store.key({"in": df}, rate=0.2, names=["x"]), store.key({"in": df.withColumn("n", F.col("n") + 1)}, rate=0.1, names=["x"]), store.key({"in": df.limit(2)}, rate=0.1, names=["x"]), store.key({"on": df}, rate=0.1, names=["x"])]
    assert len({key, *others}) == 5
    made = []

    def make():
        made.append(1)
        return df.groupBy("n").count()

    for _ in range(3):
        assert sorted(map(tuple, store.get(key, make).collect())) == [(1, 1), (2, 2)]
    assert (store.hits, store.misses, len(made)) == (2, 1, 1)
    path = tmp_path / "kept" / key
    for part in path.glob("part-*"):
        part.write_bytes(b"broken")
    for part in path.glob(".part-*"):
        part.unlink()
    assert sorted(map(tuple, store.get(key, make).collect())) == [(1, 1), (2, 2)] and (store.hits, store.misses) == (2, 2)
    monkeypatch.setenv("TESSERA_REUSE", "0")
    store.get(key, make)
    store.get("never", make)
    assert (store.hits, store.misses, len(made)) == (2, 2, 4) and not (tmp_path / "kept" / "never").exists()


def test_of_two_writers_the_first_stays(spark, tmp_path):
    one, two = tables.Reuse(str(tmp_path)), tables.Reuse(str(tmp_path))
    df = lambda v: spark.createDataFrame([(v,)], "v int")

    def slow():
        one.get("k", lambda: df(1))  # another writer ends while this one computes
        return df(2)

    assert [x.v for x in two.get("k", slow).collect()] == [1] and [x.v for x in one.get("k", lambda: df(3)).collect()] == [1]
    assert [p.name for p in tmp_path.iterdir()] == ["k"]


@pytest.mark.parametrize("comments", [[], ["weekly ranks", "of 3 names"]])
def test_report_with_comments(spark, tmp_path, comments):
    tables.write_csv(spark.createDataFrame([("b", 2.5), ("a", 1.0)], "name string, v double"), str(tmp_path / "r"), ["name"], comments=comments)
    text = next((tmp_path / "r").glob("part-*")).read_text().splitlines()
    assert text == [*[f"# {c}" for c in comments], "name,v", "a,1.0", "b,2.5"]
