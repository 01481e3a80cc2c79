"""State on streams: batches and a restart give what the batch operators give; and paths against all paths."""

import datetime
import itertools
import random

import numpy as np
import pytest

from tessera.operators import buffers, regime
from tessera.streaming import stateful

MODEL = regime.States((0.6, 0.4), ((0.9, 0.1), (0.2, 0.8)), ((0.0, 0.2), (1.0, -0.5)), (((1.0, 0.1), (0.1, 0.5)), ((0.7, -0.2), (-0.2, 1.1))))


def day(k):
    return datetime.date(2024, 1, 1) + datetime.timedelta(k)


def run(spark, folder, schema, of, sink, parts):
    """One run after another over a folder that grows: each ends, and the next goes on from the checkpoint."""
    stateful.use_state_store(spark)
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = of(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
        q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", sink + "-at").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None, k
    return spark.read.parquet(sink).collect()


def test_buffer_on_a_stream(spark, tmp_path):
    r = random.Random(6)
    rows = []
    for d in range(12):
        for s in ("a", "b"):
            names = [f"n{k}" for k in range(12)]
            r.shuffle(names)
            if d % 3:  # drift rather than a new order
                names = sorted(names, key=lambda n: int(n[1:]) + r.random() * 6)
            rows += [(s, day(d), n, k + 1, 3, 6) for k, n in enumerate(names)]
    schema = "strategy string, d date, ticker string, rank int, enter int, leave int"
    want = {(x.strategy, str(x.d), x.ticker) for x in buffers.rebalance_buffer(spark.createDataFrame(rows, schema)).collect()}
    late = [("a", day(2), "n99", 1, 3, 6)]
    last = [(s, day(99), "n0", 1, 3, 6) for s in ("a", "b")]  # decides the last date, and is open itself
    cut = lambda a, b: [x for x in rows if a <= (x[1] - day(0)).days < b]
    half = [x for x in cut(4, 5) if x[3] <= 3]  # a date that comes in two batches
    parts = [cut(0, 4) + half, [x for x in cut(4, 8) if x not in half] + late, cut(8, 12) + last]
    got = run(spark, str(tmp_path / "in"), schema, stateful.stream_buffer, str(tmp_path / "out"), parts)
    assert {(x.strategy, x.d, x.ticker) for x in got} == want and len(got) == len(want)


def test_filter_on_a_stream(spark, tmp_path):
    r = random.Random(7)
    rows = [(s, day(d), r.gauss(d % 7 > 3, 1), None if d == 9 else r.gauss(0, 1)) for s in "xyz" for d in range(20)]
    schema = "series string, d date, a double, b double"
    want = {(x.series, str(x.d)): x.chances for x in regime.state_chances(spark.createDataFrame(rows, schema), ["a", "b"], MODEL, "series").collect()}
    cut = lambda a, b: [x for x in rows if a <= (x[1] - day(0)).days < b]
    got = run(spark, str(tmp_path / "in"), schema, lambda s: stateful.stream_filter(s, ["a", "b"], MODEL, version=3), str(tmp_path / "out"), [cut(0, 7), cut(7, 8) + cut(2, 4), cut(8, 20)])
    assert len(got) == len(want) and all(x.version == 3 and x.chances == pytest.approx(want[x.series, x.d]) for x in got)


def test_path_is_the_best_of_all(spark):
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 9):
        x = r.normal(size=(n, 2))
        x[n // 2, 0] = np.nan if n > 2 else x[n // 2, 0]
        rows = MODEL.log_density(x)

        def value(p, rows=rows):
            return np.log(MODEL.start[p[0]]) + sum(np.log(MODEL.move[a][b]) for a, b in itertools.pairwise(p)) + sum(rows[t, s] for t, s in enumerate(p))

        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert tuple(MODEL.path(x)) == best
    series = [(s, day(d), float(v), float(w)) for s in "ab" for d, (v, w) in enumerate(r.normal(size=(40, 2)))]
    got = regime.state_path(spark.createDataFrame(series, "s string, d date, a double, b double").repartition(3), ["a", "b"], MODEL, "s").orderBy("s", "d").collect()
    for s in "ab":
        assert [x.state for x in got if x.s == s] == MODEL.path(np.array([y[2:] for y in series if y[0] == s])).tolist()


def test_filtered_chances_by_sums_over_paths():
    x = np.random.default_rng(2).normal(size=(6, 2))
    rows, got = MODEL.log_density(x), MODEL.filtered(x)
    for t in range(6):
        total = [0.0, 0.0]
        for p in itertools.product((0, 1), repeat=t + 1):
            total[p[-1]] += MODEL.start[p[0]] * np.prod([MODEL.move[a][b] for a, b in itertools.pairwise(p)]) * np.exp(sum(rows[k, s] for k, s in enumerate(p)))
        assert got[t] == pytest.approx(np.array(total) / sum(total))
