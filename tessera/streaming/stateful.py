"""State from bar to bar on a stream: the holdings of a buffer and the belief of a regime filter. (An extension: the batch operators are
tessera.operators.buffers and regime.)"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.buffers import kept
from tessera.operators.regime import States

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """The state store that these operators need; to be set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class _Buffer(StatefulProcessor):
    """Keyed by strategy: the names held after the last decided date, and the rows of the date that is still open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.book = handle.getValueState("book", "held array<string>, open_d string, tickers array<string>, ranks array<long>, leaves array<long>, enter long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat([*rows])
        new["d"] = new["d"].astype(str)
        held, now, tickers, ranks, leaves, enter = self.book.get() if self.book.exists() else ([], "", [], [], [], 0)
        held, out = list(held), []
        if now:
            before = pd.DataFrame({"d": now, "ticker": list(tickers), "rank": list(ranks), "leave": list(leaves), "enter": enter})
            new = pd.concat([before, new[new["d"] >= now]])  # a date that was decided takes no more rows
        days = [(d, x.drop_duplicates("ticker", keep="last").sort_values(["rank", "ticker"])) for d, x in new.groupby("d", sort=True)]
        for d, x in days[:-1]:
            held = kept(held, x["ticker"].tolist(), x["rank"].tolist(), x["leave"].tolist(), int(x["enter"].iloc[0]))
            out += [(key[0], d, t) for t in sorted(held)]
        if days:
            d, x = days[-1]
            self.book.update((held, d, x["ticker"].tolist(), [int(v) for v in x["rank"]], [int(v) for v in x["leave"]], int(x["enter"].iloc[0])))
        yield pd.DataFrame(out, columns=["strategy", "d", "ticker"])

    def close(self) -> None:
        pass


def stream_buffer(ranked: DataFrame) -> DataFrame:
    """strategy, d, ticker (strings) held by the buffer over a stream of ranked rows (strategy, d, ticker, rank, enter, leave).

    A date is decided when the strategy's first row of a later date arrives; rows that come for it afterwards are too late and are left
    out. Of rows that repeat a name the last counts. State is the names held and the open date's rows within the bands, so it stays as
    small as a book; a restart from the checkpoint goes on where the last batch ended.
    """
    rows = ranked.where("rank <= greatest(enter, leave)").selectExpr("cast(strategy as string) strategy", "cast(d as string) d", "cast(ticker as string) ticker", "cast(rank as long) rank", "cast(enter as long) enter", "cast(leave as long) leave")
    return rows.groupBy("strategy").transformWithStateInPandas(_Buffer(), "strategy string, d string, ticker string", "Append", "None")


class _Belief(StatefulProcessor):
    """Keyed by series: the chances of the states after its last bar, and the version of the model that they are of."""

    def __init__(self, model: States, version: int, columns: list[str]) -> None:
        self.model, self.version, self.columns = model, version, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.belief = handle.getValueState("belief", "chances array<double>, d string, version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat([*rows])
        new["d"] = new["d"].astype(str)
        before, last, version = self.belief.get() if self.belief.exists() else (None, "", self.version)
        if before is not None and len(before) != len(self.model.start):
            before = None  # the states of another model: it starts anew
        new = new[new["d"] > last].drop_duplicates("d", keep="last").sort_values("d")
        if len(new):
            found = self.model.filtered(new[self.columns].to_numpy(float, na_value=np.nan), None if before is None else np.array(before))
            self.belief.update((found[-1].tolist(), new["d"].iloc[-1], self.version))
            yield pd.DataFrame({"series": key[0], "d": new["d"], "chances": [a.tolist() for a in found], "version": self.version})
        else:
            yield pd.DataFrame({"series": [], "d": [], "chances": [], "version": []})

    def close(self) -> None:
        pass


def stream_filter(bars: DataFrame, columns: list[str], model: States, *, version: int = 0) -> DataFrame:
    """series, d, chances, version for each bar of a stream (series, d and the columns): one update of the series' belief a bar, by its order.

    Bars that are not later than the series' last one are left out. A query that is restarted with another model goes on from the belief
    that the old one left, if it has as many states.
    """
    rows = bars.selectExpr("cast(series as string) series", "cast(d as string) d", *[f"cast({c} as double) {c}" for c in columns])
    return rows.groupBy("series").transformWithStateInPandas(_Belief(model, version, columns), "series string, d string, chances array<double>, version long", "Append", "None")
