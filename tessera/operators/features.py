"""Features and targets of a panel, and their ranks within each date."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import by_name, full_windows


@dataclass(frozen=True)
class Horizons:
    """Lookbacks, counted in bars of the name, and forward horizons of the targets."""

    # The lookbacks and horizons of the full feature set.
    momenta: tuple[int, ...] = (1, 5, 20, 60, 120, 252)
    averages: tuple[int, ...] = (20, 50, 200)
    vols: tuple[int, ...] = (20, 60)
    short: int = 20
    year: int = 252
    targets: tuple[int, ...] = (1, 5, 21)

    @property
    def features(self) -> list[str]:
        return [
            *[f"mom_{h}" for h in self.momenta], *[f"sma_{n}" for n in self.averages], f"max_ret_{self.short}", *[f"vol_{n}" for n in self.vols],
            f"parkinson_{self.short}", f"drawdown_{self.year}", "amihud", f"vol_var_{self.short}", f"turn_{self.short}",
        ]

    @property
    def labels(self) -> list[str]:
        return [f"fwd_{h}" for h in self.targets]


#: What end-of-day delivery data adds, where bars have the columns.
INSTITUTIONAL = ("delivery_qty", "delivery_pct")


def _ratio(a: Column, b: Column) -> Column:
    """a / b, null where that is no number."""
    return a / F.when(b != 0, b)


def features(bars: DataFrame, h: Horizons = Horizons()) -> DataFrame:
    """ticker, d, the features and targets of h, and delivery columns if bars have them.

    All windows are over a name's own rows in order of d, so they share one exchange and one sort; a value is null until its window
    is full. Prices must be positive.
    """
    w, close = by_name(), F.col("close")
    back = lambda c, k: F.lag(c, k).over(w)
    rows = bars.withColumns({"r1": F.ln(close / back("close", 1)), "range2": F.pow(F.ln(F.col("high") / F.col("low")), 2)})
    s = h.short
    rows = full_windows(rows, {
        **{f"_mean_{n}": ("mean", "close", n) for n in h.averages}, "_best": ("max", "r1", s), **{f"_var_{n}": ("var", "r1", n) for n in h.vols},
        "_range": ("mean", "range2", s), "_top": ("max", "close", h.year), f"vol_var_{s}": ("var", "volume", s), "_usual": ("mean", "volume", s),
    })
    out = {f"mom_{k}": F.ln(close / back("close", k)) for k in h.momenta}
    out |= {f"sma_{n}": close / F.col(f"_mean_{n}") for n in h.averages}
    out |= {f"max_ret_{s}": F.col("_best")} | {f"vol_{n}": F.sqrt(f"_var_{n}") for n in h.vols}
    out |= {
        f"parkinson_{s}": F.sqrt(F.col("_range") / (4 * F.ln(F.lit(2.0)))), f"drawdown_{h.year}": close / F.col("_top") - 1,
        "amihud": _ratio(F.abs("r1"), close * F.col("volume")), f"turn_{s}": _ratio(F.col("volume"), F.col("_usual")),
    }
    out |= {f"fwd_{k}": F.ln(F.lead("close", k).over(w) / close) for k in h.targets}
    extra = [c for c in INSTITUTIONAL if c in bars.columns]
    return rows.withColumns(out).select("ticker", "d", *h.features, *extra, *h.labels)


def session_targets(bars: DataFrame, ahead: int) -> DataFrame:
    """Forward returns of intraday bars (ticker, d, bin, close) that must end on the same day."""
    w = Window.partitionBy("ticker").orderBy("d", "bin")
    return bars.select("ticker", "d", "bin", F.when(F.lead("d", ahead).over(w) == F.col("d"), F.ln(F.lead("close", ahead).over(w) / F.col("close"))).alias("fwd"))


def complete(rows: DataFrame, columns: list[str], labels: list[str]) -> DataFrame:
    """Rows that have all features and any label."""
    return rows.dropna("any", subset=columns).dropna("all", subset=labels)


def masked(rows: DataFrame, mask: DataFrame) -> DataFrame:
    """The rows of a universe (ticker, d): after windows, which see the whole history, and before ranks."""
    return rows.join(mask.select("ticker", "d"), ["ticker", "d"], "left_semi")


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    """rows, or an error that names what is empty; asks for one row only."""
    if rows.isEmpty():
        raise ValueError(f"{what} leaves no row")
    return rows


def rank_normalised(rows: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """rows with the columns, rounded to nine digits (fifteen for amihud, which is tiny) so that equal values tie, replaced by their ranks in [-1, 1] within the keys.

    Spark brings the rows of the keys together and in order once; each column is then ranked in Arrow batches, where a window for each would
    sort the whole rows again.
    """
    keys = keys or ("d",)
    rows = rows.withColumns({c: F.round(c, 15 if c == "amihud" else 9).cast("double") for c in columns})
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(partial(_ranked, columns=columns, keys=keys), rows.schema)


def _ranked(batches: Iterator[pa.RecordBatch], columns: Sequence[str], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Batches in order of the keys with the columns ranked; the rows of a batch's last keys wait for the next batch."""
    held: list[pa.RecordBatch] = []

    def ranks(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(starts) - 1
        first, n = np.flatnonzero(starts), np.bincount(group)
        for c in columns:
            at, column = table.schema.get_field_index(c), table[c].combine_chunks()
            known, x = column.is_valid().to_numpy(zero_copy_only=False), column.fill_null(0.0).to_numpy()
            order = np.lexsort((x, known, group))  # nulls come first, as in a window
            v, k, g = x[order], known[order], group[order]
            same = (k[1:] == k[:-1]) & (g[1:] == g[:-1]) & ((v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1])))
            peer = np.concatenate([[0], np.cumsum(~same)])  # equal values share a place
            size = np.bincount(peer)
            rank = (np.cumsum(size) - size)[peer] - first[g] + 1 + (size[peer] - 1) / 2.0
            out = np.empty(len(x))
            out[order] = np.where(n[g] == 1, 0.0, 2 * (rank - 1) / np.maximum(n[g] - 1, 1) - 1)
            table = table.set_column(at, c, pa.array(out))
        yield from table.to_batches()

    for batch in chain(batches, [None]):
        last = batch is None
        if not last and batch.num_rows:
            held.append(batch)
        if not held or (not last and not batch.num_rows):
            continue
        if not last and len(held) > 1 and all(held[0][k][0] == batch[k][-1] for k in keys):
            continue  # still the same keys
        table = pa.Table.from_batches(held).combine_chunks()
        codes = [table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys]
        starts = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in codes], axis=0)])
        done = table.num_rows if last else int(np.flatnonzero(starts)[-1])
        if done:
            yield from ranks(table.slice(0, done), starts[:done])
        held = table.slice(done).to_batches() if done < table.num_rows else []


def feature_matrix(bars: DataFrame, h: Horizons = Horizons(), mask: DataFrame | None = None) -> DataFrame:
    """Complete rows of the features, ranked within each date; those of the mask only, if there is one: a mask that no bar is in is an error."""
    if mask is not None:
        require_rows(masked(bars.select("ticker", "d"), mask), "the universe mask")
    rows = complete(features(bars, h), h.features, h.labels)
    rows = masked(rows, mask) if mask is not None else rows
    return rank_normalised(rows, h.features).select("ticker", "d", *h.features, *h.labels)
