"""Quality classifier: a generalised additive model with pairwise interactions, boosted cyclically on binned statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import labelled_features, stats_batch


@dataclass(frozen=True)
class AdditiveModel:
    """intercept; per feature its bin edges and a table of additions; per pair of features a table over their coarse bins."""

    intercept: float
    edges: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    coarse: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int, np.ndarray], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, k], side="left")]
        low = [np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.coarse)] if self.pairs else []
        for a, b, t in self.pairs:
            z += t[low[a], low[b]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _split(g: np.ndarray, h: np.ndarray, depth: int, reg: float) -> np.ndarray:
    """Leaf values of the best tree of that depth over ordered bins with gradient sums g and curvature sums h."""
    out = np.full(len(g), g.sum() / (h.sum() + reg))
    if depth and len(g) > 1:
        cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = cg**2 / (ch + reg) + (g.sum() - cg) ** 2 / (h.sum() - ch + reg)
        k = int(gain.argmax()) + 1
        if gain[k - 1] > g.sum() ** 2 / (h.sum() + reg) + 1e-9:
            out[:k], out[k:] = _split(g[:k], h[:k], depth - 1, reg), _split(g[k:], h[k:], depth - 1, reg)
    return out


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 32, coarse_bins: int = 6, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 8, depth: int = 2, rate: float = 0.15, reg: float = 1.0) -> AdditiveModel:
    """Fits labels y (0 or 1) by features x. Each round boosts every feature's table by a shallow tree over its quantile bins, one
    after the other; then the n_pairs pairs of features whose coarse cells have the largest remaining gradients get tables likewise.
    No rows, or one label only: the intercept alone."""
    n, m = x.shape
    p = (y.sum() + 1) / (n + 2)
    quantiles = lambda v, b: np.unique(np.quantile(v, np.linspace(0, 1, b + 1)[1:-1])) if n else np.zeros(0)
    edges, coarse = [quantiles(x[:, k], bins) for k in range(m)], [quantiles(x[:, k], coarse_bins) for k in range(m)]
    at = [np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)]
    low = [np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(coarse)]
    tables, z = [np.zeros(len(e) + 1) for e in edges], np.full(n, np.log(p / (1 - p)))
    if n and 0 < y.sum() < n:
        for _ in range(rounds):
            for k in range(m):
                q = 1 / (1 + np.exp(-z))
                step = rate * _split(np.bincount(at[k], y - q, len(tables[k])), np.bincount(at[k], q * (1 - q), len(tables[k])), depth, reg)
                tables[k] += step
                z += step[at[k]]
        found: list[tuple[float, int, int]] = []
        q = 1 / (1 + np.exp(-z))
        for a in range(m):
            for b in range(a):
                wide = len(coarse[b]) + 1
                cell = low[a] * wide + low[b]
                g, h = np.bincount(cell, y - q), np.bincount(cell, q * (1 - q))
                found.append((float((g**2 / (h + reg)).sum()), a, b))
        pairs = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for _, a, b in sorted(found, reverse=True)[:n_pairs]]
        for _ in range(pair_rounds):
            for a, b, table in pairs:
                q, wide = 1 / (1 + np.exp(-z)), table.shape[1]
                cell = low[a] * wide + low[b]
                g, h = (np.bincount(cell, w, table.size).reshape(table.shape) for w in (y - q, q * (1 - q)))
                # a tree of two levels: one cut of a, then one of b in either half
                cg, ch = np.cumsum(g.sum(1))[:-1], np.cumsum(h.sum(1))[:-1]
                cut = int((cg**2 / (ch + reg) + (g.sum() - cg) ** 2 / (h.sum() - ch + reg)).argmax()) + 1 if len(cg) else 1
                step = np.zeros_like(table)
                for part in (slice(0, cut), slice(cut, None)):
                    if g[part].size:
                        step[part] = rate * _split(g[part].sum(0), h[part].sum(0), 1, reg)
                table += step
                z += step[low[a], low[b]]
    else:
        pairs = []
    return AdditiveModel(float(np.log(p / (1 - p))), tuple(edges), tuple(tables), tuple(coarse), tuple(pairs))


#: Documents that the model may learn from; the others are held out.
LEARN = "crc32(cast(doc_id as string)) % 5 <> 0"


def fit_quality(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000) -> AdditiveModel:
    """From at most max_rows labelled documents for which LEARN holds. Without labels, or with one kind only, a constant."""
    _, x, y = labelled_features(docs, labels, max_rows, where=LEARN)
    return fit(x, y)


def score_quality(docs: DataFrame, model: AdditiveModel, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row. Null text is scored as empty; a null id is held out; repeated rows are scored
    each; an empty table gives none; other columns, whatever their names, are ignored."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, x = stats_batch(b.column(0), b.column(1))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(score, "doc_id long, score double, predicted int")
    return out.select("doc_id", (~F.coalesce(F.expr(LEARN), F.lit(False))).alias("held_out"), "score", "predicted")
