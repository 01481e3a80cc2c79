"""Quality rules: decision lists learned by sequential covering, applied as ordered Spark conditional expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .stats import COUNTS, FEATURES, STATS_SCHEMA, labelled_features, stats_batch


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, prefix: str = "") -> Column:
        c = F.col(prefix + self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first whose conditions all hold rejects a document; without one it is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def keep(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for rule in reversed(self.rules):
            whole = F.lit(True)
            for c in rule:
                whole = whole & c.column(prefix)
            out = F.when(whole, F.lit(False)).otherwise(out)
        return out

    def describe(self) -> list[str]:
        return [" and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in r) for r in self.rules]


def cover(x: np.ndarray, bad: np.ndarray, *, names: tuple[str, ...] = FEATURES, cuts: int = 64, max_conditions: int = 3, max_rules: int = 16, least_precision: float = 0.95, least_covered: int = 3) -> DecisionList:
    """Sequential covering. Two rows of three grow a rule by information gain, every third prunes it; a rule enters the list if,
    of the rows it covers that no rule before has covered, at least least_precision are bad and least_covered of them are."""
    rules: list[tuple[Condition, ...]] = []
    if len(x) == 0:
        return DecisionList(())
    todo = np.ones(len(x), bool)
    grow = np.arange(len(x)) % 3 != 2
    points = []
    for k in range(x.shape[1]):
        v = np.unique(x[:, k])
        mid = (v[1:] + v[:-1]) / 2
        points.append(mid if len(mid) <= cuts else np.unique(np.quantile(mid, np.linspace(0, 1, cuts))))
    holds = lambda c: x[:, names.index(c.feature)] > c.threshold if c.above else x[:, names.index(c.feature)] <= c.threshold
    while len(rules) < max_rules and (todo & bad).any():
        rule: list[Condition] = []
        on = todo & grow
        while len(rule) < max_conditions:
            p0, n0 = (on & bad).sum(), (on & ~bad).sum()
            if not p0 or not n0:
                break
            best, gain0 = None, 1e-9
            for k, name in enumerate(names):
                values = x[on, k]
                order = np.argsort(values, kind="stable")
                good = np.concatenate([[0], np.cumsum(~bad[on][order])])
                poor = np.concatenate([[0], np.cumsum(bad[on][order])])
                at = np.searchsorted(values[order], points[k], side="right")
                for above in (False, True):
                    p, n = (p0 - poor[at], n0 - good[at]) if above else (poor[at], good[at])
                    gain = p * (np.log2((p + 1e-12) / (p + n + 1e-12)) - np.log2(p0 / (p0 + n0)))
                    if len(gain) and gain.max() > gain0:
                        gain0, best = gain.max(), Condition(name, above, float(points[k][gain.argmax()]))
            if best is None:
                break
            rule.append(best)
            on &= holds(best)

        def worth(r: list[Condition]) -> float:
            m = todo & ~grow
            for c in r:
                m = m & holds(c)
            p, n = (m & bad).sum(), (m & ~bad).sum()
            return (p - n) / (p + n + 1)

        while len(rule) > 1 and worth(rule[:-1]) > worth(rule):
            rule.pop()
        on = todo.copy()
        for c in rule:
            on &= holds(c)
        p = (on & bad).sum()
        if not rule or p < least_covered or p < least_precision * on.sum():
            break
        rules.append(tuple(rule))
        todo &= ~on
    return DecisionList(tuple(rules))


def learn_rules(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000) -> DecisionList:
    """From the statistics of at most max_rows documents with labels.quality; 0 is bad. No labels: an empty list, which keeps all."""
    _, x, y = labelled_features(docs, labels, max_rows)
    return cover(x, y == 0)


#: A document fails without any learned rule if it has fewer words or a larger share of them in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20


def base_failed(prefix: str = "") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < LEAST_WORDS) | (100 * F.col(f"{prefix}n_repeat_words") > MOST_REPEATED * n)


def judged(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Statistics (of document_stats) with base_failed and kept, a row each; a document without a word fails. An empty list keeps all
    that does not fail."""
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.keep())


def keep_good(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, with their columns, whatever their names. Null and empty texts have no word and fail; repeated rows
    are judged each; an empty table gives none."""
    names, at = [f"c{k}" for k in range(len(docs.columns))], docs.columns.index(text_col)
    extra = [f"stats_{c}" for c in (*COUNTS, *FEATURES)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, counts, features = stats_batch(b.column(0), b.column(at).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c) for c in counts.T), *(pa.array(c) for c in features.T)], [*names, *extra])

    rows = docs.toDF(*names)  # so that no name of theirs meets one of ours
    schema = StructType(list(rows.schema.fields))  # add() changes what it is called on
    for part in STATS_SCHEMA.split(", ")[1:]:
        schema = schema.add(f"stats_{part.split()[0]}", part.split()[1])
    return rows.mapInArrow(add, schema).where(~base_failed("stats_") & rules.keep("stats_")).select(*names).toDF(*docs.columns)
