"""Language identification: each document as a mixture of languages, fitted by expectation-maximisation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunk_rows, materialize, sum_chunks

BUCKETS = 1 << 16
_NOT_LETTERS = re.compile(r"[\W\d_]+")
LEARN = "lang is not null and crc32(cast(doc_id as string)) % 5 <> 0"


def grams(text: str) -> np.ndarray:
    """Buckets of the three-byte windows of the lower-cased letters, other characters made one space."""
    b = np.frombuffer(f" {_NOT_LETTERS.sub(' ', text.lower())} ".encode(), np.uint8).astype(np.uint32)
    return (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)


@dataclass(frozen=True)
class LanguageModel:
    names: tuple[str, ...]
    chance: np.ndarray  # languages x buckets

    def mixture(self, text: str | None, *, rounds: int = 12, penalty: float = 6.0, least: float = 0.02) -> tuple[dict[str, float], float]:
        """The languages of a text and their shares, the largest first, and how sure that one is. None, and 0, without a letter.

        Expectation-maximisation over all languages gives an order by share; of the sets of the first one, two, ... with a share
        of `least` or more, refitted, the one with the highest log likelihood less penalty * log(n) per language beyond the first wins.
        """
        if not text or not self.names or not any(map(str.isalpha, text)):
            return {}, 0.0
        u, c = np.unique(grams(text), return_counts=True)
        p, c = self.chance[:, u], c.astype(float)
        alone = np.log(p) @ c
        share = self._shares(p, c, rounds)
        order = np.lexsort((np.arange(len(share)), -share))
        best, most = (int(alone.argmax()),), float(alone.max())
        weight = np.ones(1)
        for k in range(2, len(order) + 1):
            if share[order[k - 1]] < least:
                break
            ix = tuple(int(x) for x in order[:k])
            w = self._shares(p[list(ix)], c, rounds)
            value = float(np.log(w @ p[list(ix)]) @ c) - penalty * np.log(c.sum() + 1) * (k - 1)
            if value > most:
                best, most, weight = ix, value, w
        top = best[int(weight.argmax())]
        odds = np.exp(np.clip((alone - alone[top]) / 3, -700, 0))  # neighbouring windows overlap: a third of the evidence
        sure = 1 / (1 + sum(float(odds[k]) for k in range(len(odds)) if k not in best))
        return {self.names[k]: float(x) for k, x in sorted(zip(best, weight, strict=True), key=lambda y: (-y[1], y[0]))}, sure

    @staticmethod
    def _shares(p: np.ndarray, c: np.ndarray, rounds: int) -> np.ndarray:
        w, n = np.full(len(p), 1 / len(p)), c.sum()
        for _ in range(rounds):
            new = w * (p @ (c / (w @ p))) / n
            done = np.abs(new - w).max() < 1e-4
            w = new
            if done:
                break
        return w


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text and any(map(str.isalpha, text)):
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total[lang] += np.bincount(grams(text), minlength=BUCKETS)
    for lang, counts in total.items():
        yield chunk_rows(lang, counts)


def fit_languages(docs: DataFrame, *, max_languages: int = 1000, smooth: float = 0.5) -> LanguageModel:
    """From text and lang of every document for which LEARN holds. Null and empty texts teach nothing; no documents give a model
    without languages, which predicts `und`.

    The model is languages x BUCKETS numbers of 8 bytes, on the driver and in each task. More than max_languages values of lang are
    an error that says so, never a smaller model: raise it where the driver and the tasks have the memory (1000 take 0.5 GB).
    """
    rows = docs.where(LEARN).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    summed = materialize(sum_chunks(rows.mapInArrow(_count, "name string, chunk int, counts binary")), "lang-grams")
    names = sorted(r.name for r in summed.select("name").distinct().limit(max_languages + 1).collect())
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages, of {8 * BUCKETS} bytes each: raise max_languages")
    table = np.zeros((len(names), BUCKETS))
    for r in summed.toLocalIterator():  # languages x BUCKETS numbers, whatever the input
        counts = np.frombuffer(r.counts, np.int64)
        table[names.index(r.name), r.chunk * len(counts) : (r.chunk + 1) * len(counts)] = counts
    table += smooth
    return LanguageModel(tuple(names), table / table.sum(1, keepdims=True))


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (map of the chosen languages to shares) for each row.

    The score is the first language's share times how sure it is against those not chosen. A text that is null or has no letter
    is `und`, 0. A null id is held out. Repeated rows are predicted each.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # max_languages x BUCKETS numbers at most

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            both = [model.mixture(t) for t in b.column(1).to_pylist()]
            found, sure = [m for m, _ in both], [s for _, s in both]
            names = pa.array([next(iter(m), "und") for m in found], pa.string())
            score = pa.array([min(1.0, s * next(iter(m.values()), 0.0)) for m, s in zip(found, sure, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), names, score, pa.array([list(m.items()) for m in found], pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "languages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, languages map<string,double>")
    return out.select("doc_id", (~F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 <> 0"), F.lit(False))).alias("held_out"), "lang_pred", "score", "languages")
