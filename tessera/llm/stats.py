"""Statistics of a whole text, and a join of labels: what the quality operators learn from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, window_hashes, word_hashes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features: shares, all between 0 and 1 but for the first three.
FEATURES = ("log_words", "word_length", "line_words", "symbol_share", "upper_share", "digit_share", "punct_share", "pipe_share", "dup_line_share", "repeat_share", "distinct_share", "other_share")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_SPACE, _SYMBOL = _class(b" \t\n\x0b\x0c\r"), _class(b"#*$%&|<>")
_UPPER, _LOWER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(b"0123456789")
_PUNCT, _PIPE, _INNER = _class(b".,;:!?'\"()-"), _class(b"|"), _class(bytes(range(0x80, 0xC0)))
_CLASSES = np.stack([_SPACE, _SYMBOL, _UPPER, _LOWER, _DIGIT, _PUNCT, _PIPE, _INNER])


def text_stats(data: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """COUNTS and FEATURES of one text in UTF-8. An empty text has zeros."""
    words = data.split()
    n = len(words)
    if not n:
        return (0,) * 5, (0.0,) * len(FEATURES)
    space, symbol, upper, lower, digit, punct, pipe, inner = (_CLASSES @ np.bincount(np.frombuffer(data, np.uint8), minlength=256)).tolist()
    chars = len(data) - inner - space
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    hashes, repeat = word_hashes(words), 0
    if n > 5:
        h = window_hashes(hashes, 5)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if same.any():
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            cover = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + 5, -1)
            repeat = int((np.cumsum(cover[:n]) > 0).sum())
    other = chars - symbol - upper - lower - digit - punct
    return (n, chars, symbol, dup, repeat), (
        float(np.log1p(n)), chars / n, n / len(lines), symbol / chars, upper / chars, digit / chars, punct / chars, pipe / chars,
        dup / len(lines), repeat / n, len(set(words)) / n, other / chars,
    )


STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in FEATURES)


def stats_batch(ids: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    both = [text_stats(x) for x in as_bytes(texts)]
    return ids, np.array([x for x, _ in both], np.int64).reshape(-1, len(COUNTS)), np.array([x for _, x in both]).reshape(-1, len(FEATURES))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *COUNTS, *FEATURES]
    for b in batches:
        ids, counts, features = stats_batch(b.column(0), b.column(1))
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in counts.T), *(pa.array(c) for c in features.T)], names)


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, COUNTS and FEATURES of each row's whole text. Null and empty texts have zeros; a null id is kept; repeated rows are
    counted each; an empty table gives none; other columns, whatever their names, are ignored."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_stats, STATS_SCHEMA)


def label_sample(labels: DataFrame, most: int, id_col: str = "doc_id", label_col: str = "quality", where: str = "true") -> DataFrame:
    """doc_id and label (0 or 1) of the `most` labelled ids with the smallest hashes; an id with both labels counts as 0."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.where("doc_id is not null and label in (0, 1)").where(where).groupBy("doc_id").agg(F.min("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled_features(docs: DataFrame, labels: DataFrame, most: int, *, where: str = "true") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the sample (`most` rows at most, on the driver): counts, features, labels; by doc_id, so that reruns agree. Labels without a
    document are left out, a null text counts as empty, and no labels give arrays of no rows."""
    spark = docs.sparkSession
    sample = label_sample(labels, most, where=where).collect()
    wanted = F.broadcast(spark.createDataFrame(sample, "doc_id long, label int"))  # `most` rows at most
    # documents of one id: the first by its text, so that the sample stays within its bound and each row of it is a document
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted, "doc_id", "left_semi")
    rows = document_stats(rows.groupBy("doc_id").agg(F.min("text").alias("text"))).join(wanted, "doc_id").select("doc_id", "label", *COUNTS, *FEATURES)
    got = sorted(rows.collect())
    table = np.array([tuple(r) for r in got], float).reshape(-1, 2 + len(COUNTS) + len(FEATURES))
    return table[:, 2 : 2 + len(COUNTS)], table[:, 2 + len(COUNTS) :], table[:, 1].astype(int)
