"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Seeds are pairs of words. An alignment of r stretches of equal words and e other steps scores at most (equal words - r) + 1, since
e >= r - 1, so one that scores s holds s - 1 of the item's pairs of neighbouring words at least. Of an item's P pairs the rarest
P - (s - 1) + 1 are seeds: no such alignment can do without all of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import quoted

_WORD = re.compile(r"[^\W_]+")
#: Words of a seed. Three would miss alignments broken after every second word, which may score half the item.
SEED = 2


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def align(item: np.ndarray, passage: np.ndarray, gap: float = 1.0, wrong: float = -1.0) -> tuple[float, int]:
    """Best local alignment score of two word sequences, a point for each equal pair, and the index after its last word in passage."""
    steps = gap * np.arange(len(passage) + 1)
    row, best, at = np.zeros(len(passage) + 1), 0.0, 0
    for w in item:
        new = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(passage == w, 1.0, wrong), row[1:] - gap, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + steps) - steps  # gaps in the item
        k = int(row.argmax())
        if row[k] > best + 1e-9:
            best, at = float(row[k]), k
    return best, at


@dataclass
class Items:
    """Test items as word numbers, their n-grams, and where in items those that are seeds stand."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    seeds: dict[tuple[int, ...], list[tuple[int, int]]]
    n: int
    whole: dict[tuple[int, ...], list[int]]  # items that are too short for an alignment, by all of their words
    keys: np.ndarray = field(init=False)
    pairs: list[np.ndarray] = field(init=False)
    seed_offsets: np.ndarray = field(init=False)  # for each key, where its seeds' items and places in them are
    pair_offsets: np.ndarray = field(init=False)  # for each key, where the items that hold the pair are, as often as they do

    def __post_init__(self) -> None:
        size = np.uint64(len(self.vocabulary) + 2)
        code = {}
        for s, where in self.seeds.items():
            code.setdefault(int(self.pack(np.array(s, np.int64), size)[0]), []).extend(where)
        self.keys = np.array(sorted(code), np.uint64)
        owners = [code[int(k)] for k in self.keys]
        self.seed_offsets = np.cumsum([0, *map(len, owners)])
        self.seed_items, self.seed_at = (np.array([x[j] for o in owners for x in o], np.int64) for j in (0, 1))
        self.pairs = [np.searchsorted(self.keys, self.pack(w)) for w in self.words]  # every pair of an item has its key, seed or not
        flat = np.concatenate([*self.pairs, np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.pair_items = np.repeat(np.arange(len(self.words)), [len(x) for x in self.pairs])[order]
        self.pair_offsets = np.searchsorted(flat[order], np.arange(len(self.keys) + 1))
        self.longest_whole = max(map(len, self.whole), default=-1)
        self._needed: dict[float, np.ndarray] = {}

    def needed(self, least: float) -> np.ndarray:
        """How many of its pairs each item shares at least with an alignment that scores `least`."""
        if least not in self._needed:
            self._needed[least] = np.array([_pairs_needed(len(w), least) for w in self.words], np.int64)
        return self._needed[least]

    def pack(self, numbers: np.ndarray, size: np.uint64 | None = None) -> np.ndarray:
        size = size or np.uint64(len(self.vocabulary) + 2)
        out = np.zeros(len(numbers) - self.n + 1, np.uint64)
        for k in range(self.n):
            out = out * size + (numbers[k : len(numbers) - self.n + 1 + k] + 1).astype(np.uint64)
        return out

    def numbers(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and seed indices of the seeds in a document."""
        if len(numbers) < self.n or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = numbers >= 0
        if not inside.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        packed = self.pack(numbers)
        at = np.searchsorted(self.keys, packed)
        ok = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == packed)
        return ok, at[ok]


def _items(rows: list, n: int) -> Items:
    vocabulary: dict[str, int] = {}
    ids, words, seeds, whole = [], [], {}, {}
    for item_id, text in rows:
        w = words_of(text)
        if len(w) < max(n, SEED):
            if w:
                whole.setdefault(tuple(vocabulary.setdefault(x, len(vocabulary)) for x in w), []).append(item_id)
            continue
        k = len(ids)
        ids.append(item_id)
        words.append(np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w], np.int64))
        for p in range(len(w) - SEED + 1):
            seeds.setdefault(tuple(words[-1][p : p + SEED].tolist()), []).append((k, p))
    return Items(ids, words, vocabulary, seeds, SEED, whole)


def _pairs_needed(words: int, least: float) -> int:
    """How many of the pairs of an item of so many words any alignment holds that scores at least `least`."""
    return max(1, math.ceil(least * words - 1 - 1e-9))


def _rare(items: Items, counts: dict[int, int], least: float) -> Items:
    """Of the seeds of each item the rarest in the corpus, so many that any alignment scoring `least` holds one of them."""
    chosen: dict[tuple[int, ...], list[tuple[int, int]]] = {s: [] for s in items.seeds}
    order = {s: k for k, s in enumerate(items.seeds)}
    key = {s: int(items.pack(np.array(s, np.int64))[0]) for s in items.seeds}
    at: dict[int, list[tuple[int, int, tuple[int, ...], int]]] = {}
    for s, where in items.seeds.items():
        for k, p in where:
            at.setdefault(k, []).append((counts.get(key[s], 0), order[s], s, p))
    for k, options in at.items():
        for _, _, s, p in sorted(options)[: max(1, len(options) - _pairs_needed(len(items.words[k]), least) + 1)]:
            chosen[s].append((k, p))
    return Items(items.ids, items.words, items.vocabulary, chosen, items.n, items.whole)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, n: int = 3, least: float = 0.5, slack: int = 16,
    slice_chars: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
) -> DataFrame:
    """(doc_id, item_id, score, start, end) for each document and test item whose alignment scores at least `least`.

    Texts are lower-cased and cut to runs of letters and digits. Seeds are the item's rarest pairs of words, by the number of
    documents that hold them, and as many as it takes to meet every such alignment (of items for which `least` is more than one word).
    Around seeds on near diagonals (within slack, or the gaps such an alignment can hold) the document's passage is aligned to the whole item; the score is
    the alignment's (1 an equal word, -1 a wrong one or a gap) by the item's words; start and end number the passage's words.
    An item of fewer than n words is found only as the whole of a document's words; one without words, or of null text, nowhere. A text is
    searched whole, in memory of some 30 bytes a word and 40 for each seed of an item that it shares enough with. Repeated rows are searched each; an empty table, or benchmark, gives
    none; other columns, whatever their names, are ignored.

    The items are held in each task. A benchmark of more than slice_chars characters is dealt with in slices of about that size,
    one scan of docs each.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for items in _slices(benchmark, item_col, n, slice_chars):
        chosen = _chosen(rows.select("text"), items, least)

        def search(batches: Iterator[pa.RecordBatch], chosen=chosen) -> Iterator[pa.RecordBatch]:
            items = chosen.value
            for b in batches:
                out = [(doc, *x) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in _search(items, items.numbers(text), least, slack)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "score", "start", "end"])

        one = rows.mapInArrow(search, "doc_id long, item_id long, score double, start int, end int")
        found = one if found is None else found.unionByName(one)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, n: int = 3, least: float = 0.5, slack: int = 16, slice_chars: int = 8_000_000, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs in which find_leaks finds nothing, with their columns, whatever their names. Null and empty texts stay; repeated
    rows are judged each; an empty table, or benchmark, changes nothing.

    Seeds are counted over all of docs, one scan for each slice of the benchmark; the slices' searches are one scan.
    """
    names, at, texts = docs.columns, docs.columns.index(text_col), docs.select(F.col(quoted(text_col)).cast("string").alias("text"))
    docs = docs.toDF(*[f"c{k}" for k in range(len(names))])
    for items in _slices(benchmark, item_col, n, slice_chars):
        chosen = _chosen(texts, items, least)

        def clean(batches: Iterator[pa.RecordBatch], chosen=chosen) -> Iterator[pa.RecordBatch]:
            items = chosen.value
            for b in batches:
                yield b.filter(pa.array([not _search(items, items.numbers(text), least, slack) for text in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs.toDF(*names)


def _slices(benchmark: DataFrame, item_col: str, n: int, slice_chars: int) -> Iterator[Items]:
    bench = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    slices = 1 + int(bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // slice_chars
    for k in range(slices):
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k).distinct()
        yield _items(sorted(map(tuple, part.collect()), key=lambda r: (r[0] is None, r)), n)


def _chosen(texts: DataFrame, items: Items, least: float):
    """The items with their rare seeds only, sent to the tasks."""
    spark = texts.sparkSession
    every = spark.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, total = every.value, Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                total.update(np.unique(items.hits(items.numbers(text))[1]).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["seed", "n"])

    counted = texts.mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()  # the slice's n-grams at most
    return spark.sparkContext.broadcast(_rare(items, {int(items.keys[r.seed]): int(r.n) for r in counted}, least))


def _expanded(at: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in the lists `at` (list k: offsets[k] to offsets[k + 1]), and for each which of `at` it is of."""
    sizes = offsets[at + 1] - offsets[at]
    of = np.repeat(np.arange(len(at)), sizes)
    return np.repeat(offsets[at] - np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes) + np.arange(len(of)), of


def _search(items: Items, numbers: np.ndarray, least: float, slack: int) -> list[tuple[int, float, int, int]]:
    whole = [(i, 1.0, 0, len(numbers)) for i in items.whole.get(tuple(numbers.tolist()), ())] if len(numbers) <= items.longest_whole else []
    where, seed = items.hits(numbers)
    if not len(where):
        return whole
    # the items that share enough of their pairs with the document, all at once
    held, _ = _expanded(np.unique(seed), items.pair_offsets)
    candidates, count = np.unique(items.pair_items[held], return_counts=True)
    candidates = candidates[count >= items.needed(least)[candidates]]
    if not len(candidates):
        return whole
    wanted = np.zeros(len(items.ids), bool)
    wanted[candidates] = True
    places, of = _expanded(seed, items.seed_offsets)
    mine = wanted[items.seed_items[places]]
    diagonals = np.unique(np.stack([items.seed_items[places[mine]], where[of[mine]] - items.seed_at[places[mine]]]), axis=1)
    out = []
    for k in np.unique(diagonals[0]).tolist():
        item, best = items.words[k], (0.0, 0, 0)
        needed = int(items.needed(least)[k])
        reach = max(slack, math.ceil((1 - least) * len(item)))  # all gaps that an alignment scoring `least` can hold
        starts = diagonals[1, diagonals[0] == k]
        # one passage for each run of near diagonals
        cuts = np.flatnonzero(np.diff(starts) > reach) + 1
        for first, last in zip(starts[np.concatenate([[0], cuts])].tolist(), starts[np.concatenate([cuts - 1, [len(starts) - 1]])].tolist(), strict=True):
            lo, hi = max(0, first - reach), min(len(numbers), last + len(item) + reach)
            passage = numbers[lo:hi]
            # what the alignment can reach at most: each pair and each word of the item, if the passage has it at all
            near = seed[slice(*np.searchsorted(where, [lo, hi]))]
            if np.isin(items.pairs[k], near).sum() < needed or np.isin(item, passage).sum() < least * len(item):
                continue
            score, end = align(item, passage)
            if score / len(item) > best[0]:
                back, length = align(item[::-1], passage[:end][::-1])
                best = (score / len(item), lo + end - length, lo + end)
        if best[0] >= least:
            out.append((items.ids[k], *best))
    return whole + out
