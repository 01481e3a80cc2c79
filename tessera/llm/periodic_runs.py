"""Periodic runs of words within a text, found by the branching tandem repeats of suffix trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, mix

#: The least length of a run in words, and in periods.
LEAST, POWER = 24, 3
#: Words that are searched together; a longer text is searched alone. Rows that are taken from a batch at once, and leaves that are visited at once.
_TOGETHER, _ROWS, _LEAVES = 1 << 16, 128, 1 << 18
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _suffixes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of s in order, each one's place in that order, and what each has in common with the one before it."""
    n = len(s)
    levels, rank, k = [], np.unique(s, return_inverse=True)[1].astype(np.int64), 1
    while True:
        levels.append(rank)
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        ahead = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ahead[1:] != ahead[:-1]]))
        if rank[order[-1]] == n - 1:
            break
        k *= 2
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[levels[level][a[inside]] == levels[level][b[inside]]]
        a[same] += 1 << level
        b[same] += 1 << level
        common[same + 1] += 1 << level
    return order, rank, common


def _smaller_halves(common: np.ndarray) -> np.ndarray:
    """Rows (depth, first leaf, last leaf, first leaf of a child, last leaf of it) for all children but the largest of each inner node of
    the suffix tree, leaves being numbered in order."""
    out: list[tuple[int, int, int, int, int]] = []
    stack: list[tuple[int, list[int]]] = []  # depth of a node, and the first leaves of its children so far
    for i, depth in enumerate([*common[1:].tolist(), 0], 1):
        first = i - 1
        while stack and stack[-1][0] > depth:
            d, starts = stack.pop()
            ends = [*starts[1:], i]
            sizes = [e - b for b, e in zip(starts, ends, strict=True)]
            largest = sizes.index(max(sizes))
            first = starts[0]
            out += [(d, first, i - 1, b, e - 1) for k, (b, e) in enumerate(zip(starts, ends, strict=True)) if k != largest]
        if stack and stack[-1][0] == depth:
            stack[-1][1].append(i)
        elif depth:
            stack.append((depth, [first, i]))
    return np.array(out, np.int64).reshape(-1, 5)


def _tandem_repeats(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all branching tandem repeats: s[start : start + period] comes twice and what follows differs from its second first
    element. s ends with an element of its own."""
    order, rank, common = _suffixes(s)
    nodes = _smaller_halves(common)
    del common
    sizes = nodes[:, 4] - nodes[:, 3] + 1
    parts = np.cumsum(sizes) // _LEAVES
    found = [np.empty((2, 0), np.int64)]
    for part in np.unique(parts).tolist():
        low, high = np.searchsorted(parts, [part, part + 1])
        t, size = nodes[low:high], sizes[low:high]
        depth, first, last = (np.repeat(t[:, k], size) for k in range(3))
        leaf = order[np.repeat(t[:, 3] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
        for sign in (1, -1):
            other = leaf + sign * depth
            ok = np.flatnonzero((other >= 0) & (other < len(s)))
            at = rank[other[ok]]
            ok = ok[(at >= first[ok]) & (at <= last[ok])]
            start, d = np.minimum(leaf[ok], other[ok]), depth[ok]
            branching = s[start + d] != s[np.minimum(start + 2 * d, len(s) - 1)]
            found.append(np.stack([start[branching], d[branching]]))
    both = np.unique(np.concatenate(found, axis=1), axis=1)
    return both[0], both[1]


def _rotations(s: np.ndarray, start: int, period: int) -> int:
    """How often the tandem repeat can be rotated to the left."""
    done, step = 0, 64
    while True:
        low = max(0, start - done - step)
        differ = np.flatnonzero(s[low : start - done] != s[low + period : start - done + period])
        if len(differ):
            return start - (low + int(differ[-1]) + 1)
        done, step = start - low, 2 * step
        if not low:
            return start


def runs_of(s: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of at least `least` elements and `power` (two or more) periods, in order. The last element
    of s must occur once."""
    start, period = _tandem_repeats(s)
    need = np.maximum(least, power * period) - 2 * period  # rotations without which the run is too short
    ok = need <= start
    start, period, need = start[ok], period[ok], need[ok]
    for k in range(1, 9):
        ok = (k > need) | (s[np.maximum(start - k, 0)] == s[start + period - k])
        start, period, need = start[ok], period[ok], need[ok]
    best: dict[tuple[int, int], int] = {}
    for b, d in zip(start.tolist(), period.tolist(), strict=True):  # by start, then period
        first = b - _rotations(s, b, d)
        at = (first, b + 2 * d)
        best[at] = min(d, best.get(at, d))
    return sorted((b, e - b, d) for (b, e), d in best.items() if e - b >= max(least, power * d))


def _repeated(words: list[list[bytes]], width: int) -> list[np.ndarray]:
    """For each text a mask of the words that a repeated stretch of `width` of its words covers."""
    sizes = [len(w) for w in words]
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    text = np.repeat(np.arange(len(words)), sizes)
    h = np.empty(total, np.uint64)
    for w, e in zip(words, ends.tolist(), strict=True):
        h[e - len(w) : e] = np.fromiter(map(hash, w), np.int64, len(w)).view(np.uint64)
    h = mix(h ^ (text.astype(np.uint64) * _B))
    parts, at, k = [], 0, 1  # the width as a sum of powers of two
    while k <= width:
        if width & k:
            parts.append((h, at))
            at += k
        if 2 * k <= width:
            h = mix(h[: len(h) - k] * _A + h[k:]) if len(h) > k else h[:0]
        k *= 2
    n = total - width + 1
    if n <= 0:
        return [np.zeros(k, bool) for k in sizes]
    gram = np.zeros(n, np.uint64)
    for x, shift in parts:
        gram = mix(gram * _A + x[shift : shift + n])
    inside = np.flatnonzero(text[:n] == text[width - 1 :])
    gram = gram[inside]
    order = np.argsort(gram)
    same = gram[order[1:]] == gram[order[:-1]]
    twice = np.zeros(len(gram) + 1, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = inside[twice[:-1]]
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + width, -1)
    return np.split(np.cumsum(change[:-1]) > 0, ends[:-1])


def text_runs(words: list[list[bytes]], least: int = LEAST, power: int = POWER) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, as runs_of: all texts' suffix trees are built at once.

    A run of length L and period q repeats L - q >= L - L // power words, so only stretches covered by repeated windows of that many
    words, for the least L, enter the trees; a run and the words beside it lie in one such stretch or at its edge."""
    width = least - least // power
    masks = _repeated(words, width)
    ids: list[np.ndarray] = []
    where: list[tuple[int, int, int]] = []  # place in the joined sequence, text, place in the text
    at = used = 0
    for k, (w, mask) in enumerate(zip(words, masks, strict=True)):
        if not mask.any():
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
        known: dict[bytes, int] = {}
        for b, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - b < least:
                continue
            where.append((at, k, b))
            ids.append(np.array([known.setdefault(x, len(known)) for x in w[b:e]], np.int64) + used)
            ids.append(np.array([-len(where)], np.int64))
            at += e - b + 1
        used += len(known)
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    if where:
        starts = np.array([x[0] for x in where])
        found = runs_of(np.concatenate(ids), least, power)
        for (b, length, d), j in zip(found, np.searchsorted(starts, [x[0] for x in found], "right") - 1, strict=True):
            place, k, first = where[j]
            out[k].append((b - place + first, length, d))
    for x in out:
        x.sort(key=lambda y: (y[0], y[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined, without those that some run holds after its first period."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for b, length, d in runs:
            change[b + d] += 1
            change[b + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, *, least: int = LEAST, power: int = POWER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period in words, by start and period), collapsed (string) for each row.

    A run is a stretch of words of smallest period q that no word beside it extends, of at least `least` words and `power` periods.
    `collapsed` is the text with its words joined by one space, without the words that any run holds after its first q. Texts are
    searched in a map without a shuffle, some 65,536 words at once; a longer text alone, in memory proportional to its words
    (about 200 bytes for each in a repeated stretch). Null or empty text: no words, no runs, an empty string. Repeated rows are
    searched each; a null id is kept. An empty table gives none; other columns, whatever their names, are ignored.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids: list, words: list[list[bytes]]) -> pa.RecordBatch:
            found = text_runs(words, least, power)
            runs = pa.array([[{"start": b, "length": n, "period": d} for b, n, d in x] for x in found], pa.list_(_RUN))
            text = pa.array([collapsed(w, x) for w, x in zip(words, found, strict=True)], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), runs, text], ["doc_id", "n_words", "runs", "collapsed"])

        ids, words, size = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                for i, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
                    w = text.split()
                    if words and size + len(w) > _TOGETHER:
                        yield done(ids, words)
                        ids, words, size = [], [], 0
                    ids.append(i)
                    words.append(w)
                    size += len(w)
        if ids:
            yield done(ids, words)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(search, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
