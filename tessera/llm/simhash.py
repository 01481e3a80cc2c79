"""Near-duplicate texts by SimHash fingerprints of 64 bits, linked at a Hamming distance of two or less."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, forget, materialize, mix
from .components import connected_components

#: Differing bits of a link; a ring of one segment more, so that some segment of a link's two fingerprints is equal.
DISTANCE, WIDTHS = 2, (22, 21, 21)
#: Fingerprints of a chain that are compared with each other; more are looked up by a longer chain.
COMPARED = 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 1 << 22


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, by pieces of some 4 MB."""
    at = 0
    while at < len(data):
        end = _SPACE.search(data, at + _PIECE) if at + _PIECE < len(data) else None
        cut = end.start() if end else len(data)
        yield data[at:cut].translate(_LOWER).split()
        at = cut


def fingerprint(data: bytes, n: int = 3, seed: int = 42) -> int:
    """A bit is set if it is in over half the hashes of the n-word shingles, each counted as often as it comes; a shorter text is one
    shingle, one without words has no bit."""
    ones, total, carried = np.zeros(64, np.int64), 0, []

    def count(shingles: list[bytes]) -> None:
        nonlocal ones, total
        for k in range(0, len(shingles), 1 << 14):
            part = shingles[k : k + (1 << 14)]
            h = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in part), np.uint64, len(part))
            ones = ones + np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            total += len(part)

    for piece in _words(data):
        words = carried + piece
        count([b" ".join(x) for x in zip(*(words[k:] for k in range(n)), strict=False)])
        carried = words[len(words) - n + 1 :] if len(words) >= n - 1 else words
    if not total and carried:
        count([b" ".join(carried)])
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, *, n: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x, n, seed) for x in as_bytes(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64), pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _segments() -> list[tuple[int, int]]:
    """(first bit, width) of each segment of the ring."""
    return [(sum(WIDTHS[:k]), w) for k, w in enumerate(WIDTHS)]


def _mask(low: int, width: int) -> int:
    return ((1 << width) - 1) << low


def chains() -> list[tuple[int, int, int]]:
    """(segment, free bit or -1, bits that must be equal) of each chain of two segments: the first one is equal, the two differ by one bit
    at most, which is the free one. By the pigeonring principle the differences of two fingerprints linked by DISTANCE = 2 can be walked
    from some of the three segments so that each chain of k segments has floor(k * 2 / 3) of them at most: 0, 1, 2."""
    out = []
    ring = _segments()
    for k, (low, width) in enumerate(ring):
        after, more = ring[(k + 1) % len(ring)]
        both = _mask(low, width) | _mask(after, more)
        out += [(k, -1, both)] + [(k, b, both & ~(1 << b)) for b in range(after, after + more)]
    return out


_CHAINS = chains()


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From distinct fingerprints a row (chain, key, fp) for each chain."""
    masks = np.array([m for _, _, m in _CHAINS], np.uint64)
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            fp = b.column(0).slice(at, 4096).to_numpy().view(np.uint64)
            key = (fp[:, None] & masks).ravel().view(np.int64)
            chain = np.tile(np.arange(len(masks), dtype=np.int16), len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(chain), pa.array(key), pa.array(np.repeat(fp, len(masks)).view(np.int64))], ["chain", "key", "fp"])


def _links(fp: np.ndarray, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs among fingerprints of one chain and key; where a bit is free, of those that differ in it."""
    free = _CHAINS[chain][1]
    if free < 0:
        a, b = np.triu_indices(len(fp), 1)
        a, b = fp[a], fp[b]
    else:
        one = (fp >> np.uint64(free)) & np.uint64(1) == 1
        a, b = (x.ravel() for x in np.meshgrid(fp[~one], fp[one]))
    ok = np.bitwise_count(a ^ b) <= DISTANCE
    return a[ok], b[ok]


def _compare(most: int):
    """Over rows (chain, key, fp) sorted by chain and key: the links among at most `most` rows of a key as (-1, a, b), and all rows of keys
    that have more as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(chain, a, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(chain, pa.int16()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["chain", "key", "fp"])

        def finish(run: tuple[int, int] | None, held: np.ndarray, large: bool):
            if large and len(held):
                yield out(np.full(len(held), run[0], np.int16), np.full(len(held), run[1], np.int64), held)
            elif len(held) > 1:
                a, b = _links(held, run[0])
                if len(a):
                    yield out(np.full(len(a), -1, np.int16), a, b)

        now, held, large = None, np.empty(0, np.uint64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            chain, key, fp = (batch.column(k).to_numpy() for k in range(3))
            fp = fp.view(np.uint64)
            new = np.flatnonzero((chain[1:] != chain[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(fp)]])
            first = (int(chain[0]), int(key[0]))
            if now is not None and now != first:
                yield from finish(now, held, large)
                held, large = np.empty(0, np.uint64), False
            links: list[tuple[np.ndarray, np.ndarray]] = []
            inner = np.flatnonzero(ends - starts > 1)
            for k in sorted({0, *inner.tolist(), len(starts) - 1}):
                mine = fp[starts[k] : ends[k]]
                if k == 0:
                    held = np.concatenate([held, mine])
                    if k < len(starts) - 1:  # the run ends within the batch
                        yield from finish(first, held, large or len(held) > most)
                        held, large = np.empty(0, np.uint64), False
                elif k == len(starts) - 1:
                    held = mine
                elif len(mine) > most:
                    yield from finish((int(chain[starts[k]]), int(key[starts[k]])), mine, True)
                else:
                    links.append(_links(mine, int(chain[starts[k]])))
            now = (int(chain[-1]), int(key[-1]))
            if len(held) > most:
                large = True
                yield from finish(now, held, True)
                held = np.empty(0, np.uint64)
            a, b = (np.concatenate([x[k] for x in links]) if links else np.empty(0, np.uint64) for k in (0, 1))
            if len(a):
                yield out(np.full(len(a), -1, np.int16), a, b)
        yield from finish(now, held, large)

    return run


def _long_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (chain, key, fp) a row (chain, key, z, fp) for each value z of the third segment that the chain's budget still admits about
    the fingerprint's own, so that linked fingerprints, and no others, share a row: about each where no bit is free; where one
    is, about those in which it is set, the others having their own value only."""
    ring = _segments()
    for batch in batches:
        chain, key, fp = (batch.column(k).to_numpy() for k in range(3))
        for c in np.unique(chain).tolist():
            mine = chain == c
            x, its = fp[mine].view(np.uint64), key[mine]
            k, free, _ = _CHAINS[c]
            low, width = ring[(k + 2) % len(ring)]
            last = x & np.uint64(_mask(low, width))
            around = last[:, None] ^ np.array([0, *(1 << b for b in range(low, low + width))], np.uint64)
            wide = np.ones(around.shape, bool)
            if free >= 0:
                wide[:, 1:] = ((x >> np.uint64(free)) & np.uint64(1) == 1)[:, None]
            at = np.flatnonzero(wide)
            row = at // around.shape[1]
            columns = (np.full(len(at), c, np.int16), its[row], around.ravel()[at].view(np.int64), x[row].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["chain", "key", "z", "fp"])


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mix(b.column(k).to_numpy().view(np.uint64)).view(np.int64)) for k in (0, 1)], ["a", "b"])


def fingerprint_links(distinct: DataFrame, *, compared: int = COMPARED) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that differ in DISTANCE bits or less: all that connect what is connected.

    Each fingerprint goes to its chains of two segments, some 42 bits with one free; those of one chain and key are compared if they
    are no more than `compared`. The others, at most 2^22 of a chain and key, take the third segment into the chain: every value within
    its budget is a key, shared by at most 23 fingerprints, which are all linked and are joined as a star.
    """
    rows = distinct.mapInArrow(_chain_rows, "chain short, key long, fp long").repartition("chain", "key").sortWithinPartitions("chain", "key")
    met = materialize(rows.mapInArrow(_compare(compared), "chain short, key long, fp long"), "simhash-chains")
    stars = met.where("chain >= 0").mapInArrow(_long_chains, "chain short, key long, z long, fp long")
    least = F.expr("min(fp) over (partition by chain, key, z)")
    stars = stars.select(least.alias("a"), F.col("fp").alias("b")).where("a <> b")
    return met.where("chain < 0").select(F.col("key").alias("a"), F.col("fp").alias("b")).unionByName(stars)


def near_duplicates(docs: DataFrame, *, n: int = 3, seed: int = 42, compared: int = COMPARED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long), component_id for each row: texts whose fingerprints differ in two bits or less are linked, and the component id is
    the smallest id that links reach.

    Null or empty text: fingerprint zero, linked like any other. Repeated rows are linked to each other. Null ids are passed over
    for the smallest one; a component of null ids only has none. A text is read in pieces, so a very long one needs no more than its
    own size in memory. An empty table gives none. Other columns, whatever their names, are ignored.
    """
    rows = materialize(fingerprints(docs, n=n, seed=seed, id_col=id_col, text_col=text_col), "simhash-rows")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    links = fingerprint_links(distinct.select("fp"), compared=compared)
    labels = connected_components(links.mapInArrow(_mixed, "a long, b long"))
    nodes = materialize(distinct.mapInArrow(_numbered, "node long, fp long, least long").join(labels, "node", "left").select("fp", "least", "root"), "simhash-nodes")
    least = materialize(nodes.where("root is not null").groupBy("root").agg(F.min("least").alias("all")), "simhash-least")
    named = materialize(nodes.join(least, "root", "left").select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("all")).alias("component_id")), "simhash-named")
    forget(labels, nodes, least, distinct)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mix(b.column(0).to_numpy().view(np.uint64)).view(np.int64)), b.column(0), b.column(1)], ["node", "fp", "least"])
