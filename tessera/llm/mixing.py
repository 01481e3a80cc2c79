"""Mixing sources to target weights: fixed-length blocks, multinomial counts per shard, index permutations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import as_bytes, materialize, mix


@dataclass(frozen=True)
class Mix:
    """documents: doc_id, size, source, source_size, target, taken; slots: shard, source_ix, slot, block, words, at (sorts a
    shard); pieces: source_ix, start, block, doc_id, size, at, words (which part of a block is of which document; start tells the
    documents of a source apart); sources: source_ix, name, source_size, target and the numbers of blocks."""

    documents: DataFrame
    slots: DataFrame
    pieces: DataFrame
    sources: DataFrame

    def places(self) -> DataFrame:
        """For each document of the mix (source_ix, start, doc_id): where its words go, an array of (shard, at, block, first, words) in
        order of shard and at: the slot that is sorted by `at` within its shard has, from its word `first` on, so many of its words."""
        words = F.least("words", F.col("slot_words") - F.col("at"))
        used = self.slots.select("source_ix", "block", "shard", F.col("at").alias("slot_at"), F.col("words").alias("slot_words"))
        met = self.pieces.join(used, ["source_ix", "block"]).where("slot_words > at")
        place = F.struct("shard", F.col("slot_at").alias("at"), "block", F.col("at").alias("first"), words.alias("words"))
        return met.groupBy("source_ix", "start", "doc_id").agg(F.sort_array(F.collect_list(place)).alias("places"))


def capped_targets(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """total shared by weight, none above cap times its size; the excess goes to the others by weight, again and again. The same as
    the shares of mix_sources, for few sources."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        whole = sum(weights[k] for k in sorted(open_))
        over = {k for k in open_ if left * weights[k] / whole >= cap * sizes[k]}
        for k in over or open_:
            target[k] = float(cap * sizes[k]) if over else left * weights[k] / whole
        if not over:
            break
        left -= sum(target[k] for k in sorted(over))
        open_ -= over
    return target


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 by key, at i: a Feistel network over the next even power of two, walked until it is below n."""
    half = np.maximum(1, np.ceil(np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 1)) / 2)).astype(np.uint64)
    mask, x, todo = (np.uint64(1) << half) - np.uint64(1), i.astype(np.uint64), np.ones(len(i), bool)
    while todo.any():
        at, h, m, k = x[todo], half[todo], mask[todo], key[todo]
        left, right = at >> h, at & m
        for r in range(4):
            left, right = right, left ^ (mix(mix(right + np.uint64(r + 1)) ^ k) & m)
        x[todo] = (left << h) | right
        todo &= x >= n.astype(np.uint64)
    return x.astype(np.int64)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = pa.array([len(x.split()) for x in as_bytes(b.column(2))], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sizes], ["doc_id", "source", "size"])


def _running(df: DataFrame, key: str, bucket: Column, order: Sequence[str], value: str) -> DataFrame:
    """df with column start: the sum of value over the rows of the same key before this one, by bucket, then order. No task holds more
    than a bucket, or a row for each bucket of a key."""
    df = df.withColumn("_b", bucket)
    sums = df.groupBy(key, "_b").agg(F.sum(value).alias("_v"))
    sums = sums.withColumn("_base", F.sum("_v").over(Window.partitionBy(key).orderBy("_b")) - F.col("_v")).drop("_v")
    own = F.sum(value).over(Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return df.join(sums, [key, "_b"]).withColumn("start", F.col("_base") + own).drop("_b", "_base")


def _sources(sized: DataFrame, weights: Sequence[float], share: float, cap: float, block_words: int) -> tuple[DataFrame, int]:
    """A row per source: source_ix, name, source_size, rows, target, full (whole blocks), per_round (blocks), quota (slots), part (words of
    the last slot, 0 for all of them); and the sum of the quotas. Sources are numbered and shared out by Spark; the driver sees sums."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
    by_name = F.col("source").asc_nulls_last()
    ranged = materialize(sums.repartitionByRange(by_name).withColumn("p", F.spark_partition_id()), "mix-by-name")
    before = ranged.groupBy("p").count()  # a row per partition
    before = before.withColumn("base", F.sum("count").over(Window.orderBy("p")) - F.col("count")).drop("count")
    ix = (F.col("base") + F.row_number().over(Window.partitionBy("p").orderBy(by_name)) - 1).cast("int")
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.col("source_ix") % len(weights))
    listed = ranged.join(before, "p").select(ix.alias("source_ix"), F.col("source").alias("name"), "n", "rows").withColumn("w", w)
    listed = materialize(listed, "mix-sources")
    total, whole = listed.agg(F.coalesce(F.sum("n"), F.lit(0)) * F.lit(float(share)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    # who is at its cap: a round for each time that the excess, shared again, brings more there
    left, capped = float(total), -1
    while True:
        over = F.lit(left) * F.col("w") / F.lit(float(whole)) >= cap * F.col("n") if whole else F.lit(True)
        took, open_, now = listed.agg(F.coalesce(F.sum(F.when(over, cap * F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0)), F.count_if(over)).first()
        if now == capped:
            break
        left, whole, capped = float(total) - float(took), float(open_), now
    n, bw = F.col("n"), F.lit(block_words).cast("long")
    out = listed.withColumn("target", F.when(over, (cap * n).cast("double")).otherwise(F.lit(left) * F.col("w") / F.lit(float(whole or 1))))
    out = out.withColumns({"goal": F.least(F.floor("target"), F.floor(cap * n)).cast("long"), "full": F.expr(f"n div {block_words}")})
    out = out.withColumn("per_round", F.col("full") + (n % bw > 0).cast("long")).withColumn("rounds", F.expr("case when n > 0 then goal div n else 0 end"))
    out = out.withColumn("rest", F.col("goal") - F.col("rounds") * n).withColumn("part", F.col("rest") % bw)
    out = out.withColumn("quota", F.col("rounds") * F.col("per_round") + F.expr(f"rest div {block_words}") + (F.col("part") > 0).cast("long"))
    out = out.select("source_ix", "name", n.alias("source_size"), "rows", "target", "full", "per_round", "quota", "part")
    out = materialize(out, "mix-quotas")
    return out, int(out.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0])


def _draws(sources: DataFrame, slots: int, shard_slots: int, most_groups: int, seed: int) -> DataFrame:
    """(shard, source_ix, n): multinomial counts of each shard. Sources are drawn in groups, most_groups at most, by the sums of their
    quotas; what a group gets is drawn again among its sources, so no task holds numbers of all sources, however many they are."""
    spark = sources.sparkSession
    wide = -(-sources.count() // most_groups) or 1
    group = F.floor(F.col("source_ix") / wide).cast("int").alias("g")
    sums = sorted(map(tuple, sources.groupBy(group).agg(F.sum("quota")).collect()))  # most_groups rows at most
    numbers, chance = np.array([g for g, _ in sums], np.int32), np.array([q for _, q in sums], float) / max(slots, 1)
    members = sources.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("source_ix", "quota"))).alias("m"))  # `wide` in each
    members = members.select("g", F.col("m.source_ix").alias("ix"), F.col("m.quota").alias("q"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                n = np.random.default_rng([seed, shard]).multinomial(min(shard_slots, slots - shard * shard_slots), chance)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard)), pa.array(numbers[at]), pa.array(n[at].astype(np.int64))], ["shard", "g", "n"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for shard, g, n, ix, q in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p = np.array(q, float)
                for k, x in zip(ix, np.random.default_rng([seed, shard, g]).multinomial(n, p / p.sum()).tolist(), strict=True):
                    if x:
                        for column, value in zip(out, (shard, k, x), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], ["shard", "source_ix", "n"])

    drawn = spark.range(-(-slots // shard_slots)).mapInArrow(draw, "shard long, g int, n long")
    return materialize(drawn.join(members, "g").select("shard", "g", "n", "ix", "q").mapInArrow(split, "shard long, source_ix int, n long"), "mix-draws")


def _refilled(dealt: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """(shard, source_ix, start, n): places that draws beyond a quota leave free, given to the sources that were drawn too rarely. There
    are as many of the one as of the other; which place gets which is a pseudorandom permutation."""
    one, small = F.lit(0).alias("k"), 64
    had = dealt.groupBy("source_ix").agg(F.sum("kept").alias("had"))
    missing = sources.join(had, "source_ix", "left").select(one, "source_ix", F.coalesce("had", F.lit(0)).alias("had"), (F.col("quota") - F.coalesce("had", F.lit(0))).alias("lacks")).where("lacks > 0")
    missing = _running(missing, "k", F.floor(F.col("source_ix") / 4096), ["source_ix"], "lacks").select("source_ix", "had", "lacks", F.col("start").alias("lo"))
    missing = materialize(missing, "mix-missing")
    count = int(missing.agg(F.coalesce(F.sum("lacks"), F.lit(0))).first()[0])
    free = dealt.groupBy("shard").agg(F.sum(F.col("n") - F.col("kept")).alias("f")).where("f > 0").withColumn("k", one)
    free = _running(free, "k", F.floor(F.col("shard") / 4096), ["shard"], "f")
    free = free.select("shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("f") - 1)).alias("r"))

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = permuted(b.column(1).to_numpy(), np.full(b.num_rows, count), np.full(b.num_rows, seed * 7919 + 1, np.uint64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t)], ["shard", "t"])

    places = free.mapInArrow(permute, "shard long, t long").withColumn("b", F.expr(f"t div {small}"))
    spans = missing.withColumn("b", F.explode(F.sequence(F.expr(f"lo div {small}"), F.expr(f"(lo + lacks - 1) div {small}"))))
    met = places.join(spans, "b").where("t >= lo and t < lo + lacks")  # 64 places and 64 spans of a bucket at most
    return met.select("shard", "source_ix", (F.col("had") + F.col("t") - F.col("lo")).alias("start"), F.lit(1).cast("long").alias("n"))


def mix_sources(
    docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2, block_words: int = 1024, shard_slots: int = 4096,
    bucket_rows: int = 2048, most_groups: int = 65_536, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> Mix:
    """Draws share times all words of docs, by source.

    Sources by code point, null last, weigh as in weights, repeating. The words of a source, its documents in an order dealt by
    hash, are packed into blocks of block_words words; the last may be shorter. Each shard of shard_slots slots draws how many
    blocks it takes from each source from a multinomial distribution; places that would pass a source's quota go, in an order that
    is permuted, to the sources that were drawn too rarely, so that a source gives the whole words of its target exactly. Slot j of
    a source is the block that a permutation of its indices, another one for each round, has at j; the short block ends each round,
    and the last slot may take the first words of its block only. So no document is taken more than ceil(cap) times.

    Null or empty text: size 0, never taken. Repeated rows are documents of their own. An empty table gives none. Other columns,
    whatever their names, are ignored. There may be any number of sources, and of documents in one: the order of a source's
    documents is made of buckets of about bucket_rows.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    sized = materialize(sized.mapInArrow(_sizes, "doc_id long, source string, size long"), "mix-sizes")
    sources, slots = _sources(sized, weights, share, cap, block_words)
    named = sized.join(sources.select("source_ix", "name", "rows"), F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "source_ix", "size", "rows")

    bucket = F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("rows") / bucket_rows))
    placed = _running(named.where("size > 0"), "source_ix", bucket, ["doc_id", "size"], "size")
    w, end = F.lit(block_words), F.col("start") + F.col("size")
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / w), F.floor((end - 1) / w))))
    begin = F.greatest(F.col("start"), F.col("block") * w)
    pieces = cut.withColumns({"at": begin - F.col("block") * w, "words": F.least(end, (F.col("block") + 1) * w) - begin})
    pieces = pieces.select("source_ix", "start", "block", "doc_id", "size", "at", "words")

    dealt = _running(_draws(sources, slots, shard_slots, most_groups, seed), "source_ix", F.floor(F.col("shard") / 4096), ["shard"], "n")
    kept = F.greatest(F.lit(0).cast("long"), F.least("n", F.col("quota") - F.col("start")))
    dealt = materialize(dealt.join(sources.select("source_ix", "quota"), "source_ix").select("shard", "source_ix", "start", "n", kept.alias("kept")), "mix-dealt")
    given = dealt.where("kept > 0").select("shard", "source_ix", "start", F.col("kept").alias("n")).unionByName(_refilled(dealt, sources, seed))
    given = given.join(sources.select("source_ix", "full", "per_round", "quota", "part", "source_size"), "source_ix")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, ix, start, n, full, per_round, quota, part, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                j = np.arange(start, start + n)
                turn, i = np.divmod(j, per_round)
                inner = i < full
                key = mix((turn * 1_000_003 + ix * 65_537 + seed).astype(np.uint64))
                block = np.where(inner, permuted(np.where(inner, i, 0), np.full(n, max(full, 1)), key), full)
                words = np.where(inner, block_words, size - full * block_words)
                if part:
                    words = np.where(j == quota - 1, part, words)
                at = mix(j.astype(np.uint64) * np.uint64(31) + np.uint64(shard * 1009 + ix)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(n, shard), np.full(n, ix, np.int32), j, block, words, at)], ["shard", "source_ix", "slot", "block", "words", "at"])

    given = given.select("shard", "source_ix", "start", "n", "full", "per_round", "quota", "part", "source_size")
    filled = given.mapInArrow(fill, "shard long, source_ix int, slot long, block long, words long, at long")
    whole = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words)
    times = filled.join(sources.select("source_ix", "source_size"), "source_ix").groupBy("source_ix", "block").agg(
        F.sum((F.col("words") == whole).cast("long")).alias("times"), F.sum(F.when(F.col("words") < whole, F.col("words")).otherwise(0)).alias("first"))
    took = F.col("words") * F.col("times") + F.greatest(F.lit(0), F.least(F.col("words"), F.col("first") - F.col("at")))
    taken = pieces.join(times, ["source_ix", "block"], "left").groupBy("source_ix", "start", "doc_id", "size").agg(F.sum(F.coalesce(took, F.lit(0))).alias("taken"))
    none = named.where("size = 0").select("source_ix", F.lit(None).cast("long").alias("start"), "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    documents = taken.unionByName(none).join(sources.select("source_ix", "name", "source_size", "target"), "source_ix")
    return Mix(documents.select("doc_id", "size", F.col("name").alias("source"), "source_size", "target", "taken", "source_ix", "start"), filled, pieces, sources)
