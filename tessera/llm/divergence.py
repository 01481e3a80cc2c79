"""How each source of a language departs from the others and from the whole, by the terms it uses; in whole numbers only."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import as_bytes, forget, materialize

#: Documents of a language that a kept term is in at least, and ranks of terms that are given.
LEAST, RANKS = 3, 200
#: Rows of a group that are ranked directly, beyond those that are in by their value.
ROOM = 4096
#: Letters as they are, A to Z in lower case, all other ASCII characters a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms that a task holds before it passes them on.
_HELD = 1 << 18
_COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From lang, source and text: n occurrences in docs documents of each term; for each group also a null term that is in none."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            k = len(terms) + 1
            yield pa.RecordBatch.from_arrays([
                pa.repeat(pa.scalar(lang, pa.string()), k), pa.repeat(pa.scalar(source, pa.string()), k), pa.array([*terms, None], pa.binary()).cast(pa.string()),
                pa.array([*n.values(), 0], pa.int64()), pa.array([*map(docs.__getitem__, terms), 0], pa.int64()),
            ], ["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            words = text.translate(_FOLD).split()
            before = len(n)
            n.update(words)
            docs.update(set(words))
            size += len(n) - before
            if size > _HELD:
                yield from rows()
                size = 0
    yield from rows()


def _share(count: str, total: str) -> str:
    """1 + floor(1000000000 * count / total) of count <= total, three digits at a time: nothing overflows below 9 * 10^15."""
    parts, rest = [], f"({count})"
    for _ in range(3):
        parts.append(f"({rest} * 1000L) div nullif({total}, 0)")
        rest = f"(({rest} * 1000L) % nullif({total}, 0))"
    return f"(1 + (({parts[0]}) * 1000 + {parts[1]}) * 1000 + {parts[2]})"


def _gap(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def term_counts(docs: DataFrame, *, least: int = LEAST, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The kept terms of each group with its counts, and the groups, as written tables.

    Terms: lang, gid, term, n (occurrences in the group), m (in the language). Groups: gid, lang, source, total (of n), lang_total, kept (terms
    of the language); a group without terms is among them.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text")).mapInArrow(_count, _COUNTS)
    one = rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    counted = one.select(
        "lang", "source", "term", "n", F.sum("docs").over(term).alias("lang_docs"), F.sum("n").over(term).alias("m"), F.row_number().over(term.orderBy("source")).alias("nth"),
    ).where(F.col("term").isNull() | (F.col("lang_docs") >= least))
    counted = materialize(counted.drop("lang_docs"), "divergence-counts")
    groups = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counted.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if(F.col("term").isNotNull() & (F.col("nth") == 1)).alias("kept"))
    groups = materialize(groups.join(langs, "lang").select(F.monotonically_increasing_id().alias("gid"), "lang", "source", "total", "lang_total", "kept"), "divergence-groups")
    terms = counted.where("term is not null").join(groups.select("lang", "source", "gid"), ["lang", "source"]).select("lang", "gid", "term", "n", "m")
    terms = materialize(terms, "divergence-terms")
    forget(counted)
    return terms, groups


def _pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b, value of each ordered pair of a language's groups: the sum over its kept terms of the gap of a's share from b's.

    A term that a group lacks has its base share there, so the sum is that of the base shares, times all terms, corrected by the terms of a, those of b,
    and those of both. The first two need only how many terms of a group have a share; the last is a join of the terms' rows.
    """
    base = groups.withColumn("base", F.expr(f"case when kept > 0 then {_share('1', '(total + kept)')} end"))
    shares = terms.join(base.select("gid", "total", "kept", "base"), "gid").select("lang", "term", "gid", "base", F.expr(_share("n + 1", "(total + kept)")).alias("p"))
    side = lambda df, s, *more: df.select("lang", *more, *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in ("lang", *more)])
    both = side(shares, "a", "term").join(side(shares, "b", "term"), ["lang", "term"]).where("gid_a < gid_b")
    fixed = lambda a, b: f"{_gap('p_' + a, 'p_' + b)} - ({_gap('p_' + a, 'base_' + b)}) - ({_gap('base_' + a, 'p_' + b)}) + {_gap('base_' + a, 'base_' + b)}"
    both = both.groupBy("gid_a", "gid_b").agg(F.sum(F.expr(fixed("a", "b"))).alias("x"), F.sum(F.expr(fixed("b", "a"))).alias("y"))
    both = both.select(F.explode(F.array(F.struct(F.col("gid_a").alias("a"), F.col("gid_b").alias("b"), F.col("x").alias("value")), F.struct(F.col("gid_b").alias("a"), F.col("gid_a").alias("b"), F.col("y").alias("value")))).alias("r")).select("r.*")

    counts = shares.groupBy("lang", "gid", "p", "base").agg(F.count("*").alias("k"))
    other = side(base.select("lang", "gid", "base"), "o")
    single = counts.join(other, "lang").where("gid <> gid_o").groupBy("gid", "gid_o").agg(
        F.sum(F.expr(f"k * (({_gap('p', 'base_o')}) - ({_gap('base', 'base_o')}))")).alias("x"), F.sum(F.expr(f"k * (({_gap('base_o', 'p')}) - ({_gap('base_o', 'base')}))")).alias("y"),
    )
    single = single.select(F.explode(F.array(F.struct(F.col("gid").alias("a"), F.col("gid_o").alias("b"), F.col("x").alias("value")), F.struct(F.col("gid_o").alias("a"), F.col("gid").alias("b"), F.col("y").alias("value")))).alias("r")).select("r.*")
    of = base.select("lang", "gid", "base", "kept")
    plain = side(of, "a", "kept").join(side(of.drop("kept"), "b"), "lang").where("gid_a <> gid_b")
    plain = plain.select(F.col("gid_a").alias("a"), F.col("gid_b").alias("b"), F.expr(f"coalesce(kept * ({_gap('base_a', 'base_b')}), 0L)").alias("value"))
    return plain.unionByName(single).unionByName(both).groupBy("a", "b").agg(F.sum("value").alias("value"))


def top_ranked(rows: DataFrame, k: int, *, group: str = "gid", value: str = "value", item: str = "item", room: int = ROOM) -> DataFrame:
    """The first k rows of each group by value (a long of zero or more) descending, then item (a string, distinct within a group) by its
    bytes, with rank; rows must be a written table.

    Radix selection: histograms over 16 bits of the values, then over the next 16, find the prefix that the kth value begins with,
    for all groups at once; where rows of one value are too many still, histograms over two bytes of their items go on, past the
    bytes that all have in common. It ends for a group when no more than `room` rows share the prefix, or all of them are in. Only those
    and the rows before them are ranked, k + room of a group at most; no histogram has more than 65,792 bins a group.
    """
    g = F.col(group)
    most = rows.groupBy(group).agg(F.count("*").alias("c"), F.max(value).alias("top"))
    none = F.lit(None).cast("binary")
    # rows with value >> shift above `high` are in; of the c rows with that prefix, and items that begin with `head`, `need` are
    state = most.select(
        g.alias("g"), F.lit(0).cast("long").alias("high"), F.lit(63).alias("shift"), F.lit(k).cast("long").alias("need"), "c",
        F.greatest(F.length(F.bin("top")) - 16, F.lit(0)).alias("next"), none.alias("head"), F.lit(False).alias("done"),
    ).withColumn("done", F.col("c") <= F.greatest(F.col("need"), F.lit(room)))
    state = materialize(state, "radix-state")
    by_value = rows.select(g.alias("g"), F.col(value).alias("v"), F.encode(item, "UTF-8").alias("t"))
    while not state.where("not done").isEmpty():
        opened = state.where("not done").drop("c", "done")
        inside = by_value.join(opened, "g").where("shiftright(v, shift) = high and (head is null or startswith(t, head))")
        bits = inside.where("shift > 0").groupBy("g", F.expr("shiftright(v, next)").alias("digit")).agg(F.count("*").alias("c"))
        order = Window.partitionBy("g").orderBy(F.desc("digit"))
        bits = bits.withColumn("upto", F.sum("c").over(order)).join(opened, "g").where("upto >= need and upto - c < need")
        bits = bits.select("g", F.col("digit").alias("high"), F.col("next").alias("shift"), (F.col("need") - F.col("upto") + F.col("c")).alias("need"), "c", F.greatest(F.col("next") - 16, F.lit(0)).alias("next"), "head")
        tied = inside.where("shift = 0")
        same = tied.groupBy("g").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).select("g", _common_bytes("lo", "hi").alias("common"))
        tied = tied.join(same, "g").groupBy("g", "common", F.expr("substring(t, length(common) + 1, 2)").alias("digit")).agg(F.count("*").alias("c"))
        order = Window.partitionBy("g").orderBy("digit")
        tied = tied.withColumn("upto", F.sum("c").over(order)).join(opened, "g").where("upto >= need and upto - c < need")
        tied = tied.select("g", "high", "shift", (F.col("need") - F.col("upto") + F.col("c")).alias("need"), "c", "next", F.concat("common", "digit").alias("head"))
        more = bits.unionByName(tied).withColumn("done", F.col("c") <= F.greatest(F.col("need"), F.lit(room)))
        before, state = state, materialize(state.where("done").select(*more.columns).unionByName(more), "radix-state")
        forget(before)
    found = rows.join(state.select(F.col("g").alias(group), "high", "shift", "head"), group)
    item_bytes = F.encode(item, "UTF-8")
    head = F.col("head").isNull() | (F.substring(item_bytes, F.lit(1), F.length("head")) <= F.col("head"))
    prefix = F.expr(f"shiftright({value}, shift)")
    found = found.where((prefix > F.col("high")) | ((prefix == F.col("high")) & head)).select(*rows.columns)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), item_bytes))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _common_bytes(a: str, b: str):
    """The bytes that two binary values begin with in common."""
    least = f"least(length({a}), length({b}))"
    n = f"aggregate(sequence(0, {least}), 0, (n, k) -> if(n = k and k < {least} and substring({a}, k + 1, 1) = substring({b}, k + 1, 1), n + 1, n))"
    return F.expr(f"substring({a}, 1, {n})")


def audit_sources(docs: DataFrame, *, least: int = LEAST, ranks: int = RANKS, room: int = ROOM, **columns: str) -> DataFrame:
    """lang, source, part, item, value (long), rank (int) for each group of lang and source.

    A language keeps the terms (runs of letters, only A-Z lower-cased) that `least` of its documents or more hold. A term's share p in a
    group or language is 1 + floor(10^9 * (count + 1) / (all counts + kept terms)), and the gap of p from q floor((p - q)^2 / q). Part
    `pair`: the other sources of the language, by the gaps of the group's shares from theirs, summed over all kept terms. Part `term`: the
    first `ranks` terms that the group uses more than its language does, by that gap.

    Nulls in lang, source and text are read as ''. A group without terms has pairs with value by base shares alone (0 where its language keeps no
    term). Ties go by the items' UTF-8 bytes. Repeated rows count each; a long text is counted whole, in one task. An empty
    table gives none; other columns, whatever their names, are ignored. Exact below 9 * 10^15
    occurrences and 10^9 kept terms of a language.
    """
    terms, groups = term_counts(docs, least=least, **columns)
    named = groups.select("gid", "lang", "source")
    pairs = _pairs(terms, groups).join(named.withColumnRenamed("gid", "a"), "a").join(named.select(F.col("gid").alias("b"), F.col("source").alias("item")), "b")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    p, q = _share("n + 1", "(total + kept)"), _share("m + 1", "(lang_total + kept)")
    more = terms.join(groups.select("gid", "total", "lang_total", "kept"), "gid").select("gid", F.col("term").alias("item"), F.expr(p).alias("p"), F.expr(q).alias("q"))
    more = materialize(more.where("p > q").select("gid", "item", F.expr(_gap("p", "q")).alias("value")), "divergence-gaps")
    top = top_ranked(more, ranks, room=room).join(named, "gid")
    return pairs.unionByName(top.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
