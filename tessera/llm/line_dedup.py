"""Line dedup over all documents, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD, forget, materialize, quoted

#: Lines of a window, and the words that fewer lines must have more of to be a window too.
LINES, PASSAGE = 3, 50


def _windows(lines: Column, n: int, passage: int | None) -> tuple[Column, Callable[[Column], Column]]:
    """Hashes of lines, and from a column of them an array of (pos, last, h1, h2): each n consecutive lines with a word in them, and fewer
    of more than `passage` words together."""
    words = lambda s: F.lit(0) if passage is None else F.regexp_count(s, F.lit(WORD))
    hashed = F.transform(
        F.filter(F.transform(lines, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: x["s"].rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["s"]).alias("h1"), F.xxhash64(F.lit(1), x["s"]).alias("h2"), words(x["s"]).alias("words")),
    )

    def over(a: Column) -> Column:
        at = lambda i, k, f: F.get(a, i + k)[f]
        starts = lambda m: F.when(F.size(a) >= m, F.sequence(F.lit(0), F.size(a) - m)).otherwise(F.array().cast("array<int>"))
        window = lambda i, m: F.struct(
            at(i, 0, "i").alias("pos"), at(i, m - 1, "i").alias("last"),
            F.xxhash64(*[at(i, k, "h1") for k in range(m)]).alias("h1"), F.xxhash64(*[at(i, k, "h2") for k in range(m)]).alias("h2"),
        )
        joint = lambda i, m: sum((at(i, k, "words") for k in range(1, m)), at(i, 0, "words"))
        worded = lambda m: F.transform(F.filter(starts(m), lambda i: joint(i, m) > passage), lambda i: window(i, m))
        fewer = [] if passage is None else [worded(m) for m in range(1, n)]
        return F.concat(F.transform(starts(n), lambda i: window(i, n)), *fewer)

    return hashed, over


def _gaps(covered: Column) -> Column:
    """From an array of (pos, last) in order, what lies between them, as (first line, number of lines): the lines that stay."""
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<s:int,l:int>>").alias("gaps"))
    return F.aggregate(
        covered, start,
        lambda s, x: F.struct(
            F.greatest(s["end"], x["last"] + 1).alias("end"),
            F.when(x["pos"] > s["end"], F.concat(s["gaps"], F.array(F.struct(s["end"].alias("s"), (x["pos"] - s["end"]).alias("l"))))).otherwise(s["gaps"]).alias("gaps"),
        ),
        lambda s: F.concat(s["gaps"], F.array(F.struct(s["end"].alias("s"), F.lit(1 << 30).alias("l")))),
    )


def _key(id_: str = "id", th: str = "th") -> Column:
    """One number for a document's id and text."""
    return F.xxhash64(id_, th)


def _most_frequent(keys: Column) -> Column:
    """Of an array of longs the one that is there most often, the largest of those: a run of the sorted array."""
    start = F.struct(F.lit(None).cast("long").alias("best"), F.lit(0).alias("most"), F.lit(None).cast("long").alias("now"), F.lit(0).alias("n"))

    def step(s: Column, k: Column) -> Column:
        n = F.when(s["now"].eqNullSafe(k), s["n"] + 1).otherwise(1)
        better = n >= s["most"]
        return F.struct(F.when(better, k).otherwise(s["best"]).alias("best"), F.when(better, n).otherwise(s["most"]).alias("most"), k.alias("now"), n.alias("n"))

    return F.aggregate(F.sort_array(keys), start, step, lambda s: s["best"])


def _copies(rows: DataFrame, covered: DataFrame, near: tuple[int, int, int]) -> DataFrame:
    """id, th, kin: the documents that are near copies, but not exact ones, of the one that most of their repeated windows were first seen in, with the keys of that
    one and of its other near copies that such windows were first seen in.

    near = (n, num, den): den * |A & B| >= num * |A | B| of the sets of n-word shingles, by hash, of both whole texts, words as runs of other
    than ASCII space, A-Z lower-cased. Each document is compared with one other, so there is no pair within a group but with its origin.
    """
    n, num, den = near
    pairs = covered.select("id", "th", _key().alias("k"), _most_frequent(F.transform("r", lambda x: x["f"])).alias("origin")).where("k <> origin")
    named = pairs.select(F.explode(F.array("k", "origin")).alias("k")).distinct()
    upper = "".join(map(chr, range(65, 91)))
    words = F.regexp_extract_all(F.translate("text", upper, upper.lower()), F.lit(f"({WORD})"))
    texts = rows.select(_key().alias("k"), "th", "text").join(named, "k", "left_semi").select("k", "th", words.alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.hash(F.slice("w", i, size))))
    sets = materialize(texts.select("k", "th", grams.alias("s")).groupBy("k").agg(F.first("th").alias("of"), F.first("s").alias("s")), "line-sets")
    both = pairs.join(sets.drop("of"), "k").join(sets.select(F.col("k").alias("origin"), "of", F.col("s").alias("t")), "origin").where("th <> of")
    shared = F.size(F.array_intersect("s", "t"))
    out = materialize(both.where(den * shared >= num * (F.size("s") + F.size("t") - shared)).select("id", "th", "k", "origin"), "line-copies")
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))
    seen = covered.alias("c").join(out.alias("o"), same("c", "o")).select("o.id", "o.th", "o.k", "o.origin", F.explode(F.array_distinct(F.transform("r", lambda x: x["f"]))).alias("f"))
    theirs = out.select(F.col("k").alias("f"), F.col("origin").alias("of"))
    kin = seen.join(theirs, "f", "left").where((F.col("f") == F.col("origin")) | (F.col("of") == F.col("origin")))
    kin = materialize(kin.groupBy("id", "th").agg(F.collect_set("f").alias("kin")), "line-kin")
    forget(sets, out)
    return kin


def dedup_lines(docs: DataFrame, *, n: int = LINES, passage: int | None = PASSAGE, near: tuple[int, int, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages cut out of the text, and columns n_lines and n_removed (long) after the others.

    A window is n consecutive lines that hold a word, or fewer of more than `passage` words together (none if it is None). Of the
    windows that are equal, the first by (id, position) stays; the lines from the first to the last of each later one are removed,
    those of overlapping windows once. The earliest copy of any line is therefore never removed. Blank lines are in no window
    but go with one that spans them. With near = (n, num, den), a near copy, but no exact one, by that share of n-word shingles of the document that most
    of its windows were first seen in keeps the windows first seen there, or in another near copy of it: a later join finds the copy whole, while what both
    repeat of others goes from both. Null text: kept as null, no lines. Empty text: one line, kept. Rows with equal id and text are
    one document, from which the same lines go; null ids come first. An empty table gives none. Columns named n_lines or n_removed
    (in any case) are replaced; all others, whatever their names, are kept as they are.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    text = F.col("row")[text_col]
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in names]).alias("row"))  # so that no name of theirs meets one of ours
    rows = rows.select("row", F.col("row")[id_col].alias("id"), F.xxhash64(text).alias("th"))
    hashed, over = _windows(F.split(text, "\n", -1), n, passage)
    windows = rows.where(text.isNotNull()).select("id", "th", hashed.alias("a")).select("id", "th", F.explode(over(F.col("a"))).alias("w")).select("id", "th", "w.*")
    windows = materialize(windows, "line-windows")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("id", "th", "pos")).alias("f"), F.count("*").alias("c")).where("c > 1").select("h1", "h2", "f")
    first = materialize(first, "line-firsts")  # so that a hot window's partition of the join can be split
    later = windows.join(first, ["h1", "h2"]).where(~F.struct("id", "th", "pos").eqNullSafe(F.col("f")))
    if near is None:
        covered = later.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("pos", "last"))).alias("r"))
    else:
        covered = materialize(later.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("pos", "last", _key("f.id", "f.th").alias("f")))).alias("r")), "line-covered")
        copies = _copies(rows.select("id", "th", text.cast("string").alias("text")), covered, near)
        c, o = covered.alias("c"), copies.alias("o")
        covered = c.join(o, F.col("c.id").eqNullSafe(F.col("o.id")) & (F.col("c.th") == F.col("o.th")), "left")
        others = F.when(F.col("kin").isNull(), F.col("r")).otherwise(F.filter("r", lambda x: ~F.array_contains("kin", x["f"])))
        covered = covered.select("c.id", "c.th", F.transform(others, lambda x: F.struct(x["pos"].alias("pos"), x["last"].alias("last"))).alias("r"))
        covered = covered.where(F.size("r") > 0)
    c, d = covered.alias("c"), rows.alias("d")
    joined = d.join(c, F.col("d.id").eqNullSafe(F.col("c.id")) & (F.col("d.th") == F.col("c.th")), "left").select("row", "r")
    joined = joined.withColumn("lines", F.split(text, "\n", -1))
    kept = F.flatten(F.transform(_gaps(F.col("r")), lambda g: F.slice(F.col("lines"), g["s"] + 1, g["l"])))
    joined = joined.withColumn("kept", F.when(F.col("r").isNotNull(), kept))
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long")
    out = [F.coalesce(F.array_join("kept", "\n"), text).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names]
    removed = F.when(F.col("kept").isNotNull(), n_lines - F.size("kept")).otherwise(0).cast("long")
    return joined.select(*out, n_lines.alias("n_lines"), removed.alias("n_removed"))
