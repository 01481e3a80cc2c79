"""N-gram Jaccard join of all documents: a blocked sparse product of document by n-gram incidence under size-derived bounds.

1. Documents with equal sets are one class; a class takes part once.
2. Grams have a fixed order, the rarest first by a table of counters over all documents (an order only: any serves). Two sets
   that link share k grams among the first n - ceil(share * n) + k of either, for any k up to their intersection; k is 1 for
   small sets and up to 4 for larger ones, of which chance makes too many meet once.
3. Sets meet at such grams. Where at most `list_pairs` do, their pairs are candidates if they meet k times and sizes and
   positions allow a link. Longer lists are never made into pairs of rows; their sets are all candidates of each other.
4. What candidates connect is a cluster. A cluster is dealt into blocks of bounded number and size. A cluster of one block is multiplied
   with itself. In a larger one each block is multiplied with a few pivots first, and links found merge sets; then only blocks
   that hold candidates of each other which are not merged yet are multiplied, and only with the sets that are such candidates.
5. A product multiplies the incidence of two blocks by slices of grams, drops pairs below the bound on their overlap, and gives a
   spanning forest of the links found. Components of all links are the result.

No candidate is capped or sampled: what a pivot doesn't merge is multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, as_bytes, chunk_rows, forget, fresh, materialize, mix, quoted, sum_chunks, window_hashes, word_hashes
from .components import connected_components, merge_components

COUNTERS = 1 << 22
FILTER_BITS = 1 << 24
_SLICE = 2048
#: Grams of an average set in a block: a block of large sets holds fewer of them.
_GRAMS = 2048


def shingles(data: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word windows of a text, A-Z in lower case; the whole sequence where it is shorter."""
    return np.unique(window_hashes(word_hashes(data.lower().split()), n))


def _need(total: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least intersection of two sets of that total size that link: den * i >= num * (total - i)."""
    return -(-num * total // (num + den))


def _meetings(n: np.ndarray) -> np.ndarray:
    """How many grams of its first ones a set of that size shares with any that it links to (the lesser of two sets' numbers holds)."""
    return 1 + np.minimum(n // 64, 3)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        u, v = root(x), root(y)
        if u != v:
            parent[max(u, v)] = min(u, v)
            out.append((x, y))
    return out


def _signature(g: np.ndarray) -> int:
    return int(mix(np.add.reduce(mix(g)) + np.array([len(g)], np.uint64)).astype(np.int64)[0])


def _count_grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            held, size = [], 0
            for data in as_bytes(b.column(0)):
                held.append((shingles(data, n) >> np.uint64(42)).astype(np.int32))
                size += len(held[-1])
                if size > COUNTERS:
                    total += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, size = [], 0
            if size:
                total += np.bincount(np.concatenate(held), minlength=COUNTERS)
        if total.any():
            yield chunk_rows(None, np.minimum(total, 65_535).astype(np.uint16))

    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).astype(np.int64)))


def _meet(limit: int, num: int, den: int):
    """From rows (gram, sig, n, pos) in order of gram and sig: pairs of the sets of a list that sizes and positions allow, how often they
    meet here and how often they must, or, of a list longer than limit, its members (hot, gram, sig). Repeated rows count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot_gram = [np.zeros(0, np.int64)] * 4, None
        for b in _then_end(batches):
            rows = held if b is None else [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, b.columns, strict=True)]
            if len(rows[0]):
                once = np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])
                rows = [x[once] for x in rows]
            gram, sig, size, pos = rows
            hot: list[tuple[np.ndarray, np.ndarray]] = []
            start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
            length = np.diff(np.append(start, len(gram)))
            if hot_gram is not None and len(start) and gram[0] == hot_gram:
                hot.append((gram[: length[0]], sig[: length[0]]))
                whole = slice(1, None)
                kept_from = length[0]
            else:
                whole, kept_from = slice(0, None), 0
            start, length = start[whole], length[whole]
            if b is not None and len(start):  # the last list may go on
                last = start[-1]
                if length[-1] > limit:
                    hot_gram = gram[last]
                    hot.append((gram[last:], sig[last:]))
                    kept_from = len(gram)
                else:
                    kept_from = last
                start, length = start[:-1], length[:-1]
            for s, m in zip(start[length > limit], length[length > limit], strict=True):
                hot.append((gram[s : s + m], sig[s : s + m]))
            left, right, times = [], [], []
            for m in np.unique(length[(length > 1) & (length <= limit)]):
                i, j = np.triu_indices(m, 1)
                at = start[length == m][:, None]
                i, j = (at + i).ravel(), (at + j).ravel()
                need = _need(size[i] + size[j], num, den)
                reach = np.minimum(size[i] - pos[i], size[j] - pos[j])
                k = _meetings(np.minimum(size[i], size[j]))
                ok = (reach + k - 1 >= need) & (den * np.minimum(size[i], size[j]) >= num * np.maximum(size[i], size[j]))
                left.append(np.minimum(sig[i[ok]], sig[j[ok]]))
                right.append(np.maximum(sig[i[ok]], sig[j[ok]]))
                times.append(k[ok])
            held = [x[kept_from:] for x in rows]
            none = [np.zeros(0, np.int64)]
            pairs, met = np.unique(np.stack([np.concatenate(left + none), np.concatenate(right + none), np.concatenate(times + none)]), axis=1, return_counts=True)
            ha, hb = np.concatenate([x for x, _ in hot] + none), np.concatenate([x for _, x in hot] + none)
            is_hot = np.concatenate([np.zeros(pairs.shape[1], bool), np.ones(len(ha), bool)])
            one = np.ones(len(ha), np.int64)
            columns = (is_hot, np.concatenate([pairs[0], ha]), np.concatenate([pairs[1], hb]), np.concatenate([met, one]), np.concatenate([pairs[2], one]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["hot", "a", "b", "met", "must"])

    return run


def _then_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _products(n: int, num: int, den: int):
    """From rows (c, i, j, side, sig, data) in order of (c, i, j): a spanning forest of the links between the sets of side 1 and those of
    side 2 of each product; sets of side 3 are of both. data is a text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in _then_end(batches):
            found: list[tuple[int, int]] = []
            if b is None:
                if held:
                    found += _product(held, n, num, den)
            elif b.num_rows:
                key = np.stack([b.column(k).to_numpy() for k in range(3)])
                cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
                if held and any(held[0].column(k)[0].as_py() != b.column(k)[0].as_py() for k in range(3)):
                    found += _product(held, n, num, den)
                    held = []
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                    held.append(b.slice(lo, hi - lo))
                    if hi < b.num_rows:
                        found += _product(held, n, num, den)
                        held = []
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

    return run


def _product(rows: list[pa.RecordBatch], n: int, num: int, den: int) -> list[tuple[int, int]]:
    side, sig = (np.concatenate([r.column(k).to_numpy() for r in rows]) for k in (3, 4))
    sig, once, at = np.unique(sig, return_index=True, return_inverse=True)
    sides = np.zeros(len(sig), np.int64)
    np.bitwise_or.at(sides, at, side)
    data = [x for r in rows for x in r.column(5)]
    sets = [shingles(data[k].as_py(), n) for k in once]
    size, flat = np.array([len(g) for g in sets], np.int64), np.concatenate(sets)
    left, right = np.flatnonzero(sides & 1), np.flatnonzero(sides & 2)
    if not len(left) or not len(right):
        return []
    fits = den * np.minimum(size[left][:, None], size[right]) >= num * np.maximum(size[left][:, None], size[right])
    fits &= left[:, None] < right if (sides == 3).all() else left[:, None] != right
    if not fits.any():
        return []
    row = np.repeat(np.arange(len(sig)), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    shared = ~new | ~np.concatenate([new[1:], [True]])  # grams of two sets or more
    row, col = row[shared], np.cumsum(new[shared]) - 1
    overlap = np.zeros((len(left), len(right)), np.float32)
    width = min(_SLICE, int(col[-1]) + 1 if len(col) else 0)
    for k in range(0, int(col[-1]) + 1 if len(col) else 0, _SLICE):
        part = slice(*np.searchsorted(col, [k, k + _SLICE]))
        x = np.zeros((len(sig), width), np.float32)
        x[row[part], col[part] - k] = 1
        overlap += x[left] @ x[right].T
    x, y = np.nonzero(fits & (overlap >= _need(size[left][:, None] + size[right], num, den)))
    return [(int(sig[p]), int(sig[q])) for p, q in _forest(left[x], right[y])]


def _bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A filter of FILTER_BITS bits of the values of a long column."""
    bit = F.pmod(column, F.lit(FILTER_BITS))
    bits = df.select(F.floor(bit / 32).cast("int").alias("w"), F.expr(f"shiftleft(1L, int(pmod({column}, {FILTER_BITS}) % 32))").alias("v"))
    out = np.zeros(FILTER_BITS // 32, np.int64)
    got = bits.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()  # FILTER_BITS / 32 numbers at most
    out[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return out


def _levels(texts: DataFrame, n: int) -> np.ndarray:
    """How common the grams of each counter are, as a small number that grows with the logarithm of their count."""
    table = np.zeros(COUNTERS, np.int64)
    for r in sum_chunks(texts.mapInArrow(_count_grams(n), "name string, chunk int, counts binary")).collect():  # COUNTERS numbers
        part = np.frombuffer(r.counts, np.int64)
        table[r.chunk * len(part) : (r.chunk + 1) * len(part)] = part
    return np.minimum(255, np.round(8 * np.log2(table + 1))).astype(np.uint8)


def _scanned(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, th, n (size of the set), sig (of the set) and first (its first grams, the rarest first) of each row."""
    level = rows.sparkSession.sparkContext.broadcast(_levels(rows.select("text"), n))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = level.value, set()
        for b in batches:
            size, sig, first = [], [], []
            for data in as_bytes(b.column(2)):
                g = shingles(data, n)
                m = len(g)
                size.append(m)
                sig.append(_signature(g))
                listed = m and sig[-1] not in seen  # equal sets of a task list their grams once, if it remembers
                first.append(g[np.lexsort((g, levels[g >> np.uint64(42)]))[: m - -(-num * m // den) + int(_meetings(m))]] if listed else g[:0])
                seen.add(sig[-1])
            if len(seen) > 1 << 18:
                seen.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int32()), pa.array(sig, pa.int64()), _lists(first)], ["doc_id", "th", "n", "sig", "first"])

    return materialize(rows.mapInArrow(scan, "doc_id long, th long, n int, sig long, first array<long>"), "ngram-scan")


def _texts(rows: DataFrame, active: DataFrame) -> DataFrame:
    """sig and data (the text's bytes) of each row of active (sig, rep_id, rep_th); texts are picked by a filter of fixed size first."""
    chosen = rows.sparkSession.sparkContext.broadcast(_bitmap(active, "rep_th"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = chosen.value
        for b in batches:
            at = b.column(1).to_numpy().astype(np.int64) % FILTER_BITS
            b = b.filter(pa.array(((bits[at >> 5] >> (at & 31)) & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(as_bytes(b.column(2)), pa.binary())], ["doc_id", "th", "data"])

    read = rows.mapInArrow(pick, "doc_id long, th long, data binary")
    found = read.join(active, (F.col("th") == F.col("rep_th")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
    return materialize(found.select("sig", "data").dropDuplicates(["sig"]), "ngram-texts")  # rows that repeat an id and a text come once


def _links(cells: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that the products of cells (c, i, j, side, sig) find."""
    dealt = cells.join(texts, "sig").select("c", "i", "j", "side", "sig", "data").repartition("c", "i", "j").sortWithinPartitions("c", "i", "j")
    return materialize(dealt.mapInArrow(_products(n, num, den), "a long, b long"), "ngram-links")


def _parts(rows: int, grams: int) -> Column:
    """Into how many blocks of so many rows, and of so many grams in all, a group of sets (n: grams of a set) is dealt."""
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.count("*") / rows, F.sum("n") / grams)).cast("int"))


def _open_cells(met: DataFrame, placed: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """Cells for the candidates in clusters of several blocks that have different labels: of a short list its pairs, of a long one those
    that lack the list's commonest label, gathered in blocks of their own, with the blocks of all of the list. placed: sig, n, c, blk."""
    named = placed.join(labels.select(F.col("node").alias("sig"), "root"), "sig", "left").select("sig", "n", "c", "blk", F.coalesce("root", "sig").alias("label"))
    named = materialize(named, "ngram-labelled")
    one = named.select(F.col("sig").alias("a"), "c", F.col("blk").alias("x"), F.col("label").alias("la"))
    two = named.select(F.col("sig").alias("b"), F.col("blk").alias("y"), F.col("label").alias("lb"))
    pairs = met.where("not hot").join(one, "a").join(two, "b").where("la <> lb")
    cells = pairs.select("c", F.col("x").alias("own"), F.col("y").alias("other"), F.col("a").alias("sig")).unionByName(pairs.select("c", F.col("y").alias("own"), F.col("x").alias("other"), F.col("b").alias("sig")))
    side = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2)
    cells = cells.select("c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "sig")

    lists = materialize(met.where("hot").select(F.col("a").alias("gram"), F.col("b").alias("sig")).join(named, "sig"), "ngram-hot")
    most = lists.groupBy("gram", "label").count().groupBy("gram").agg(F.max_by("label", F.struct("count", "label")).alias("most"), F.count("*").alias("labels"))
    most = materialize(most.where("labels > 1").select("gram", "most"), "ngram-most")
    marked = materialize(lists.join(most, "gram").withColumn("left_over", F.col("label") != F.col("most")), "ngram-marked")
    left = marked.where("left_over").select("c", "sig", "n").distinct()
    sizes = left.groupBy("c").agg(_parts(4 * block, block * _GRAMS).alias("parts"))
    left = materialize(left.join(sizes, "c").select("c", "sig", (-2 - F.pmod(F.xxhash64("sig", F.lit(11)), F.col("parts"))).cast("int").alias("j")), "ngram-left")
    their = marked.where("left_over").select("gram", "sig").join(left, "sig").select("gram", "c", "j").distinct()
    needed = materialize(their.join(marked.select("gram", F.col("blk").alias("i")).distinct(), "gram").select("c", "i", "j").distinct(), "ngram-needed")
    own = marked.select("c", F.col("blk").alias("i"), "sig").distinct().join(needed, ["c", "i"]).select("c", "i", "j", F.lit(1).alias("side"), "sig")
    theirs = left.join(needed, ["c", "j"]).select("c", "i", "j", F.lit(2).alias("side"), "sig")
    out = materialize(cells.unionByName(own).unionByName(theirs).distinct(), "ngram-cells")
    forget(named, lists, most, marked, left, needed)
    return out


def ngram_groups(docs: DataFrame, *, n: int = 4, num: int = 85, den: int = 100, list_pairs: int = 64, block: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id, group for each row: as ngram_components, and a number of the component,
    which rows without id have too; null for an empty set."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("text"))
    scanned = _scanned(rows, n, num, den)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    classes = scanned.where("n > 0").groupBy("sig").agg(F.max("n").alias("n"), first.alias("f"))
    classes = materialize(classes.select("sig", "n", F.col("f.doc_id").alias("rep_id"), F.col("f.th").alias("rep_th")), "ngram-classes")

    grams = scanned.select("sig", "n", F.posexplode("first").alias("pos", "gram")).select("gram", "sig", "n", "pos").repartition("gram").sortWithinPartitions("gram", "sig")
    met = grams.mapInArrow(_meet(list_pairs, num, den), "hot boolean, a long, b long, met long, must long")
    met = materialize(met.groupBy("hot", "a", "b").agg(F.sum("met").alias("met"), F.first("must").alias("must")).where("met >= must").select("hot", "a", "b"), "ngram-lists")
    gram_node = F.col("a").bitwiseXOR(F.lit(0x5851F42D4C957F2D))  # grams and sets are nodes of one graph
    clusters = connected_components(met.select(F.when(F.col("hot"), gram_node).otherwise(F.col("a")).alias("a"), "b"))
    members = materialize(classes.join(clusters, F.col("sig") == F.col("node")).select("sig", "n", "rep_id", "rep_th", F.col("root").alias("c")), "ngram-members")
    forget(clusters)
    few = block // 2 or 1
    blocks = members.groupBy("c").agg(_parts(block, block * _GRAMS).alias("nb"), _parts(few, few * _GRAMS).alias("np"))
    blocks = materialize(blocks, "ngram-blocks")
    active = materialize(members.join(blocks, "c").withColumn("blk", F.pmod(F.xxhash64("sig"), F.col("nb")).cast("int")), "ngram-active")
    texts = _texts(rows, active.select("sig", "rep_id", "rep_th"))

    number = lambda x, kind="int": F.lit(x).cast(kind)
    whole = active.where("nb = 1").select("c", number(0).alias("i"), number(0).alias("j"), number(3).alias("side"), "sig")
    large = active.where("nb > 1")
    own = large.select("c", F.col("blk").alias("i"), number(-1).alias("j"), number(1).alias("side"), "sig")
    pivots = large.where(F.pmod(F.xxhash64("sig", F.lit(7)), F.col("np")) == 0)
    pivots = pivots.select("c", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), number(-1).alias("j"), number(2).alias("side"), "sig")
    links = _links(whole.unionByName(own).unionByName(pivots), texts, n, num, den)
    labels = connected_components(links)
    if not large.isEmpty():
        cells = _open_cells(met, large.select("sig", "n", "c", "blk"), labels, block)
        if not cells.isEmpty():
            more = _links(cells, texts, n, num, den)
            old, labels = labels, merge_components(labels, more)
            forget(old, more)
        forget(cells)
    forget(met, members, blocks, active, texts, links)

    least = materialize(labels.join(classes.select(F.col("sig").alias("node"), "rep_id"), "node").groupBy("root").agg(F.min("rep_id").alias("least")), "ngram-least")
    linked = labels.join(least, "root").select(F.col("node").alias("sig"), "least", "root")
    named = materialize(classes.join(linked, "sig", "left").select("sig", F.coalesce("least", "rep_id").alias("component_id"), F.coalesce("root", "sig").alias("group")), "ngram-named")
    forget(labels, least, classes)
    some = scanned.where("n > 0").select("doc_id", "th", "n", "sig").join(named, "sig").select("doc_id", "th", "n", "component_id", "group")
    empty = scanned.where("n = 0").select("doc_id", "th", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"))
    return some.unionByName(empty).select("doc_id", "th", F.col("n").cast("long").alias("n_shingles"), "component_id", "group")


def ngram_components(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: documents whose sets of n-word shingles have den * |A & B| >= num * |A | B|
    are linked, and the component id is the smallest id that links reach. The options are those of ngram_groups.

    Null text or one without words: an empty set, linked with nothing, its own component. Repeated rows are linked to each other.
    Null ids are passed over for the smallest one; a component of null ids only has none. An empty table gives none. Other columns,
    whatever their names, are ignored.
    """
    return ngram_groups(docs, **options).select("doc_id", "n_shingles", "component_id")


def keep_one_each(docs: DataFrame, groups: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component of groups (ngram_groups of docs), and all rows without a word; with the columns of docs.

    The row with the smallest id stays; among rows of one id that with the smallest hash of its text; of rows that have both in
    common, one. Rows without an id stay only where no row of their component has one.
    """
    names, p = docs.columns, fresh("keep_", docs.columns)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    kept = groups.where("group is not null").groupBy("group").agg(F.min(order).alias("k")).select(F.coalesce("k.doc_id", F.lit(0)).alias(f"{p}id"), F.col("k.none").alias(f"{p}none"), F.col("k.th").alias(f"{p}th"), F.lit(True).alias(f"{p}found"))
    text, mine = F.col(quoted(text_col)).cast("string"), F.col(quoted(id_col)).cast("long")
    keys = [f"{p}th", f"{p}id", f"{p}none"]  # never null, so that the join's partitions serve the window
    rows = docs.withColumns(dict(zip(keys, (F.xxhash64(text), F.coalesce(mine, F.lit(0)), mine.isNull()), strict=True)))
    others = [F.col(quoted(c)) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = rows.join(kept, keys, "left").withColumn(f"{p}nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*others))))
    has_word = F.coalesce(text.rlike(WORD), F.lit(False))
    return rows.where(~has_word | (F.col(f"{p}found") & (F.col(f"{p}nth") == 1))).select(*[F.col(quoted(c)) for c in names])
