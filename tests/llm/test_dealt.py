"""The dealt operators against brute force on small tables with nulls, ties, repeated rows, long texts and clashing columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, components, decontaminate, langid, line_dedup, mixing, ngram_join, pii, quality_gam, quality_rules, stats, warc

SF = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_words string, size int, n_removed int, words string, c int"


def docs(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, la, so, "x", 1, 2, "y", 3) for i, t, la, so in rows], DOCS)


def some_texts(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["alpha", "beta", "gamma", "delta", "eins", "zwei", "the", "of", "to", "fin"] + [f"w{k}" for k in range(60)]
    out = []
    for k in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(0, 90))]
        text = " ".join(w)
        if k % 5 == 0 and out:
            w = SPLIT.findall(out[r.randrange(len(out))])
            for _ in range(r.randint(0, 2)):
                if w:
                    w[r.randrange(len(w))] = "edit"
            text = "\n".join(" ".join(w[j : j + 8]) for j in range(0, len(w), 8))
        out.append(text)
    return out


HARD = [(900, None), (901, ""), (902, " \t\n "), (903, "one"), (904, "a b c"), (905, "x " * 3000), (906, "longword" * 5000), (None, "some text of no id at all here"), (907, "é à ü\x85\xa0ß ı İ ́")]


def rows_of(seed=1, n=60):
    rows = [(k, t) for k, t in enumerate(some_texts(seed, n))] + HARD
    rows += [rows[3], rows[3]]
    return [(i, t, ("en", "de", None)[k % 3], ("s1", "s2", None, "S3")[k % 4]) for k, (i, t) in enumerate(rows)]


# 1
def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, t int")


def test_chat_round_trip(spark):
    texts = ["", None, "</s>", "\\", "\\_", "\\a</s>\\", "<<SYS>>[INST] x [/INST]", "[ROLE] u [TEXT] v [/ROLE]", "<", "[INST", "a\nb", "é😀", "x" * 100_000]
    roles = ["user", "assistant", "system", "tool", "", None, "</s>", "[TEXT]"]
    r = random.Random(3)
    rows = [(c, t, r.choice(roles), r.choice(texts), "z", 1) for c in range(40) for t in range(r.randint(1, 6))]
    rows += [(100, 0, "user", "same", "z", 1)] * 2 + [(101, None, "user", "n", "z", 1), (101, 0, "assistant", "m", "z", 1), (None, 0, "user", "q", "z", 1)]
    from pyspark.sql import functions as F

    out = chat.format_chats(turns_of(spark, rows)).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("lost", chat.masked_text(F.col("segments"))).collect()
    want = {}
    for c, t, role, text, *_ in rows:
        want.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert {o.conv_id for o in out} == set(want)
    for o in out:
        w = [x[2:] for x in sorted(want[o.conv_id])]
        assert [tuple(b) for b in o.back] == w and o.n_turns == len(w)
        assert o.lost == "".join(t for role, t in w if role == "assistant")
        assert o.formatted == "".join(s.text for s in o.segments)
        state, ok = "", True
        for role, _ in w:
            ok, state = ok and role in chat.INSTRUCT.follows.get(state, ()), role
        assert o.valid == (ok and state in chat.INSTRUCT.final)
    assert chat.format_chats(turns_of(spark, [])).count() == 0


def test_template_rules():
    with pytest.raises(ValueError):
        chat.Template({"user": ("abca", "x")}, ("1", "2", "3"), (), {}, ())
    with pytest.raises(ValueError):
        chat.Template({"user": ("[a]", "[[a]]")}, ("1", "2", "3"), (), {}, ())


# 2
def test_targets():
    assert mixing.capped_targets([100, 100, 100], [5, 2, 1], 450, 2) == pytest.approx([200, 500 / 3, 250 / 3])
    assert sum(mixing.capped_targets([10, 1000], [5, 1], 1515, 2)) == pytest.approx(1515)
    assert mixing.capped_targets([0, 0], [5, 2], 0, 2) == [0, 0]


def test_permutation():
    import numpy as np

    for n in (1, 2, 3, 7, 64, 1000):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


@pytest.mark.parametrize("groups", [65_536, 2])
def test_mixing(spark, groups):
    rows = rows_of()
    options = {"block_words": 16, "shard_slots": 8, "bucket_rows": 20, "most_groups": groups}
    m = mixing.mix_sources(docs(spark, rows), **options)
    got, again = sorted(map(tuple, m.documents.collect()), key=str), sorted(map(tuple, mixing.mix_sources(docs(spark, rows), **options).documents.collect()), key=str)
    assert got == again and len(got) == len(rows)
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(SPLIT.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.capped_targets([size[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5 * sum(size.values()), 2), strict=True))
    taken = {}
    for doc_id, n, source, whole, target, took, *_ in got:
        assert whole == size[source] and target == pytest.approx(want[source]) and 0 <= took <= 2 * n
        taken[source] = taken.get(source, 0) + took
    for s in names:
        assert taken[s] == min(int(want[s]), 2 * size[s])
    slots, pieces = m.slots.collect(), m.pieces.collect()
    assert len({(x.source_ix, x.slot) for x in slots}) == len(slots)  # no slot twice, none missing
    assert {(x.source_ix, x.slot) for x in slots} == {(x.source_ix, j) for x in m.sources.collect() for j in range(x.quota)}
    shards = [x.shard for x in slots]
    assert all(shards.count(k) == 8 for k in range(max(shards))) and shards.count(max(shards)) <= 8
    # each word of a block is of one document, and what a document gives is what slots take of its pieces
    cells, gave = {}, {}
    for p in pieces:
        for w in range(p.at, p.at + p.words):
            assert cells.setdefault((p.source_ix, p.block, w), (p.doc_id, p.start)) == (p.doc_id, p.start)
    for x in slots:
        for w in range(x.words):
            k = (x.source_ix, cells[x.source_ix, x.block, w])
            gave[k] = gave.get(k, 0) + 1
    for r in m.documents.collect():
        assert r.taken == gave.get((r.source_ix, (r.doc_id, r.start)), 0)
    for r in m.places().collect():
        assert sum(q.words for q in r.places) == gave[r.source_ix, (r.doc_id, r.start)] and list(r.places) == sorted(r.places)
    assert mixing.mix_sources(docs(spark, [])).documents.count() == 0
    assert mixing.mix_sources(docs(spark, [(1, None, "en", "s"), (2, "", "en", None)])).documents.agg({"taken": "sum"}).collect()[0][0] == 0


def test_mixing_of_many_sources(spark):
    rows = [(k, " ".join(["w"] * (1 + k % 7)), "en", f"s{k % 300:03d}") for k in range(900)]
    m = mixing.mix_sources(docs(spark, rows), block_words=4, shard_slots=16, most_groups=7)
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    want = mixing.capped_targets([size[s] for s in sorted(size)], [(5, 2, 1)[k % 3] for k in range(300)], 1.5 * sum(size.values()), 2)
    taken = {}
    for r in m.documents.collect():
        assert r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert [taken[s] for s in sorted(size)] == [min(int(t), 2 * size[s]) for t, s in zip(want, sorted(size), strict=True)]


# 3
def brute_lines(rows, n=3, passage=50):
    seen, removed = {}, {}
    occurrences = []
    for i, t in sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = t.split("\n")
        full = [k for k, x in enumerate(lines) if SPLIT.search(x)]
        for m in range(1, n + 1):
            for a in range(len(full) - m + 1):
                key = tuple(lines[x] for x in full[a : a + m])
                if m == n or sum(len(SPLIT.findall(x)) for x in key) > passage:
                    occurrences.append((i, t, full[a], full[a + m - 1], key))
    for i, t, first, last, key in sorted(occurrences, key=lambda x: (x[0] is not None, x[0] or 0, x[2])):
        if seen.setdefault(key, (i, t, first)) != (i, t, first):
            removed.setdefault((i, t), set()).update(range(first, last + 1))
    return removed


def test_line_dedup(spark):
    r = random.Random(5)
    pool = [f"line {k} here" for k in range(12)] + ["", "  ", "L " * 51, "M " * 50, "N " * 30, "O " * 25]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(r.randint(0, 12)))) for k in range(80)] + HARD
    rows += [rows[0], rows[1], (1, "other text")]
    full = [(i, t, "en", "s") for i, t in rows]
    got = line_dedup.dedup_lines(docs(spark, full)).collect()
    removed = brute_lines(rows)
    want = []
    for i, t in rows:
        gone = removed.get((i, t), set())
        want.append((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), 0 if t is None else t.count("\n") + 1, len(gone)))
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((g.doc_id, g.text, g.n_lines, g.n_removed) for g in got), key=key) == sorted(want, key=key)
    assert removed and {g.words for g in got} == {"y"}
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_keeps_any_columns(spark):
    names = ["_id", "_th", "_lines", "_kept", "_n", "row", "id", "th", "lines", "kept", "r", "a.b", "w", "N_LINES", "pos"]
    text = "a b\nc d\ne f\ng"
    rows = [(k, text, *range(50, 50 + len(names))) for k in (1, 2, 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in names))
    out = line_dedup.dedup_lines(d)
    assert out.columns == [c for c in d.columns if c != "N_LINES"] + ["n_lines", "n_removed"]
    for g in out.collect():
        assert g["_id"] == 50 and g["a.b"] == 61 and g.n_removed == (0 if g.doc_id == 1 else 4) and g.text == (text if g.doc_id == 1 else "")


def test_line_dedup_of_two_lines(spark):
    line = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))[:199]
    short = lambda k, n: " ".join(f"{chr(97 + j % 26)}{k}" for j in range(n))
    two, few, one = [short(1, 26), short(2, 26)], [short(3, 25), short(4, 25)], "a " * 51
    rows = [(1, "\n".join([*two, line(1, 9)])), (2, "\n".join([line(2, 9), two[0], "", two[1], line(3, 9)])), (3, "\n".join(two)), (4, "\n".join(few)), (5, "\n".join(few)), (6, one), (7, f"{one}\nx")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {g.doc_id: (g.text, g.n_removed) for g in line_dedup.dedup_lines(d).collect()}
    assert all(len(x) < 200 for x in (*two, *few, one))
    want = {i: (t, 0) for i, t in rows} | {2: (f"{line(2, 9)}\n{line(3, 9)}", 3), 3: ("", 2), 7: ("x", 1)}
    assert got == want
    assert sum(g.n_removed for g in line_dedup.dedup_lines(d, passage=None).collect()) == 0
    import corpus_pipeline

    assert {g.doc_id for g in corpus_pipeline.lines(spark, d, "").collect()} == {1, 2, 3, 4, 5, 6}  # 3 copies 1: the join drops it
    assert {g.doc_id for g in corpus_pipeline.near_duplicates(spark, corpus_pipeline.lines(spark, d, ""), "").collect()} == {1, 2, 4, 6}  # 5 is a copy of 4


def test_near_copies_keep_the_lines_of_their_original(spark):
    r = random.Random(31)
    line = lambda n=12: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    notice = [line() for _ in range(4)]  # boilerplate of many
    original = [line() for _ in range(30)]
    rows = [(1, [line() for _ in range(10)] + notice), (2, original + notice)]
    for k in range(3, 9):  # copies with a word changed in two lines, between boilerplate or without
        copy = list(original)
        for at in (k, 2 * k):
            copy[at] = copy[at].replace(" ", " changed ", 1)
        rows.append((k, copy + (notice if k % 2 else [])))
    rows += [(20, [line() for _ in range(10)] + notice), (21, original[:8] + [line() for _ in range(30)]), (22, original), (22, original)]
    d = docs(spark, [(i, "\n".join(t), "en", "s") for i, t in rows])
    got = line_dedup.dedup_lines(d, near=(5, 80, 100))
    assert got.columns == d.columns or set(d.columns) <= set(got.columns)
    by = {}
    for g in got.collect():
        by.setdefault(g.doc_id, []).append(g.text.split("\n"))
    assert by[2] == [original] and by[22] == [original, original]
    assert all(set(by[k][0]) >= set(original) - {original[k], original[2 * k]} for k in range(3, 9)) and all(len(by[k][0]) == 30 for k in range(3, 9))
    assert len(by[1][0]) == 14 and len(by[20][0]) == 10 and len(by[21][0]) == 30  # sharers lose the shared lines
    import corpus_pipeline

    left = corpus_pipeline.near_duplicates(spark, corpus_pipeline.lines(spark, d, ""), "")
    assert sorted(x.doc_id for x in left.collect()) == [1, 2, 20, 21]
    assert line_dedup.dedup_lines(docs(spark, []), near=(5, 80, 100)).count() == 0


def test_near_copies_of_hard_rows(spark):
    d = docs(spark, rows_of(4, 80))
    got = {}
    for x in line_dedup.dedup_lines(d, near=(5, 80, 100)).collect():
        got.setdefault(x.doc_id, set()).add(x.text)
    assert {k: len(v) for k, v in got.items()}.keys() == {i for i, *_ in rows_of(4, 80)} and got[900] == {None} and got[901] == {""}


# 4
def test_languages(spark):
    r = random.Random(2)
    words = {"en": ["the", "thing", "with", "that", "hello"], "de": ["der", "ung", "und", "nicht", "schön"], "fr": ["le", "eaux", "être", "dans", "oui"]}
    text = lambda la, n: " ".join(r.choice(words[la]) for _ in range(n))
    rows = [(k, text(la, r.randint(3, 40)), la, "s") for k in range(120) for la in [("en", "de", "fr")[k % 3]]]
    rows += [(500, None, "en", "s"), (501, "", "en", "s"), (502, "123 !? 4", "en", "s"), (503, text("en", 60) + " " + text("de", 60), None, "s"), (None, text("fr", 9), "fr", "s"), rows[0], (504, text("de", 30_000), None, "s")]
    d = docs(spark, rows)
    got = langid.predict_languages(d, langid.fit_languages(d)).collect()
    assert len(got) == len(rows)
    by = {g.doc_id: g for g in got}
    assert all(by[k].lang_pred == ("en", "de", "fr")[k % 3] and 0 <= by[k].score <= 1 for k in range(120))
    assert {by[k].lang_pred for k in (500, 501, 502)} == {"und"} and by[500].score == 0
    assert set(by[503].languages) == {"en", "de"} and abs(by[503].languages["en"] - 0.5) < 0.2
    assert by[504].lang_pred == "de" and by[None].held_out and by[None].lang_pred == "fr"
    import zlib

    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got if g.doc_id is not None)
    empty = docs(spark, [])
    assert langid.predict_languages(empty, langid.fit_languages(empty)).count() == 0
    assert langid.predict_languages(d, langid.fit_languages(empty)).select("lang_pred").distinct().collect()[0][0] == "und"


def test_an_empty_name_is_a_language(spark):
    r = random.Random(5)
    say = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    names = {"": ["the", "with", "that"], "de": ["der", "und", "nicht"]}
    d = docs(spark, [(k, say(names[la], 20), la, "s") for k in range(40) for la in [("", "de")[k % 2]]] + [(99, "12 !", "", "s")])
    got = {x.doc_id: x for x in langid.predict_languages(d, langid.fit_languages(d)).collect()}
    assert all(got[k].lang_pred == ("", "de")[k % 2] and 0.5 < got[k].score <= 1 and set(got[k].languages) == {("", "de")[k % 2]} for k in range(40))
    assert got[99].lang_pred == "und" and got[99].score == 0


def test_languages_by_brute_force(spark):
    import math

    import numpy as np

    r = random.Random(21)
    words = {"a": ["kala", "mono", "tiki"], "b": ["brugh", "sterk", "wend"], "c": ["ciao", "bello", "tiki"]}
    say = lambda la, n: " ".join(r.choice(words[la]) for _ in range(n))
    rows = [(k, say("abc"[k % 3], 8), "abc"[k % 3], "s") for k in range(30)] + [(100, say("a", 20) + " " + say("b", 12), None, "s"), (101, "Tiki, TIKI 77 tiki", None, "s")]
    d = docs(spark, rows)
    model = langid.fit_languages(d)
    import zlib

    counts = {la: {} for la in "abc"}
    three = lambda t: [x for b in [f" {re.sub(r'[^a-z]+', ' ', t.lower())} ".encode()] for x in (b[k : k + 3] for k in range(len(b) - 2))]
    bucket = lambda g: ((g[0] * 0x9E3779B1 + g[1] * 0x85EBCA77 + g[2] * 0xC2B2AE3D) & 0xFFFFFFFF) >> 16
    for i, t, la, _ in rows:
        if la and zlib.crc32(str(i).encode()) % 5:
            for g in three(t):
                counts[la][bucket(g)] = counts[la].get(bucket(g), 0) + 1
    total = {la: sum(c.values()) + 0.5 * langid.BUCKETS for la, c in counts.items()}
    p = lambda la, g: (counts[la].get(g, 0) + 0.5) / total[la]

    def shares(langs, c):
        w, n = [1 / len(langs)] * len(langs), sum(c.values())
        for _ in range(12):
            new = [sum(k * w[x] * p(la, g) / sum(w[y] * p(lb, g) for y, lb in enumerate(langs)) for g, k in c.items()) / n for x, la in enumerate(langs)]
            done, w = max(abs(x - y) for x, y in zip(new, w, strict=True)) < 1e-4, new
            if done:
                break
        return w

    for g in langid.predict_languages(d, model).collect():
        text = next(t for i, t, *_ in rows if i == g.doc_id)
        c = {}
        for x in three(text):
            c[bucket(x)] = c.get(bucket(x), 0) + 1
        first = shares("abc", c)
        order = sorted(range(3), key=lambda k: (-first[k], k))
        alone = {la: sum(k * math.log(p(la, x)) for x, k in c.items()) for la in "abc"}
        best, most, weight = [max("abc", key=lambda la: alone[la])], max(alone.values()), [1.0]
        for k in (2, 3):
            if first[order[k - 1]] < 0.02:
                break
            langs = ["abc"[x] for x in order[:k]]
            w = shares(langs, c)
            value = sum(n * math.log(sum(w[y] * p(la, x) for y, la in enumerate(langs))) for x, n in c.items()) - 6 * math.log(sum(c.values()) + 1) * (k - 1)
            if value > most:
                best, most, weight = langs, value, w
        assert set(g.languages) == set(best) and g.lang_pred == best[int(np.argmax(weight))]
        assert all(g.languages[la] == pytest.approx(x) for la, x in zip(best, weight, strict=True))


# 5
def brute_base(t):
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m[0])]


def test_pii(spark):
    r = random.Random(7)
    bits = ["a@b.co", "x.y@z", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111111111111111", "4111 1111-1111 1111", "4111111111111112", "+1 (659) 555-3949", "+1 2", "555-123-4567", "(659) 555-3949", " ", " ", "é", "😀", "abc", "_", ".", "-", "+", "joe [at] mail [dot] com", "card ", "v1.2.3.4", "0", "9" * 17, "a@b.c_d@e.f"]
    rows = [(k, "".join(r.choice(bits) for _ in range(r.randint(0, 14))), None, None) for k in range(400)]
    rows += [(i, t, None, None) for i, t in HARD] + [(950, "9 " * 4000, None, None), (951, "a" * 50_000, None, None), (952, "1." * 5000, None, None), (953, "+" + "1 " * 9000, None, None), rows[0]]
    got = pii.find_pii(docs(spark, rows)).collect()
    texts = dict((i, t) for i, t, *_ in rows)
    assert len(got) == len(rows)
    for g in got:
        base = [(s.kind, s.start, s.end) for s in g.spans if s.base]
        assert base == brute_base(texts[g.doc_id] or ""), texts[g.doc_id][:200]
        spans = [(s.kind, s.start, s.end) for s in g.spans]
        assert spans == sorted(spans)
        for s in g.spans:
            assert s.base or not any(b.start < s.end and s.start < b.end for b in g.spans if b.base)
    assert pii.find_pii(docs(spark, [])).count() == 0


def test_pii_adds_spans_and_rejects_decoys(spark):
    r = random.Random(31)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    digits = lambda n: "".join(r.choice("23456789") for _ in range(n))
    say = lambda n: " ".join(r.choice(["some", "plain", "words", "of", "text", "Wortzusammensetzung"]) for _ in range(n))
    true = {
        "secret": [lambda: f'token = "{hexes(40)}"', lambda: f"password={hexes(18)}", lambda: "AKIA" + "".join(r.choice("ABCDEFGH234567") for _ in range(16)), lambda: f"api_key: {hexes(32)}"],
        "phone": [lambda: f"call ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"my phone is {digits(3)}-{digits(3)}-{digits(4)}"],
        "email": [lambda: f"mail joe{digits(2)} [at] mail{digits(1)} [dot] com"],
    }
    decoys = [lambda: f"commit {hexes(8)}", lambda: f"version {digits(1)}.{digits(1)}.{digits(1)}", lambda: "Licensed under CC BY-NC 4.0.", lambda: f"order {digits(12)}", lambda: f"part {digits(3)}/{digits(4)}", lambda: f"src={say(1)}", lambda: f"ISBN {digits(13)}"]
    rows, planted = [], {}
    for k in range(240):
        kind = list(true)[k % 3] if k % 2 else None
        bit = r.choice(true[kind])() if kind else r.choice(decoys)()
        rows.append((k, f"{say(9)} {bit} {say(7)}", None, None))
        planted[k] = (kind, re.split(r"[\"= ]+", bit.strip('"'))[-1] if kind == "secret" else None)
    got = {g.doc_id: [(pii.KINDS[s.kind], s.start, s.end, s.base) for s in g.spans] for g in pii.find_pii(docs(spark, rows)).collect()}
    texts = {i: t for i, t, *_ in rows}
    hit = {kind: [any(s[0] == kind and not s[3] for s in got[k]) for k, (x, _) in planted.items() if x == kind] for kind in true}
    assert all(sum(h) >= 0.9 * len(h) for h in hit.values()), {k: sum(h) / len(h) for k, h in hit.items()}
    assert all((texts[k][s[1] : s[2]] == value) for k, (kind, value) in planted.items() if kind == "secret" for s in got[k] if s[0] == "secret")
    wrong = [k for k, (kind, _) in planted.items() if kind is None and got[k]]
    assert len(wrong) <= 0.1 * sum(kind is None for kind, _ in planted.values()), [texts[k] for k in wrong]


def test_pii_of_four_languages(spark):
    """Personal data of each kind beyond the base patterns, with contexts of four languages, in texts cut from documents; and decoys."""
    r = random.Random(17)
    digits = lambda n, of="23456789": "".join(r.choice(of) for _ in range(n))
    mixed = lambda n: "".join(r.choice("abcdefghjkmnpqrstuvwxyz23456789") for _ in range(n - 1)) + "7"
    area = lambda: f"0{digits(3)} {digits(7)}"
    triple = lambda: f"6{digits(2)} {digits(3)} {digits(3)}"
    pairs = lambda: "06 " + " ".join(digits(2) for _ in range(4))
    spelt = lambda: f"{mixed(6)} [at] post{digits(1)} [dot] {r.choice(('de', 'fr', 'es', 'com', 'org', 'ch'))}"
    true = {
        ("de", "phone"): lambda: (r.choice(("Telefon ", "Ruf ", "Handy: ")), area()), ("fr", "phone"): lambda: (r.choice(("téléphone ", "appelez le ")), pairs()),
        ("es", "phone"): lambda: (r.choice(("teléfono ", "móvil: ", "llame al ")), triple()), ("en", "phone"): lambda: (r.choice(("phone ", "call ")), f"{digits(3)}-{digits(3)}-{digits(4)}"),
        ("de", "secret"): lambda: ("Passwort: ", mixed(14)), ("fr", "secret"): lambda: ("mot de passe: ", mixed(14)), ("es", "secret"): lambda: (r.choice(("contraseña: ", "clave=")), mixed(14)),
        ("en", "secret"): lambda: ("password: ", mixed(14)), ("de", "email"): lambda: ("Kontakt ", spelt()), ("fr", "email"): lambda: ("courriel ", spelt()),
        ("es", "email"): lambda: ("correo ", spelt()), ("en", "email"): lambda: ("contact ", spelt()),
    }
    decoys = {
        "de": lambda: r.choice((f"Rechnung {area()}", f"die Summe {triple()}", f"Version {digits(1)}.{digits(1)}.{digits(1)}")), "fr": lambda: r.choice((f"{triple()} habitants", f"commande {digits(12)}", f"facture {area()}")),
        "es": lambda: r.choice((f"{triple()} habitantes", f"factura {area()}", f"pedido {digits(12)}")), "en": lambda: r.choice((f"a total of {triple()} units", f"order {digits(12)}", f"invoice {area()}")),
    }
    cut = {}
    for lang, text in spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and text is not null and not text rlike '[0-9@]'").select("lang", "text").collect():
        cut.setdefault(lang, []).extend(w for w in (SPLIT.findall(text)[k : k + 8] for k in range(0, 400, 8)) if len(w) == 8)
    rows, want = [], {}
    for (lang, kind), make in true.items():
        for _ in range(25):
            lead, value = make()
            head, tail = " ".join(r.choice(cut[lang])), " ".join(r.choice(cut[lang]))
            want[len(rows)] = (lang, kind, len(head) + 1 + len(lead), len(head) + 1 + len(lead) + len(value))
            rows.append((len(rows), f"{head} {lead}{value} {tail}", lang, None))
    for lang, make in decoys.items():
        for _ in range(50):
            want[len(rows)] = (lang, None)
            rows.append((len(rows), f"{' '.join(r.choice(cut[lang]))} {make()} {' '.join(r.choice(cut[lang]))}", lang, None))
    got = {g.doc_id: [(pii.KINDS[s.kind], s.start, s.end) for s in g.spans] for g in pii.find_pii(docs(spark, rows)).collect()}
    caught = {}
    for k, w in want.items():
        caught.setdefault(w[:2], []).append(w[1:] in got[k] if w[1] else bool(got[k]))
    share = {k: sum(v) / len(v) for k, v in caught.items()}
    print(share)
    assert all(v >= 0.9 for (_, kind), v in share.items() if kind) and all(v <= 0.1 for (_, kind), v in share.items() if not kind), share


def test_pii_learns_context_words(spark):
    """Words that announce a kind are learned from base spans, whatever the language, and serve candidates that have no base pattern."""
    r = random.Random(5)
    digits = lambda n: "".join(r.choice("23456789") for _ in range(n))
    say = lambda: " ".join(r.choice(["vorto", "frazo", "teksto", "linio", "domo", "arbo"]) for _ in range(6))
    rows = [(k, f"{say()} sonu numeron +1 659 {digits(3)} {digits(4)} {say()}", None, None) for k in range(60)]
    rows += [(100 + k, f"{say()} fakturo {digits(15)}1 {say()}", None, None) for k in range(60)]
    rows += [(200 + k, f"{say()} numeron 6{digits(2)} {digits(3)} {digits(3)} {say()}", None, None) for k in range(20)] + [(300 + k, f"{say()} 6{digits(2)} {digits(3)} {digits(3)} {say()}", None, None) for k in range(20)]
    spans = docs(spark, rows).select(F.explode(pii._candidates(F.col("text"))).alias("x")).select("x.*")
    words = pii.context_words(spans)
    phone, card = pii.KINDS.index("phone"), pii.KINDS.index("card")
    assert words[phone, True] == ["numeron", "sonu"] and "fakturo" in words[card, False] and not set(words.get((card, True), ())) & {"fakturo"}
    assert pii.context_words(spans.where("false")) == {}
    got = {g.doc_id: [s for s in g.spans if s.kind == phone] for g in pii.find_pii(docs(spark, rows)).collect()}
    assert sum(bool(got[k]) for k in range(200, 220)) >= 18 and sum(bool(got[k]) for k in range(300, 320)) <= 2


def test_pii_of_many_matches(spark):
    mail = "a@b.co 10.0.0.1 password=abcdef123456 "
    (g,) = pii.find_pii(docs(spark, [(1, mail * 5000 + "y" * 70 + " [at] mail [dot] com", None, None)])).collect()
    base = [s for s in g.spans if s.base]
    assert len(base) == 10_000 and base[4999].start == 4999 * len(mail) and base[-1].end == 4999 * len(mail) + 15
    assert sum(s.kind == 4 for s in g.spans) in (0, 5000)


def test_reliabilities():
    patterns = [((1, 1, 0), 90), ((1, -1, 0), 10), ((-1, -1, 0), 80), ((-1, 1, 0), 20)]
    share, tables, chance = pii.reliabilities(patterns)
    assert chance[1, 1, 0] > 0.9 > 0.1 > chance[-1, -1, 0] and 0.3 < share < 0.7
    assert tables[0][1][0] > tables[0][1][1]
    model = pii.SpanClassifier.train([(0, 0, 1, 90.0, 5.0), (0, 0, 2, 5.0, 80.0), (0, 1, 1, 95.0, 85.0)])
    assert model.weights[0][0][1] > 2 and model.weights[0][0][2] < -2 and abs(model.weights[0][1][1]) < 0.2 and model.prior[1] == 0


# 6
def brute_components(rows, n=4):
    sets = []
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in SPLIT.findall(t or "")]
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old = group[a]
                group = [group[b] if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(((i, len(s), least.get(g)) for g, (i, _), s in zip(group, rows, sets, strict=True)), key=str)


@pytest.mark.parametrize(("limit", "block"), [(64, 128), (2, 3), (3, 7), (64, 4)])
def test_ngram_join(spark, limit, block):
    r = random.Random(11)
    base = [f"b{k}" for k in range(60)]
    rows = [(i, t) for i, t, *_ in rows_of(4, 50)]
    for k in range(60):  # near copies of each other, in long lists
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(60)] = f"e{r.randrange(9)}"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000, " ".join(base).upper())]
    long = [f"l{k}" for k in range(300)]
    for k in range(40):  # around the limit, in sets that must meet more than once
        w = list(long)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(300)] = f"x{r.randrange(999)}"
        rows.append((3000 + k, " ".join(w)))
    r.shuffle(rows)
    d = docs(spark, [(i, t, "en", "s") for i, t in rows])
    got = ngram_join.ngram_components(d, list_pairs=limit, block=block)
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == brute_components(rows)
    groups = ngram_join.ngram_groups(d, list_pairs=limit, block=block)
    kept = ngram_join.keep_one_each(d, groups)
    assert kept.columns == d.columns
    words = [(i, t) for i, t in rows if SPLIT.search(t or "")]
    with_id = {c for i, _, c in brute_components(words) if i is not None}
    left = sorted(((x.doc_id, x.text) for x in kept.collect()), key=str)
    assert sorted(i for i, t in left if SPLIT.search(t or "") and i is not None) == sorted(with_id)  # one row each
    assert [x for x in left if not SPLIT.search(x[1] or "")] == sorted(((i, t) for i, t in rows if not SPLIT.search(t or "")), key=str)


def test_ngram_join_empty(spark):
    assert ngram_join.ngram_components(docs(spark, [])).count() == 0
    assert [tuple(x) for x in ngram_join.ngram_components(docs(spark, [(1, None, "en", "s")])).collect()] == [(1, 0, 1)]


def test_near_duplicates_of_the_pipeline(spark):
    import corpus_pipeline

    base = lambda k: [f"b{k}x{j}" for j in range(470)]
    edited = lambda k, step: " ".join(f"e{j}" if j % step == step // 2 else x for j, x in enumerate(base(k)))
    added = lambda k, n: " ".join([*base(k)[:100], *(f"new{j}" for j in range(n))])
    rows = [(1, " ".join(base(1))), (2, edited(1, 47)), (3, " ".join(base(2)[:100])), (4, added(2, 20)), (5, added(2, 60)), (6, " ".join(base(3))), (7, edited(3, 30))]
    kept = corpus_pipeline.near_duplicates(spark, docs(spark, [(i, t, "en", "s") for i, t in rows]), "")
    assert {r.doc_id for r in kept.collect()} == {1, 3, 5, 6, 7}


def test_one_row_of_each_group_stays(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text), (1, text), (2, text.upper()), (3, "quite another text of some eight words here"), (3, "and the same id has this other one too"), (None, text), (None, "no id has this text of nine words or more"), (None, "no id has this text of nine words or more"), (4, None), (4, None)]
    d = spark.createDataFrame([(i, t, 7, 8, {"k": 1}) for i, t in rows], "doc_id long, text string, keep_th int, KEEP_nth int, m map<string,int>")
    out = ngram_join.keep_one_each(d, ngram_join.ngram_groups(d))
    assert out.columns == d.columns
    left = sorted(((x.doc_id, x.text, x.keep_th, x.KEEP_nth) for x in out.collect()), key=str)
    assert left == sorted(((i, t, 7, 8) for i, t in [rows[0], rows[3], rows[4], rows[6], (4, None), (4, None)]), key=str)


def test_components(spark):
    r = random.Random(1)
    edges = [(k * 977, (k + 1) * 977) for k in range(300)] + [(10**9 + r.randrange(80), 10**9 + r.randrange(80)) for _ in range(60)] + [(5, 5)]
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    nodes = [x for x in parent if x != 5]
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert all((got[x] == got[y]) == (find(x) == find(y)) for x in nodes[::7] for y in nodes[::5] if x in got and y in got)


@pytest.mark.parametrize("held", [40, 1 << 18])
def test_components_merge_with_new_links(spark, monkeypatch, held):
    monkeypatch.setattr(components, "_HELD", held)
    r = random.Random(2)
    ids = [r.getrandbits(64) - 2**63 for _ in range(500)] + [-(2**63), 2**63 - 1, 0]
    path, star = list(zip(ids[:200], ids[1:201], strict=True)), [(ids[5], x) for x in ids[250:330]]
    mixed = [(r.choice(ids), r.choice(ids)) for _ in range(150)]

    def table(edges):
        return spark.createDataFrame(edges, "a long, b long").repartition(3)

    def groups(pairs):
        named = {}
        for node, root in pairs:
            named.setdefault(root, set()).add(node)
        assert all(root in nodes for root, nodes in named.items())
        return sorted(map(sorted, named.values()))

    def brute(edges):
        of = {x: {x} for e in edges if e[0] != e[1] for x in e}
        for a, b in edges:
            if a != b and of[a] is not of[b]:
                of[a] |= of[b]
                for x in of[b]:
                    of[x] = of[a]
        return sorted({tuple(sorted(g)) for g in of.values()})

    for edges, more in ((path, mixed), (star, path), ([(7, 7)], []), ([], [(1, 2), (3, 3)])):
        labels = components.connected_components(table(edges))
        assert list(map(tuple, groups((x.node, x.root) for x in labels.collect()))) == brute(edges)
        merged = components.merge_components(labels, table(more))
        assert list(map(tuple, groups((x.node, x.root) for x in merged.collect()))) == brute(edges + more)


# 7
def test_leaks(spark):
    r = random.Random(9)
    vocab = [f"v{k}" for k in range(300)] + ["the", "of", "and"] * 40
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(say(40))) for k in range(20)] + [(90, None), (91, "two words"), (92, "")]
    rows, want = [], set()
    for k in range(150):
        w = say(r.randint(0, 200))
        if k % 5 == 0:
            item = items[r.randrange(20)]
            copy = item[1].split()
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = "changed"
            del copy[5:6]
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() + "," for x in copy]
            want.add((k, item[0]))
        rows.append((k, " ".join(w)))
    rows += HARD
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    d = docs(spark, [(i, t, "en", "s") for i, t in rows])
    got = decontaminate.find_leaks(d, bench).collect()
    texts, item_words = dict(rows), {i: decontaminate.words_of(t) for i, t in items}

    def score(a, b):
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(0, row[j] + (1 if x == y else -1), row[j + 1] - 1, new[j] - 1))
            best, row = max(best, *new), new
        return best / len(a)

    brute = {(i, k) for i, t in rows for k, w in item_words.items() if len(w) >= 3 and score(w, decontaminate.words_of(t)) >= 0.5}
    assert {(g.doc_id, g.item_id) for g in got} == brute and want <= brute
    for g in got:
        assert g.score == pytest.approx(score(item_words[g.item_id], decontaminate.words_of(texts[g.doc_id])[g.start : g.end]))
    sliced = decontaminate.find_leaks(d, bench, slice_chars=1500).collect()
    assert {(g.doc_id, g.item_id) for g in sliced} == brute
    kept = decontaminate.drop_leaks(d, bench)
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} == {i for i, _ in rows} - {i for i, _ in brute}
    assert decontaminate.find_leaks(docs(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(d, bench.limit(0)).count() == 0


def test_leaks_of_one_or_two_words(spark):
    items = [(1, "Forty-two"), (2, "yes"), (3, "!?"), (4, "the quick brown fox jumps")]
    rows = [(1, "forty two."), (2, "YES"), (3, "yes indeed it is forty two yes"), (4, ""), (5, "!?"), (6, None), (7, "The quick brown fox jumps. yes")]
    d, bench = docs(spark, [(i, t, "en", "s") for i, t in rows]), spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id, x.score, x.start, x.end) for x in decontaminate.find_leaks(d, bench).collect()} == {(1, 1, 1.0, 0, 2), (2, 2, 1.0, 0, 1), (7, 4, 1.0, 0, 5)}
    assert {x.doc_id for x in decontaminate.drop_leaks(d, bench).collect()} == {3, 4, 5, 6}


def test_leaks_with_a_pair_that_every_item_holds(spark):
    r = random.Random(8)
    items = [(k, "of the " + " ".join(f"x{r.randrange(400)}" for _ in range(10))) for k in range(300)]
    rows = [(k, " ".join([f"y{k}", items[k][1].replace("of the", "in a"), "of the", "end"])) for k in range(0, 300, 7)] + [(1000, "of the " * 200)]
    d, bench = docs(spark, [(i, t, "en", "s") for i, t in rows]), spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(d, bench).collect()} == brute_leaks(rows, items)


def brute_leaks(rows, items):
    """Ids of documents and items whose best local alignment scores half the item's words."""
    found = set()
    for i, t in rows:
        for k, u in items:
            a, b = u.split(), t.split()
            best, row = 0, [0] * (len(b) + 1)
            for x in a:
                new = [0]
                for j, y in enumerate(b):
                    new.append(max(0, row[j] + (1 if x == y else -1), row[j + 1] - 1, new[j] - 1))
                best, row = max(best, *new), new
            if 2 * best >= len(a):
                found.add((i, k))
    return found


def test_leaks_of_edited_short_items(spark):
    r = random.Random(12)
    items = [(m, " ".join(f"i{m}x{k}" for k in range(m))) for m in range(4, 21)]
    cut = lambda m, at, new=True: " ".join((f"e{k}" if k in at else f"i{m}x{k}") for k in range(m) if new or k not in at)
    apart = lambda m, n: " ".join(f"i{m}x{k}" + (f" e{k}" if k % n == n - 1 else "") for k in range(m))
    texts = [cut(7, {3}), cut(4, {3}), cut(18, {3, 7, 11, 15}), apart(18, 3), apart(18, 2), apart(20, 2), "i4x0 i4x1", cut(4, {2}, False)]
    for m in range(4, 21):
        for _ in range(12):
            w = [f"i{m}x{k}" for k in range(m)]
            for _ in range(r.randint(1, m // 2 + 1)):
                at = r.randrange(len(w))
                w[at : at + r.randint(0, 1)] = ["new"] * r.randint(0, 1)
            texts.append(" ".join(w))
    rows = [(i, f"before it {t} after it") for i, t in enumerate(texts)]
    want = brute_leaks(rows, items)
    assert {(i, m) for i, m in enumerate((7, 4, 18, 18, 18, 20, 4, 4))} <= want and len({i for i, _ in want}) < len(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {(g.doc_id, g.item_id) for g in got.collect()} == want


def test_leaks_of_long_items_with_long_insertions(spark):
    item = [f"i{k}" for k in range(150)]
    new = lambda n, at: [f"n{at}x{k}" for k in range(n)]
    put = lambda n, *at: " ".join(w for k, x in enumerate(item) for w in [*(new(n, k) if k in at else []), x])
    texts = [put(30, 50, 100), put(60, 75), put(18, 30, 60, 90, 120), put(37, 50, 100), put(38, 50, 100), " ".join(item[:50] + item[70:]), " ".join(item[:40] + new(25, 0) + item[60:])]
    rows = list(enumerate(texts))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    d = spark.createDataFrame([(i, f"before it {t} after it") for i, t in rows], "doc_id long, text string")
    want = brute_leaks(rows, [(1, " ".join(item))])
    assert {(0, 1), (1, 1), (2, 1), (3, 1)} <= want
    got = decontaminate.find_leaks(d, bench).collect()
    assert {(g.doc_id, g.item_id) for g in got} == want and {g.score for g in got if g.doc_id == 0} == {0.6}
    assert {r.doc_id for r in decontaminate.drop_leaks(d, bench).collect()} == {i for i, _ in rows} - {i for i, _ in want}


# 8
def test_warc(spark):
    same, tricky = "x" * 150, "a\r\n\r\nWARC/1.1\r\nb\r\n\r\n" * 9
    rows = [(5, "http://A.b.Example.com:80/p?q#f", same), (3, "http://z.example.com", same), (9, None, same), (1, "no url", "short"), (2, "https://u@k.org/é\r\nX: y", "short"), (4, "http://a/", None), (6, "http://a/", ""), (7, "http://a/", tricky), (8, "http://a/b", "é" * 100), (None, "http://q/", same), (5, "http://A.b.Example.com:80/p?q#f", same), (10, "http://big/", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, n int")
    index = warc.archive_and_index(pages, archive_bytes=2000)
    from pyspark.sql import functions as F

    keys = pages.select(warc.url_key(F.col("url")).alias("key"))
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(h) if len(b) >= 100 else None
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if f is not None and f != i else "response", f if f != i else None))
    found = index.lookup(keys)
    got = warc.read_records(found)
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == sorted(want, key=str)
    one = index.lookup(keys.where("key like 'com,example,b,a%'"))
    assert {r.page_id for r in one.collect()} == {5} and one.count() == 2
    assert [r[0] for r in keys.where("key like 'com%'").distinct().sort("key").collect()] == ["com,example,b,a)/p?q", "com,example,z)/"]
    got = warc.read_records(found.where("page_id in (7, 8)"), payload=True)
    assert {bytes(r.payload).decode() for r in got.collect()} == {tricky, "é" * 100}
    assert warc.read_records(warc.archive_and_index(pages.limit(0)).lookup(keys)).count() == 0


def test_archives_roll_by_bytes(spark):
    import os

    from tessera.llm._common import table_path

    rows = [(k, f"http://h/{k}", chr(97 + k % 26) * (20_000 if k < 40 else 10)) for k in range(400)]
    at = table_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), at, archive_bytes=65_000)
    sizes = [os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(at.removeprefix("file://")) for f in names if f.startswith("part-")]
    assert len(sizes) > 8 and max(sizes) <= 65_004 and sorted(r.page_id for r in warc.read_pointers(spark, at).collect()) == list(range(400))


def test_index_blocks(spark):
    rows = [(k, f"http://h{k % 50}.org/{k % 7}", f"p{k}" * 40) for k in range(500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    captures = warc.archive_and_index(pages).blocks
    assert captures.count() >= 1
    from tessera.llm._common import table_path

    at = table_path(spark, "warc")
    warc.write_warc(pages, at)
    index = warc.build_index(warc.read_pointers(spark, at), block_lines=13, most_segments=5)
    assert 1 < len(index.top[0]) < index.blocks.count()
    from pyspark.sql import functions as F

    got = index.lookup(pages.where("page_id % 50 = 0").select(warc.url_key(F.col("url")).alias("key")))
    assert sorted(r.page_id for r in got.collect()) == [k for k in range(500) if k % 50 == 0]
    every = index.lookup(pages.select(warc.url_key(F.col("url")).alias("key")))
    assert sorted(r.page_id for r in warc.read_records(every).collect()) == list(range(500))
    assert index.lookup(spark.createDataFrame([("zzz",), (None,), ("",)], "key string")).count() == 0


# 9 and 10
def brute_stats(t):
    words, lines = SPLIT.findall(t or ""), [x for x in (t or "").split("\n") if SPLIT.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    many = {w for w in windows if windows.count(w) > 1}
    cover = {k + j for k, w in enumerate(windows) if w in many for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover)


def test_stats(spark):
    rows = rows_of(6, 40) + [(800 + k, t, None, None) for k, t in enumerate(["a b c d e f a b c d e", "#a $b\n#a $b\n\n#a $b", "é|<>& " * 3])]
    rows = [r for r in rows if r[0] != 905]
    got = stats.document_stats(docs(spark, rows)).collect()
    want = sorted([(i, *brute_stats(t)) for i, t, *_ in rows], key=str)
    assert sorted([(g.doc_id, *(g[c] for c in stats.COUNTS)) for g in got], key=str) == want


def labelled(spark, n=300):
    r = random.Random(8)
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        w = [r.choice(["some", "words", "are", "here", "now"]) + str(r.randrange(500)) for _ in range(r.randint(12, 60))]
        rows.append((k, " ".join(x + ("###" if bad else "") for x in w), "en", "s"))
        if k % 3:
            labels.append((k, 0 if bad else 1))
    rows += [(i, t, None, None) for i, t in HARD]
    return docs(spark, rows), spark.createDataFrame([*labels, (None, 1), (5000, 1), (7, None)], "doc_id long, quality int"), rows


def test_quality_rules(spark):
    d, labels, rows = labelled(spark)
    rules = quality_rules.learn_rules(d, labels)
    assert rules.rules
    kept = {g.doc_id: g.kept for g in quality_rules.judged(stats.document_stats(d), rules).collect()}
    assert all(kept[k] == (k % 4 != 0) for k in range(300))
    out = quality_rules.keep_good(d, rules)
    assert out.columns == d.columns
    assert {r.doc_id for r in out.collect()} == {k for k, v in kept.items() if v}
    clash = d.selectExpr("*", "1 as stats_n_words", "2 as _STATS_x", "3 as `a.b`")
    assert quality_rules.keep_good(clash, rules).columns == clash.columns and quality_rules.keep_good(clash, rules).count() == out.count()
    none = quality_rules.learn_rules(d, labels.limit(0))
    assert none.rules == () and quality_rules.judged(stats.document_stats(d), none).where("kept").count() > 250
    assert quality_rules.keep_good(docs(spark, []), rules).count() == 0


def test_rules_cover_as_brute_force_does():
    import math

    import numpy as np

    r = random.Random(17)
    x = np.array([[r.randint(0, 6), r.randint(0, 6)] for _ in range(90)], float)
    bad = np.array([a > 4 and b > 2 or a < 1 for a, b in x])
    found = quality_rules.cover(x, bad, names=("a", "b"), least_covered=2)
    todo, rules = list(range(90)), []
    while any(bad[k] for k in todo):
        on, rule = [k for k in todo if k % 3 != 2], []
        while len(rule) < 3:
            p0, n0 = sum(bad[k] for k in on), sum(not bad[k] for k in on)
            if not p0 or not n0:
                break
            best, most = None, 1e-9
            for f in (0, 1):
                v = sorted(set(x[:, f]))
                for above in (False, True):
                    for t in [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)]:
                        inside = [k for k in on if (x[k, f] > t) == above]
                        p = sum(bad[k] for k in inside)
                        gain = p * (math.log2((p + 1e-12) / (len(inside) + 1e-12)) - math.log2(p0 / (p0 + n0)))
                        if gain > most + 1e-12:
                            best, most = ("ab"[f], above, t), gain
            if not best:
                break
            rule.append(best)
            on = [k for k in on if (x[k, "ab".index(best[0])] > best[2]) == best[1]]
        holds = lambda k, some: all((x[k, "ab".index(f)] > t) == above for f, above, t in some)

        def worth(some):
            inside = [k for k in todo if k % 3 == 2 and holds(k, some)]  # noqa: B023
            p = sum(bad[k] for k in inside)
            return (2 * p - len(inside)) / (len(inside) + 1)

        while len(rule) > 1 and worth(rule[:-1]) > worth(rule):
            rule.pop()
        inside = [k for k in todo if holds(k, rule)]
        if not rule or sum(bad[k] for k in inside) < max(2, 0.95 * len(inside)):
            break
        rules.append(rule)
        todo = [k for k in todo if k not in inside]
    assert rules and [[(c.feature, c.above, c.threshold) for c in rule] for rule in found.rules] == rules


def test_additive_model_as_brute_force():
    import math

    import numpy as np

    r = random.Random(23)
    x = np.array([[r.randint(0, 5), r.random()] for _ in range(80)], float)
    y = np.array([int(a > 2 or b > 0.9) for a, b in x])
    model = quality_gam.fit(x, y, bins=4, rounds=3, n_pairs=0, depth=1, rate=0.5)
    edges = [sorted(set(np.quantile(x[:, k], [0.25, 0.5, 0.75]))) for k in (0, 1)]
    cell = lambda v, k: sum(v > e for e in edges[k])
    z0 = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    z, tables = [z0] * 80, [[0.0] * (len(e) + 1) for e in edges]
    for _ in range(3):
        for k in (0, 1):
            q = [1 / (1 + math.exp(-v)) for v in z]
            sums = lambda inside: (sum(y[j] - q[j] for j in inside), sum(q[j] * (1 - q[j]) for j in inside))  # noqa: B023, E731
            best, most, everyone = None, sums(range(80))[0] ** 2 / (sums(range(80))[1] + 1) + 1e-9, range(80)
            for c in range(1, len(tables[k])):
                low, high = sums([j for j in everyone if cell(x[j, k], k) < c]), sums([j for j in everyone if cell(x[j, k], k) >= c])
                gain = low[0] ** 2 / (low[1] + 1) + high[0] ** 2 / (high[1] + 1)
                if gain > most:
                    best, most = (c, low[0] / (low[1] + 1), high[0] / (high[1] + 1)), gain
            g, h = sums(everyone)
            step = [0.5 * (g / (h + 1) if best is None else best[1] if c < best[0] else best[2]) for c in range(len(tables[k]))]
            tables[k] = [a + b for a, b in zip(tables[k], step, strict=True)]
            z = [v + step[cell(x[j, k], k)] for j, v in enumerate(z)]
    assert model.score(x) == pytest.approx([1 / (1 + math.exp(-v)) for v in z])
    assert all(a == pytest.approx(b) for a, b in zip(model.tables, tables, strict=True))
    pairs = quality_gam.fit(x, y, n_pairs=1, rounds=5, pair_rounds=5)
    score = lambda v: pairs.intercept + sum(t[int((v[k] > pairs.edges[k]).sum())] for k, t in enumerate(pairs.tables)) + sum(t[int((v[a] > pairs.coarse[a]).sum()), int((v[b] > pairs.coarse[b]).sum())] for a, b, t in pairs.pairs)
    assert pairs.score(x) == pytest.approx([1 / (1 + math.exp(-score(v))) for v in x])


def test_sample_holds_whole_documents(spark):
    rows = [(1, "a b c d"), (1, "zz"), (2, "q"), (3, None)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (9, 1)], "doc_id long, quality int")
    counts, features, y = stats.labelled_features(spark.createDataFrame(rows, "doc_id long, text string"), labels, 10)
    assert [tuple(map(int, c)) for c in counts] == [brute_stats("a b c d"), brute_stats("q"), brute_stats(None)] and list(y) == [1, 0, 0]
    assert [tuple(f) for f in features] == [stats.text_stats(t)[1] for t in (b"a b c d", b"q", b"")]


def test_quality_classifier(spark):
    d, labels, rows = labelled(spark)
    got = quality_gam.score_quality(d, quality_gam.fit_quality(d, labels)).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for g in got)
    held = [g for g in got if g.held_out and g.doc_id is not None and g.doc_id < 300]
    assert held and all((g.score > 0.5) == (g.doc_id % 4 != 0) for g in held)
    same = quality_gam.score_quality(d, quality_gam.fit_quality(d, labels.limit(0))).select("score").distinct().collect()
    assert len(same) == 1


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken", "places"]
    rows = out.collect()
    assert 100 < len(rows) <= 200 and all(r.taken <= 2 * r.size and r.taken == sum(p.words for p in r.places) for r in rows)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, d, "/root/testdata/sf0.001")
        assert after.columns == d.columns and after.count() <= d.count()
        d = after


def test_pipeline_on_hard_rows(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(41)
    say = lambda n: " ".join(r.choice("abcdefghij") + str(r.randrange(999)) for _ in range(n))
    passage = "\n".join(say(9) for _ in range(4))
    clean = [(k, "\n".join(say(12) for _ in range(5))) for k in range(40)]
    item = say(30)
    rows = clean + [(900, None), (901, ""), (902, " \n "), (903, "one"), (905, "x " * 3000), (906, "longword" * 3000), (None, "\n".join(say(12) for _ in range(5))), (907, say(30_000))]
    rows += [clean[3], clean[3], (50, clean[4][1]), (51, clean[5][1].replace(" ", "  ")), (60, f"{passage}\n{say(30)}"), (61, f"{passage}\n{say(30)}"), (62, f"{say(20)} {item} {say(20)}"), (63, f"{passage}\n{say(3)}")]
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["_id", "_th", "_lines", "_kept", "_n", "_stats_n_words", "stats_n_words", "keep_nth", "n_lines2", "row", "sig", "taken", "size", "words", "block"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in names)
    make = lambda some: spark.createDataFrame([(i, t, None, ("s", None, "Ä")[k % 3], len(t or ""), *range(len(names))) for k, (i, t) in enumerate(some)], schema)
    d = make(rows)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        d = spark.createDataFrame(stage(spark, d, str(tmp_path)).collect(), schema)
        got = d.collect()
        assert all(x["_id"] == 0 and x["block"] == 14 and x.n_chars == len(x.text) for x in got)
        kept[name] = sorted((x.doc_id for x in got), key=str)
    assert not {900, 901, 902, 903, 905, 906} & set(kept["quality_rules"]) and {*range(40), 50, 51, 60, 61, 62, 63, 907, None} <= set(kept["quality_rules"])
    assert not {50, 63} & set(kept["line_dedup"]) and kept["line_dedup"].count(3) == 3
    assert kept["ngram_jaccard_join"].count(3) == 1 and 51 not in kept["ngram_jaccard_join"] and {60, 61, None} <= set(kept["ngram_jaccard_join"])
    assert 62 not in kept["benchmark_decontamination"] and set(range(40)) <= set(kept["benchmark_decontamination"])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id for x in out), key=str) == kept["benchmark_decontamination"]
    empty = make([(1, "x")]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
