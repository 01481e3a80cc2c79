"""Source divergence, SimHash and periodic runs against brute force, with nulls, ties, repeated rows, long texts and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from tessera.llm import divergence, periodic_runs, queries, simhash

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n long, docs int, value string, gid int, fp int, runs string"
HARD = [(900, None), (901, ""), (902, " \t\n "), (903, "one"), (904, "a b"), (905, "x " * 3000), (906, "longword" * 20_000), (None, "some text of no id at all here"), (907, "é à ü\x85\xa0ß ı İ ́ A\x1cB")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, la, so, 1, 2, "v", 3, 4, "r") for i, t, la, so in rows], DOCS)


def rows_of(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["Alpha", "beta", "gamma", "é", "the", "of", "to"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    texts = []
    for k in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(0, 120))]
        if k % 4 == 0 and texts:
            w = SPLIT.findall(r.choice(texts))
            if w and k % 8 == 0:
                w[r.randrange(len(w))] = "edit"
        if k % 7 == 3:
            w[5:5] = [vocab[j % 5] for j in range(r.randint(20, 60))]
        texts.append(" ".join(w))
    rows = [(k, t) for k, t in enumerate(texts)] + HARD
    rows += [rows[3], rows[3]]
    return [(i, t, ("en", "de", None, "")[k % 4], ("s1", "s2", None, "S3", "é")[k % 5]) for k, (i, t) in enumerate(rows)]


def reach(ids, links):
    """The smallest id that links between places reach, nulls passed over."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(ids))]


# 11
def share(count, total):
    return 1 + 10**9 * count // total


def audit(rows, least, ranks):
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = []
    for (lang, source), mine in counts.items():
        kept = [t for t, c in held[lang].items() if c >= least]
        p = lambda c, kept=kept: {t: share(c[t] + 1, sum(c[x] for x in kept) + len(kept)) for t in kept}
        its, whole = p(mine), p(sum((c for (la, _), c in counts.items() if la == lang), Counter()))
        pairs = []
        for (la, other), theirs in counts.items():
            if la == lang and other != source:
                q = p(theirs)
                pairs.append((other, sum((its[t] - q[t]) ** 2 // q[t] for t in kept)))
        terms = [(t, (its[t] - whole[t]) ** 2 // whole[t]) for t in kept if mine[t] and its[t] > whole[t]]
        for part, found, most in (("pair", pairs, 10**9), ("term", terms, ranks)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize(("ranks", "room", "held"), [(200, 4096, 1 << 18), (3, 1, 20), (7, 0, 100)])
def test_divergence(spark, monkeypatch, ranks, room, held):
    monkeypatch.setattr(divergence, "_HELD", held)
    rows = rows_of()
    got = divergence.audit_sources(docs(spark, rows), ranks=ranks, room=room)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == audit(rows, 3, ranks)


def test_divergence_without_kept_terms(spark):
    rows = [(1, "a b", "en", "s"), (2, None, "en", "t"), (3, "c", None, None)]
    assert sorted(map(tuple, divergence.audit_sources(docs(spark, rows)).collect())) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    assert divergence.audit_sources(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("k", "room"), [(1, 0), (5, 2), (20, 0), (60, 7), (1000, 3)])
def test_radix_selection(spark, tmp_path, k, room):
    r = random.Random(k)
    rows = []
    for g in range(6):
        top = (3, 10, 70_000, 1 << 40, 1 << 62, 1)[g]
        stem = "é" * (g * 9)
        items = {stem + "".join(r.choice("abé\x01ÿ😀") for _ in range(r.randint(0, 5))) for _ in range(150)}
        rows += [(g, r.choice([0, top, top // 2, r.randint(0, top), r.randint(0, 3)]), t) for t in sorted(items)]
    rows += [(9, 5, "only")]
    spark.createDataFrame(rows, "gid long, value long, item string").write.parquet(str(tmp_path / "rows"))
    got = divergence.top_ranked(spark.read.parquet(str(tmp_path / "rows")), k, room=room).collect()
    want = []
    for g in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2].encode()))
        want += [(*x, j + 1) for j, x in enumerate(mine[:k])]
    assert sorted((x.gid, x.value, x.item, x["rank"]) for x in got) == sorted(want)


def test_shares_of_many_words(spark):
    counts = [(0, 1), (1, 1), (7, 9), (10**15 + 3, 8 * 10**15 + 1), (10**12, 10**12), (123456789012345, 9 * 10**15 - 1)]
    got = spark.createDataFrame(counts, "c long, t long").selectExpr(divergence._share("c", "t") + " as p", "c", "t").collect()
    assert all(x.p == share(x.c, x.t) for x in got) and len(got) == len(counts)


# 12
def print_of(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in SPLIT.findall(text or "")]
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize(("compared", "piece"), [(64, 1 << 22), (1, 50)])
def test_simhash_of_texts(spark, monkeypatch, compared, piece):
    monkeypatch.setattr(simhash, "_PIECE", piece)
    rows = rows_of()
    prints = [print_of(t) for _, t, _, _ in rows]
    assert [simhash.fingerprint((t or "").encode()) for _, t, _, _ in rows] == prints
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = sorted(zip([str(i) for i, *_ in rows], prints, map(str, reach([i for i, *_ in rows], links)), strict=True))
    got = simhash.near_duplicates(docs(spark, rows), compared=compared).collect()
    assert sorted((str(x.doc_id), x.fp % 2**64, str(x.component_id)) for x in got) == want
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def near_prints(seed, n):
    """Clusters about centres, with differences spread or within a segment, and links that only a walk makes."""
    r = random.Random(seed)
    out = {0, 1, 3, 7, 15, 2**64 - 1, 2**64 - 2, 1 << 63}
    for k in range(n):
        centre = r.getrandbits(64)
        for _ in range(12):
            bits = r.sample(range(64), r.randint(0, 3)) if k % 2 else r.sample(range(44, 64), r.randint(0, 3))
            out.add(centre ^ sum(1 << b for b in bits))
    return sorted(out)


@pytest.mark.parametrize("compared", [1, 3, 64])
def test_simhash_links(spark, compared):
    prints = near_prints(compared, 30)
    df = spark.createDataFrame([(p if p < 2**63 else p - 2**64,) for p in prints], "fp long")
    got = {(x.a % 2**64, x.b % 2**64) for x in simhash.fingerprint_links(df, compared=compared).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in got)
    at = {p: k for k, p in enumerate(prints)}
    ids = list(range(len(prints)))
    all_links = [(a, b) for a in ids for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert reach(ids, [(at[a], at[b]) for a, b in got]) == reach(ids, all_links) and all_links


def test_chains_meet_every_link():
    r = random.Random(4)
    masks = simhash.chains()
    for bits in [(), *((b,) for b in range(64)), *((a, b) for a in range(64) for b in range(a))]:
        x = r.getrandbits(64)
        y = x ^ sum(1 << b for b in bits)
        assert any(x & m == y & m and (free < 0 or (x ^ y) >> free & 1) for _, free, m in masks), bits


# 13
def runs(w, least=24, power=3):
    out = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, power * q):
                out.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((b, e - b, q) for (b, e), q in out.items())


def periodic_texts(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        size, letters = r.randint(0, 150), r.choice([1, 2, 2, 3, 5, 30])
        w = [b"w%d" % r.randrange(letters) for _ in range(size)]
        for _ in range(r.randint(0, 3) if w else 0):
            base = [b"w%d" % r.randrange(max(letters, 3)) for _ in range(r.randint(1, 12))]
            at = r.randrange(len(w))
            w[at:at] = [base[k % len(base)] for k in range(r.randint(10, 70))]
        out.append(w)
    return out


@pytest.mark.parametrize(("least", "power"), [(24, 3), (6, 2), (10, 4), (2, 2)])
def test_runs(least, power):
    texts = periodic_texts(least, 400)
    assert periodic_runs.text_runs(texts, least, power) == [runs(w, least, power) for w in texts]
    assert periodic_runs.text_runs([[b"a"] * 50_000], least, power) == [[(0, 50_000, 1)]]


@pytest.mark.parametrize("together", [1 << 18, 300])
def test_runs_of_documents(spark, monkeypatch, together):
    monkeypatch.setattr(periodic_runs, "_TOGETHER", together)
    rows = rows_of(2)
    got = periodic_runs.find_runs(docs(spark, rows)).collect()
    assert len(got) == len(rows)

    def of(i, text):
        w = SPLIT.findall(text or "")
        found = runs(w)
        gone = {k for b, n, q in found for k in range(b + q, b + n)}
        return str(i), len(w), sorted(found, key=lambda x: (x[0], x[2])), " ".join(x for k, x in enumerate(w) if k not in gone)

    want = sorted(of(i, t) for i, t, _, _ in rows)
    assert sorted((str(x.doc_id), x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in got) == want and any(x[2] for x in want)
    assert periodic_runs.find_runs(docs(spark, [])).count() == 0


def test_runs_of_planted_documents(spark, tmp_path):
    rows = rows_of(3, 200)
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, text, _, _ in rows:
        w = SPLIT.findall(text or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        found = sorted(runs(w), key=lambda x: (x[0], x[2]))
        gone = {k for b, n, q in found for k in range(b + q, b + n)}
        best = next((x for x in found if all(x[1] * y[2] >= y[1] * x[2] for y in found)), (None, None, None))
        listed = "".join(f"{b},{n},{q}\n" for b, n, q in found)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        hexed = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((str(i), len(found), *map(str, (*best, best[1] and 1000 * best[1] // best[2])), hexed(listed), hexed(kept)))
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((str(x[0]), x[1], *map(str, x[2:6]), x[6], x[7]) for x in got.collect()) == sorted(want)
