"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, langid, line_dedup, mixing, ngram_join, periodic_runs, pii, quality_gam, quality_rules, simhash, stats, warc
from ._common import WORD


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Two rows made to be hard: control strings of the template as texts.
_HARD = "select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with control strings, formatted and read back; a null text or role is empty, repeated rows are turns."""
    rows = _read(spark, sf_dir, "conversations").select(*(F.col(c).cast(t) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    out = chat.format_chats(rows.unionByName(spark.sql(_HARD))).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("lost", chat.masked_text(F.col("segments")))
    digest = F.sha2(F.encode(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), "UTF-8"), 256)
    return out.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.encode("lost", "UTF-8"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that the mix takes; a null or empty text has none, repeated rows are documents of their own."""
    return mixing.mix_sources(_read(spark, sf_dir, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the later occurrences of repeated passages; a null text stays null, repeated rows lose the same lines."""
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those not held out; `und` for a null text or one without a letter."""
    docs = _read(spark, sf_dir, "documents")
    return langid.predict_languages(docs, langid.fit_languages(docs)).select("doc_id", "held_out", "lang_pred", "score", F.map_keys("languages").alias("languages"))


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data: counts and digest of those of the base patterns, all spans, and how many the method found in all and
    added as secrets; a null text has none, repeated rows are searched each."""
    found = pii.find_pii(_read(spark, sf_dir, "documents"))
    base = found.withColumn("base", F.filter("spans", lambda x: x["base"]))
    names = F.array(*map(F.lit, pii.KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k, c: F.size(F.filter(c, lambda x: x["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    return base.select(
        "doc_id", *(count(k, "base") for k in range(4)), F.sha2(F.encode(joined("base"), "UTF-8"), 256).alias("base_sha256"), joined("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), count(4, "spans"),
    )


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by 0.85 of their four-word shingles; texts without words are components of their own."""
    return ngram_join.ngram_components(_read(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items that align; null texts match nothing, repeated rows are searched each."""
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the records say that the index finds for its url, read as ranges of the archives; a null page is an empty payload."""
    pages = _read(spark, sf_dir, "pages")
    index = warc.archive_and_index(pages)
    found = index.lookup(pages.select(warc.url_key(F.col("url")).alias("key")))
    return warc.read_records(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether base rules and learned rules keep it; a null or empty text has zeros and fails."""
    docs = _read(spark, sf_dir, "documents")
    rules = quality_rules.learn_rules(docs, _read(spark, sf_dir, "labels"))
    return quality_rules.judged(stats.document_stats(docs), rules).select("doc_id", *stats.COUNTS, "base_failed", "kept")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labelled ones not held out; a null text is scored as empty."""
    docs = _read(spark, sf_dir, "documents")
    return quality_gam.score_quality(docs, quality_gam.fit_quality(docs, _read(spark, sf_dir, "labels")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources of each language by how far their terms' shares differ, and the terms that each source uses more than its language;
    nulls are read as empty."""
    return divergence.audit_sources(_read(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of documents whose fingerprints differ in two bits or less; a null text has fingerprint zero."""
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The words of every tenth document, by crc32 of its id, are made periodic from one of them on.
_PLANTED = f"""
with w as (select doc_id, text, regexp_extract_all(text, '({WORD})') as words, crc32(cast(doc_id as string)) as h from {{docs}}),
a as (select *, size(words) as n, h div 10 as g from w),
b as (select *, cast(g % nullif(n, 0) as int) as a, cast(1 + (n - g % nullif(n, 0)) div (3 + g % 8) as int) as p from a)
select doc_id, if(h % 10 = 0 and n > 0, array_join(transform(sequence(0, n - 1), i -> words[if(i < a, i, a + (i - a) % p)]), ' '), text) as text from b"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text, some of which are made periodic, and digests of the runs and of the text without their later periods; a null
    text has no words."""
    planted = spark.sql(_PLANTED.replace("\\", "\\\\"), docs=_read(spark, sf_dir, "documents"))
    found = periodic_runs.find_runs(planted)
    better = lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b)
    first = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    best = found.withColumn("best", first)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        digest(listed).alias("runs_sha256"), digest("collapsed").alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (
    op1_chat_formatting, op2_source_mixing, op3_line_dedup, op4_language_mixture, op5_pii_spans, op6_ngram_jaccard_join,
    op7_benchmark_decontamination, op8_warc_index, op9_quality_rules, op10_quality_classifier, op11_source_divergence, op12_simhash, op13_periodic_runs,
)}


def _escaped(c: str) -> str:
    out = f"replace({c}, '\\', '\\_')"
    for k, x in enumerate(chat.INSTRUCT.controls):
        out = f"replace({out}, '{x}', '\\{chr(97 + k)}')"
    return out


_UPPER = "".join(map(chr, range(65, 91)))
_OTHER = sum(map(len, chat.INSTRUCT.other))
_MARKS = " ".join(f"when '{r}' then {len(a) + len(b)}" for r, (a, b) in chat.INSTRUCT.turns.items())

ORACLES = {
    "op1_chat_formatting": f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
s as (select *, lag(role, 1, '') over (partition by conv_id order by turn nulls first, role, text) as before,
  lead(role) over (partition by conv_id order by turn nulls first, role, text) is null as at_end from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length({_escaped('text')}) + case role {_MARKS} else {_OTHER} + length({_escaped('role')}) end) as bigint) as formatted_chars,
  bool_and(case before when '' then role in ('system', 'user') when 'system' then role = 'user' when 'user' then role = 'assistant'
    when 'assistant' then role = 'user' else false end) and bool_and(not at_end or role in ('user', 'assistant')) as valid
from s group by conv_id""",
    "op3_line_dedup": f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
f as (select *, lead(s) over w as s2, lead(s, 2) over w as s3, lead(pos) over w as p2, lead(pos, 2) over w as p3, len(regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+')) as words
  from l where regexp_matches(s, '[^\\x20\\x09-\\x0D]') window w as (partition by doc_id order by pos)),
g as (select *, lead(words) over (partition by doc_id order by pos) as words2 from f),
v as (select doc_id, pos, p3 as last, [s, s2, s3] as k from g where p3 is not null
  union all select doc_id, pos, pos, [s] from g where words > {line_dedup.PASSAGE}
  union all select doc_id, pos, p2, [s, s2] from g where p2 is not null and words + words2 > {line_dedup.PASSAGE}),
r as (select doc_id, pos, last, row_number() over (partition by k order by doc_id, pos) as nth from v),
c as (select distinct doc_id, unnest(range(pos, last + 1)) as pos from r where nth > 1)
select d.doc_id, case when count(l.pos) filter (where c.pos is null) = 0 and d.text is not null then '' else string_agg(l.s, chr(10) order by l.pos) filter (where c.pos is null) end as text,
  count(l.pos) as n_lines, count(c.pos) as n_removed
from documents d left join l using (doc_id) left join c on c.doc_id = l.doc_id and c.pos = l.pos group by d.doc_id, d.text""",
    "op8_warc_index": """
with p as (select page_id, url, coalesce(html, '') as html from pages),
q as (select *, strlen(html) as n, sha256(html) as digest from p),
r as (select *, case when n >= 100 then min(page_id) over (partition by digest) end as first from q)
select page_id, n as payload_bytes, digest as payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type,
  case when first <> page_id then first end as refers_to, url from r""",
    "op11_source_divergence": rf"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (select rid, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*) as m from t group by all having count(distinct rid) >= {divergence.LEAST}),
v as (select lang, count(*) as v, sum(m)::bigint as total from k group by all),
c as (select lang, source, term, count(*) as n from t semi join k using (lang, term) group by all),
s as (select lang, source, sum(n)::bigint as total from c group by all),
g as (select distinct lang, source from d),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(s.total, 0) + v.v) as p, 1 + 1000000000 * (k.m + 1) // (v.total + v.v) as q
  from g join k using (lang) join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term left join s on s.lang = g.lang and s.source = g.source),
x as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (select g.lang, g.source, 'pair' as part, h.source as item, coalesce(x.value, 0) as value from g join g h on g.lang = h.lang and g.source <> h.source
    left join x on x.lang = g.lang and x.source = g.source and x.item = h.source
  union all select lang, source, 'term', term, (p - q) * (p - q) // q from p where n > 0 and p > q),
o as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from r)
select lang, source, part, item, value, cast(rank as integer) as rank from o where part = 'pair' or rank <= {divergence.RANKS}""",
    "op13_periodic_runs": rf"""
with tab as (select list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ord(x) as bigint))), lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295) as h
  from documents, tab),
e as (select *, len(words) as n, h // 10 as g, (h // 10) % len(words) as a from d),
f as (select *, 1 + (n - a) // (3 + g % 8) as p from e),
w as (select rid, n, unnest(range(n)) as pos, unnest(list_transform(range(n), lambda i: words[1 + case when h % 10 = 0 and i >= a then a + (i - a) % p else i end])) as word from f),
m as (select x.rid, x.pos, y.pos - x.pos as q from w x join w y on x.rid = y.rid and x.word = y.word and y.pos > x.pos where (y.pos - x.pos) * {periodic_runs.POWER} <= x.n),
i as (select *, pos - row_number() over (partition by rid, q order by pos) as island from m),
j as (select rid, q, min(pos) as start, count(*) + q as length from i group by rid, q, island having count(*) + q >= greatest({periodic_runs.LEAST}, {periodic_runs.POWER} * q)),
r as (select rid, start, length, min(q) as period from j group by all),
b as (select *, row_number() over (partition by rid order by length / period desc, start, period) as nth from r),
s as (select rid, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs from r group by rid),
x as (select distinct rid, unnest(range(start + period, start + length)) as pos from r),
y as (select rid, string_agg(word, ' ' order by pos) as kept from w anti join x using (rid, pos) group by rid)
select doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, length * 1000 // period as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from d left join s using (rid) left join y using (rid) left join b on b.rid = d.rid and nth = 1""",
}
