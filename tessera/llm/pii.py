"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs the labelers, and a span classifier trained on its
verdicts adds spans to those of the base patterns. Context words are learned from the neighbourhood of spans, beside fixed lists.

Texts are touched by DataFrame expressions only. The driver sees counts of vote patterns (kinds x 3 to the number of labelers at most),
sums per value of a span feature (kinds x features x 8 at most) and learned words (kinds x 2 x 64 at most), whatever the input.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

#: The first four have a base pattern; of the last all spans are added by the method.
KINDS = ("email", "ip", "card", "phone", "secret")
#: The base patterns, written so that a search takes time in proportion to the text: a match begins where a run of its characters
#: does, or where the match before it ended, and what can't be given back is possessive.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Wider patterns, which give candidates only: spelt addresses, numbers without a country code, values of keys and long mixed strings.
_AT, _DOT = r"\x20?[\[(]\x20?at\x20?[\])]\x20?", r"\x20?[\[(]\x20?dot\x20?[\])]\x20?"
SPELT_EMAIL = rf"(?i)(?:\G|(?<!{_LOCAL})){_LOCAL}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9A-Za-z+.-])(?<!\+[0-9]{1,3}[\x20-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
#: Numbers as they are written within a country: five pairs, three threes that begin with 6 to 9, an area code and one long group.
PAIRED_PHONE = r"(?<![0-9A-Za-z+.,/-])(?<![0-9]\x20)0[1-9](?:[\x20.-][0-9]{2}){4}(?![0-9A-Za-z]|[\x20.,/-][0-9])"
TRIPLE_PHONE = r"(?<![0-9A-Za-z+.,/-])(?<![0-9]\x20)[6-9][0-9]{2}[\x20.-][0-9]{3}[\x20.-][0-9]{3}(?![0-9A-Za-z]|[\x20.,/-][0-9])"
AREA_PHONE = r"(?<![0-9A-Za-z+.,/-])(?<![0-9]\x20)0[1-9][0-9]{1,4}[\x20/-][0-9]{5,8}(?![0-9A-Za-z]|[\x20.,/-][0-9])"
_KEY = r"(?iu:pass(?:word|wd|phrase|wort)|pwd|token|secret|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|kennwort|mot de passe|mdp|contraseña|contrasena|clave|jeton)"
_VALUE = r"[A-Za-z0-9](?:[._+/=-]*+[A-Za-z0-9])++"
SECRET = rf"(?<![A-Za-z0-9]){_KEY}\x20?[:=]\x20?[\"']?{_VALUE}|(?<![A-Za-z0-9._+/=@-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9](?:[_+/=-]*+[A-Za-z0-9]){{11,}}+(?!@)"

# Gazetteers and context words, of four languages. A top domain of two letters is a country's.
TOP_DOMAINS = r"^(?:[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|cloud|online|shop|site|store|tech|xyz)$"
CARD_LEADS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
RESERVED_NETWORKS = r"^(?:0\.|127\.|22[4-9]\.|2[3-5][0-9]\.)"
CALLING_CODES = r"^\+?(?:1|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
KEY_PREFIXES = r"^(?:AKIA|ASIA|AIza|gh[pousr]_|sk_live_|xox[abp]-|eyJ)"
CONTEXT = {
    "email": "e-?mail|contact|write to|reach|kontakt|schreib|courriel|écri|correo|escrib|contacte",
    "ip": r"\bip\b|host|server|address|client|login from|rechner|adresse|serveur|hôte|servidor|dirección|equipo",
    "card": "card|visa|mastercard|amex|payment|credit|paid|karte|zahlung|bezahl|carte|paiement|payé|tarjeta|pago|pagad",
    "phone": "phone|tel|call|mobile|fax|cell|dial|ring|telefon|anruf|ruf|handy|mobil|téléphone|appel|portable|teléfono|llam|móvil",
    "secret": "password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|credential|login|auth|passwort|kennwort|schlüssel|mot de passe|jeton|contraseña|clave",
}
AGAINST = {
    "email": r"example of|syntax|beispiel|exemple|ejemplo", "ip": r"version|release|section|\bv$|abschnitt|kapitel|chapitre|versión|sección",
    "card": r"isbn|serial|invoice|order|tracking|rechnung|bestell|sendung|facture|commande|colis|factura|pedido|envío",
    "phone": r"isbn|order|serial|invoice|part no|version|rechnung|bestell|teile|facture|commande|pièce|factura|pedido|pieza|total|summe|somme|suma|habitants|einwohner|habitantes",
    "secret": r"commit|checksum|sha-?[0-9]+|md5|digest|version|revision|doi|isbn|uuid|order|invoice|href|src|prüfsumme|bestell|rechnung|empreinte|commande|facture|huella|pedido|factura",
}
AFTER_AGAINST = r"^\x20?(?:%|px|kg|km|cm|mm|ms|mb|gb|kb|units|pieces|items|stück|euro|pièces|unités|piezas|unidades|habitants|einwohner|habitantes)(?![a-z])"

#: A labeler votes 1 for, -1 against, or 0 if it can't say.
LABELERS = ("pattern or checksum", "gazetteer", "words before", "words after", "boundaries")
#: How much a labeler's vote counts before anything is known of it.
TRUST = (3, 1, 1, 1, 1)
FEATURES = ("length", "digits", "capitals", "distinct characters", "before", "after", "separators", "context", "key")

#: bare: nothing in a span's form tells it from another number, so the words before it decide the pattern's vote. near and far: the
#: words before a span, and those after it, which show how common a word is anyway.
_SPAN = "struct<kind:int,start:int,end:int,base:boolean,votes:array<int>,feats:array<int>,bare:boolean,near:array<string>,far:array<string>>"
NEAR = 3
_CONTEXT_LABELER, _CONTEXT_FEATURE = LABELERS.index("words before"), FEATURES.index("context")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(rows: Column, zero: Column, out_type: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What step (from state and element to new state and output) gives for each element of an array from left to right. Arrays grow
    by chunks of about the square root of n, so that the copies made take n * sqrt(n) steps and not n * n."""

    def over(r: Column) -> Column:
        n = F.size(r)
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
        chunks = F.transform(F.sequence(F.lit(1), n, width), lambda i: F.slice(r, i, width))

        def element(a: Column, x: Column) -> Column:
            state, out = step(a["s"], x)
            return F.struct(state.alias("s"), F.concat(a["out"], F.array(out)).alias("out"))

        def chunk(a: Column, c: Column) -> Column:
            inner = F.aggregate(c, F.struct(a["s"].alias("s"), F.array().cast(f"array<{out_type}>").alias("out")), element)
            return _let(inner, lambda i: F.struct(i["s"].alias("s"), F.concat(a["out"], F.array(i["out"])).alias("out")))

        start = F.struct(zero.alias("s"), F.array().cast(f"array<array<{out_type}>>").alias("out"))
        return F.when(n > 0, F.flatten(F.aggregate(chunks, start, chunk)["out"])).otherwise(F.array().cast(f"array<{out_type}>"))

    return _let(rows, over)


@dataclass(frozen=True)
class _Match:
    """A match: its text, up to 40 characters before and 24 after it (not beyond the matches next to it), and its value, the part of
    the match that is the span: its last characters."""

    text: Column
    before: Column
    after: Column
    value: Column

    @property
    def left(self) -> Column:
        return F.substring(self.before, -1, 1)

    @property
    def right(self) -> Column:
        return F.substring(self.after, 1, 1)


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return (out if no is None else out.when(no, F.lit(-1))).otherwise(F.lit(0))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    twice = lambda c: F.when(c > 4, 2 * c - 9).otherwise(2 * c)
    each = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == 1, twice(F.try_to_number(c, F.lit("9")).cast("int"))).otherwise(F.try_to_number(c, F.lit("9")).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _features(kind: str, x: _Match) -> list[Column]:
    """Evidence of the span's own shape and surroundings, each a number from 0 to 7."""
    n = F.length(x.value)
    count = lambda pattern: n - F.length(F.regexp_replace(x.value, pattern, ""))
    share = lambda c: F.floor(F.lit(4) * c / n).cast("int")
    beside = lambda c: F.when(c == "", 0).when(c.rlike(r"[\x20\x09-\x0D]"), 1).when(c.rlike("[\"'`]"), 2).when(c.rlike("[=:]"), 3).when(c.rlike("[0-9A-Za-z_]"), 4).when(c.rlike(r"[(\[<{)\]>}]"), 5).otherwise(6)
    near, off = F.lower(x.before).rlike(CONTEXT[kind]), F.lower(x.before).rlike(AGAINST[kind])
    key = F.substring(x.text, F.lit(1), F.length(x.text) - n)
    return [
        F.least(F.lit(7), F.floor(F.log2(n.cast("double"))).cast("int")), share(count("[0-9]")), share(count("[A-Z]")),
        F.least(F.lit(7), F.floor(F.log2(F.size(F.array_distinct(F.split(x.value, ""))).cast("double"))).cast("int")), beside(x.left), beside(x.right),
        F.least(F.lit(3), count("[^0-9A-Za-z]")), near.cast("int") + 2 * off.cast("int"), F.when(key == "", 0).otherwise(1),
    ]


def _near(before: Column) -> Column:
    """The last NEAR words of what stands before a span; its first word, which may be cut, isn't one of them."""
    words = F.regexp_extract_all(F.lower(before), F.lit(r"\p{L}{2,}"), F.lit(0))
    cut = F.when(F.length(before) < 40, F.lit(1)).otherwise(F.lit(2))
    return F.array_distinct(F.slice(words, F.greatest(cut, F.size(words) - NEAR + 1), F.lit(NEAR)))


def _far(after: Column) -> Column:
    """The first NEAR words of what stands after a span; its last word, which may be cut, isn't one of them."""
    words = F.regexp_extract_all(F.lower(after), F.lit(r"\p{L}{2,}"), F.lit(0))
    whole = F.size(words) - F.when(F.length(after) < 24, F.lit(0)).otherwise(F.lit(1))
    return F.array_distinct(F.slice(words, F.lit(1), F.greatest(F.lit(0), F.least(F.lit(NEAR), whole))))


def _matched(text: Column, pattern: str, kind: str, judge: Callable[[_Match], tuple[Column, Column, Column, Column, Column]], value: str | None = None, bare: bool = False) -> Column:
    """Spans (_SPAN) of the matches that judge takes; it gives take, base and the votes of pattern, gazetteer and boundaries. value: a
    pattern whose group 1 is the part of a match, up to its end, that is the span; else all of it is. Positions are in code points, ends exclusive."""

    def rows(x: Column) -> Column:
        pairs = F.zip_with(x["m"], x["g"], lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        both = F.zip_with(pairs, F.slice(x["g"], F.lit(2), F.size(x["g"])), lambda p, g: F.struct(p["m"].alias("m"), F.length(p["g"]).alias("skip"), F.substring(p["g"], -40, 40).alias("before"), F.substring(g, 1, 24).alias("after")))
        return F.filter(both, lambda y: y["m"].isNotNull())

    def located(r: Column) -> Column:
        ends = _scan(r, F.lit(0), "int", lambda at, x: (at + x["skip"] + F.length(x["m"]), at + x["skip"] + F.length(x["m"])))
        return F.zip_with(r, ends, lambda x, e: F.struct(x["m"].alias("m"), x["before"].alias("before"), F.coalesce(x["after"], F.lit("")).alias("after"), (F.regexp_extract(x["m"], value, 1) if value else x["m"]).alias("value"), e.alias("end")))

    def span(y: Column) -> Column:
        x = _Match(y["m"], y["before"], y["after"], y["value"])
        take, base, shape, listed, alone = judge(x)
        low = F.lower(x.before)
        votes = [shape, listed, _vote(low.rlike(CONTEXT[kind]), low.rlike(AGAINST[kind])), _vote(F.lower(x.after).rlike(CONTEXT[kind]), F.lower(x.after).rlike(AFTER_AGAINST)), alone]
        return F.struct(
            take.alias("take"), F.lit(KINDS.index(kind)).alias("kind"), (y["end"] - F.length(x.value)).alias("start"), y["end"].alias("end"), base.alias("base"),
            F.array(*votes).alias("votes"), F.array(*_features(kind, x)).alias("feats"), F.lit(bare).alias("bare"), _near(x.before).alias("near"), _far(x.after).alias("far"),
        )

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    spans = F.filter(F.transform(_let(_let(found, rows), located), span), lambda s: s["take"])
    return F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "base", "votes", "feats", "bare", "near", "far")]))


def _candidates(text: Column) -> Column:
    yes, no = F.lit(True), F.lit(False)

    def email(x: _Match):
        known = F.lower(F.element_at(F.split(x.text, r"\."), -1)).rlike(TOP_DOMAINS)
        return yes, yes, _vote(yes), _vote(known, ~known), _vote(~x.right.rlike("[@_]"), x.right.rlike("[@_]"))

    def spelt(x: _Match):
        known = F.lower(F.regexp_extract(x.text, "([A-Za-z0-9-]+)$", 1)).rlike(TOP_DOMAINS)
        return yes, no, F.lit(0), _vote(known, ~known), _vote(~x.right.rlike("[@_]"), x.right.rlike("[@_]"))

    def ip(x: _Match):
        fits, kept = F.forall(F.split(x.text, r"\."), lambda p: p.cast("double") <= 255), x.text.rlike(RESERVED_NETWORKS)
        alone = ~x.right.rlike("[0-9A-Za-z]") & ~x.left.rlike(r"[A-Za-z.]")
        return yes, fits, _vote(fits, ~fits), _vote(~kept, kept), _vote(alone, ~alone)

    def card(x: _Match):
        d = _digits(x.text)
        n, lead = F.length(d), d.rlike(CARD_LEADS)
        ok = (n >= 16) & (n <= 19) & _luhn(d)
        alone = ~x.right.rlike("[0-9A-Za-z]") & ~x.left.rlike("[A-Za-z+]")
        return (n >= 13) & (n <= 19), ok, _vote(ok | ((n >= 13) & _luhn(d)), ~_luhn(d)), _vote(lead, ~lead), _vote(alone, ~alone)

    def phone(x: _Match):
        n = F.length(_digits(x.text))
        ok, known, alone = (n >= 8) & (n <= 15), x.text.rlike(CALLING_CODES), ~x.right.rlike("[0-9A-Za-z]")
        return (n >= 7) & (n <= 16), ok, _vote(ok, ~ok), _vote(known, ~known), _vote(alone, ~alone)

    def local_phone(x: _Match):
        code = ~F.substring(_digits(x.text), 1, 1).isin("0", "1")
        return yes, no, _vote(code, ~code), F.lit(0), _vote(x.right.rlike(r"^[^0-9A-Za-z/_]?$") & ~x.left.rlike("[/_#]"), x.right.rlike("[/_]") | x.left.rlike("[/_#]"))

    def paired_phone(x: _Match):
        return yes, no, _vote(yes), F.lit(0), _vote(~x.right.rlike("[/_%]") & ~x.left.rlike("[/_#]"), x.right.rlike("[/_%]") | x.left.rlike("[/_#]"))

    def plain_phone(x: _Match):
        return yes, no, F.lit(0), F.lit(0), _vote(~x.right.rlike("[/_%]") & ~x.left.rlike("[/_#]"), x.right.rlike("[/_%]") | x.left.rlike("[/_#]"))

    def secret(x: _Match):
        n, letters = F.length(x.value), x.value.rlike("[A-Za-z]") & x.value.rlike("[0-9]")
        key = F.substring(x.text, F.lit(1), F.length(x.text) - n) != ""
        varied = F.size(F.array_distinct(F.split(x.value, ""))) >= 8
        strong = letters & (n >= 12) & varied
        listed = x.value.rlike(KEY_PREFIXES) | key
        alone = ~x.right.rlike("[0-9A-Za-z@]") & ~x.left.rlike("[0-9A-Za-z@/.]")
        return (n >= 6) & x.value.rlike("[0-9A-Za-z]"), no, _vote(strong, ~letters), _vote(listed), _vote(alone, ~alone)

    none = F.array().cast(f"array<{_SPAN}>")
    when = lambda c, x: F.when(c, x).otherwise(none)
    digit = text.rlike("[0-9]")
    return F.concat(
        when(text.contains("@"), _matched(text, EMAIL, "email", email)), when(text.rlike(rf"(?i){_AT}"), _matched(text, SPELT_EMAIL, "email", spelt)),
        when(digit & text.contains("."), _matched(text, IP, "ip", ip)), when(digit, _matched(text, CARD, "card", card)),
        when(digit & text.contains("+"), _matched(text, PHONE, "phone", phone)), when(digit & text.rlike(LOCAL_PHONE), _matched(text, LOCAL_PHONE, "phone", local_phone)),
        when(digit & text.rlike(PAIRED_PHONE), _matched(text, PAIRED_PHONE, "phone", paired_phone)), when(digit & text.rlike(TRIPLE_PHONE), _matched(text, TRIPLE_PHONE, "phone", plain_phone, bare=True)),
        when(digit & text.rlike(AREA_PHONE), _matched(text, AREA_PHONE, "phone", plain_phone, bare=True)),
        when(digit | text.rlike(rf"{_KEY}\x20?[:=]"), _matched(text, SECRET, "secret", secret, rf"^(?:{_KEY}\x20?[:=]\x20?[\"']?)?+(.*)$")),
    )


def _clear_of_base(spans: Column) -> Column:
    """The base spans, and of the others those that overlap no base span."""
    line = "struct<start:int,end:int,span:" + _SPAN + ",hit:boolean>"
    rows = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x.alias("span"), F.lit(False).alias("hit"))))
    put = lambda x, hit: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["span"].alias("span"), (x["hit"] | (~x["span"]["base"] & hit)).alias("hit"))
    ahead = _scan(rows, F.lit(0), line, lambda s, x: (F.when(x["span"]["base"], F.greatest(s, x["end"])).otherwise(s), put(x, x["start"] < s)))
    back = _scan(F.reverse(ahead), F.lit(2**31 - 1), line, lambda s, x: (F.when(x["span"]["base"], F.least(s, x["start"])).otherwise(s), put(x, x["end"] > s)))
    mixed = F.exists(spans, lambda x: x["base"]) & F.exists(spans, lambda x: ~x["base"])
    return F.when(mixed, F.transform(F.filter(back, lambda x: ~x["hit"]), lambda x: x["span"])).otherwise(spans)


def reliabilities(patterns: Iterable[tuple[tuple[int, ...], int]], rounds: int = 40, trust: tuple[int, ...] = TRUST) -> tuple[float, list[dict[int, tuple[float, float]]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation over (votes, count): the share of true spans, per labeler and vote its chance given true and given
    false, and per vote pattern the chance that its spans are true. It starts from the votes, weighed by trust."""
    patterns = list(patterns)
    chance = {v: min(0.95, max(0.05, 0.5 + 0.15 * sum(a * b for a, b in zip(v, (*trust, *[1] * len(v)), strict=False)))) for v, _ in patterns}
    share, tables = 0.5, []
    for _ in range(rounds):
        true, all_ = sum(chance[v] * c for v, c in patterns), sum(c for _, c in patterns)
        share = (true + 1) / (all_ + 2)
        tables = []
        for k in range(len(patterns[0][0]) if patterns else 0):
            table = {}
            for vote in (-1, 0, 1):
                t, f = sum(chance[v] * c for v, c in patterns if v[k] == vote), sum((1 - chance[v]) * c for v, c in patterns if v[k] == vote)
                # a labeler is right more often than not: pseudo-counts of one vote that way
                table[vote] = ((t + (1.5 if vote == 1 else 0.5)) / (true + 2.5), (f + (1.5 if vote == -1 else 0.5)) / (all_ - true + 2.5))
            tables.append(table)
        for v, _ in patterns:
            a, b = math.log(share), math.log(1 - share)
            for k, vote in enumerate(v):
                a, b = a + math.log(tables[k][vote][0]), b + math.log(tables[k][vote][1])
            chance[v] = 1 / (1 + math.exp(min(50.0, b - a)))
    return share, tables, chance


@dataclass(frozen=True)
class SpanClassifier:
    """Naive Bayes per kind over FEATURES, trained on the chances that expectation-maximisation gives: the log odds of a true span, and
    per feature and value what it adds to them."""

    prior: tuple[float, ...]
    weights: tuple[tuple[tuple[float, ...], ...], ...]

    @staticmethod
    def train(sums: Iterable[tuple[int, int, int, float, float]], kinds: int = len(KINDS), features: int = len(FEATURES), values: int = 8) -> SpanClassifier:
        """From (kind, feature, value, sum of chances, sum of one less the chance)."""
        true = [[[0.0] * values for _ in range(features)] for _ in range(kinds)]
        false = [[[0.0] * values for _ in range(features)] for _ in range(kinds)]
        for kind, feature, value, t, f in sums:
            true[kind][feature][value], false[kind][feature][value] = t, f
        prior, weights = [], []
        for t, f in zip(true, false, strict=True):
            nt, nf = sum(t[0]), sum(f[0])
            prior.append(math.log((nt + 1) / (nf + 1)))
            weights.append(tuple(tuple(math.log((a + 0.5) / (nt + values / 2)) - math.log((b + 0.5) / (nf + values / 2)) for a, b in zip(x, y, strict=True)) for x, y in zip(t, f, strict=True)))
        return SpanClassifier(tuple(prior), tuple(weights))

    def chance(self, kind: Column, feats: Column) -> Column:
        lits = lambda xs: F.array(*[F.lit(x) for x in xs])
        tables = F.array(*[F.array(*[lits(f) for f in k]) for k in self.weights])
        mine = F.zip_with(F.get(tables, kind), feats, lambda w, v: F.get(w, v))
        return 1 / (1 + F.exp(-F.aggregate(mine, F.get(lits(self.prior), kind), lambda a, b: a + b)))


def context_words(spans: DataFrame, *, least: int = 20, ratio: float = 4.0, z: float = 4.0, most: int = 64) -> dict[tuple[int, bool], list[str]]:
    """Words that announce a kind, and words that announce what only looks like it, learned from spans (kind, base, votes, near, far):
    (kind, for or against) to words.

    For: from base spans, and from candidates that pattern and gazetteer both take. Against: from candidates that the pattern's check
    refuses. A word counts if it stands before at least `least` of these spans, `ratio` times as often as after them, by `z` standard
    deviations; a word of both lists is of neither. Counts cover all spans; a list holds the `most` words of the largest z, so that the
    model's size is bounded. No spans: no words.
    """
    shape, listed = F.get("votes", F.lit(0)), F.get("votes", F.lit(1))
    side = F.when(F.col("base") | ((shape == 1) & (listed == 1)), F.lit(True)).when(shape == -1, F.lit(False))
    rows = spans.select("kind", side.alias("side"), "near", "far").where("side is not null")
    marked = lambda c, on: F.transform(c, lambda w: F.struct(w.alias("word"), F.lit(on).alias("before")))
    each = rows.select("kind", "side", F.explode(F.concat(marked("near", 1), marked("far", 0))).alias("x")).select("kind", "side", "x.*")
    n = each.groupBy("kind", "side", "word").agg(F.sum("before").alias("a"), F.sum(1 - F.col("before")).alias("b"))
    score = (F.col("a") - F.col("b")) / F.sqrt((F.col("a") + F.col("b")).cast("double"))
    told = n.withColumn("z", score).where((F.col("a") >= least) & (F.col("a") >= ratio * (F.col("b") + 1)) & (F.col("z") >= z))
    nth = F.row_number().over(Window.partitionBy("kind", "side").orderBy(F.desc("z"), "word"))
    found: dict[tuple[int, bool], set[str]] = {}
    for kind, side_, word in told.withColumn("nth", nth).where(F.col("nth") <= most).select("kind", "side", "word").collect():
        found.setdefault((kind, side_), set()).add(word)
    return {(kind, s): sorted(words - found.get((kind, not s), set())) for (kind, s), words in found.items()}


def _with_context(spans: Column, words: dict[tuple[int, bool], list[str]]) -> Column:
    """The spans with the vote and the feature of their context by the learned words too, and with the pattern's vote of bare ones."""
    lists = {s: F.array(*[F.array(*[F.lit(w) for w in words.get((k, s), ())]).cast("array<string>") for k in range(len(KINDS))]) for s in (True, False)}
    has = lambda x, s: F.coalesce(F.arrays_overlap(x["near"], F.get(lists[s], x["kind"])), F.lit(False))

    def judged(x: Column) -> Column:
        old, context = F.get(x["votes"], F.lit(_CONTEXT_LABELER)), F.get(x["feats"], F.lit(_CONTEXT_FEATURE))
        vote = F.when(old != 0, old).when(has(x, True), 1).when(has(x, False), -1).otherwise(0)
        seen = context.bitwiseOR(has(x, True).cast("int")).bitwiseOR(2 * has(x, False).cast("int"))
        put = lambda xs, at, new: F.transform(xs, lambda y, i: F.when(i == at, new).otherwise(y))
        votes = F.when(x["bare"], put(x["votes"], 0, F.when(vote == 1, 1).otherwise(-1))).otherwise(x["votes"])
        return F.struct(*[x[c].alias(c) for c in ("kind", "start", "end", "base")], put(votes, _CONTEXT_LABELER, vote).alias("votes"), put(x["feats"], _CONTEXT_FEATURE, seen).alias("feats"))

    return F.transform(spans, judged)


def find_pii(docs: DataFrame, *, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, base) by kind, then start, for each row of docs.

    base: found by the kind's base pattern and check. The others are candidates of wider patterns whose chance by the classifier is at
    least `least` and that overlap no base span. Words before a span vote by fixed lists of four languages and by those of context_words. Null or empty text: no spans. Repeated rows are searched each; an empty table gives
    none; other columns, whatever their names, are ignored. Work grows with the text, and with matches to the power 1.5.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    found = materialize(text.select("doc_id", _let(_candidates(F.col("t")), _clear_of_base).alias("c")), "pii-candidates")
    words = context_words(found.select(F.explode("c").alias("x")).select("x.*"))
    found = found.select("doc_id", _with_context(F.col("c"), words).alias("c"))
    spans = found.select(F.explode("c").alias("x")).select("x.*")
    counted: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for r in sorted(spans.groupBy("kind", "votes").count().collect()):  # kinds x 3 to the number of labelers, at most
        counted.setdefault(r[0], []).append((tuple(r[1]), r[2]))
    name = lambda kind, votes: ",".join(map(str, (kind, *votes)))
    chances = {name(kind, v): p for kind, patterns in counted.items() for v, p in reliabilities(patterns)[2].items()}
    sums: list[tuple] = []
    if chances:
        key = F.concat_ws(",", F.col("kind").cast("string"), F.transform("votes", lambda v: v.cast("string")))
        chance = F.element_at(F.create_map(*[F.lit(x) for pair in chances.items() for x in pair]), key)
        by = spans.select("kind", chance.alias("p"), F.posexplode("feats").alias("feature", "value"))
        sums = sorted(map(tuple, by.groupBy("kind", "feature", "value").agg(F.sum("p"), F.sum(1 - F.col("p"))).collect()))  # kinds x features x 8
    model = SpanClassifier.train(sums)
    taken = F.filter("c", lambda x: x["base"] | (model.chance(x["kind"], x["feats"]) >= least))
    short = F.transform(taken, lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "start", "end", "base")]))
    return found.select("doc_id", F.array_sort(short).alias("spans"))
