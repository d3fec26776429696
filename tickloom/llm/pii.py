"""Personal data by weak supervision, in DataFrame and SQL functions only.

Three sorts of labelers propose spans and vote on them. Regular expressions: strict forms of each kind. Gazetteers: top
level domains (name at host dot com), country codes (0044 20 ...), countries of bank accounts. Context: what follows
"token =", "passport no." or "born on". Whoever has proposed it, each span gets LABELERS votes (for, against, abstain):
its form (checksums, number ranges), gazetteers, the words before it, and its borders.

Spans are counted by pattern of votes and features: a table of classes, all that reaches the driver. By
expectation-maximisation on it each labeler's reliability by kind and the share of true spans of each kind are estimated.
A logistic span classifier is trained on the resulting soft labels. Besides the votes it sees what no labeler looks at:
length, make-up of the characters, the character before. It is then an expression over each span. Matches of the base
patterns that pass their own test are always kept.

An abstention says nothing. What tells the two classes of the mixture apart is the first belief that labelers are right
more often than not; it stays in force as pseudo-votes, TRUST of their number, at every size.

Defined results: null text counts as empty; repeated rows give repeated results; null ids stay null; other columns,
whatever their names, are ignored by find() and kept by redact(); an empty table gives an empty result; of spans at one
place all kinds are listed, in the order of KINDS. Positions are code points, end exclusive.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# Patterns. The base patterns equal
#   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card   [0-9]([\x20-]?[0-9])+
#   phone  \+[0-9][\x20().0-9-]+[0-9]
# in a form that runs in linear time and without recursion: no part can give back what the next part could use, and a
# match can't begin inside a run of its first class, unless the match before ended there (\G).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Gazetteers.
TOP_LEVEL = "com org net edu gov mil int info io dev app ai co uk de fr es it nl be ch at pt pl se no dk fi ie eu us ca mx br ar jp cn in au nz ru za test example".split()
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 351 352 353 354 355 356 357 358 359 370 371 372 380 385 386 420 421 971 972".split()
ACCOUNT_COUNTRIES = "AD AE AL AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK TR".split()
KEY_HEADS = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "xoxb-", "xoxp-", "eyJ", "AIza")
_KEY = "(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential)"
_NUMBERED = "(?i:passport|account|member|customer|policy|patient|tax|driver'?s? licen[cs]e) (?i:no\\.?|number|id|#)"
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+().-])(?<!\+[0-9]{1,3}[ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "secret": r"(?<![0-9A-Za-z_+/-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[po]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,100}|xox[bp]-[A-Za-z0-9-]{10,100}|AIza[A-Za-z0-9_-]{35})(?![0-9A-Za-z])",
}
GAZETTEERS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{2,64}}+ at [A-Za-z0-9-]{{2,63}}+ dot (?:{'|'.join(TOP_LEVEL)})(?![A-Za-z0-9])",
    "phone": rf"(?<![0-9+().-])00[ -]?(?:{'|'.join(COUNTRY_CODES)})(?:[ .()-]{{0,2}}[0-9]){{7,12}}(?![0-9])",
    "iban": rf"(?<![0-9A-Za-z])(?:{'|'.join(ACCOUNT_COUNTRIES)})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?![0-9A-Za-z])",
}
CONTEXTS = {
    "secret": rf"(?<![0-9A-Za-z+/_-])(?<={_KEY}[\x22']?\s{{0,3}}[=:]\s{{0,3}}[\x22']?)[0-9A-Za-z+/_-]{{12,128}}+",
    "number": rf"(?<={_NUMBERED}[ :]{{0,3}})(?<![A-Za-z0-9-])[A-Za-z0-9][A-Za-z0-9-]{{4,19}}+",
    "birth": r"(?<=(?i:born|birth|d\.?o\.?b\.?)[a-z ]{0,12}[ :]{1,3})(?<![0-9./-])[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}+(?![./-]?[0-9])",
}
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret", "number", "birth")

# Words before a span.
FOR = {
    "email": "e-?mail|mailto|contact|write to|correo|courriel|kontakt",
    "ip": r"\bip\b|address|host|server|client|adresse",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta",
    "phone": r"phone|\bcall\b|mobile|\btel\b|\bfax\b|telefon|téléphone|teléfono",
    "ssn": r"\bssn\b|social security",
    "iban": "iban|account|konto|compte|cuenta",
    "secret": "key|password|passwd|pwd|token|secret|credential",
    "number": "passport|account|member|customer|policy|patient|tax|licen[cs]e",
    "birth": "born|birth|dob|d\\.o\\.b",
}
AGAINST = r"version|release|\bisbn\b|invoice|order|serial|section|figure|licen[cs]e|\bv$|§ ?$"
PLACEHOLDERS = r"(?i)^(?:x+|\*+|your[a-z_-]*|change[_-]?me|example[a-z_-]*|placeholder[a-z_-]*|(.)\1+)$"

LABELERS = 4
#: First belief: a labeler votes for a true span, and against a false one, with these chances, when it votes.
RIGHT, REJECTS = 0.95, 0.7
#: Probability from which the classifier accepts a span.
ACCEPT = 0.8
#: Share of the votes that the first belief weighs; weight of a kind's first share of true spans, one half, in spans.
TRUST, EVEN = 0.2, 2.0
ROUNDS, EPOCHS, RATE = 100, 400, 0.5
_STEP = 256  # matches a block of the running sum


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _found(text: Column, pattern: str) -> Column:
    """All matches as (start, end, value, before, after): the pieces between them give the places. Running sums go by
    blocks, so that many matches in one text take little more than linear time."""

    def build(s: Column) -> Column:
        gaps, hits = s["gaps"], s["hits"]
        lens = F.zip_with(gaps, hits, lambda a, b: F.length(a) + F.coalesce(F.length(b), F.lit(0)))

        def add(a: Column) -> Column:
            return F.aggregate(a, F.lit(0), lambda x, y: x + y)

        def place(lens: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / _STEP).cast("int"))
            sums = F.transform(blocks, lambda b: add(F.slice(lens, b * _STEP + 1, _STEP)))
            ahead = _let(sums, lambda t: F.transform(t, lambda _, b: add(F.slice(t, 1, b))))

            def one(ahead: Column) -> Column:
                def span(v: Column, i: Column) -> Column:
                    b = F.floor(i / _STEP).cast("int")
                    start = F.get(ahead, b) + add(F.slice(lens, b * _STEP + 1, i - b * _STEP)) + F.length(F.get(gaps, i))
                    return F.struct(
                        start.alias("start"),
                        (start + F.length(v)).alias("end"),
                        v.alias("value"),
                        F.right(F.get(gaps, i), F.lit(40)).alias("before"),
                        F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"),
                    )

                return F.transform(hits, span)

            return _let(ahead, one)

        return _let(lens, place)

    return _let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), build)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        x = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        y = F.when(i % 2 == 0, x * 2).otherwise(x)
        return acc + F.when(y > 9, y - 9).otherwise(y)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _octets(v: Column) -> Column:
    """All parts at most 255; parts may have leading zeros and any length."""

    def low(part: Column) -> Column:
        short = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.when(F.length(short) <= 3, short.cast("int") <= 255).otherwise(F.lit(False))

    return F.forall(F.split(v, r"\."), low)


def _passes(kind: str, v: Column) -> Column:
    """The test that a base match must pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(v)
    n = F.length(_digits(v))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(12, 19), _luhn(_digits(v))).otherwise(F.lit(False))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, base: bool, x: Column) -> list[Column]:
    """Form, gazetteer, context and borders."""
    v, digits = x["value"], _digits(x["value"])
    none = F.lit(False)
    if kind == "email":
        domain = F.lower(F.regexp_extract(v, r"(?:@|\[at\]|\(at\)| at ) ?(.*)$", 1))
        domain = F.regexp_replace(domain, r" ?(?:\[dot\]|\(dot\)| dot |\.) ?", ".")
        last = F.element_at(F.split(domain, r"\.+"), -1)
        form = _vote(last.rlike("^[a-z]{2,24}$") & ~v.rlike(r"^\.|\.@|\.\."), ~last.rlike("^[a-z]{2,24}$"))
        gazette = _vote(last.isin(TOP_LEVEL), ~last.rlike("^[a-z-]+$"))
    elif kind == "ip":
        form = _vote(_octets(v), ~_octets(v))
        gazette = _vote(~v.rlike(r"^(?:0|127|255)\.") & _octets(v), v.rlike(r"^0+\."))
    elif kind == "card":
        form = _vote(_passes("card", v), ~_passes("card", v))
        gazette = _vote(digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6011|65)") & F.length(digits).between(13, 19), digits.rlike("^(?:0|1|7|8|9)"))
    elif kind == "phone" and base:
        form = _vote(_passes("phone", v), ~_passes("phone", v))
        heads = [F.substr(digits, F.lit(1), F.lit(n)).isin([c for c in COUNTRY_CODES if len(c) == n]) for n in (1, 2, 3)]
        gazette = _vote(heads[0] | heads[1] | heads[2], digits.startswith("0"))
    elif kind == "phone":
        form = _vote(digits.rlike("^[2-9][0-9]{2}[2-9]"), digits.rlike("^[01]|^[0-9]{3}[01]"))
        gazette = _vote(digits.rlike("^[0-9]{3}555|^8(?:00|88|77)"), none)
    elif kind == "ssn":
        form = _vote(~digits.rlike("^(?:000|666|9)|^...00|0000$"), digits.rlike("^(?:000|666|9)|^...00|0000$"))
        gazette = _vote(none, digits.rlike(r"^(\d)\1+$"))
    elif kind == "iban":
        compact = F.regexp_replace(v, " ", "")
        form = _vote(F.length(compact).between(15, 34) & compact.rlike("[0-9]{8}"), ~compact.rlike("[0-9]{6}"))
        gazette = _vote(F.substr(v, F.lit(1), F.lit(2)).isin(ACCOUNT_COUNTRIES), ~compact.rlike("^(?:[A-Z]{2})[0-9]"))
    elif kind == "secret":
        form = _vote(v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.length(v) >= 16), ~v.rlike("[0-9]") | v.rlike(PLACEHOLDERS))
        heads = [v.startswith(h) for h in KEY_HEADS]
        gazette = _vote(reduce(lambda a, b: a | b, heads), v.rlike(PLACEHOLDERS) | v.rlike("^[a-z-]+$"))
    elif kind == "number":
        form = _vote(F.length(digits) >= 4, F.length(digits) == 0)
        gazette = _vote(none, v.rlike(PLACEHOLDERS))
    else:
        parts = F.transform(F.split(v, "[./-]"), lambda p: p.cast("int"))
        year = F.greatest(F.get(parts, F.lit(0)), F.get(parts, F.lit(2)))
        low = F.least(F.get(parts, F.lit(0)), F.get(parts, F.lit(2)))
        fits = low.between(1, 31) & F.get(parts, F.lit(1)).between(1, 31) & (F.least(low, F.get(parts, F.lit(1))) <= 12)
        form = _vote(fits, ~fits)
        gazette = _vote(year.between(1900, 2030) | (year < 100), (year > 2030) | year.between(100, 1899))
    before = F.lower(x["before"])
    context = _vote(before.rlike(FOR[kind]), before.rlike(AGAINST))
    glued = x["before"].rlike("[A-Za-z0-9_]$") | x["after"].rlike("[A-Za-z0-9_@]")
    return [form, gazette, context, _vote(~glued, glued)]


def _shape(kind: str, base: bool):
    def shape(x: Column) -> Column:
        n = F.length(x["value"])
        return F.struct(
            x["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            x["end"].alias("end"),
            (_passes(kind, x["value"]) if base else F.lit(False)).alias("base"),
            F.array(*_votes(kind, base, x)).alias("votes"),
            _features_of(x).alias("of"),
        )

    return shape


#: Features by class: length, make-up, character before.
CLASSES = (3, 6, 4)


def _features_of(x: Column) -> Column:
    """The classes of a span, in the order of CLASSES."""
    v = x["value"]
    n = F.length(v)
    size = F.when(n < 12, 0).when(n < 20, 1).otherwise(2)
    digits = F.length(_digits(v))
    letters = v.rlike("[A-Za-z]")
    alike = v.rlike(r"^[^A-Za-z0-9]*([A-Za-z0-9])(?:\1|[^A-Za-z0-9])*$")  # one letter or digit only
    make = F.when(alike, 0).when(digits == 0, 1).when(~letters & (digits == n), 2).when(~letters, 3).when(v.rlike("[A-Z]") & v.rlike("[a-z]"), 4).otherwise(5)
    last = F.right(x["before"], F.lit(1))
    before = F.when(last == "", 0).when(last.rlike(r"\s"), 1).when(last.rlike(r"[\x22'(\[<=:]"), 2).otherwise(3)
    return F.array(size, make, before)


def _of_rank(i: int):
    return lambda s: s["rank"] == i


def _any(text: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def _gate(kind: str, patterns: dict, t: Column) -> Column:
    """Where a text can hold a match at all, the cheapest test first; the patterns run on those texts only."""
    if patterns is BASE:
        return {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike("[0-9]"), "phone": t.rlike(r"\+[0-9]")}[kind]
    if patterns is MORE:
        return {
            "email": _any(t, "[at]", "(at)"), "phone": t.rlike(r"[0-9]{3}[ .-][0-9]{4}"), "ssn": t.rlike(r"-[0-9]{2}-[0-9]{4}"),
            "secret": _any(t, "AKIA", "ASIA", "ghp_", "gho_", "sk-", "xoxb-", "xoxp-", "AIza"),
        }[kind]
    if patterns is GAZETTEERS:
        return {"email": t.contains(" at ") & t.contains(" dot "), "phone": t.rlike(r"00[ -]?[1-9]"), "iban": t.rlike(r"[A-Z]{2}[0-9]{2}")}[kind]
    return {
        "secret": _any(t, "=", ":") & t.rlike(_KEY + r"[\x22']?\s{0,3}[=:]"), "number": t.rlike("[0-9]") & t.rlike(_NUMBERED),
        "birth": t.rlike("[0-9][./-][0-9]") & t.rlike(r"(?i:born|birth|d\.?o\.?b)"),
    }[kind]


def _candidates(text: Column) -> Column:
    """All candidates of a text as an array of (start, rank, end, base, votes, of)."""
    kind_type = "array<struct<start:int,rank:int,end:int,base:boolean,votes:array<int>,of:array<int>>>"
    parts = []
    for patterns in (BASE, MORE, GAZETTEERS, CONTEXTS):
        for kind, pattern in patterns.items():
            hits = _found(text, pattern)
            if kind == "card":  # shorter runs of digits are no candidates
                hits = F.filter(hits, lambda x: F.length(_digits(x["value"])).between(12, 19))
            parts.append(F.when(_gate(kind, patterns, text), F.transform(hits, _shape(kind, patterns is BASE))).otherwise(F.array().cast(kind_type)).cast(kind_type))
    return F.concat(*parts)


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def estimate(counts: dict[tuple, int]) -> tuple[dict[int, float], dict[tuple[int, int], dict[tuple[int, int], float]], dict[tuple, float]]:
    """Expectation-maximisation on (rank, votes, of) -> count: the prior of each kind, P(vote | class, no abstention) of
    each labeler and kind, and the posterior of each row."""
    first = {(1, 1): RIGHT, (-1, 1): 1 - RIGHT, (1, 0): 1 - REJECTS, (-1, 0): REJECTS}
    ranks = sorted({k[0] for k in counts})
    chance = {(j, r): dict(first) for j in range(LABELERS) for r in ranks}
    prior = dict.fromkeys(ranks, 0.5)
    posterior: dict[tuple, float] = {}
    for _ in range(ROUNDS):
        for key in counts:
            rank, votes = key[0], key[1]
            odds = math.log(prior[rank] / (1 - prior[rank])) + sum(math.log(chance[j, rank][v, 1] / chance[j, rank][v, 0]) for j, v in enumerate(votes) if v)
            posterior[key] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for j, r in chance:
            voted = [(n, key[1][j], posterior[key]) for key, n in counts.items() if key[0] == r and key[1][j]]
            belief = 1 + TRUST * sum(n for n, _, _ in voted)
            for c in (0, 1):
                mass = {v: belief * first[v, c] + sum(n * (p if c else 1 - p) for n, w, p in voted if w == v) for v in (1, -1)}
                for v in mass:
                    chance[j, r][v, c] = mass[v] / sum(mass.values())
        for r in ranks:
            seen = [(n, posterior[k]) for k, n in counts.items() if k[0] == r]
            prior[r] = (EVEN / 2 + sum(n * p for n, p in seen)) / (EVEN + sum(n for n, _ in seen))
    return prior, chance, posterior


def _features(rank: int, votes: tuple, of: tuple) -> list[str]:
    return ["bias", f"kind{rank}"] + [f"vote{j}:{rank}:{v}" for j, v in enumerate(votes) if v] + [f"of{i}:{c}" for i, c in enumerate(of)]


def train(counts: dict[tuple, int]) -> dict[str, float]:
    """Weights of the logistic span classifier: gradient steps on the soft labels over the counted rows, from zero."""
    _, _, soft = estimate(counts)
    weights: dict[str, float] = defaultdict(float)
    rows = [(_features(*key), n, soft[key]) for key, n in counts.items()]
    held: dict[str, int] = defaultdict(int)  # each weight steps by its own number of spans
    for names, n, _ in rows:
        for f in names:
            held[f] += n
    for _ in range(EPOCHS):
        slope: dict[str, float] = defaultdict(float)
        for names, n, want in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[f] for f in names)))))
            for f in names:
                slope[f] += n * (want - p)
        for f, g in slope.items():
            weights[f] += RATE * (g / (held[f] + EVEN) - 1e-3 * weights[f])
    return dict(weights)


def fit(candidates: DataFrame) -> dict[str, float]:
    """From a table with a column c of candidates: votes over all of them, counted, and the classifier trained on them."""
    each = candidates.select(F.explode("c").alias("c"))
    rows = each.groupBy("c.rank", "c.votes", "c.of").agg(F.count("*").alias("n")).collect()  # at most kinds * 3^4 * 72 rows
    counts = {(r["rank"], tuple(r["votes"]), tuple(r["of"])): r["n"] for r in sorted(rows, key=lambda r: (r["rank"], r["votes"], r["of"]))}
    return train(counts)


def _score(c: Column, weights: dict[str, float]) -> Column:
    """The classifier over a candidate; kinds, votes and classes that it has never seen add nothing."""

    def pick(value: Column, names: dict) -> Column:
        out = F.lit(0.0)
        for v, name in names.items():
            if weights.get(name):
                out = F.when(value == F.lit(v), F.lit(weights[name])).otherwise(out)
        return out

    total = F.lit(weights.get("bias", -10.0)) + pick(c["rank"], {i: f"kind{i}" for i in range(len(KINDS))})
    for j in range(LABELERS):
        vote = F.get(c["votes"], F.lit(j)) + 10 * c["rank"]
        total = total + pick(vote, {v + 10 * r: f"vote{j}:{r}:{v}" for r in range(len(KINDS)) for v in (1, -1)})
    for i, n in enumerate(CLASSES):
        total = total + pick(F.get(c["of"], F.lit(i)), {k: f"of{i}:{k}" for k in range(n)})
    return total


def _bare(c: Column, keep) -> Column:
    """Accepted candidates as (start, rank, end), in order, once each."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(c, keep), lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end")))))


def _accepted(c: Column, weights: dict[str, float]) -> Column:
    return _bare(c, lambda c: c["base"] | (_score(c, weights) > math.log(ACCEPT / (1 - ACCEPT))))


def _written(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans). Candidates are written once; the
    classifier is trained on them and applied to them."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.keep(docs.select("doc_id", _candidates(_text()).alias("c")))
    weights = fit(found)
    df = found.select("doc_id", _bare(F.col("c"), lambda c: c["base"]).alias("base"), _accepted(F.col("c"), weights).alias("spans"))
    counts = [F.size(F.filter("base", _of_rank(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return df.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets (overlapping spans become one, of the kind that begins
    first) and n_chars, where it is a column, brought up to date."""
    weights = fit(docs.select(_candidates(_text()).alias("c")))
    df = docs.select(F.struct("*").alias("row"), _text().alias("text"), _accepted(_candidates(_text()), weights).alias("spans"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        piece = F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(piece, F.get(names, s["rank"])))).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate("spans", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(F.col("text"), a["at"] + 1, F.length("text"))))
    changed = F.size("spans") > 0
    df = df.select("row", F.when(changed, done).alias("new"))
    out = {c: F.col("row").getField(c) for c in docs.columns}
    out["text"] = F.coalesce("new", F.col("row.text"))
    if "n_chars" in out:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(F.col("new").isNotNull(), F.length("new").cast(kind)).otherwise(F.col("row.n_chars"))
    return df.select(*[c.alias(k) for k, c in out.items()])


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
