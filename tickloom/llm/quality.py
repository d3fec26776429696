"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule has a feature expression and a rejection predicate. plan_cascade() measures each rule's cost on a bounded sample
(seconds to evaluate it in one task, beyond those of the same task without it, the least of several runs) and takes the
rules greedily: next comes the one that rejects most of the sample's documents still left per second. The verdict is a
nested CASE with the features inside its branches, so a document is tested only up to the first rule that rejects it,
and what later rules would need is never computed for it. The order changes the cost, never the verdict.

Defined results: null text counts as the empty text, which fails; repeated rows give repeated results; null ids stay
null; extra columns, whatever their names, are kept by keep_good() and left out by features(); an empty table gives an
empty result (and the rules keep their given order).
"""

from __future__ import annotations

import math
import time
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Rows of the sample on which cost and selectivity are estimated, and runs of each timing; the verdicts are over all rows.
SAMPLE, RUNS = 1000, 2
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document is rejected where rejects(features) is true; needs names the features it reads."""

    name: str
    needs: tuple[str, ...]
    rejects: str


#: Fixed thresholds. The first two are the base rules.
RULES = (
    Rule("few_words", ("n_words",), "n_words < 20"),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", ("n_words", "n_symbols"), "10 * n_symbols > n_words"),
    Rule("word_length", ("n_words", "word_chars"), "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("stutter", ("n_words", "n_stutter"), "10 * n_stutter > 3 * n_words"),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), "n_dup_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
)
BASE = ("few_words", "repeated_windows")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _windows(w: Column) -> Column:
    """One 64-bit hash per window of WINDOW words, from hashes of 2, 4 and 8 neighbours."""
    n = F.size(w)

    def pair(gap: int):
        # zip_with pads the shorter side with nulls; the ends it makes are cut off below
        return lambda h: F.zip_with(h, F.slice(h, gap + 1, F.greatest(F.size(h) - gap, F.lit(0))), lambda a, b: F.xxhash64(a, b))

    hashes = F.transform(w, lambda x: F.xxhash64(x))
    for gap in (1, 2, 4):
        hashes = _let(hashes, pair(gap))
    return F.when(n >= WINDOW, F.slice(hashes, 1, F.greatest(n - (WINDOW - 1), F.lit(1))))


def _covered(h: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: sort by (hash, place), keep those equal to a neighbour,
    sort their places and add up the steps, at most WINDOW each."""
    tagged = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def equal_to_neighbour(s: Column) -> Column:
        n = F.size(s)
        after = F.transform(F.slice(s, 2, n - 1), lambda x: x["h"])
        before = F.concat(F.array(F.lit(None).cast("long")), F.transform(F.slice(s, 1, n - 1), lambda x: x["h"]))
        beside = F.arrays_zip(s.alias("s"), before.alias("b"), after.alias("a"))
        return F.transform(
            F.filter(beside, lambda x: F.coalesce(x["s"]["h"] == x["b"], F.lit(False)) | F.coalesce(x["s"]["h"] == x["a"], F.lit(False))),
            lambda x: x["s"]["i"],
        )

    places = F.array_sort(_let(tagged, equal_to_neighbour))
    return _let(
        places,
        lambda p: F.aggregate(
            F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
            F.lit(0).cast("long"),
            lambda acc, x: acc + x,
        ),
    )


def _text() -> Column:
    """Never null."""
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _feature(name: str, text: Column, w: Column) -> Column:
    """A feature of a text and its words."""
    if name == "n_words":
        return F.size(w).cast("long")
    if name == "word_chars":
        return F.length(F.array_join(w, "")).cast("long")
    if name == "n_stutter":  # words equal to the word before
        return F.size(F.filter(F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: a == b), lambda same: F.coalesce(same, F.lit(False)))).cast("long")
    if name == "n_symbols":
        return (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long")
    if name == "n_lines":
        return F.size(_lines(text)).cast("long")
    if name == "n_dup_lines":
        return _let(_lines(text), lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")
    if name == "n_repeat_words":
        return _let(_windows(w), lambda h: F.when(h.isNull() | (F.size(F.array_distinct(h)) == F.size(h)), F.lit(0).cast("long")).otherwise(_covered(h)))
    raise KeyError(name)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _verdict(rules: list[Rule] | tuple[Rule, ...], text: Column, w: Column, given: tuple[str, ...] = ()) -> Column:
    """True if no rule rejects. Features that are not columns yet are computed inside their branch, so only where no
    earlier rule has rejected."""
    out = F.lit(True)
    for r in reversed(rules):
        test = F.expr(r.rejects)
        lazy = [n for n in r.needs if n not in given]
        if lazy:
            made = F.array(F.struct(*[_feature(n, text, w).alias(n) for n in lazy]))
            test = F.transform(made, _substituted(r.rejects, lazy))[0]
        out = F.when(test, F.lit(False)).otherwise(out)
    return out


def _passes(rules) -> Column:
    """The verdict on the column text, which is split once."""
    return _let(_text(), lambda t: _let(_words(t), lambda w: _verdict(rules, t, w)))


def _substituted(text: str, lazy: list[str]):
    return lambda s: _substitute(text, s, lazy)


def _substitute(text: str, s: Column, lazy: list[str]) -> Column:
    """The predicate text over struct fields. Predicates are sums and comparisons of features and whole numbers."""
    import ast

    def build(n):
        match n:
            case ast.BoolOp():
                parts = [build(v) for v in n.values]
                out = parts[0]
                for p in parts[1:]:
                    out = out & p if isinstance(n.op, ast.And) else out | p
                return out
            case ast.Compare():
                a, b = build(n.left), build(n.comparators[0])
                return {ast.Lt: a < b, ast.Gt: a > b, ast.GtE: a >= b, ast.LtE: a <= b}[type(n.ops[0])]
            case ast.BinOp():
                return build(n.left) * build(n.right)
            case ast.Constant():
                return F.lit(n.value).cast("long")
            case ast.Name():
                return s[n.id] if n.id in lazy else F.col(n.id)
        raise ValueError(text)

    return build(ast.parse(text, mode="eval").body)


def _sampled(docs: DataFrame, sample: int) -> DataFrame:
    """At most `sample` rows, those of the smallest hashes of id and text, in one partition. Only rows under a threshold
    that some `sample` rows pass are sorted."""
    n = docs.count()
    h = F.xxhash64("doc_id", "text")
    limit = math.ceil(min(1.0, 1.5 * sample / max(n, 1)) * (1 << 20))
    few = docs.select("doc_id", "text").where(F.pmod(h, F.lit(1 << 20)) < limit)
    return few.orderBy(h).limit(sample).coalesce(1)


def ordered(rules, costs: list[float], patterns: dict[int, int]) -> list[Rule]:
    """Greedily by rejections per cost among the documents that no earlier rule rejects. patterns: how many documents
    have which set of rejecting rules, as bits by the rules' places. Rules that reject none come last, cheapest first."""
    left, todo, out = dict(patterns), list(range(len(rules))), []
    while todo:
        hits = {i: sum(n for bits, n in left.items() if bits >> i & 1) for i in todo}
        best = min(todo, key=lambda i: (-hits[i] / costs[i], costs[i], i))
        out.append(rules[best])
        todo.remove(best)
        left = {bits: n for bits, n in left.items() if not bits >> best & 1}
    return out


def plan_cascade(docs: DataFrame, rules=RULES, sample: int = SAMPLE) -> list[Rule]:
    """The rules in the order of ordered(), rated on a sample."""
    rows = _sampled(docs, sample).persist()
    try:
        if rows.isEmpty():
            return list(rules)

        def seconds(column: Column) -> float:
            took = []
            for _ in range(RUNS):
                began = time.monotonic()
                rows.agg(F.count_if(column)).first()
                took.append(time.monotonic() - began)
            return min(took)

        idle = _let(_words(_text()), lambda w: F.size(w) >= 0)  # what all have in common
        seconds(idle)  # compiles it
        least = seconds(idle)
        costs = [max(seconds(_passes([r])) - least, 1e-4) for r in rules]
        bits = sum((F.when(~_passes([r]), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(rules)), F.lit(0))
        return ordered(rules, costs, Counter(r["bits"] for r in rows.select(bits.alias("bits")).collect()))  # at most the sample
    finally:
        rows.unpersist()


#: Features that are part of a result by themselves.
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(docs: DataFrame, order=RULES) -> DataFrame:
    """(doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept): what is shown is
    computed for every document, what only other rules need inside their branch."""
    df = docs.select("doc_id", "text", _text().alias("t")).withColumn("w", _words(F.col("t")))
    df = df.select("doc_id", "text", "t", "w", *[_feature(n, F.col("t"), F.col("w")).alias(n) for n in SHOWN])
    failed = F.expr(" or ".join(f"({r.rejects})" for r in RULES if r.name in BASE))
    df = df.select("*", failed.alias("base_failed"))
    others = [r for r in order if r.name not in BASE]
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(_verdict(others, F.col("t"), F.col("w"), SHOWN))
    return df.select("doc_id", "text", *SHOWN, "base_failed", kept.alias("kept"))


def keep_good(docs: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """The documents that no rule rejects, with their own columns; features are computed only as far as needed."""
    order = plan_cascade(docs, rules, sample)
    return docs.where(_passes(order))


def op10_quality_cascade(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return features(docs, plan_cascade(docs)).drop("text")


#: The rules' thresholds, as RULES states them.
OP10_SQL = """
with w as (
  select doc_id, coalesce(text, '') as t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines,
         row_number() over () as rid
  from documents),
win as (select rid, i, array_to_string(w[i:i + 7], chr(10)) as g from w, unnest(range(1, len(w) - 6)) as u(i) where len(w) >= 8),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as k from win) where k > 1),
cov as (select rid, count(distinct i + o) as n from twice, unnest(range(0, 8)) as v(o) group by rid),
f as (
  select w.rid, doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as n_stutter, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words
  from w left join cov on w.rid = cov.rid)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
       n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or 10 * n_symbols > n_words
            or word_chars < 2 * n_words or word_chars > 20 * n_words
            or 10 * n_stutter > 3 * n_words or (n_dup_lines >= 4 and 10 * n_dup_lines > 3 * n_lines)) as kept
from f"""
