"""Language of web pages by Bayesian fusion of evidence.

Text: a naive Bayes model over letter trigrams of words, fitted to a bounded sample of labelled documents and applied to
whole page texts; its log-likelihood is tempered, since neighbouring trigrams are not independent. Markup: the declared
language, with P(declared | language) counted over all pages. Address: the host's prior, smoothed towards its domain's,
that towards its suffix's and that towards the prior of all pages; each level is a grouped sum of the text posteriors
over all pages. A page's own posterior is left out of every sum that judges it. The posterior is proportional to the
product. A domain is what registries sell names under, and one label more (SECOND_LEVEL).

Defined results: null html counts as empty (evidence from the address alone), a null address as an unknown host; repeated
rows give repeated results; null ids stay null; equal posteriors go to the language first in the alphabet; other columns
are ignored; an empty table of pages gives an empty result; without labelled documents the language is null.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .html import read

#: Labelled documents that the text model is fitted to, about.
FIT_DOCS = 3000
#: Trigrams that count as independent, at most; pseudo-counts of a trigram, of a level of the address and of a declaration.
INDEPENDENT, PSEUDO, LEVEL, DECLARED = 60, 0.5, 5.0, 1.0
MEMORY = 300_000

_WORD = re.compile(r"[^\W\d_]+")
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", re.IGNORECASE)
_CODE = re.compile(r"[A-Za-z]+")
#: Second-level labels under which names of a country are registered.
SECOND_LEVEL = frozenset("ac co com edu gob gouv gov gv id ltd mil ne net nhs nom or org plc police sch".split())


def trigrams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


class TextModel:
    def __init__(self, counts: dict[str, dict[str, int]]):
        self.languages = sorted(counts)
        kinds = {t for c in counts.values() for t in c}
        self.table = {}
        sums = [sum(counts[x].values()) for x in self.languages]
        for t in kinds:
            self.table[t] = np.array([math.log((counts[x].get(t, 0) + PSEUDO) / (n + PSEUDO * (len(kinds) + 1))) for x, n in zip(self.languages, sums, strict=True)])
        self.unseen = np.array([math.log(PSEUDO / (n + PSEUDO * (len(kinds) + 1))) for n in sums])
        self.words: dict[str, np.ndarray] = {}

    def posterior(self, text: str) -> np.ndarray:
        """Of the text alone, under equal priors."""
        if len(self.words) > MEMORY:
            self.words.clear()
        total, n = np.zeros(len(self.languages)), 0
        for word, times in Counter(_WORD.findall(text.lower())).items():
            if word not in self.words:
                self.words[word] = sum((self.table.get(t, self.unseen) for t in trigrams(word)), np.zeros(len(self.languages)))
            total += times * self.words[word]
            n += times * len(word)
        total *= min(1.0, INDEPENDENT / max(n, 1))
        p = np.exp(total - total.max())
        return p / p.sum()


def fit(labelled: DataFrame, size: int = FIT_DOCS) -> TextModel | None:
    """From documents(doc_id, text, lang): a hash sample of about `size` of them."""
    labelled = labelled.where("lang is not null and text is not null")
    n = labelled.count()
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < math.ceil(min(1.0, size / max(n, 1)) * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for word, times in Counter(_WORD.findall(text.lower())).items():
                    for t in trigrams(word):
                        seen[lang][t] += times
            rows = [(x, t, k) for x, c in seen.items() for t, k in c.items()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "t", "n"])

    counts: dict[str, dict[str, int]] = defaultdict(dict)
    grouped = sample.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, t string, n long").groupBy("lang", "t").agg(F.sum("n").alias("n"))
    for r in grouped.collect():  # bounded by the sample
        counts[r["lang"]][r["t"]] = r["n"]
    return TextModel(counts) if counts else None


def read_page(page: str | None, known: frozenset[str]) -> tuple[str, str]:
    """Text and declared language: a known one, 'other' or 'none'."""
    text, said = read(page)
    m = _CODE.match((said or "").strip())
    code = m[0].lower() if m else ""
    return text, code if code in known else "other" if code else "none"


def parts_of(host: str) -> tuple[str, str]:
    """Domain and suffix of a host: a suffix of two labels where a country's second-level label is one."""
    labels = host.split(".")
    k = 2 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SECOND_LEVEL else 1
    return ".".join(labels[-k - 1 :]), ".".join(labels[-k:])


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower().strip(".") if m else ""


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """(page_id, host, domain, suffix, declared, p): p is the text posterior by language."""
    known = frozenset(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts = [host_of(u) for u in b.column(1).to_pylist()]
            declared, p = [], []
            for k in range(0, b.num_rows, 256):
                for page in b.column(2).slice(k, 256).to_pylist():
                    text, code = read_page(page, known)
                    declared.append(code)
                    p.append(model.posterior(text).tolist())
            domains, suffixes = (list(x) for x in zip(*map(parts_of, hosts), strict=True)) if hosts else ([], [])
            yield pa.record_batch(
                [b.column(0), pa.array(hosts, pa.string()), pa.array(domains, pa.string()), pa.array(suffixes, pa.string()), pa.array(declared, pa.string()), pa.array(p, pa.list_(pa.float64()))],
                names=["page_id", "host", "domain", "suffix", "declared", "p"],
            )

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, host string, domain string, suffix string, declared string, p array<double>")


def identify(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """pages -> (page_id, host, declared, text_lang, lang, confidence)."""
    spark = pages.sparkSession
    model = fit(labelled)
    if model is None:
        source = pages.select(F.col("page_id").cast("long").alias("page_id"))
        nothing = {"host": "string", "declared": "string", "text_lang": "string", "lang": "string", "confidence": "double"}
        return source.select("page_id", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    scratch, names = Scratch(spark, "language"), model.languages
    n = len(names)
    seen = scratch.keep(evidence(pages, model))
    mass = [F.sum(F.get("p", F.lit(i))) for i in range(n)]

    def level(df: DataFrame, keys: list[str], source: list[Column], tag: str) -> DataFrame:
        return df.groupBy(*keys).agg(*[s.alias(f"{tag}{i}") for i, s in enumerate(source)])

    # sums roll up: hosts from pages, domains from hosts, suffixes from domains
    hosts = scratch.keep(level(seen, ["host", "domain", "suffix"], mass, "h"))
    domains = scratch.keep(level(hosts, ["domain", "suffix"], [F.sum(f"h{i}") for i in range(n)], "d"))
    suffixes = scratch.keep(level(domains, ["suffix"], [F.sum(f"d{i}") for i in range(n)], "s"))
    total = suffixes.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)) for i in range(n)]).first()
    declared: dict[str, list[float]] = {x: [0.0] * n for x in (*names, "other", "none")}
    for r in seen.groupBy("declared").agg(*[m.alias(f"m{i}") for i, m in enumerate(mass)]).collect():  # at most n + 2 rows
        declared[r["declared"]] = [r[f"m{i}"] for i in range(n)]
    sums = hosts.join(domains, ["domain", "suffix"]).join(suffixes, "suffix")
    by_host = scratch.keep(sums.select("host", *[F.array(*[F.col(f"{tag}{i}") for i in range(n)]).alias(tag) for tag in "hds"]))
    joined = seen.join(by_host, "host")
    own = [F.get("p", F.lit(i)) for i in range(n)]

    def without(values: list[Column]) -> list[Column]:
        return [F.greatest(v - p, F.lit(0.0)) for v, p in zip(values, own, strict=True)]

    prior = [(x + 1.0) / (max(sum(total) - 1, 0.0) + n) for x in without([F.lit(x) for x in total])]
    for tag in "sdh":  # from the suffix to the host
        rest = without([F.get(tag, F.lit(i)) for i in range(n)])
        size = sum(rest, F.lit(LEVEL))
        prior = [(x + LEVEL * q) / size for x, q in zip(rest, prior, strict=True)]
    raw = []
    for i in range(n):
        of = sum(row[i] for row in declared.values())
        said = F.lit(0.0)
        for x, row in declared.items():
            said = F.when(F.col("declared") == x, F.lit(row[i])).otherwise(said)
        said = (F.greatest(said - own[i], F.lit(0.0)) + DECLARED) / (F.greatest(F.lit(of) - own[i], F.lit(0.0)) + DECLARED * len(declared))
        raw.append(F.greatest(own[i], F.lit(1e-12)) * said * prior[i])
    whole = sum(raw, F.lit(0.0))

    def first(values: list[Column]) -> Column:
        return F.array_max(F.array(*[F.struct(v.alias("v"), F.lit(-i).alias("place"), F.lit(x).alias("name")) for i, (x, v) in enumerate(zip(names, values, strict=True))]))

    return (
        joined.select("page_id", "host", "declared", first([F.get("p", F.lit(i)) for i in range(n)]).alias("t"), first([x / whole for x in raw]).alias("b"))
        .select("page_id", "host", "declared", F.col("t.name").alias("text_lang"), F.col("b.name").alias("lang"), F.col("b.v").alias("confidence"))
    )


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
