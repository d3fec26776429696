from __future__ import annotations

import math
import re
import time
from collections import Counter

import numpy as np

from tickloom.llm import language as lg

LABELLED = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog of that house with this", "en"), ("der hund und die katze mit dem haus von einer", "de"), ("le chat et la maison avec les chiens dans une", "fr")] * 12)]


def tables(spark, pages):
    docs = spark.createDataFrame(LABELLED, "doc_id long, text string, lang string")
    return spark.createDataFrame(pages, "page_id long, url string, html string, host int, p int"), docs


def test_text_decides_and_host_helps_where_text_is_silent(spark):
    pages = [(i, f"http://a.example.de/{i}", "<html lang=de><body><p>der hund und die katze mit dem haus</p>", 0, 0) for i in range(20)]
    pages += [(100, "http://a.example.de/x", "<p>12345</p>", 0, 0), (101, "http://b.example.de/x", None, 0, 0), (102, "http://a.example.de/y", "<html lang=de><p>the cat and the dog of that house with this and the house</p>", 0, 0)]
    pages += [(103, None, "<p>le chat et la maison avec les chiens</p>", 0, 0), (None, "no address", "<p>the dog and the cat</p>", 0, 0)]
    got = {r["page_id"]: r for r in lg.identify(*tables(spark, pages)).collect()}
    assert {got[i]["lang"] for i in range(20)} == {"de"}
    assert got[100]["lang"] == "de" and got[101]["lang"] == "de"  # by host and by domain
    assert got[102]["text_lang"] == "en" and got[102]["lang"] == "en"  # clear text beats host and markup
    assert got[103]["lang"] == "fr" and got[103]["host"] == ""
    assert got[None]["lang"] == "en"
    assert all(1 / 3 <= r["confidence"] <= 1 for r in got.values())


def brute_posteriors(texts):
    """Naive Bayes over letter trigrams of padded words, fitted to LABELLED, tempered to 60 letters."""
    counts = {}
    grams = lambda t: [f" {w} "[k : k + 3] for w in re.findall(r"[^\W\d_]+", t.lower()) for k in range(len(w))]
    for _, t, x in LABELLED:
        counts.setdefault(x, Counter()).update(grams(t))
    names = sorted(counts)
    kinds = len(set().union(*counts.values())) + 1
    out = []
    for t in texts:
        logs = np.array([sum(math.log((counts[x][g] + 0.5) / (counts[x].total() + 0.5 * kinds)) for g in grams(t)) for x in names], dtype=float)
        logs *= min(1.0, 60 / max(len(grams(t)), 1))
        p = np.exp(logs - logs.max())
        out.append(p / p.sum())
    return names, out


def brute(pages, texts, codes):
    """Sums over all other pages, level by level; pages: (id, url)."""
    names, p = brute_posteriors(texts)
    n = len(names)
    hosts = [(u or "").split("/")[2] if "//" in (u or "") else "" for _, u in pages]
    suffix = [".".join(h.split(".")[-2:]) if h.endswith(".co.uk") else h.split(".")[-1] for h in hosts]
    domain = [".".join(h.split(".")[-3:]) if h.endswith(".co.uk") else ".".join(h.split(".")[-2:]) for h in hosts]
    kinds, out = [*names, "other", "none"], {}
    for i, (page, _) in enumerate(pages):
        others = [j for j in range(len(pages)) if j != i]
        mass = lambda at: sum((p[j] for j in others if at[j] == at[i]), np.zeros(n))  # noqa: E731, B023
        prior = (sum((p[j] for j in others), np.zeros(n)) + 1) / (len(others) + n)
        for at in (suffix, domain, hosts):
            prior = (mass(at) + lg.LEVEL * prior) / (mass(at).sum() + lg.LEVEL)
        said = (mass(codes) + 1) / (sum((p[j] for j in others), np.zeros(n)) + len(kinds))
        q = np.maximum(p[i], 1e-12) * said * prior
        out[page] = (names[int(q.argmax())], q.max() / q.sum())
    return out


def test_fusion_equals_brute_force(spark):
    texts = ["the", "der", "q", "le chat"]
    hosts = ["a.x.example", "b.x.example", "shop.a.co.uk", "www.b.co.uk", "b.co.uk"]
    pages = [(i, f"http://{hosts[i % 5]}/{i}", f"<html lang={['en', 'de', 'zz'][i % 3]}><p>{texts[i % 4]}</p>", 0, 0) for i in range(40)]
    pages += [(100, None, "<p>der hund", 0, 0), (101, "http://alone.example.test/", "<meta http-equiv=Content-Language content=fr><p>12", 0, 0)]
    codes = [["en", "de", "other"][i % 3] for i in range(40)] + ["none", "fr"]
    got = {r["page_id"]: r for r in lg.identify(*tables(spark, pages)).collect()}
    want = brute([x[:2] for x in pages], [texts[i % 4] for i in range(40)] + ["der hund", "12"], codes)
    assert {i: r["lang"] for i, r in got.items()} == {i: x for i, (x, _) in want.items()}
    assert all(abs(got[i]["confidence"] - c) < 1e-9 for i, (_, c) in want.items())
    assert got[101]["declared"] == "fr"


def test_domains():
    assert [lg.parts_of(h) for h in ("a.b.example", "x.co.uk", "www.x.co.uk", "co.uk", "x.com", "")] == [
        ("b.example", "example"), ("x.co.uk", "co.uk"), ("x.co.uk", "co.uk"), ("co.uk", "uk"), ("x.com", "com"), ("", ""),
    ]


def test_broken_and_very_long_pages(spark):
    began = time.monotonic()
    for page in ("<html " * 170_000, "<meta " * 170_000, "<" * 1_000_000, "<html lang" * 100_000 + ">", "<a <b " * 150_000):
        assert lg.read_page(page, frozenset(["en"]))[1] in ("none", "other")
    assert time.monotonic() - began < 5
    pages = [(1, "http://a.example/", "<html lang=en><p>" + "der hund und die katze mit dem haus " * 30_000, 0, 0), (2, "http://b.example/", "<html " * 100_000, 0, 0)]
    got = {r["page_id"]: r["lang"] for r in lg.identify(*tables(spark, pages)).collect()}
    assert got[1] == "de" and got[2] in ("de", "en", "fr")


def test_ties_and_repeated_rows(spark):
    pages = [(7, "http://a.example/", "<p>12345", 0, 0)] * 3
    got = lg.identify(*tables(spark, pages)).collect()
    assert [(r["lang"], r["text_lang"]) for r in got] == [("de", "de")] * 3  # all equal: the first of the alphabet
    assert all(abs(r["confidence"] - 1 / 3) < 1e-9 for r in got)


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lg.fit(docs.where("doc_id % 2 = 0"))
    rows = docs.where("doc_id % 2 = 1").select("text", "lang").collect()
    hits = sum(model.languages[int(model.posterior(r["text"]).argmax())] == r["lang"] for r in rows)
    assert hits >= 0.98 * len(rows)


def test_query_agrees_with_the_markup(spark, small):
    got = lg.op1_language_id(spark, small).collect()
    assert sum(r["lang"] == r["declared"] for r in got) >= 0.98 * len(got) > 0


def test_empty_tables(spark):
    d, docs = tables(spark, [])
    assert lg.identify(d, docs).count() == 0
    some, _ = tables(spark, [(1, "http://a/b", "<p>x", 0, 0)])
    assert lg.identify(some, docs.limit(0)).first()["lang"] is None
