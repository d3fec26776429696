from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tickloom.llm import quality

from . import brute

ROWS = [(1, None), (2, ""), (None, "a b c " * 40), (3, "same line\n" * 12 + "x " * 30), (4, "# * $ " * 30), (5, "w" * 60_000), (7, "".join(f"w{i} " * 5 for i in range(9))), (6, "long" * 9 + " " + ("abcdefghij" * 3 + " ") * 25)]


def rows():
    rng = random.Random(5)
    out = list(ROWS)
    for k in range(60):
        n = rng.choice([5, 19, 20, 40, 200])
        vocabulary = [f"w{i}" for i in range(rng.choice([2, 6, 300]))]
        out.append((10 + k, "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "\t", " | "]) for _ in range(n))))
    return out + out[8:11]


def test_features_equal_brute_force(docs_of):
    data = rows()
    got = quality.features(docs_of(data)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    key = lambda d, t: (d if d is not None else -1, t or "")
    want = sorted((key(d, t), tuple(brute.quality(t)[n] for n in names)) for d, t in data)
    assert sorted((key(r["doc_id"], r["text"]), tuple(r[n] for n in names)) for r in got) == want


def test_the_cascade_keeps_what_no_rule_rejects(docs_of):
    data = rows()
    df = docs_of(data)
    got = quality.keep_good(df)
    assert got.columns == df.columns
    want = sorted(d for d, t in data if brute.quality(t)["kept"])
    assert want and sorted(r["doc_id"] for r in got.select("doc_id").collect()) == want


def test_order_changes_no_verdict(docs_of, monkeypatch):
    df = docs_of(rows())
    kept = []
    for rules in (list(quality.RULES), list(reversed(quality.RULES))):
        monkeypatch.setattr(quality, "plan_cascade", lambda *_, rules=rules: rules)
        kept.append(sorted(r["doc_id"] for r in quality.keep_good(df).select("doc_id").collect()))
    assert kept[0] == kept[1]


def test_plan_orders_by_rejections_per_cost(docs_of):
    order = quality.plan_cascade(docs_of([(i, "word " * 5) for i in range(50)]))
    assert {r.name for r in order} == {r.name for r in quality.RULES}
    assert order.index(next(r for r in order if r.name == "few_words")) < order.index(next(r for r in order if r.name == "symbols"))


def test_order_is_greedy_and_conditional():
    """b rejects most, but all of them fall to the cheap a; c comes before it with fewer."""
    a, b, c, d = (quality.Rule(x, ("n_words",), "n_words < 1") for x in "abcd")
    patterns = {0b0011: 60, 0b0001: 10, 0b0100: 20, 0b0010: 5, 0: 100}
    assert quality.ordered([a, b, c, d], [1.0, 1.0, 1.0, 0.1], patterns) == [a, c, b, d]
    assert quality.ordered([a, b], [100.0, 1.0], patterns) == [b, a]


def test_a_rejected_document_pays_for_no_later_rule(docs_of, monkeypatch):
    """The second rule's feature can't be computed at all; documents that the first rejects never ask for it."""
    plain = quality._feature
    monkeypatch.setattr(quality, "_feature", lambda n, *of: F.raise_error(F.lit("computed")).cast("long") if n == "n_symbols" else plain(n, *of))
    first, second = quality.RULES[0], quality.RULES[2]
    assert second.name == "symbols"
    short = docs_of([(i, "a b c") for i in range(9)])
    monkeypatch.setattr(quality, "plan_cascade", lambda *_: [first, second])
    assert quality.keep_good(short).count() == 0
    monkeypatch.setattr(quality, "plan_cascade", lambda *_: [second, first])
    with pytest.raises(Exception, match="computed"):
        quality.keep_good(short).collect()
    # in the query the shown columns are there anyway; the others only where the base rules and earlier ones let through
    monkeypatch.setattr(quality, "_feature", lambda n, *of: F.raise_error(F.lit("computed")).cast("long") if n == "n_stutter" else plain(n, *of))
    assert not any(r["kept"] for r in quality.features(short).collect())
    with pytest.raises(Exception, match="computed"):
        quality.features(docs_of([(1, " ".join(f"w{i}" for i in range(40)))])).collect()


def test_sample_is_bounded_and_ignores_file_order(spark, docs_of):
    data = [(i, f"text {i} " * 30) for i in range(500)] + [(7, "same " * 9)] * 300
    ids = [sorted(r["doc_id"] for r in quality._sampled(docs_of(x), 50).collect()) for x in (data, data[::-1])]
    assert ids[0] == ids[1] and 0 < len(ids[0]) <= 50


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)), 5, "x", 6, 7)], "doc_id long, text string, n_words long, w string, row int, __text int")
    got = quality.keep_good(df)
    assert got.columns == df.columns and got.collect() == df.collect()
    assert quality.features(df).first()["n_words"] == 40


def test_empty_table(docs_of):
    assert quality.features(docs_of([])).count() == 0
    assert quality.keep_good(docs_of([])).count() == 0


def test_query_equals_brute_force(spark, small, small_texts):
    for r in quality.op10_quality_cascade(spark, small).collect():
        want = brute.quality(small_texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
