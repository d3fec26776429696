from __future__ import annotations

import random

import pytest

from tickloom.llm import decontam

from . import brute


def tables():
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 9, 14, 30, 60])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "two words"), (103, "Mixed CASE item of seven words here")]
    docs = [(None, "noise " * 9 + items[0][1]), (1, None), (2, ""), (3, "two words"), (4, "x two words y z a b"), (5, "mixed case\titem OF seven\nwords here and more")]
    for k in range(120):
        body = [word() for _ in range(rng.choice([3, 50, 400, 3000]))]
        if k % 2:
            item = rng.choice(items[:25])[1].split()
            cut = rng.choice([0, 1, 2, len(item) // 3])
            at = rng.randrange(len(body))
            body[at:at] = item[cut:]
        docs.append((10 + k, " ".join(body)))
    return docs + docs[-2:], items


@pytest.mark.parametrize(("limit", "bits"), [(-1, 22), (1 << 24, 22), (1 << 24, 6)])
def test_leaks_equal_brute_force(spark, docs_of, monkeypatch, limit, bits):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)  # shuffled and broadcast joins
    monkeypatch.setattr(decontam, "FILTER_BITS", bits)  # and bitmaps that let nearly everything through
    docs, items = tables()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in decontam.contaminated(docs_of(docs), bench).collect()}
    want = {(d, i): x[:2] for d, t in docs for i, s in items if (x := brute.contained(t, s))[2]}
    assert got == want and len(want) > 30


def test_many_items_one_very_long_and_one_popular(spark, docs_of):
    """Five thousand items, one of 20,000 words, one that every third document holds."""
    rng = random.Random(17)
    word = lambda: f"v{rng.randrange(50_000)}"
    items = [(i, " ".join(word() for _ in range(12))) for i in range(5000)] + [(9000, " ".join(word() for _ in range(20_000)))]
    docs = []
    for k in range(300):
        body = [word() for _ in range(40)]
        if k % 3 == 0:
            body += items[7][1].split()
        if k % 50 == 1:
            body += items[k][1].split()
        docs.append((k, " ".join(body)))
    docs.append((1000, "before it " + items[-1][1] + " after"))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs_of(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    sets = [(i, brute.shingles(t)) for i, t in items]
    want = {(d, i) for d, t in docs for a in [brute.shingles(t)] for i, b in sets if 10 * len(a & b) >= 8 * len(b)}
    assert got == want and len(got) > 106


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "z a b c d e f", 5, 6, "n"), (2, "clean", 7, 8, None)], "doc_id long, text string, row int, key long, name string")
    some = spark.createDataFrame([(1, "a b c d e f", 1)], "item_id long, text string, item int")
    got = decontam.drop_contaminated(docs, some)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(2, "clean", 7, 8, None)]


def test_clean_documents_stay(spark, docs_of):
    docs, items = tables()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs_of(docs)
    got = decontam.drop_contaminated(df, bench)
    assert got.columns == df.columns
    want = sorted(((d is not None, d or 0) for d, t in docs if not any(brute.contained(t, s)[2] for _, s in items)))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got.select("doc_id").collect()) == want


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.contaminated(docs_of([]), some).count() == 0
    assert decontam.contaminated(docs_of([(1, "a b c d e f")]), none).count() == 0
    assert decontam.drop_contaminated(docs_of([(1, "a b c d e f")]), none).count() == 1
    assert decontam.drop_contaminated(docs_of([(1, "z a b c d e f")]), some).count() == 0


def test_query_equals_sql(spark, duck, small):
    got = sorted(tuple(r) for r in decontam.op4_decontaminate(spark, small).collect())
    assert got == sorted(tuple(r) for r in duck.sql(decontam.OP4_SQL).fetchall()) and got
