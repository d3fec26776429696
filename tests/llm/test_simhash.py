from __future__ import annotations

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import graph, simhash

from . import brute


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3))
def test_masks_cover_every_pair_within_the_radius(x, flips):
    y = x
    for f in set(flips):
        y ^= 1 << f
    assert any(x & m == y & m for m in simhash.covering_masks(3))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=" \t\nabAB é\x85\x1c", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute.fingerprint(text)


def near_copies():
    rng = random.Random(3)
    rows = [(None, "x y z"), (900, None), (901, ""), (902, " \n "), (903, "x y z"), (904, "X  Y z"), (905, "w" * 50_000)]
    for k in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(150)]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy)))
    return rows + rows[7:9]


def test_components_equal_brute_force(docs_of):
    rows = near_copies()
    got = simhash.near_duplicates(docs_of(rows)).collect()
    fps = [(d, brute.fingerprint(t)) for d, t in rows]
    want = sorted(((d if d is not None else -1, f, c) for (d, f), c in zip(fps, brute.components(fps), strict=True)))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fp"] % 2**64, r["component_id"]) for r in got) == want
    assert len({c for _, _, c in want}) < len(rows) - 20


def test_blocks_lose_no_link(spark):
    rng = random.Random(4)
    center = rng.getrandbits(64)
    fps = {center}
    while len(fps) < 150:  # one hot bucket: a chain of small steps
        x = rng.choice(sorted(fps))
        for _ in range(rng.randrange(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long")
    edges = simhash.links(df, simhash.Scratch(spark, "links"), block=16).collect()
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        a, b = e["u"] % 2**64, e["v"] % 2**64
        parent[find(a)] = find(b)
    ids = sorted(fps)
    want = brute.components(list(enumerate(ids)))
    assert len({find(x) for x in ids}) == len(set(want))


def test_one_of_each_component_stays(docs_of):
    rows = near_copies()
    df = docs_of(rows)
    got = simhash.drop_near_duplicates(df)
    assert got.columns == df.columns
    fps = [(d, brute.fingerprint(t)) for d, t in rows]
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == sorted(set(brute.components(fps)))


def test_empty_table(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    assert simhash.drop_near_duplicates(docs_of([])).count() == 0


def test_shared_folder(spark, monkeypatch):
    from tickloom.llm import common

    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")

    class Unset:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = spark.sparkContext

    first = common.shared_dir(Unset)
    assert first.startswith("file://") and common.shared_dir(Unset) == first


@pytest.mark.parametrize("most", [0, simhash.BROADCAST_BYTES])
def test_near_copies_beyond_the_fingerprints(spark, docs_of, monkeypatch, most):
    """Of pairs of every similarity, exactly those of five-word Jaccard 0.8 or more, or of near fingerprints, are linked,
    whether or not the candidates' names are broadcast."""
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", most)
    rng = random.Random(5)
    rows, kept, far = [], [], 0
    for k in range(60):
        a = [f"v{rng.randrange(5000)}" for _ in range(90)]
        b = list(a)
        for _ in range(1 + k % 4):
            b[rng.randrange(90)] = f"n{k}"
        texts = [" ".join(a), " ".join(b)]
        x, y = ({tuple(w[i : i + 5]) for i in range(86)} for w in (a, b))
        near = len(x & y) >= 0.8 * len(x | y)
        bits = (brute.fingerprint(texts[0]) ^ brute.fingerprint(texts[1])).bit_count()
        far += near and bits > 3
        rows += [(2 * k, texts[0]), (2 * k + 1, texts[1])]
        kept += [2 * k] if near or bits <= 3 else [2 * k, 2 * k + 1]
    assert far > 10 and len(kept) > 70
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        got = simhash.drop_near_duplicates(docs_of(rows + [(None, None), (1000, "")]), jaccard=0.8)
        assert sorted(r["doc_id"] for r in got.collect()) == [*kept, 1000]
    finally:
        spark.conf.set(limit, before)


def test_a_large_group_of_near_copies(docs_of, monkeypatch):
    """Many copies of one text with a few words changed, over several blocks, and texts of a common passage that are not
    alike: the forest joins just what brute force joins."""
    monkeypatch.setattr(simhash, "TEXTS", 32)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(150):
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(60)] = f"c{rng.randrange(30)}"
        rows.append((k, " ".join(copy)))
    for k in range(40):
        rows.append((1000 + k, " ".join([*base[:25], *(f"u{k}x{i}" for i in range(rng.randrange(4, 60)))])))
    rows += rows[3:6] + [(2000, None), (2001, ""), (2002, "w1 w2"), (2003, "w1  W2"), (2004, "long " * 30_000)]
    got = simhash.drop_near_duplicates(docs_of(rows), jaccard=0.8)
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == sorted(set(brute.near_components(rows)))


def test_texts_are_not_moved(spark, docs_of):
    """Where no join may broadcast, the step moves sketches of all texts and hashes of candidates, not the texts."""

    def moved():
        spark.range(1).count()
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        time.sleep(1)
        spark.range(1).count()
        context.listenerBus().waitUntilEmpty()
        all_ = context.statusStore().executorList(True)
        return sum(all_.apply(i).totalShuffleWrite() for i in range(all_.size()))

    rng = random.Random(6)
    rows = [(k, " ".join(f"{rng.getrandbits(64):x}" for _ in range(1000))) for k in range(400)]
    rows += [(1000 + k, f"{rows[k][1]} more") for k in range(15)] + [rows[20]]
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        docs = simhash.Scratch(spark, "texts").keep(docs_of(rows))
        start = moved()
        got = simhash.drop_near_duplicates(docs, jaccard=0.8).select("doc_id", "text").collect()
        assert sorted(map(tuple, got)) == sorted(rows[:400])
        assert moved() - start < 0.4 * sum(len(t) for _, t in rows)
    finally:
        spark.conf.set(limit, before)


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components_of_any_graph(spark, monkeypatch, tmp_path, few):
    """Small graphs are solved at once, others in rounds over tables, with the same labels."""
    monkeypatch.setattr(graph, "FEW", few)
    r = random.Random(8)
    low, high = -(2**63), 2**63 - 1
    path = [(i, i + 1) for i in range(100, 160)]
    r.shuffle(path)
    hub = [(7, r.randint(low, high)) for _ in range(50)]
    edges = [*path, *hub, *hub, (high, low), (3, 3), (None, 4), (5, None), *((r.randint(1000, 1200), r.randint(1000, 1200)) for _ in range(120))]
    parent = {x: x for u, v in edges if u is not None and v is not None and u != v for x in (u, v)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u in parent and v in parent and u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    got = graph.components(spark.createDataFrame(edges, "u long, v long"), simhash.Scratch(spark, "graph"))
    assert sorted(map(tuple, got.collect())) == sorted((x, root(x)) for x in parent)
    none = graph.components(spark.createDataFrame([], "u long, v long"), simhash.Scratch(spark, "graph"))
    assert none.columns == ["node", "label"] and not none.count()


def test_plans_stay_short(spark, docs_of):
    """Bitmaps of names don't stand in plans, which the driver writes out with each of their updates, and small graphs
    take no rounds of jobs."""
    words = [f"w{i}" for i in range(5000)]
    r = random.Random(9)
    rows = []
    for i in range(0, 1200, 2):
        text = r.sample(words, 40)
        rows += [(i, " ".join(text)), (i + 1, " ".join(text[:-1]) + " end")]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "")
    try:
        got = simhash.drop_near_duplicates(docs_of(rows), jaccard=0.8)
        assert len(got._jdf.queryExecution().toString()) < 200_000
        assert got.count() == 600
        assert len(tracker.getJobIdsForGroup("plans")) < 120
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
