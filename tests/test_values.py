"""Values of the queries that SQL can't express, by numpy, pandas or plain Python."""

from __future__ import annotations

import datetime as dt
import json
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import indicators, stats
from tickloom.plans.catalog import QUERIES
from tickloom.sources import tables
from tickloom.sources.panels import Panels
from tickloom.streaming import incremental


def cleaned(x: np.ndarray) -> np.ndarray:
    """Each column's residual on a constant and the cleaned columns before it, by projection."""
    out = x.astype(float).copy()
    for k in range(1, x.shape[1]):
        m = np.column_stack([np.ones(len(x)), out[:, :k]])
        out[:, k] = x[:, k] - m @ np.linalg.pinv(m) @ x[:, k]
    return out


def test_json_records(spark, small):
    want = {r["c_custkey"]: r for r in spark.read.parquet(f"{small}/customer.parquet").collect()}
    got = QUERIES["s8_json_records"](spark, small).collect()
    assert len(got) == len(want)
    for r in got:
        c = want[r["c_custkey"]]
        assert json.loads(r["detail"]) == {"c_name": c["c_name"], "c_acctbal": c["c_acctbal"]}
        assert json.loads(r["segments"]) == [c["c_mktsegment"]]


def test_article_texts(spark, small):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in QUERIES["f6_article_text"](spark, small).collect()}
    assert got.keys() == pages.keys()
    import html

    squeezed = lambda t: re.sub(r"\s+", "", t)
    for k, page in pages.items():
        article = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
        article = re.sub(r"<(script|style)\b.*?</\1>|<!--.*?-->", "", article, flags=re.S)
        value = next(v for c, v in got[k].asDict().items() if c != "page_id")
        assert squeezed(value) == squeezed(html.unescape(re.sub(r"<[^>]*>", "", article)))


def test_cascade_of_every_symbol(spark, small):
    columns = ["discount", "tax", "quantity"]
    raw = Panels(spark, small).metrics.select("symbol", "date", *columns).toPandas().dropna()
    got = QUERIES["l2_cascade"](spark, small).toPandas()
    checked = 0
    for symbol, part in raw.groupby("symbol"):
        part = part.sort_values("date")
        if len(part) < 8:
            continue
        mine = got[got["symbol"] == symbol].sort_values("date")
        mine = mine[mine["date"].isin(part["date"])]
        assert np.allclose(mine[columns].to_numpy(float), cleaned(part[columns].to_numpy(float)), atol=1e-8)
        checked += 1
    assert checked > 5


def test_macro_factors(spark):
    """Six shocks, cleaned in order; a component's sign is a convention."""
    folder = "/root/testdata/sf0.01"  # the smallest scale has no day with all tenors
    p = Panels(spark, folder)
    wide = p.px_day.groupBy("date").pivot("symbol").agg(F.first("close")).join(p.bench_day, "date").toPandas().sort_values("date").reset_index(drop=True)
    tenors = sorted(c for c in wide.columns if c not in ("date", "bench"))
    full = wide.dropna(subset=tenors).reset_index(drop=True)
    moved = full[tenors].astype(float).diff().iloc[1:]
    x = moved.to_numpy() - moved.to_numpy().mean(0)
    scores = x @ np.linalg.svd(x, full_matrices=False)[2][:3].T
    series = wide.assign(market=wide["bench"].astype(float) - 1.0, credit=(wide[tenors[4]] - wide[tenors[0]]).astype(float), inflation=wide[tenors[2]].astype(float))
    series["credit"], series["inflation"] = series["credit"].diff(), series["inflation"].diff()
    table = pd.DataFrame(scores, columns=["level", "slope", "curvature"]).assign(date=full["date"].iloc[1:].to_numpy())
    table = table.merge(series[["date", "market", "credit", "inflation"]], on="date").sort_values("date").dropna()
    names = ["market", "level", "slope", "curvature", "credit", "inflation"]
    want = cleaned(table[names].to_numpy(float))
    got = QUERIES["l5_macro_factors"](spark, folder).toPandas().sort_values("date").dropna()
    assert len(got) == len(want) > 100
    for k, name in enumerate(names):
        a, b = got[name].to_numpy(float), want[:, k]
        assert np.allclose(a, b, atol=1e-6 * np.abs(b).max()) or (name in names[1:4] and np.allclose(a, -b, atol=1e-6 * np.abs(b).max())), name


def test_rolling_betas_by_formula(spark, small):
    """The first factor's slope is the simple regression's, the second's that of the regression on both."""
    got = QUERIES["w30_rolling_betas"](spark, small).toPandas().dropna()
    assert len(got) > 50
    p = Panels(spark, small)
    bench = p.bench_day.toPandas().sort_values("date")
    bench["b"] = bench["bench"].astype(float).pct_change(fill_method=None)
    px = p.px_day.toPandas().merge(bench, on="date").sort_values(["symbol", "date"])
    symbol = got["symbol"].iloc[0]
    part = px[px["symbol"] == symbol].reset_index(drop=True)
    part["r"] = part["close"].astype(float).pct_change(fill_method=None)
    part["b1"] = part["b"].shift(1)
    part = part.dropna(subset=["r", "b", "b1"]).reset_index(drop=True)
    mine = got[got["symbol"] == symbol].set_index("date")
    checked = 0
    for i in range(59, len(part), 37):
        w = part.iloc[i - 59 : i + 1]
        if part["date"][i] in mine.index:
            simple = np.cov(w["r"], w["b"])[0, 1] / w["b"].var()
            both = np.linalg.lstsq(np.column_stack([np.ones(60), w["b"], w["b1"]]), w["r"], rcond=None)[0][2]
            row = mine.loc[part["date"][i]]
            assert (row["beta_b"], row["beta_b1"]) == (pytest.approx(simple, abs=1e-9), pytest.approx(both, abs=1e-9))
            checked += 1
    assert checked > 3


def test_all_indicators_equal_pandas(spark, small):
    got = QUERIES["w8_all_indicators"](spark, small).toPandas().sort_values(["symbol", "date"])
    px = Panels(spark, small).px_month.toPandas().sort_values(["symbol", "date"])
    assert len(got) == len(px)
    for symbol, part in px.groupby("symbol"):
        c = part["close"].astype(float).reset_index(drop=True)
        mine = got[got["symbol"] == symbol].reset_index(drop=True)
        line = c.ewm(span=12, adjust=False, min_periods=12).mean() - c.ewm(span=26, adjust=False, min_periods=26).mean()
        for name, want in {"sma_20": c.rolling(20).mean(), "sma_50": c.rolling(50).mean(), "ema_12": c.ewm(span=12, adjust=True, min_periods=12).mean(), "macd": line}.items():
            assert np.allclose(mine[name].astype(float), want, equal_nan=True), name


def brute_kalman(y, x, rounds):
    """The same model by conditioning one joint normal distribution of all states, without recursions."""
    n = len(y)
    h = np.zeros((n, 2 * n))
    for i in range(n):
        h[i, 2 * i : 2 * i + 2] = 1.0, x[i]
    q, r, m0, p0 = np.eye(2) * 1e-5, 1.0, np.zeros(2), np.eye(2)

    def given(k):
        """Mean and covariance of all states given the first k observations."""
        cov = np.block([[p0 + min(i, j) * q for j in range(n)] for i in range(n)])
        mean = np.tile(m0, n)
        gain = cov @ h[:k].T @ np.linalg.inv(h[:k] @ cov @ h[:k].T + r * np.eye(k))
        return mean + gain @ (y[:k] - h[:k] @ mean), cov - gain @ h[:k] @ cov

    for _ in range(rounds):
        filtered = np.array([given(i + 1)[0][2 * i : 2 * i + 2] for i in range(n)])
        m, c = given(n)
        block = lambda i, j: c[2 * i : 2 * i + 2, 2 * j : 2 * j + 2]  # noqa: E731, B023
        s = m.reshape(n, 2)
        r = float(np.mean([(y[i] - h[i, 2 * i : 2 * i + 2] @ s[i]) ** 2 + h[i, 2 * i : 2 * i + 2] @ block(i, i) @ h[i, 2 * i : 2 * i + 2] for i in range(n)]))
        q = sum(np.outer(s[i] - s[i - 1], s[i] - s[i - 1]) + block(i, i) + block(i - 1, i - 1) - block(i, i - 1) - block(i - 1, i) for i in range(1, n)) / (n - 1)
        q = (q + q.T) / 2 + np.eye(2) * 1e-12
        m0, p0 = s[0], block(0, 0)
    return filtered


def test_kalman_beta_equals_joint_conditioning(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=14)
    y = 0.3 + np.linspace(0.5, 1.5, 14) * x + 0.1 * rng.normal(size=14)
    d0 = dt.date(2024, 1, 1)
    d = spark.createDataFrame([("a", d0 + dt.timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate(zip(y, x, strict=True))], "symbol string, date date, y double, x double")
    got = indicators.kalman_beta(d, "y", "x", 3).toPandas().sort_values("date")
    assert np.allclose(got[["alpha", "beta"]].to_numpy(float), brute_kalman(y, x, 3), atol=1e-6)


# aggregates without a single task


@pytest.mark.parametrize("kinds", [3, 40, 100_000])
def test_top_share_and_overall_rank(spark, kinds):
    rng = random.Random(kinds)
    rows = [(i, float(rng.randrange(kinds))) for i in range(3000)] + [(9000 + i, None) for i in range(5)]
    d = spark.createDataFrame(rows, "k long, v double")
    best = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0]))[:600]
    assert sorted(r["k"] for r in stats.top_share(d, "v", 0.2, "k").collect()) == sorted(k for k, _ in best)
    want = pd.Series([v for _, v in rows], dtype=float).rank()
    got = {r["k"]: r["rank"] for r in stats.overall_rank(d, "v", "rank", buckets=7).collect()}
    assert [got[k] for k, _ in rows] == [None if np.isnan(w) else w for w in want]


def test_no_rows_no_share(spark):
    d = spark.createDataFrame([], "k long, v double")
    assert stats.top_share(d, "v", 0.2, "k").count() == 0 and stats.spearman(d.withColumn("w", F.col("v")), "v", "w").first()[0] is None


# streams and statements


def test_streams_go_on_after_a_restart(spark, tmp_path):
    """A second run under the same path reads only new files, remembers keys, and keeps what was there."""
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema = "link string, date date, value int, seq long"
    day = dt.date(2024, 1, 1)

    def arrive(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{name}")

    def run():
        stream = lambda: incremental.file_stream(spark, f"{source}/*", spark.createDataFrame([], schema).schema)
        items = incremental.run_to_table(incremental.new_items(stream(), "link"), f"{out}/items")
        series = incremental.Series(spark, f"{out}/series", spark.createDataFrame([], schema).schema, ["link", "date"])
        series.run(stream())
        return sorted(r["link"] for r in items.collect()), sorted((r["link"], r["value"]) for r in series.now().collect())

    arrive("1", [("a", day, 1, 1), ("b", day, 1, 1), ("a", day, 2, 2)])
    assert run() == (["a", "b"], [("a", 2), ("b", 1)])
    written = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("out/**/part-*")}
    assert run() == (["a", "b"], [("a", 2), ("b", 1)])  # nothing is new
    assert {f: f.stat().st_mtime_ns for f in tmp_path.rglob("out/**/part-*")} == written
    arrive("2", [("b", day, 7, 5), ("c", day, 3, 1), ("a", day, 0, 0)])
    assert run() == (["a", "b", "c"], [("a", 2), ("b", 7), ("c", 3)])
    assert all(f.stat().st_mtime_ns == t for f, t in written.items())  # and nothing old is written again


def test_live_entries(spark):
    now = dt.datetime(2024, 1, 10)
    rows = [(k, now - dt.timedelta(hours=h)) for k, h in enumerate([1, 30, 5, 47, 48, 100, 5])]
    d = spark.createDataFrame(rows, "key int, stored_at timestamp")
    assert [r["key"] for r in tables.live_entries(d, now, 48 * 3600, 3).collect()] == [0, 2, 6]
    assert tables.live_entries(d, now, 48 * 3600, 100).count() == 5


def test_a_cluster_has_to_name_a_shared_folder(spark):
    class Unset:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="checkpoint"):
        tables.work_dir(Unset, "x")
    Unset.sparkContext = spark.sparkContext
    assert tables.work_dir(Unset, "x").startswith("file://")
