"""Fixed numbers, edge cases and cross-checks with pandas and numpy."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from tickloom.functions import columns as cn
from tickloom.functions import dates
from tickloom.operators import cleaning, crosssection, fundamentals, indicators, joins, linear, portfolio, returns, stats, text
from tickloom.sources import feeds, tables

D0 = dt.date(2024, 1, 1)


def W():
    return cn.by("symbol", order="date")


def series(spark, values, symbol="A"):
    rows = [(symbol, D0 + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, date date, close double")


def column(df, c):
    return [r[c] for r in df.orderBy("date").collect()]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


# per-symbol indicators


def test_sma_needs_full_windows(spark):
    assert column(series(spark, [1, 2, None, 4, 5, 6]).withColumn("x", indicators.sma("close", W(), 2)), "x") == [None, 1.5, None, None, 4.5, 5.5]


@pytest.mark.parametrize("adjust", [True, False])
def test_ema_equals_pandas(spark, adjust):
    v = [1, 2, None, 4, 5, None, 7, 8, 9, 10]
    got = column(indicators.ema(series(spark, v), "close", 3, adjust), "ema")
    want = pd.Series(v, dtype=float).ewm(span=3, adjust=adjust).mean().tolist()
    assert np.allclose(got, want, atol=1e-12)


def test_flat_series_has_rsi_100(spark):
    got = column(indicators.rsi(series(spark, [5] * 6), period=3), "rsi")
    assert got[3:] == [100.0] * 3
    assert all(x is None or math.isnan(x) for x in got[:3])


def test_rsi_stays_in_range(spark):
    rng = np.random.default_rng(1)
    got = column(indicators.rsi(series(spark, 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 60))))), "rsi")[14:]
    assert all(0 <= x <= 100 for x in got)


def test_macd_is_line_minus_signal(spark):
    rng = np.random.default_rng(2)
    d = indicators.macd(series(spark, 100 + np.cumsum(rng.normal(size=60)))).toPandas().dropna()
    assert np.allclose(d["histogram"], d["macd"] - d["signal"])
    assert len(d) == 60 - 33


def test_bands_surround_the_mean(spark):
    up, mid, low = indicators.bollinger("close", W(), 4)
    d = series(spark, [1, 3, 2, 5, 4, 6]).select("date", up.alias("u"), mid.alias("m"), low.alias("l")).dropna().collect()
    assert d and all(r["l"] <= r["m"] <= r["u"] for r in d)


def test_padded_and_unpadded_change(spark):
    d = series(spark, [100, None, 110])
    assert column(d.withColumn("x", cn.change("close", 1, W())), "x") == [None, None, None]
    d = d.withColumn("padded", cn.filled("close", W()))
    assert np.allclose(column(d.withColumn("x", cn.change("padded", 1, W())), "x")[1:], [0.0, 0.1])


def test_zero_start_has_no_momentum(spark):
    d = series(spark, [0, 1, 2, 3]).withColumn("x", indicators.momentum("close", W(), 2, 1))
    assert column(d, "x") == [None, None, None, 1.0]


def test_cagr_needs_a_positive_start(spark):
    d = series(spark, [-1, 4, 2, 16]).withColumn("x", indicators.cagr("close", W(), 2, per_year=1))
    assert column(d, "x") == [None, None, None, 1.0]


def test_rolling_beta_of_a_multiple(spark):
    rng = np.random.default_rng(3)
    b = rng.normal(size=30)
    rows = [("A", D0 + dt.timedelta(days=i), float(2 * x), float(x)) for i, x in enumerate(b)]
    d = spark.createDataFrame(rows, "symbol string, date date, y double, b double").withColumn("x", indicators.rolling_beta("y", "b", W(), 10, 5))
    assert np.allclose([x for x in column(d, "x") if x is not None], 2.0)


def test_kalman_finds_a_constant_slope(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=200)
    rows = [("A", D0 + dt.timedelta(days=i), float(1.5 * v + 0.01 * rng.normal()), float(v)) for i, v in enumerate(x)]
    d = indicators.kalman_beta(spark.createDataFrame(rows, "symbol string, date date, y double, x double"), "y", "x")
    assert abs(column(d, "beta")[-1] - 1.5) < 0.05


def test_lag_slope_of_a_line(spark):
    assert np.allclose([x for x in column(returns.lag_slope(series(spark, [1, 3, 5, 7, 9]), "close", 3), "slope") if x is not None], 2.0)


def test_densify_has_every_pair(spark):
    d = series(spark, [1, 2]).unionByName(series(spark, [3], "B"))
    assert indicators.densify(d, d.select("date").distinct()).count() == 4


def test_short_series_has_no_signal(spark):
    d = returns.signals(series(spark, [1, 2, 3]), 2, 4, 1, period=3)
    assert column(d, "trend") == [None] * 3
    assert column(d, "rsi_signal") == [0.0] * 3
    d = returns.signals(series(spark, [5, 4, 3, 2, 1, 9]), 2, 3, 2, period=2)
    assert column(d, "trend") == [0.0, 0.0, -1.0, -1.0, -1.0, 1.0]
    assert column(d, "rsi_signal")[2:] == [1.0, 1.0, 1.0, -1.0]


# cross-section


def cross(spark, values):
    return spark.createDataFrame([(D0, i, None if v is None else float(v)) for i, v in enumerate(values)], "date date, symbol int, x double")


def test_robust_zscore_golden(spark):
    d = crosssection.zscore(cross(spark, range(1, 11)), "x", ["date"], "z")
    got = [r["z"] for r in d.orderBy("symbol").collect()]
    assert np.allclose(got, (np.arange(1, 11) - 5.5) / (2.5 * 1.4826), atol=1e-10)


def test_constant_group_has_no_zscore(spark):
    d = crosssection.zscore(cross(spark, [3] * 8), "x", ["date"], "z")
    assert {r["z"] for r in d.collect()} == {None}


@pytest.mark.parametrize(
    ("values", "want"),
    [([1, 2, 2, 2, 2, 2, 3, 4, 5, 100], [1, 1, 1, 1, 1, 1, 3, 3, 4, 4]), ([1, 2, 3, 4, 5, 6, 7], [1, 1, 2, 3, 4, 5, 5]), ([7, 7, 7], [None] * 3)],
)
def test_quantile_bins(spark, values, want):
    d = cross(spark, values).withColumn("b", cn.quantile_bins("x", 5, "date"))
    assert [r["b"] for r in d.orderBy("symbol").collect()] == want


@settings(max_examples=8, deadline=None)
@given(st_.lists(st_.integers(0, 12), min_size=3, max_size=40))
def test_quantile_bins_equal_pandas(spark, values):
    d = cross(spark, values).withColumn("b", cn.quantile_bins("x", 5, "date"))
    got = [r["b"] for r in d.orderBy("symbol").collect()]
    s = pd.Series(values, dtype=float)
    edges = s.quantile(np.linspace(0, 1, 6)).unique()
    want = [None] * len(s) if len(edges) < 2 else [int(x) + 1 for x in pd.qcut(s, 5, labels=False, duplicates="drop")]
    assert got == want
    whole = cross(spark, values).withColumn("b", cn.quantile_bins("x", 5, "date", whole=True))
    assert [r["b"] for r in whole.orderBy("symbol").collect()] == (want if len(edges) == 6 else [None] * len(s))


def test_percent_rank_averages_ties(spark):
    d = cross(spark, [3, 1, 3, None]).withColumn("p", cn.percent_rank_average("x", "date"))
    assert [r["p"] for r in d.orderBy("symbol").collect()] == [pytest.approx(2.5 / 3), pytest.approx(1 / 3), pytest.approx(2.5 / 3), None]


def test_binned_equals_window_form(spark):
    d = cross(spark, [4, 4, 1, 9, 2, 2, 8, 7])
    a = crosssection.binned(d, "x", 4, ["date"]).orderBy("symbol").collect()
    b = d.withColumn("bin", cn.quantile_bins("x", 4, "date")).orderBy("symbol").collect()
    assert [r["bin"] for r in a] == [r["bin"] for r in b]


def test_transition_labels(spark):
    def label(*ranks):
        return one(spark, crosssection.transition_label([F.lit(r).cast("string") for r in ranks], ["rank1"], ["rank5"]))

    assert label("rank1", "rank1") == "remain high"
    assert label("rank5", "rank5") == "remain low"
    assert label("rank5", "rank1") == "move to high"
    assert label("rank1", "rank5") == "drop to low"
    assert label("rank2", "rank3") == "others"
    assert label("rank2", None) is None


def test_missing_metric_has_no_composite(spark):
    d = cross(spark, [1, 2, 3, None]).withColumn("y", F.col("symbol") * 1.0)
    got = crosssection.composite(d, {"x": (0.5, False), "y": (0.5, True)}, ["date"]).orderBy("symbol").collect()
    assert got[3]["score"] is None and got[0]["score"] is not None


# statistics


def test_shape_is_bias_corrected(spark):
    v = [1, 1.5, 2, 2.5, 3, 3.5, 4, 10, 15, 20]
    r = series(spark, v).agg(cn.skewness("close").alias("s"), cn.kurtosis("close").alias("k")).first()
    assert (r["s"], r["k"]) == (pytest.approx(pd.Series(v).skew()), pytest.approx(pd.Series(v).kurt()))


def test_percent_below_is_strict(spark):
    assert series(spark, [1, 2, 3, 4, 5]).agg(stats.percent_below("close", 3.0).alias("x")).first()["x"] == pytest.approx(40.0)


def test_risk_without_spread(spark):
    r = series(spark, [0.01, 0.01, 0.01]).agg(stats.sharpe("close").alias("s"), stats.sortino("close").alias("t"), stats.downside_deviation("close").alias("d"), stats.volatility("close").alias("v")).first()
    assert (r["s"], r["t"], r["d"], r["v"]) == (float("inf"), float("inf"), 0.0, 0.0)
    r = series(spark, [0.0, 0.0]).agg(stats.sharpe("close").alias("s")).first()
    assert r["s"] is None


def test_drawdown_ignores_an_initial_loss(spark):
    d = stats.drawdowns(series(spark, [-0.5, 0.1, -0.2]), "close", ["symbol"])
    assert np.allclose(column(d, "drawdown"), [0, 0, -0.2])


def test_drawdown_with_a_total_loss(spark):
    d = stats.drawdowns(series(spark, [0.1, -1.0, 0.5]), "close", ["symbol"])
    assert np.allclose(column(d, "drawdown"), [0, -1, -1])


def test_kendall_of_opposites(spark):
    d = series(spark, [1, 2, 3, 4]).withColumn("o", -F.col("close"))
    assert stats.kendall(d, "close", "o", "date").first()["tau"] == -1.0


def test_student_p_value():
    assert stats.student_p_value(2.0, 10) == pytest.approx(0.07338803477074039, abs=1e-10)
    assert stats.student_p_value(0.0, 5) == pytest.approx(1.0)


@settings(max_examples=6, deadline=None)
@given(st_.lists(st_.floats(-0.5, 0.5, allow_subnormal=False), min_size=3, max_size=40), st_.floats(0.5, 4))
def test_volatility_scales(spark, r, k):
    d = series(spark, r)
    a = d.agg(stats.volatility("close").alias("v")).first()["v"]
    b = d.agg(stats.volatility(F.col("close") * k).alias("v")).first()["v"]
    assert a >= 0
    assert b == pytest.approx(a * k, rel=1e-6, abs=1e-9)


def test_ic_needs_five_symbols(spark):
    rows = [(D0, i, float(i), float(i * i)) for i in range(4)] + [(D0 + dt.timedelta(days=1), i, float(i), float(-i)) for i in range(6)]
    d = spark.createDataFrame(rows, "date date, symbol int, f double, r double")
    assert column(stats.ic_series(d, "f", "r"), "ic") == [None, -1.0]


def test_claim_scores(spark):
    rows = [("A", 0.8, "cagr_connection", ["rule_11"]), ("A", 0.5, "other", ["rule_6"]), ("B", 0.6, "cagr_connection", [])]
    d = stats.claim_scores(spark.createDataFrame(rows, "ticker string, confidence double, claim_type string, rules array<string>")).orderBy("ticker").collect()
    assert d[0]["score"] == pytest.approx((2 * 0.88 + 1.5 * 0.5) / 3.5)
    assert d[0]["structural"] == 1.0
    assert d[1]["score"] == pytest.approx(0.54)


# portfolio and regression


def test_sector_counts_by_largest_remainder(spark):
    stocks = spark.createDataFrame([(i, "ABC"[i % 3], 1.0) for i in range(9)], "symbol int, sector string, score double")
    bench = spark.createDataFrame([("A", 0.40), ("B", 0.35), ("C", 0.25), ("D", 0.0)], "sector string, weight double")
    got = {r["sector"]: r["n"] for r in portfolio.sector_counts(stocks, bench, 5).collect()}
    assert got == {"A": 2, "B": 2, "C": 1}
    weights = portfolio.build(stocks, bench, 5).toPandas()
    assert weights["weight"].sum() == pytest.approx(1.0) and len(weights) == 5


def test_drift_without_target(spark):
    d, pct, flag = portfolio.drift(F.lit(0.1), F.lit(0.0))
    assert (one(spark, d), one(spark, pct), one(spark, flag)) == (0.1, float("inf"), True)


def test_residuals_are_orthogonal(spark):
    rng = np.random.default_rng(42)
    x, e = rng.normal(size=50), rng.normal(size=50)
    rows = [(1, D0 + dt.timedelta(days=i), float(a), float(0.5 * a + 0.5 * b), float(b + a * a)) for i, (a, b) in enumerate(zip(x, e, strict=True))]
    d = spark.createDataFrame(rows, "k int, date date, x double, y double, z double")
    r = linear.residual(d, "y", "x", ["k"]).toPandas()
    assert abs(r["residual"] @ r["x"]) < 1e-9 and abs(r["residual"].sum()) < 1e-9
    r = linear.residuals(d, "z", ["x", "y"], ["k"], "k int").toPandas().sort_values("date")
    assert abs(r["residual"].to_numpy() @ x) < 1e-9
    c = linear.cascade(d, ["x", "y", "z"], ["k"], "k int").toPandas()
    assert abs(c["x"] @ c["y"]) < 1e-9 and abs(c["y"] @ c["z"]) < 1e-9


def test_principal_components_equal_numpy(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(80, 1)) @ np.ones((1, 5)) + 0.3 * rng.normal(size=(80, 5))
    names = [f"t{i}" for i in range(5)]
    d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "i int, " + ", ".join(f"{n} double" for n in names))
    pca = linear.Components(d, names, 3)
    values = np.sort(np.linalg.eigvalsh(np.cov(m.T)))[::-1]
    assert np.allclose(pca.explained, values[:3] / values.sum())
    scores = d.select(*pca.transform(["a", "b", "c"])).toPandas()
    assert abs(scores["a"].mean()) < 1e-9 and pca.loadings[0].sum() > 0
    assert np.allclose(scores.var(), values[:3])


def test_rolling_betas_of_an_exact_model(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 2))
    rows = [("A", D0 + dt.timedelta(days=i), float(a), float(b), float(2 * a)) for i, (a, b) in enumerate(x)]
    d = spark.createDataFrame(rows, "symbol string, date date, f double, g double, y double")
    got = linear.rolling_betas(d, "y", ["f", "g"], 20, "string").toPandas().dropna()
    assert len(got) == 21 and np.allclose(got["beta_f"], 2.0) and np.allclose(got["beta_g"], 0.0, atol=1e-9)


# text, dates, cleaning


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://www.cnbc.com/article/", "https://cnbc.com/article"),
        ("https://example.com/news?utm_source=twitter&page=1", "https://example.com/news?page=1"),
        ("https://example.com/article#comments", "https://example.com/article"),
        ("https://example.com/news/index.html", "https://example.com/news"),
        ("https://Example.com/a/#x", "https://example.com/a/"),
        ("https://e.com/a?blank=&k=1&ref=z", "https://e.com/a?k=1"),
        ("https://e.com/a?q=a%20b+c&x=%e9%C3%a9&t=~*&k=100%&q=2", "https://e.com/a?q=a+b+c&q=2&x=%EF%BF%BD%C3%A9&t=~%2A&k=100%25"),
        ("", ""),
    ],
)
def test_normalise_url(spark, url, want):
    assert one(spark, text.normalise_url(F.lit(url))) == want


def test_title_similarity(spark):
    assert one(spark, text.title_similarity(F.lit("A b c"), F.lit("a B d"))) == 0.5
    assert one(spark, text.title_similarity(F.lit(""), F.lit("a"))) == 0.0


def test_first_category_wins(spark):
    r = one(spark, text.categorise(F.lit("Fed lifts NASDAQ and Apple")))
    assert (r["category"], r["confidence"]) == ("index", 0.25)
    assert one(spark, text.categorise(F.lit("nothing here")))["category"] == "other"


@pytest.mark.parametrize(("ticker", "want"), [("AAPL UW Equity", "AAPL"), ("7203 JT Equity", "7203.T"), ("ABC ZZ Equity", "ABC ZZ Equity"), ("X", "X"), ("BRK/B UN Equity", "BRK-B")])
def test_tickers(spark, ticker, want):
    assert one(spark, text.convert_ticker(F.lit(ticker), {"BRK/B UN Equity": "BRK-B"})) == want


def test_paywall_thresholds(spark):
    assert one(spark, text.paywalled(F.lit("Subscribe to continue")))
    assert not one(spark, text.paywalled(F.lit("paywall " + "x" * 300)))
    assert one(spark, text.paywalled(F.lit("paywall, members only " + "x" * 300)))


def test_five_forces(spark):
    low, mid, high = (F.lit(x) for x in ("low", "medium", "high"))
    assert one(spark, text.five_forces(low, high, low, mid, low)) == "medium"
    assert one(spark, text.five_forces(high, high, low, low, low)) == "low"


def test_transcript_sections_and_period(spark):
    s = one(spark, text.transcript_sections(F.lit("<q Ann>Hi - ---</q><a Bob> </a><a Bob>Yes</a>")))
    assert [(x["kind"], x["speaker"], x["content"]) for x in s] == [("q", "Ann", "Hi"), ("a", "Bob", "Yes")]
    assert one(spark, text.fiscal_period(F.lit("The Q3 2021 call"), F.lit(0), F.lit(0))) == "Q3 2021"
    assert one(spark, text.fiscal_period(F.lit("call"), F.lit(2022), F.lit(11))) == "Q4 2022"


def test_tuesdays(spark):
    for day in range(1, 15):
        d = dt.date(2024, 5, day)
        got = one(spark, dates.previous_tuesday(F.lit(d)))
        assert got.weekday() == 1 and 0 <= (d - got).days < 7


@pytest.mark.parametrize(("written", "want"), [("2024-02-03", dt.date(2024, 2, 3)), ("20240203", dt.date(2024, 2, 3)), ("02/03/2024", dt.date(2024, 2, 3)), ("2024-02-30", None), ("soon", None)])
def test_parse_dates(spark, written, want):
    assert one(spark, dates.parse(F.lit(written))) == want


@pytest.mark.parametrize(("raw", "want"), [("$1,234.5", 1234.5), (" 12% ", 12.0), ("N/A", None), ("", None), ("abc", None), ("inf", None), ("NaN", None)])
def test_clean_numbers(spark, raw, want):
    assert one(spark, cleaning.clean_number(F.lit(raw))) == want


def test_adjusted_close_only_without_close(spark):
    d = spark.createDataFrame([(1.0, 2.0)], "Close double, `Adj Close` double")
    assert cleaning.normalise_ohlcv(d).first()["close"] == 1.0
    assert cleaning.normalise_ohlcv(d.drop("Close")).first()["close"] == 2.0


def test_similar_titles_equal_all_pairs(spark):
    titles = ["a b c d e f", "a b c d e g", "a b c d e f x", "q", "", "a b c d e f"]
    rows = [(i, f"http://x/{i}", t) for i, t in enumerate(titles)]
    d = spark.createDataFrame(rows, "item_id long, link string, title string")
    got = {r["item_id"]: r["first"] for r in joins.first_similar(d, d, 0.7).collect()}
    sets = [set(t.split()) for t in titles]
    want = {}
    for i, a in enumerate(sets):
        want[i] = min(j for j, b in enumerate(sets) if i == j or (a and b and len(a & b) / len(a | b) >= 0.7))
    assert got == want


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, seq long")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert [tuple(r) for r in tables.insert_absent(old, new, ["k"], "seq").collect()] == [(3, "z", 1)]


def test_feeds(spark):
    rss = "<rss><channel><item><guid>1</guid><title>T</title><link>http://x</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>2</id><link href="http://y"/><updated>2024-01-03T00:00:00Z</updated></entry></feed>'
    d = spark.createDataFrame([("a", rss), ("b", atom), ("c", "<broken"), ("d", None)], "feed_id string, xml string")
    got = feeds.feed_items(d).withColumn("at", feeds.published("published")).orderBy("feed_id").collect()
    assert [(r["item_id"], r["link"], r["at"]) for r in got] == [("1", "http://x", dt.datetime(2024, 1, 2, 10)), ("2", "http://y", dt.datetime(2024, 1, 3))]


def test_json_with_trailing_commas(spark):
    d = spark.createDataFrame([(1, '[{"a": 1,}, {"a": 2},]')], "k int, t string")
    assert [r["a"] for r in feeds.json_records(d, "t", "a int").orderBy("a").collect()] == [1, 2]


def test_regimes_need_history(spark):
    d = fundamentals.regimes(series(spark, [1, 2, 3, 0]).select("date", "close"), "close", 2)
    assert column(d, "regime") == ["Unknown", "Unknown", "High & Rising", "Low & Falling"]
    assert column(d, "trend") == ["Falling", "Rising", "Rising", "Falling"]


def test_registry_and_chain(spark):
    from tickloom.operators.plugins import FACTORS, Chain, Registry

    assert FACTORS.named("price") == ["momentum_12_1", "reversal_1"]
    with pytest.raises(ValueError, match="needs price"):
        FACTORS.factors["size"](series(spark, [1]))
    own = Registry()
    own.add("one", "x")(lambda d: d.select("symbol", "date", F.lit(1).alias("value")))
    with pytest.raises(ValueError, match="already"):
        own.add("one", "x")(lambda d: d)
    assert own.compute(series(spark, [1, 2])).count() == 2
    chain = Chain().require("positive", "close > 0").require("small", "close < 10").then("double", lambda d: d.withColumn("close", F.col("close") * 2))
    good, bad = chain.run(series(spark, [1, -1, None, 50]))
    assert column(good, "close") == [2.0]
    assert column(bad, "error") == ["positive", "positive", "small"]


def test_recursive_columns_across_batches(spark):
    """Series that span Arrow batches, and many in one batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        rng = np.random.default_rng(7)
        data = {f"s{i}": 100 + np.cumsum(rng.normal(size=n)) for i, n in enumerate([1, 2, 30, 5, 7, 14, 21, 3, 50])}
        rows = [(s, D0 + dt.timedelta(days=i), float(v)) for s, x in data.items() for i, v in enumerate(x)]
        d = indicators.all_indicators(spark.createDataFrame(rows, "symbol string, date date, close double").coalesce(1)).toPandas()
        assert len(d) == len(rows)
        for s, x in data.items():
            got = d[d["symbol"] == s].sort_values("date")
            p = pd.Series(x)
            want = p.ewm(span=12, min_periods=12).mean()
            assert np.allclose(got["ema_12"].astype(float), want, equal_nan=True)
            line = p.ewm(span=12, adjust=False, min_periods=12).mean() - p.ewm(span=26, adjust=False, min_periods=26).mean()
            assert np.allclose(got["signal"].astype(float), line.ewm(span=9, adjust=False, min_periods=9).mean(), equal_nan=True)
    finally:
        spark.conf.set(key, before)


def test_kendall_by_group(spark):
    """Every group has its tau, as the definition over all pairs gives it, ties and repeated rows included."""
    rng = random.Random(4)
    rows = [(g, rng.randrange(60), rng.randrange(9) / 2, rng.choice([None, float("nan"), *range(12)])) for g in range(6) for _ in range(g * g * 4)] + [(9, 1, 2.0, 3), (9, 2, 2.0, 4)]
    d = spark.createDataFrame([(g, i, a, None if b is None else float(b)) for g, i, a, b in rows], "g int, i int, a double, b double")
    sign = lambda x: (x > 0) - (x < 0)
    want = {}
    for g in {r[0] for r in rows}:
        x = [r[1:] for r in rows if r[0] == g and r[3] is not None and r[3] == r[3]]
        pairs = [(sign(p[1] - q[1]), sign(p[2] - q[2])) for p in x for q in x if p[0] < q[0]]
        size = sum(abs(s) for s, _ in pairs) * sum(abs(t) for _, t in pairs)
        want[g] = sum(s * t for s, t in pairs) / size**0.5 if size else None
    got = {r["g"]: r["tau"] for r in stats.kendall(d, "a", "b", "i", ["g"]).collect()}
    assert got.keys() == want.keys() and all(got[g] == (want[g] if want[g] is None else pytest.approx(want[g])) for g in want)


def test_tau_of_every_symbol(spark, small):
    from tickloom.plans.catalog import QUERIES

    symbols = spark.read.parquet(f"{small}/lineitem.parquet").selectExpr("l_suppkey").distinct().count()
    assert symbols > 1 and QUERIES["a5_kendall"](spark, small).count() == symbols


def test_every_page_is_in_a_feed(spark, tmp_path):
    from tickloom.plans.catalog import QUERIES

    spark.range(250).selectExpr("id as page_id", "concat('http://x/?a=1&b=<', id) as url", "'' as html").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r["feed_id"], r["item_id"], r["link"]) for r in QUERIES["s12_feed_items"](spark, str(tmp_path)).collect()}
    assert got == {(f"f{i // 100}", f"g{i}", f"http://x/?a=1&b=<{i}") for i in range(250)}
