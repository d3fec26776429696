"""Regression and factor construction: residuals, principal components, macro factors, rolling multi-factor betas."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by


def residual(df: DataFrame, y: str, x: str, keys: list[str], out: str = "residual", least: int = 3) -> DataFrame:
    """df with y minus its least-squares fit on x (with a constant) within the group, one aggregate joined back."""
    pair = F.col(y).isNotNull() & F.col(x).isNotNull()
    fit = df.where(pair).groupBy(*keys).agg(F.regr_slope(y, x).alias("__b"), F.regr_intercept(y, x).alias("__a"), F.count("*").alias("__n"))
    j = df.join(fit, keys, "left")
    return j.withColumn(out, F.when(pair & (F.col("__n") >= least), F.col(y) - F.col("__a") - F.col("__b") * F.col(x))).drop("__a", "__b", "__n")


def _ols(x, y):
    """Residuals of y on the columns of x and a constant."""
    import numpy as np

    a = np.column_stack([np.ones(len(y)), x])
    return y - a @ np.linalg.lstsq(a, y, rcond=None)[0]


def _whole(df: DataFrame, run, schema: str, keys: list[str]) -> DataFrame:
    def each(t: pa.Table) -> pa.Table:
        return pa.Table.from_pandas(run(t.to_pandas().sort_values("date")), schema=None, preserve_index=False)

    return df.groupBy(*keys).applyInArrow(each, schema)


def residuals(df: DataFrame, y: str, controls: list[str], keys: list[str], kinds: str) -> DataFrame:
    """(keys, date, residual) of y on several controls; rows that miss any are left out. kinds: DDL of the keys."""

    def run(t):
        t = t.dropna(subset=[y, *controls])
        t["residual"] = _ols(t[controls].to_numpy(float), t[y].to_numpy(float)) if len(t) > len(controls) + 1 else None
        return t[[*keys, "date", "residual"]]

    return _whole(df.select(*keys, "date", y, *controls), run, f"{kinds}, date date, residual double", keys)


def cascade(df: DataFrame, factors: list[str], keys: list[str], kinds: str) -> DataFrame:
    """Each factor cleaned of all before it, in the given order, with the cleaned ones as controls."""

    def run(t):
        import numpy as np

        t = t.dropna(subset=factors).copy()
        done = []
        for f in factors:
            v = t[f].to_numpy(float)
            if done and len(t) > len(done) + 1:
                v = _ols(np.column_stack(done), v)
            done.append(v)
            t[f] = v
        return t[[*keys, "date", *factors]]

    return _whole(df.select(*keys, "date", *factors), run, f"{kinds}, date date, " + ", ".join(f"{f} double" for f in factors), keys)


def covariance(df: DataFrame, columns: list[str]) -> tuple[list[float], list[list[float]], int]:
    """Means and sample covariances of complete rows, in one distributed aggregate; its size is that of the columns."""
    d = df.dropna(subset=columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = d.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.covar_samp(a, b).alias(f"c_{a}_{b}") for a, b in pairs]).first()
    k = len(columns)
    cov = [[0.0] * k for _ in range(k)]
    for a, b in pairs:
        i, j = columns.index(a), columns.index(b)
        cov[i][j] = cov[j][i] = row[f"c_{a}_{b}"] or 0.0
    return [row[f"m_{c}"] or 0.0 for c in columns], cov, row["n"]


class Components:
    """Principal components of complete rows. Signs: the first has a positive sum of loadings, the second a positive last
    loading, the third a positive middle one; later ones stay as they come."""

    def __init__(self, df: DataFrame, columns: list[str], n: int):
        import numpy as np

        self.columns = columns
        self.means, cov, self.rows = covariance(df, columns)
        values, vectors = np.linalg.eigh(np.array(cov))
        order = np.argsort(values)[::-1][:n]
        self.loadings = vectors[:, order].T
        self.explained = (values[order] / max(values.sum(), 1e-300)).tolist()
        for i, v in enumerate(self.loadings):
            if i < 3 and (v.sum(), v[-1], v[len(v) // 2])[i] < 0:
                self.loadings[i] = -v

    def transform(self, names: list[str]) -> list[Column]:
        """Centred scores as plain expressions."""
        out = []
        for name, v in zip(names, self.loadings.tolist(), strict=False):
            out.append(sum(((F.col(c) - m) * w for c, m, w in zip(self.columns, self.means, v, strict=True)), F.lit(0.0)).alias(name))
        return out


def differences(df: DataFrame, columns: list[str], order: str = "date") -> DataFrame:
    """First differences of a single series after rows with gaps are dropped."""
    w = by(order=order)
    return df.dropna(subset=columns).select(order, *[(F.col(c) - F.lag(c).over(w)).alias(c) for c in columns]).dropna(subset=columns)


def curve_state(spread: Column, flat: float = 0.2, steep: float = 1.0) -> Column:
    return F.when(spread.isNull(), None).when(spread < 0, "inverted").when(spread >= steep, "steep").when(spread <= flat, "flat").otherwise("normal")


def macro_factors(yields: DataFrame, tenors: list[str], series: DataFrame) -> DataFrame:
    """(date, market, level, slope, curvature, credit, inflation): the shocks cleaned in this order. series has (date,
    market, risk_free, credit_high, credit_low, breakeven)."""
    moved = differences(yields, tenors)
    pca = Components(moved, tenors, 3)
    rates = moved.select("date", *pca.transform(["level", "slope", "curvature"]))
    w = by(order="date")
    other = series.select(
        "date",
        (F.col("market") - F.col("risk_free")).alias("market"),
        ((F.col("credit_high") - F.col("credit_low")) - F.lag(F.col("credit_high") - F.col("credit_low")).over(w)).alias("credit"),
        (F.col("breakeven") - F.lag("breakeven").over(w)).alias("inflation"),
    )
    names = ["market", "level", "slope", "curvature", "credit", "inflation"]
    joined = rates.join(other, "date").withColumn("one", F.lit(1))
    return cascade(joined, names, ["one"], "one int").select("date", *names)


def rolling_betas(df: DataFrame, y: str, factors: list[str], window: int, symbol_kind: str) -> DataFrame:
    """(symbol, date, beta per factor) over trailing windows of complete rows: within each window the factors are cleaned
    of those before them, then y is regressed on them."""

    def run(t):
        import numpy as np

        t = t.dropna(subset=[y, *factors]).reset_index(drop=True)
        x, v = t[factors].to_numpy(float), t[y].to_numpy(float)
        out = np.full((len(t), len(factors)), np.nan)
        for i in range(window - 1, len(t)):
            a = x[i - window + 1 : i + 1].copy()
            for k in range(1, a.shape[1]):
                a[:, k] = _ols(a[:, :k], a[:, k])
            m = np.column_stack([np.ones(window), a])
            out[i] = np.linalg.lstsq(m, v[i - window + 1 : i + 1], rcond=None)[0][1:]
        for k, f in enumerate(factors):
            t[f"beta_{f}"] = out[:, k]
        return t[["symbol", "date", *[f"beta_{f}" for f in factors]]]

    return _whole(df.select("symbol", "date", y, *factors), run, f"symbol {symbol_kind}, date date, " + ", ".join(f"beta_{f} double" for f in factors), ["symbol"])
