"""The plug-in surface: factors, a registry, providers, and chains of record processors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    """Tables by name, each with (symbol, date, ...)."""

    def table(self, name: str) -> DataFrame: ...


@dataclass(frozen=True)
class Factor:
    """A named factor: compute(panel) -> (symbol, date, value). needs: columns the panel must have."""

    name: str
    category: str
    compute: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ("symbol", "date", "close")
    lookback: int = 0

    def __call__(self, panel: DataFrame) -> DataFrame:
        lost = [c for c in self.needs if c not in panel.columns]
        if lost:
            raise ValueError(f"factor {self.name} needs {', '.join(lost)}")
        return self.compute(panel).select("symbol", "date", F.lit(self.name).alias("factor"), F.col("value").cast("double").alias("value"))


@dataclass
class Registry:
    factors: dict[str, Factor] = field(default_factory=dict)

    def add(self, name: str, category: str, needs: tuple[str, ...] = ("symbol", "date", "close"), lookback: int = 0):
        """Decorator: registers a compute function under a new name."""

        def put(fn: Callable[[DataFrame], DataFrame]) -> Factor:
            if name in self.factors:
                raise ValueError(f"factor {name} is registered already")
            self.factors[name] = Factor(name, category, fn, needs, lookback)
            return self.factors[name]

        return put

    def named(self, category: str | None = None) -> list[str]:
        return sorted(n for n, f in self.factors.items() if category in (None, f.category))

    def compute(self, panel: DataFrame, names: list[str] | None = None) -> DataFrame:
        """Long table of several factors."""
        out = None
        for n in names or self.named():
            one = self.factors[n](panel)
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise ValueError("no factors")
        return out


@dataclass
class Chain:
    """Processors in turn, each a function from DataFrame to DataFrame. Records that a check rejects leave the chain with
    the check's name in `error` instead of stopping it."""

    steps: list[tuple[str, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)
    checks: list[tuple[str, str]] = field(default_factory=list)

    def then(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> Chain:
        return Chain([*self.steps, (name, fn)], self.checks)

    def require(self, name: str, condition: str) -> Chain:
        return Chain(self.steps, [*self.checks, (name, condition)])

    def run(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(good, rejected): the rejected have a column `error`."""
        error = F.lit(None).cast("string")
        for name, condition in reversed(self.checks):
            error = F.when(~F.coalesce(F.expr(condition), F.lit(False)), name).otherwise(error)
        marked = df.withColumn("error", error)
        good = marked.where("error is null").drop("error")
        for _, fn in self.steps:
            good = good.transform(fn)
        return good, marked.where("error is not null")


#: Factors that come with the engine.
FACTORS = Registry()


@FACTORS.add("momentum_12_1", "price", lookback=12)
def momentum_12_1(panel: DataFrame) -> DataFrame:
    from ..functions.columns import by
    from .indicators import momentum

    return panel.select("symbol", "date", momentum("close", by("symbol", order="date"), 12, 1).alias("value"))


@FACTORS.add("reversal_1", "price", lookback=1)
def reversal_1(panel: DataFrame) -> DataFrame:
    from ..functions.columns import by, change

    return panel.select("symbol", "date", (-change("close", 1, by("symbol", order="date"))).alias("value"))


@FACTORS.add("volatility_12", "risk", lookback=12)
def volatility_12(panel: DataFrame) -> DataFrame:
    from ..functions.columns import by
    from .indicators import rolling_volatility, simple_return

    w = by("symbol", order="date")
    return panel.withColumn("r", simple_return("close", w)).select("symbol", "date", rolling_volatility("r", w, 12).alias("value"))


@FACTORS.add("size", "size", needs=("symbol", "date", "price"))
def size(panel: DataFrame) -> DataFrame:
    return panel.select("symbol", "date", F.log1p("price").alias("value"))
