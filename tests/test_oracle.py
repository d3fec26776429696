"""Every query with SQL gives the same rows, column names and types as DuckDB."""

from __future__ import annotations

import pandas as pd
import pytest

from tickloom.plans.catalog import ORACLE_SQL, QUERIES

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, pd.Timestamp):
            return str(v.date())
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return repr(float(v) + 0.0)
        return str(v)

    return sorted(tuple(one(v) for v in row) for row in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds
    assert canonical(df.toPandas()) == canonical(rel.df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, small, name):
    """Their values are held against numpy, pandas or plain Python in test_values and test_operators."""
    folder = small if name not in ("l3_principal_components", "l5_macro_factors") else "/root/testdata/sf0.01"  # no day with all tenors below
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["symbol", "date", "ret_3m", "sma_3", "z"]
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
