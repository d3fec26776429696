"""Normalising columns, parsing numbers out of text, predicates on feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that stand for a missing number, and other names of the price columns.
MISSING = ("", "N/A", "NA", "n/a")
ALIASES = {"adj close": "adj_close", "adjclose": "adj_close", "adj_close": "adj_close"}
STANDARD = ("open", "high", "low", "close", "volume")


def normalise_ohlcv(df: DataFrame) -> DataFrame:
    """Lower-case names, adjusted close as close only if there is no close, absent columns as missing, standard order."""
    names = {c: ALIASES.get(c.lower(), c.lower()) for c in df.columns}
    out = df.withColumnsRenamed(names)
    if "adj_close" in out.columns and "close" not in out.columns:
        out = out.withColumnRenamed("adj_close", "close")
    for c in STANDARD:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    keys = [c for c in ("symbol", "date") if c in out.columns]
    return out.select(*keys, *STANDARD)


def clean_number(c: Column | str, strip: str = r"[$,%\s]") -> Column:
    """A double out of "$1,234.5", "12%" and the like; missing markers, junk and non-finite values become missing."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(c)
    number = F.regexp_replace(t, strip, "").try_cast("double")
    number = F.when(F.abs(number) == float("inf"), None).otherwise(F.nanvl(number, F.lit(None).cast("double")))
    return F.when(~t.isin(*MISSING), number)


def clean_count(c: Column | str) -> Column:
    return clean_number(c).try_cast("long")


def snake_case(c: Column | str) -> Column:
    """An underscore between a lower-case letter or digit and an upper-case letter, then lower case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, "([a-z0-9])(?=[A-Z])", "$1_"))


def known_by(df: DataFrame, date: str, cutoff: str) -> DataFrame:
    """Point-in-time filter: only what was known on the cutoff."""
    return df.where(F.col(date) <= F.lit(cutoff).cast("date"))


def compliant(df: DataFrame, date: str, cutoff: str) -> DataFrame:
    """One row: how many rows are after the cutoff, and whether none is."""
    late = F.count_if(F.col(date) > F.lit(cutoff).cast("date"))
    return df.agg(late.alias("late"), (late == 0).alias("compliant"))


def host(url: Column | str) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def drop_blocked(df: DataFrame, url: str, blocked: DataFrame) -> DataFrame:
    """Without rows whose host equals a blocked domain or ends in it: the host's dot-suffixes are exploded, so that the
    match is an equi-join. blocked(domain); df needs a unique `item_id`."""
    parts = F.split(host(url), r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hit = df.select("item_id", F.explode(tails).alias("domain")).join(blocked, "domain", "left_semi")
    return df.join(hit.select("item_id").distinct(), "item_id", "left_anti")


def recent(df: DataFrame, ts: str, now: Column, hours: int) -> DataFrame:
    """Rows of the last hours before an explicit now."""
    return df.where(F.col(ts) >= now - F.expr(f"interval {hours} hours"))


def mentions(query: str, *fields: str) -> Column:
    """Case-insensitive containment in any of the fields."""
    out = F.lit(False)
    for f in fields:
        out = out | F.coalesce(F.contains(F.lower(F.col(f)), F.lit(query.lower())), F.lit(False))
    return out


def check_weights(df: DataFrame, weight: str, tolerance: float = 1e-6) -> DataFrame:
    """One row: weights outside [0, 1], and whether they add up to one."""
    return df.agg(F.count_if((F.col(weight) < 0) | (F.col(weight) > 1)).alias("outside"), (F.abs(F.sum(weight) - 1) <= tolerance).alias("sums_to_one"))
