"""Scans, sinks and schema checks on plain Parquet and text formats."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a temporary
    one, if driver and executors are one process; a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tickloom-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def scan(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.parquet(pattern)


def run_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """SQL over named views, with bound parameters (:name) instead of text built from values."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args) if args else spark.sql(sql)


def execute(spark: SparkSession, *statements: str, args: dict | None = None) -> list[DataFrame]:
    """DDL and DML, run in order as they come, with bound parameters; the results of each."""
    return [spark.sql(x, args=args) if args else spark.sql(x) for x in statements]


def live_entries(entries: DataFrame, now, ttl_seconds: int, most: int) -> DataFrame:
    """entries(key, stored_at, ...): those not older than the time to live, at most `most` of them, the oldest evicted
    first, ties by key."""
    live = entries.where(F.col("stored_at") > F.lit(now) - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return live.orderBy(F.desc("stored_at"), "key").limit(most)


def tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def filtered_facts(df: DataFrame, start: str, end: str, symbols: list) -> DataFrame:
    """Rows in a date range of some symbols; both predicates reach the scan."""
    return df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("symbol").isin(symbols))


def union_pivot(parts: list[DataFrame], variables: list[str]) -> DataFrame:
    """Long tables (symbol, date, variable, value) to one row per symbol and month end."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    ends = whole.withColumn("date", F.last_day("date"))
    return ends.groupBy("symbol", "date").pivot("variable", variables).agg(F.min("value"))


def write_parquet(df: DataFrame, path: str, **options) -> None:
    w = df.write.mode("overwrite")
    if "partition_by" in options:
        w = w.partitionBy(*options["partition_by"])
    w.parquet(path)


def write_split(df: DataFrame, path: str, n: int) -> None:
    """n files of about equal size."""
    df.repartition(n).write.mode("overwrite").parquet(path)


def write_by_years(df: DataFrame, path: str, date: str = "date", span: int = 3) -> None:
    """One directory per `span` years."""
    bucket = (F.floor(F.year(date) / span) * span).cast("int")
    df.withColumn("year_bucket", bucket).write.mode("overwrite").partitionBy("year_bucket").parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """ISO dates; NaN as null, which JSON lacks otherwise."""
    fixed = [F.nanvl(c, F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*fixed).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("dateFormat", "yyyy-MM-dd").csv(path)


def read_json_records(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Records, one to a line or (whole) one array to a file, with nested values as JSON strings."""
    df = spark.read.option("multiLine", str(whole).lower()).json(path)
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def agent_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("record"))


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the last in the given order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, the new one where a key is in both, the last of `new` by its `seq` if it repeats keys. old has the
    columns of new but seq."""
    both = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(new)
    return latest(both, keys, F.col("seq")).drop("seq")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of new whose key is not in old, one per key (the first by `order`)."""
    first = latest(new, keys, -F.col(order))
    return first.join(old.select(*keys), keys, "left_anti")


def validate(df: DataFrame, required: dict[str, str], keys: list[str]) -> DataFrame:
    """(column, problem, n): missing columns, declared types that differ, nulls in keys. Empty if all is well."""
    have = dict(df.dtypes)
    rows = [(c, "missing", 1) for c in required if c not in have]
    rows += [(c, f"type {have[c]} instead of {t}", 1) for c, t in required.items() if c in have and have[c] != t]
    found = df.sparkSession.createDataFrame(rows, "column string, problem string, n long")
    present = [k for k in keys if k in have]
    if present:
        nulls = df.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in present]).unpivot([], present, "column", "n")
        found = found.unionByName(nulls.where("n > 0").select("column", F.lit("null key").alias("problem"), "n"))
    return found


def collector_check(df: DataFrame, required: list[str], not_negative: list[str]) -> DataFrame:
    """One row: empty, missing_columns, negatives."""
    lost = sorted(set(required) - set(df.columns))
    negative = sum((F.count_if(F.col(c) < 0) for c in not_negative if c in df.columns), F.lit(0))
    return df.agg((F.count("*") == 0).alias("empty"), F.lit(len(lost)).cast("long").alias("missing_columns"), negative.cast("long").alias("negatives"))


def melt_weights(df: DataFrame, key: str) -> DataFrame:
    """A wide sheet (key, one column per date, weights in percent) to (symbol, date, weight), one row per pair."""
    columns = [c for c in df.columns if c != key]
    long = df.unpivot([key], columns, "date", "percent").where("percent is not null")
    named = long.select(F.col(key).alias("symbol"), F.col("date").cast("date").alias("date"), (F.col("percent") / 100).alias("weight"))
    return named.groupBy("symbol", "date").agg(F.max("weight").alias("weight"))


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work items that a checkpointed batch has not finished yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def append_json(df: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    write_json(df, path, mode="append")


def write_portfolio(holdings: DataFrame, path: str) -> None:
    """Holdings as JSON and CSV, and a table of rationales, side by side."""
    write_json(holdings, f"{path}/holdings.json")
    write_csv(holdings, f"{path}/holdings.csv")
    why = F.concat(F.col("symbol").cast("string"), F.lit(": sector "), F.col("sector"), F.lit(", score "), F.format_number("score", 2))
    holdings.select(why.alias("value")).write.mode("overwrite").text(f"{path}/rationale")
