"""Shared plumbing: tables in the shared folder, word splitting, skew-safe counters."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"


#: Folders made where no shared one is named, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a temporary one, if driver
    and executors are one process; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = context.applicationId
        if app not in _OWN:
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='tickloom-')}"
        folder = _OWN[app]
    return folder.rstrip("/")


#: Rows of an Arrow batch that carries whole texts to Python, while a table is written.
BATCH_ROWS = 512
_ROWS, _CLEAN = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def while_writing(spark: SparkSession) -> Iterator[None]:
    """Short Arrow batches, unless the session has a limit of its own, and shuffle files that go as soon as the table is
    written. Both settings are put back."""
    before = {k: spark.conf.get(k, None) for k in (_ROWS, _CLEAN)}
    if before[_ROWS] in (None, "10000"):
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Scratch:
    """Written tables of one operator run; each cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def keep(self, df: DataFrame, **options: str) -> DataFrame:
        """Write df as Parquet in the shared folder and read it back."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        with while_writing(self.spark):
            df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tickloom_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables written by keep() that nothing reads any more."""
        for df in tables:
            path = getattr(df, "_tickloom_path", None)
            if path:
                jvm = self.spark.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def row_key() -> Column:
    """Names a row by what it holds: 128 bits of its id and text."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("doc_id", "text")]
    return F.unhex(F.md5(F.concat(parts[0], F.lit("\n"), parts[1])))


def bitmap(hashes: DataFrame, n: int, bits: int, apart: bool = False):
    """A test whether a hash can be among the n ones in the column h: two parts of it are looked up. 256 bits an entry,
    up to the limit; at most 2^bits / 64 rows reach the driver. apart: the bits are the result of a subquery, so that the
    driver doesn't write them out with each plan and each of its updates; such a test can't be used inside a lambda."""
    power = max(6, min(bits, (256 * n).bit_length()))

    def places(h) -> list[Column]:
        return [F.shiftrightunsigned(h, 64 - power), F.shiftrightunsigned(h, 32 - power // 2).bitwiseAND((1 << power) - 1)]

    at = hashes.select(F.explode(F.array(*places("h"))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    rows = at.groupBy(F.shiftrightunsigned("at", 6).alias("k")).agg(F.bit_or(bit).alias("w")).toArrow()
    held = np.zeros(1 << (power - 6), dtype=np.int64)
    held[rows.column("k").to_numpy()] = rows.column("w").to_numpy()
    if apart:
        one = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.array(held))
        table = hashes.sparkSession.createDataFrame(pa.table({"held": one})).scalar()
    else:
        table = F.split(F.lit(",".join(map(str, held.tolist()))), ",").cast("array<bigint>")  # folded to one literal

    def test(h: Column) -> Column:
        one, two = (F.call_function("getbit", F.get(table, F.shiftrightunsigned(x, 6).cast("int")), (x % 64).cast("int")) == 1 for x in places(h))
        return one & two

    return test


def words(text: Column) -> Column:
    """The maximal runs without white space; null counts as the empty text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
