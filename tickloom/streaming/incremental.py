"""Streams over files: de-duplication with retention, new-item detection, incremental series.

All of them run with availableNow triggers, so that a scheduler can start them at any time. Table and state live under a
path that the caller names: a later run with the same path, in the same session or another, goes on where the last one
ended, and files that are done are not read again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def deduplicated(stream: DataFrame, ts: str, key: str, retention: str = "7 days") -> DataFrame:
    """The first row of each key within the retention; the stamp is not refreshed by later sightings."""
    return stream.withWatermark(ts, retention).dropDuplicatesWithinWatermark([key])


def deduplicated_sliding(stream: DataFrame, ts: str, key: str, retention_hours: int = 168) -> DataFrame:
    """As deduplicated(), but every sighting refreshes the stamp: a key that keeps coming back is never new again.
    State per key is one timestamp, dropped by an event-time timer."""
    span = retention_hours * 3_600_000
    columns = [f.name for f in stream.schema.fields]

    def each(_key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        t = pd.concat(list(frames)).sort_values(ts)
        new = []
        for stamp in t[ts]:
            ms = int(pd.Timestamp(stamp).value // 1_000_000)
            new.append(last is None or ms - last > span)
            last = ms if last is None else max(last, ms)
        state.update((last,))
        until = max(last + span, state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(until)
        yield t[new][columns]

    from pyspark.sql.streaming.state import GroupStateTimeout

    marked = stream.withWatermark(ts, f"{retention_hours} hours")
    return marked.groupBy(key).applyInPandasWithState(each, stream.schema, T.StructType([T.StructField("last", T.LongType())]), "append", GroupStateTimeout.EventTimeTimeout)


def new_items(stream: DataFrame, key: str) -> DataFrame:
    """The first row of each key there ever was. The keys are the stream's state, so no stored table is read again."""
    return stream.dropDuplicates([key])


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Run what is there to the end, append to the Parquet table path/rows, read it back. The state is in path/state."""
    spark = stream.sparkSession
    q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


class Series:
    """A series of which later rows replace earlier ones of the same keys. Each micro-batch adds its own rows, the last
    one a key, as a part of its own; now() takes the last of each key over all parts. A batch that is run again overwrites
    its part, and nothing else is written again."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], seq: str = "seq"):
        self.spark, self.path, self.schema, self.keys, self.seq = spark, path, schema, keys, seq

    def _last(self, df: DataFrame) -> DataFrame:
        values = [c for c in self.schema.names if c not in self.keys]
        last = df.groupBy(*self.keys).agg(F.max_by(F.struct(*values), self.seq).alias("x"))
        return last.select(*self.keys, *[F.col(f"x.{c}").alias(c) for c in values]).select(*self.schema.names)

    def _parts(self) -> DataFrame:
        """All parts; a folder that isn't there yet is empty."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/parts")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/parts")

    def run(self, stream: DataFrame) -> None:
        def step(batch: DataFrame, number: int) -> None:
            self._last(batch).write.mode("overwrite").parquet(f"{self.path}/parts/{number}")

        q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    def now(self) -> DataFrame:
        return self._last(self._parts()).drop(self.seq)


def windowed_counts(stream: DataFrame, ts: str, key: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tumbling counts with late data up to a limit."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def resume_point(df: DataFrame, date: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(date).alias("last"))
