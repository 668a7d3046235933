"""Event-time operators for streams; each also takes a batch frame and gives the same rows for it."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import work_folder


def read_events(spark: SparkSession, path: str, schema: Any = None, **options: str) -> DataFrame:
    """A stream of the Parquet files in a folder."""
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).options(**options).parquet(path)


def _marked(df: DataFrame, time: str, late: str | None) -> DataFrame:
    return _instant(df, time).withWatermark(time, late) if late and df.isStreaming else df


def _instant(df: DataFrame, time: str) -> DataFrame:
    """Watermarks need instants; a time without zone is read in the session's."""
    return df.withColumn(time, F.col(time).cast("timestamp")) if df.schema[time].dataType.typeName() == "timestamp_ntz" else df


def windowed(df: DataFrame, time: str, width: str, aggregates: list[Column], keys: list[str] | None = None, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Aggregates of tumbling windows, or of sliding ones."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = _marked(df, time, late).groupBy(window.alias("w"), *(keys or [])).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggregates: list[Column], late: str | None = None) -> DataFrame:
    """Aggregates of sessions that end after a gap without events."""
    out = _marked(df, time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in out.columns if c != "w"])


def deduplicated(df: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key; a stream forgets keys after the lateness."""
    return _instant(df, time).withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def interval_joined(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, within: str, late: str) -> DataFrame:
    """Rows of two streams with equal keys where right comes at most `within` after left. Right columns are prefixed r_."""
    a = _marked(left, left_time, late)
    b = _marked(right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]), f"r_{right_time}", late)
    on = [F.col(k) == F.col(f"r_{k}") for k in keys]
    after = (F.col(f"r_{right_time}") >= F.col(left_time)) & (F.col(f"r_{right_time}") <= F.col(left_time) + F.expr(f"interval {within}"))
    condition = after
    for o in on:
        condition = condition & o
    return a.join(b, condition)


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """A stream's count and sum of each key so far, kept as state: key, n, total."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = df.schema[key].dataType.simpleString()

    def step(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n, total = n + len(frame), total + float(frame[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [own[0]], "n": [n], "total": [total]})

    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


#: State is kept on the executors' disks, and only so much of it in memory.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


@contextlib.contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """A stream that starts within keeps its state on disk; settings of the session's own stay as they are."""
    own = {k: v for k, v in STATE.items() if k not in spark.conf.getAll}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in own:
            spark.conf.unset(k)


def run_once(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there into Parquet files, and give them as a view of this name.

    The files, of which the driver holds nothing, are in the shared folder until the driver ends. In complete mode the last batch counts.
    """
    spark, path = df.sparkSession, work_folder(df.sparkSession)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    spark.createDataFrame([], df.schema).write.parquet(f"{path}/none")  # there may be no batch
    files.deleteOnExit(place)
    last = "none"

    def put(batch: DataFrame, number: int) -> None:
        nonlocal last
        last = str(number)
        batch.write.mode("overwrite").parquet(f"{path}/{number}")

    own = spark._jvm.org.apache.hadoop.fs.Path(checkpoint or f"{path}-state")
    try:
        with _state_on_disk(spark):
            running = df.writeStream.foreachBatch(put).queryName(name).outputMode(mode).option("checkpointLocation", own.toString()).trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        if not checkpoint:
            files.delete(own, True)
    out = spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{path}/{last}" if mode == "complete" else path)
    out.createOrReplaceTempView(name)
    return out


def write_each(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write a stream's batches to Parquet, each once: a batch that runs again replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
