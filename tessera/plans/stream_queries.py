"""Event-time queries: the batch forms beside SQL, and the same by streams that run once over the files."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import Query
from tessera.plans.tables import frame
from tessera.sources.files import work_folder
from tessera.streaming import events as E


def _tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.windowed(frame(spark, sf_dir, "events"), "ts", "1 hour", [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")], ["event_type"])
    return out.select("window_start", "event_type", "n", "total")


def _sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.windowed(frame(spark, sf_dir, "events"), "ts", "1 hour", [F.count("*").alias("n")], slide="15 minutes").select("window_start", "n")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.sessions(frame(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")])
    return out.select("user_id", "session_start", "n")


def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.deduplicated(frame(spark, sf_dir, "events").select("user_id", "event_type"), "ts", ["user_id", "event_type"], "1 hour")


def _interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir, "events")
    out = E.interval_joined(own.filter("event_type = 'view'"), own.filter("event_type = 'click'"), ["user_id"], "ts", "ts", "10 minutes", "1 hour")
    return out.select("event_id", "r_event_id")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows by a stream: every window, as the mode is complete."""
    source = spark.readStream.schema(frame(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(_folder(sf_dir))
    out = E.windowed(source.filter("event_id is not null"), "ts", "1 hour", [F.count("*").alias("n")])
    return E.run_once(out, f"t{uuid.uuid4().hex}", "complete").select("window_start", "n")


def _source(spark: SparkSession, *parts: DataFrame) -> DataFrame:
    """A stream that reads the parts one after the other, each as a batch of its own."""
    path = work_folder(spark)
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{path}/part={i}")
        time.sleep(0.01)  # files are read by their times
    return E.read_events(spark, path, parts[0].schema, maxFilesPerTrigger="1", recursiveFileLookup="true")


def _name() -> str:
    return f"t{uuid.uuid4().hex}"


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has passed. The third batch is ten days late, and is dropped: a batch's late rows are told by the watermark before the batch before it."""
    own = frame(spark, sf_dir, "events")
    stream = _source(spark, own.filter("event_id % 2 = 0"), own.filter("event_id % 2 = 1"), own.withColumn("ts", F.col("ts") - F.expr("INTERVAL 10 DAYS")))
    return E.run_once(E.windowed(stream, "ts", "1 hour", [F.count("*").alias("n")], late="1 hour"), _name()).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


def _sessions_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.sessions(_source(spark, frame(spark, sf_dir, "events")), "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")], late="1 hour")
    return E.run_once(out, _name()).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


def _dedup_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event arrives twice, in two batches."""
    own = frame(spark, sf_dir, "events")
    return E.run_once(E.deduplicated(_source(spark, own, own), "ts", ["event_id"], "400 days"), _name()).select("event_id", "user_id", "value")


def _join_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks by streams of two batches each, the later half first."""
    own = frame(spark, sf_dir, "events")
    halves = [own.filter("event_id % 2 = 1"), own.filter("event_id % 2 = 0")]
    views, clicks = (_source(spark, *[h.filter(F.col("event_type") == kind) for h in order]) for kind, order in (("view", halves), ("click", halves[::-1])))
    return E.run_once(E.interval_joined(views, clicks, ["user_id"], "ts", "ts", "10 minutes", "400 days"), _name()).select("event_id", "r_event_id")


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums kept over two batches: the last of each user."""
    own = frame(spark, sf_dir, "events")
    out = E.run_once(E.running_totals(_source(spark, own.filter("event_id % 3 = 0"), own.filter("event_id % 3 > 0")), "user_id", "value"), _name(), "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches written to files, each once: the stream that starts again finds nothing to do."""
    own = frame(spark, sf_dir, "events")
    stream, path, check = _source(spark, own.filter("event_id % 2 = 0"), own.filter("event_id % 2 = 1")), work_folder(spark), work_folder(spark)
    E.write_each(stream, path, check)
    E.write_each(stream, path, check)
    return spark.read.parquet(path).select("event_id", "user_id", F.col("batch").cast("int").alias("batch"))


def _folder(sf_dir: str) -> str:
    """events.parquet as what a stream can watch: the folder, or a glob of the one file."""
    return f"{sf_dir}/events.parque[t]"


QUERIES: dict[str, tuple[Query, str | None]] = {
    "stream_tumbling": (_tumbling, "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "stream_sliding": (_sliding, "SELECT time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS window_start, count(*) AS n FROM events, range(4) r(i) GROUP BY ALL"),
    "stream_sessions": (_sessions, "SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"),
    "stream_dedup": (_dedup, "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_interval_join": (_interval, "SELECT a.event_id, b.event_id AS r_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE"),
    "stream_late_rows": (_late, "SELECT window_start, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY 1) WHERE window_start + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR"),
    "stream_sessions_by_stream": (_sessions_by_stream, "SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR"),
    "stream_dedup_by_stream": (_dedup_by_stream, "SELECT event_id, user_id, value FROM events"),
    "stream_join_by_stream": (_join_by_stream, "SELECT a.event_id, b.event_id AS r_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE"),
    "stream_state": (_state, "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id"),
    "stream_written_once": (_written, "SELECT event_id, user_id, (event_id % 2)::INT AS batch FROM events"),
    "stream_windows_by_stream": (_stream, "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY ALL"),
}
