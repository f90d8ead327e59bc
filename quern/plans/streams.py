"""Streams over the tables, run over all that is there; a checkpoint folder of their own each."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from quern.streaming import streams as T


def _folder(spark) -> str:
    """A new folder in the one that all executors share; one of the driver's only where the cluster names none, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared}/stream-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="stream-")


def _stream(spark, d, name):
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parquet*")


def _run(spark, df, mode):
    folder = _folder(spark)
    return T.run_to_files(df, f"{folder}/out", f"{folder}/state", mode)


def stream_tumbling(spark, d):
    """Hourly counts by type, all windows, as a complete result."""
    got = T.tumbling(_stream(spark, d, "events"), "ts", "1 hour", ["event_type"])
    return _run(spark, got, "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def stream_dedup(spark, d):
    """Metric rows without their repeats, by run and metric."""
    own = T.once_only(_stream(spark, d, "metrics"), "logged_at", ["run", "step", "metric"])
    return _run(spark, own.select("run", "step", "metric"), "append").groupBy("run", "metric").agg(F.count("*").alias("n"), F.sum("step").alias("steps"))


def stream_ema(spark, d):
    """The smoothed loss of each run from a stream, a value for each first row of a step."""
    own = T.once_only(_stream(spark, d, "metrics").where("metric = 'train/loss' and value is not null and not isnan(value)"), "logged_at", ["run", "step"])
    means = _run(spark, T.smoothed(own, "run", "step", "value"), "append")
    return means.groupBy("key").agg(F.count("*").alias("n"), F.max("step").alias("last_step"), F.round(F.max_by("ema", "step"), 4).alias("last"))


QUERIES = {
    "stream_tumbling": (stream_tumbling, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "stream_dedup": (stream_dedup, "SELECT run, metric, count(DISTINCT step) AS n, sum(DISTINCT step)::BIGINT AS steps FROM metrics GROUP BY ALL"),
    "stream_ema": (stream_ema, """WITH RECURSIVE o AS (SELECT run, step, arg_min(value, (arrived_at, value)) AS value FROM metrics WHERE metric = 'train/loss' AND value IS NOT NULL AND NOT isnan(value) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS i FROM o),
        e AS (SELECT run, step, i, 0.1::DOUBLE * value AS s FROM r WHERE i = 1 UNION ALL SELECT r.run, r.step, r.i, 0.9 * e.s + 0.1 * r.value FROM e JOIN r ON r.run = e.run AND r.i = e.i + 1)
        SELECT run AS key, count(*) AS n, max(step) AS last_step, round(arg_max(s / (1 - 0.9::DOUBLE ** i), step), 4) AS last FROM e GROUP BY run"""),
}
