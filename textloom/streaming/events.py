"""Structured Streaming over the event log; each job has a batch twin.

Results are appended to files as their windows close, ten minutes of event time after
their end: nothing is gathered in the driver, and state goes with its window.  A window
that the stream's end leaves open isn't part of a result, and an event that comes after
its window has closed is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.plans.registry import query
from textloom.session import scratch

#: How late an event may be.
DELAY = "10 minutes"
_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream with a watermark; times are UTC."""
    return stream_of(spark, _folder(spark, sf_dir))


def stream_of(spark: SparkSession, folder: str, files_a_trigger: int | None = None) -> DataFrame:
    """A folder of event files as a stream, by time of their arrival."""
    source = spark.readStream.schema(spark.read.parquet(folder).schema).option("pathGlobFilter", "*.parquet")
    source = source.option("maxFilesPerTrigger", files_a_trigger) if files_a_trigger else source
    return source.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", DELAY)


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A file source reads folders: the table's rows are laid out in one."""
    path = scratch(spark, "event-stream")
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(path)
    return path


def run_to_end(stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there; closed windows are appended to files, which are read back."""
    spark = stream.sparkSession
    out = scratch(spark, "stream-out")
    stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", scratch(spark, "stream-state")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tumbling(events: DataFrame) -> DataFrame:
    g = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return g.select(F.col("w.start").alias("day"), "event_type", "n", "v")


def error_rate(events: DataFrame) -> DataFrame:
    g = events.groupBy(F.window("ts", "6 hours", "3 hours").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return g.select(F.col("w.start").alias("started"), "n", "errors")


def user_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    g = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("started"), "n")


def _ntz(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("stream_tumbling", f"SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2 HAVING day + INTERVAL 1 DAY <= {_CLOSED}")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _ntz(run_to_end(tumbling(event_stream(spark, d))), "day").withColumn("v", F.round("v", 4))


@query("stream_error_rate", f"""
WITH w AS (SELECT time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL (h) HOUR AS started, event_type FROM events, (SELECT unnest([0, 3]) AS h))
SELECT started, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM w GROUP BY 1 HAVING started + INTERVAL 6 HOUR <= {_CLOSED}""")
def stream_error_rate(spark: SparkSession, d: str) -> DataFrame:
    return _ntz(run_to_end(error_rate(event_stream(spark, d))), "started")


@query("stream_sessions", f"""
WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000, false)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _ntz(run_to_end(user_sessions(event_stream(spark, d))), "started")
