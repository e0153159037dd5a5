"""Usage log from the events table, batch and stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.inputs import col, lit
from titlelab.session import scratch_path
from titlelab.sources.tables import read_table
from titlelab.streaming import usage

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

_LOG = """SELECT event_type AS endpoint_type, CAST(user_id AS VARCHAR) AS ip_address, ts AS timestamp,
    strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time, CAST(hour(ts) AS INTEGER) AS hour,
    CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, round(CAST(round(value * 1000) AS BIGINT) / 1000.0, 3) AS processing_time_ms,
    event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN 'failed: ' || props END AS error_message,
    nullif(json_extract_string(props, '$.k'), '0') AS extra_k FROM events"""


def _requests(events):
    """Events as requests: ``value`` is the time taken, ``error`` the failing kind."""
    micros = F.round(col("value") * 1000).cast("bigint")
    failed = col("event_type") == "error"
    df = events.select(
        col("event_type").alias("endpoint_type"),
        col("user_id").cast("string").alias("ip_address"),
        F.timestamp_add("MICROSECOND", -micros, col("ts")).alias("start_ts"),
        col("ts").alias("end_ts"),
        (~failed).alias("success"),
        F.when(failed, F.concat(lit("failed: "), "props")).alias("error_message"),
        "props",
    )
    k = F.get_json_object("props", "$.k")
    return usage.with_extra(df, {"k": F.when(k != "0", k)})


def _flat(log):
    return log.withColumn("extra_k", col("extra")["k"]).drop("extra").withColumn(
        "processing_time_ms", F.round("processing_time_ms", 3)
    )


@query("usage_log", _LOG)
def usage_log(spark, sf):
    return _flat(usage.usage_log(_requests(read_table(spark, "events", sf))))


@query(
    "usage_log_split",
    f"""SELECT success, date, count(*) AS n, count(extra_k) AS n_extra, round(sum(processing_time_ms), 3) AS total_ms
    FROM ({_LOG}) GROUP BY ALL""",
)
def usage_log_split(spark, sf):
    """The log written to its success and date folders, read back and counted per folder."""
    path = scratch_path(spark, "usage-log")
    usage.write_usage_log(usage.usage_log(_requests(read_table(spark, "events", sf))), path)
    stored = _flat(usage.read_usage_log(spark.read, path))
    return stored.groupBy("success", "date").agg(
        F.count("*").alias("n"),
        F.count("extra_k").alias("n_extra"),
        F.round(F.sum("processing_time_ms"), 3).alias("total_ms"),
    )


@query("usage_log_stream", _LOG)
def usage_log_stream(spark, sf):
    """The same log written by a stream over the events file."""
    stream = (
        spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf)
    )
    path, progress = scratch_path(spark, "usage-stream"), scratch_path(spark, "usage-progress")
    usage.usage_log_stream(_requests(stream), path, progress).awaitTermination()
    return _flat(usage.read_usage_log(spark.read, path))
