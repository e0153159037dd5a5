"""Usage log: one record per request, as a batch table or a stream.

The same column logic serves both. Records are stored under ``success=`` and ``date=``
folders, which replaces separate success and error collections and a date index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG_COLUMNS = (
    "endpoint_type", "ip_address", "timestamp", "date", "time", "hour", "day_of_week",
    "processing_time_ms", "success", "error_message", "extra",
)
UNKNOWN_ADDRESS = "unknown"


def log_time_parts(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Add date, time, hour and day of week (Monday = 0)."""
    at = F.col(ts)
    return df.withColumns(
        {
            "date": F.date_format(at, "yyyy-MM-dd"),
            "time": F.date_format(at, "HH:mm:ss"),
            "hour": F.hour(at),
            "day_of_week": F.weekday(at),
        }
    )


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps, with microsecond detail."""
    return (
        F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    ) / F.lit(1000.0)


def with_extra(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add ``extra``: a map of the values that are present, or null when there is none."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in cols.items()])
    filled = F.filter(entries, lambda e: e["value"].isNotNull())
    return df.withColumn("extra", F.when(F.size(filled) > 0, F.map_from_entries(filled)))


def usage_log(events: DataFrame) -> DataFrame:
    """Log records from ``(endpoint_type, ip_address, start_ts, end_ts, success,
    error_message, extra)``. Row by row, so it works on batch tables and streams."""
    timed = events.withColumn("timestamp", F.col("end_ts"))
    timed = timed.withColumn("processing_time_ms", elapsed_ms(F.col("start_ts"), F.col("end_ts")))
    timed = timed.withColumn("ip_address", F.coalesce("ip_address", F.lit(UNKNOWN_ADDRESS)))
    return log_time_parts(timed).select(*LOG_COLUMNS)


def write_usage_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """Write a batch of records.

    Range partitioning on the folder columns and time keeps a folder's rows together but
    lets a busy day use as many tasks (and files) as it needs.
    """
    order = ["success", "date", "endpoint_type", "timestamp"]
    laid_out = log.repartitionByRange(*order).sortWithinPartitions(*order)
    laid_out.write.partitionBy("success", "date").mode(mode).parquet(path)


def usage_log_stream(
    events: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append a stream of events to the log.

    Each batch is laid out like a batch table and written to a folder of its own,
    ``batch=<number>``. A batch that is run again after a failure replaces its folder, so a
    restarted query neither loses nor repeats records.
    """

    def write(batch: DataFrame, number: int) -> None:
        write_usage_log(batch, f"{path.rstrip('/')}/batch={number}", "overwrite")

    writer = (
        usage_log(events)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_usage_log(log_reader, path: str) -> DataFrame:
    """The stored log, of batches or a stream; ``log_reader`` is ``spark.read``.

    Folder values come back as their original types.
    """
    stored = log_reader.parquet(path).drop("batch")
    return stored.withColumn("success", F.col("success").cast("boolean")).withColumn(
        "date", F.date_format(F.col("date").cast("date"), "yyyy-MM-dd")
    )
