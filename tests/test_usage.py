import datetime as dt

from pyspark.sql import functions as F

from conftest import SMALL, values
from registry.usage import EVENTS_SCHEMA, _requests
from titlelab.sources.tables import read_table
from titlelab.streaming import usage


def test_time_parts_count_days_from_monday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 7),), (dt.datetime(2024, 1, 7, 23, 5, 9),)], "timestamp timestamp_ntz")
    got = values(usage.log_time_parts(df).select("date", "time", "hour", "day_of_week"))
    assert got == [("2024-01-01", "00:00:07", 0, 0), ("2024-01-07", "23:05:09", 23, 6)]


def test_elapsed_keeps_microseconds(spark):
    a, b = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 1, 234567)
    df = spark.createDataFrame([(a, b)], "s timestamp_ntz, e timestamp_ntz")
    assert df.select(usage.elapsed_ms(F.col("s"), F.col("e"))).first()[0] == 1234.567


def test_extra_is_null_when_nothing_is_given(spark):
    df = spark.createDataFrame([("x", None), (None, None)], "a string, b string")
    got = usage.with_extra(df, {"a": F.col("a"), "b": F.col("b")})
    assert [r.extra for r in got.collect()] == [{"a": "x"}, None]


def flat(df):
    return values(df.withColumn("extra", F.to_json("extra")).select(*usage.LOG_COLUMNS))


def test_batch_log_survives_writing(spark, tmp_path):
    log = usage.usage_log(_requests(read_table(spark, "events", SMALL)))
    usage.write_usage_log(log, str(tmp_path / "log"))
    assert flat(usage.read_usage_log(spark.read, str(tmp_path / "log"))) == flat(log)
    errors = (tmp_path / "log" / "success=false").exists()
    assert errors and (tmp_path / "log" / "success=true").exists()


def test_stream_equals_batch_and_a_rerun_adds_nothing(spark, tmp_path):
    path, progress = str(tmp_path / "log"), str(tmp_path / "progress")
    for _ in range(2):
        stream = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(SMALL)
        usage.usage_log_stream(_requests(stream), path, progress).awaitTermination()
    batch = usage.usage_log(_requests(read_table(spark, "events", SMALL)))
    assert flat(usage.read_usage_log(spark.read, path)) == flat(batch)
