"""Which driver table plays which part, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlelab.sources.tables import read_table

col, lit = F.col, F.lit

TITLES_SQL = """SELECT p_partkey AS id, p_type AS main_id, 'Main ' || p_type AS main_name,
    p_type || '/' || p_brand AS sub_id, p_brand AS sub_name, p_name AS title FROM part"""


def titles(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, "part", sf).select(
        col("p_partkey").alias("id"),
        col("p_type").alias("main_id"),
        F.concat(lit("Main "), col("p_type")).alias("main_name"),
        F.concat_ws("/", "p_type", "p_brand").alias("sub_id"),
        col("p_brand").alias("sub_name"),
        col("p_name").alias("title"),
    )


def mains_sql() -> str:
    return """SELECT r_regionkey AS main_id, r_name AS main_name FROM region"""


def occupations(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as main occupations; all live."""
    return read_table(spark, "region", sf).select(
        col("r_regionkey").alias("id"), *_flags(lit(True), lit(False), lit(True))
    )


def occupation_names(spark: SparkSession, sf: str) -> DataFrame:
    """Each region's name in two languages."""
    region = read_table(spark, "region", sf)
    first = region.select(
        col("r_regionkey").alias("occupation_id"), lit("1").alias("language_id"), col("r_name").alias("name")
    )
    return first.union(first.select("occupation_id", lit("2"), F.lower("name")))


def subs(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as sub occupations of their region; key 3 is off line."""
    return read_table(spark, "nation", sf).select(
        col("n_nationkey").alias("id"),
        col("n_regionkey").alias("occupation_id"),
        *_flags(lit(True), lit(False), col("n_nationkey") != 3),
    )


def sub_names(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth nation is described in the second language only."""
    return read_table(spark, "nation", sf).select(
        col("n_nationkey").alias("occupation_sub_id"),
        F.when(col("n_nationkey") % 5 == 4, "2").otherwise("1").alias("language_id"),
        col("n_name").alias("name"),
    )


def _flags(status, flags, online):
    def flag(condition, name):
        return F.when(condition, "1").otherwise("0").alias(name)

    return flag(status, "is_status"), flag(flags, "is_flags"), flag(online, "is_online")


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as job posts; the customer's nation is the occupation."""
    orders = read_table(spark, "orders", sf)
    customer = read_table(spark, "customer", sf).select("c_custkey", "c_nationkey")
    joined = orders.join(customer, col("o_custkey") == col("c_custkey"))
    return joined.select(
        col("o_orderkey").alias("id"),
        col("c_nationkey").alias("occupation_new_id"),
        *_flags(col("o_orderstatus") == "F", col("o_orderpriority") == "5-LOW", lit(True)),
        col("o_orderdate").alias("created_at"),
    )


def post_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as post descriptions; the part's name is the position."""
    line = read_table(spark, "lineitem", sf).select("l_orderkey", "l_partkey", "l_linenumber")
    part = read_table(spark, "part", sf).select("p_partkey", "p_name")
    return line.join(part, col("l_partkey") == col("p_partkey")).select(
        col("l_orderkey").alias("jobpost_id"), col("p_name").alias("position"), "l_linenumber"
    )


POSTS_SQL = """SELECT o_orderkey AS id, c_nationkey AS main_id, o_orderdate AS created_at, p_name AS title,
    l_linenumber FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
    WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'"""

# Character classes with the same meaning as the Spark patterns, for the SQL engine.
_SPACE = r"\s\x{0B}\x{1c}-\x{1f}\x{85}\x{a0}\p{Z}"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_{_SPACE}]', '', 'g')"


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def business_sql(x: str) -> str:
    return rf"regexp_replace({trim_sql(x)}, '[^\p{{L}}\p{{N}}_{_SPACE}ก-๙]', '', 'g')"


def tokens_sql(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def hash_sql(*parts: str, seed: int = 42) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def md5_sql(*parts: str, seed: int = 42) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"md5({text})"
