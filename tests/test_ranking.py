import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conftest import values
from titlelab.functions.hashing import hash_bucket
from titlelab.operators import ranking, splits
from titlelab.session import durable


@pytest.fixture(scope="module")
def skewed(spark):
    """2,000 rows; group 0 has about two thirds of them, one group key is null."""
    key = F.when(F.col("id") % 3 < 2, 0).when(F.col("id") % 30 == 2, None).otherwise(F.col("id") % 7)
    return spark.range(2000).select("id", key.alias("g"), (F.col("id") * 7919 % 101).alias("v")).cache()


def plain(df, order):
    rank = F.row_number().over(W.partitionBy("g").orderBy(*order))
    return df.withColumn("rank", rank)


def test_cap_per_group_equals_a_plain_window(skewed):
    got = ranking.cap_per_group(skewed, ["g"], 25, ["-v", "id"])
    want = plain(skewed, [F.desc("v"), F.asc("id")]).where("rank <= 25")
    assert values(got) == values(want)


def test_cap_per_group_cuts_before_the_last_shuffle(skewed):
    plan = ranking.cap_per_group(skewed, ["g"], 5, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 3


def test_numbered_equals_a_global_window(skewed):
    got = ranking.numbered(skewed, ["v", "-id"])
    want = skewed.withColumn("row_no", F.row_number().over(W.orderBy("v", F.desc("id"))))
    assert values(got) == values(want)


def test_numbered_within_equals_a_plain_window(skewed):
    got = ranking.numbered_within(skewed, ["g"], ["v", "id"])
    assert values(got) == values(plain(skewed, ["v", "id"]))


def test_numbered_uses_several_partitions(spark):
    df = spark.range(200_000).repartition(8)
    got = ranking.numbered(df, ["-id"])
    assert got.where(F.col("row_no") != 200_000 - F.col("id")).count() == 0


@pytest.mark.parametrize("bits", [1, 12, 16])
def test_hash_ranked_does_not_depend_on_bucket_size(skewed, bits):
    got = ranking.hash_ranked(skewed, ["g"], "id", bits=bits)
    md5 = F.md5(F.concat(F.lit("42:"), F.col("id").cast("string")))
    want = plain(skewed, [md5, "id"]).withColumn("group_size", F.count("*").over(W.partitionBy("g")))
    assert values(got.select(want.columns)) == values(want)


def test_split_is_stable_and_complete(skewed):
    once, again = splits.split(skewed, "id"), splits.split(skewed.repartition(13), "id")
    assert values(once) == values(again)
    sizes = dict(once.groupBy("part").count().collect())
    assert sum(sizes.values()) == 2000 and 1500 < sizes["train"] < 1700


def test_hash_bucket_matches_python(spark):
    import hashlib

    rows = spark.range(50).select("id", hash_bucket(42, F.col("id"), 100).alias("b")).collect()
    assert all(r.b == int(hashlib.md5(f"42:{r.id}".encode()).hexdigest()[:8], 16) % 100 for r in rows)


def test_stratified_split_takes_a_share_of_each_label(skewed):
    parts = splits.stratified_split(skewed, "g", "id").groupBy("g").agg(
        F.count("*").alias("n"), F.sum((F.col("part") == "test").cast("int")).alias("t")
    )
    assert all(r.t == -(-r.n // 5) for r in parts.collect())


def test_kfold_sizes_differ_by_at_most_one(skewed):
    folds = splits.kfold(skewed, "g", "id").groupBy("g", "fold").count()
    spread = folds.groupBy("g").agg((F.max("count") - F.min("count")).alias("d"))
    assert all(r.d <= 1 for r in spread.collect())
    assert splits.kfold(skewed, "g", "id").select("id").distinct().count() == 2000


@pytest.mark.parametrize("test", [0.005, 0.125, 0.2, 0.5])
def test_split_follows_any_share(spark, test):
    ids = spark.range(20_000)
    share = splits.split(ids, "id", test).where("part = 'test'").count() / 20_000
    assert share == pytest.approx(test, rel=0.15)


def test_hot_sort_key_is_spread(spark, monkeypatch):
    """Half of the rows have one key; no partition of the numbered table holds much of them."""
    written = []
    monkeypatch.setattr(ranking, "durable", lambda df: written.append(durable(df)) or written[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        title = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string"))
        placed = ranking.numbered(spark.range(40_000).select("id", title.alias("title")).repartition(8), ["title"])
        assert placed.agg(F.count_distinct("row_no"), F.max("row_no")).first()[:] == (40_000, 40_000)
        pieces = written[0].groupBy(F.input_file_name().alias("file")).count()
        assert pieces.agg(F.max("count")).first()[0] <= 2 * 40_000 / pieces.count()
        titles = [r["title"] for r in placed.orderBy("row_no").collect()]
        assert titles == sorted(titles)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_rows_are_spread_and_numbered(spark, monkeypatch):
    """A row that makes up most of the table: folded to pieces, unfolded over several partitions."""
    monkeypatch.setattr(ranking, "_PIECE_COPIES", 50)
    written = []
    monkeypatch.setattr(ranking, "durable", lambda df: written.append(durable(df)) or written[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        title = F.when(F.col("id") % 5 < 4, "same").otherwise(F.concat(F.lit("t"), F.col("id")))
        rows = spark.range(4000).select(title.alias("title"), F.lit(None).cast("int").alias("x")).repartition(6)
        placed = ranking.numbered(rows, ["title"])
        assert placed.agg(F.count("*"), F.count_distinct("row_no"), F.max("row_no")).first()[:] == (4000, 4000, 4000)
        titles = [r["title"] for r in placed.orderBy("row_no").collect()]
        assert titles == sorted(r["title"] for r in rows.collect())
        same = written[0].where("title = 'same'").groupBy(F.input_file_name()).count()
        assert same.count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


RERUN = """
import os, random, sys
sys.path.insert(0, {repo!r})
from pyspark import TaskContext
from titlelab.operators import ranking
from titlelab.session import build_session

spark = build_session("rerun", "local[2,4]", {{"spark.sql.shuffle.partitions": "5", "spark.ui.enabled": "false", "spark.checkpoint.dir": {shared!r}}})
spark.sparkContext.setLogLevel("OFF")

def shaken(frames):
    # the first run of a task hands out its rows and dies; the next hands them out in another order
    again = TaskContext.get().attemptNumber()
    for frame in frames:
        yield frame.sample(frac=1, random_state=again + {seed})
    if {fail} and not again:
        raise RuntimeError("lost")

rows = spark.range(0, 3000, 1, 4).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 50 as string)) as title")
placed = ranking.numbered(rows.mapInPandas(shaken, rows.schema), ["title"])
numbers = sorted((r["id"], r["row_no"]) for r in placed.collect())
assert sorted(n for _, n in numbers) == list(range(1, 3001))
print("numbers", hash(tuple(numbers)))
"""


def test_numbers_are_the_same_after_lost_tasks(tmp_path):
    """Tasks that die and come back with their rows in another order number them alike."""
    import subprocess
    import sys
    from pathlib import Path

    said = []
    for seed, fail in ((0, False), (7, True)):
        code = RERUN.format(repo=str(Path(__file__).resolve().parents[1]), shared=str(tmp_path / f"s{seed}"), seed=seed, fail=fail)
        done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240)
        said.append([x for x in done.stdout.splitlines() if x.startswith("numbers")])
        assert said[-1], done.stderr[-2000:]
    assert said[0] == said[1]
