"""What the plans do with large inputs and hot keys, shown at small size."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, values
from registry import QUERIES, load_all
from titlelab.operators import catalog, centroids, text_vectors, topup
from titlelab.session import durable, shared_dir

load_all()


@contextmanager
def settings(spark, **conf):
    conf = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tiny_thresholds(spark):
    """Treat a few kilobytes as a large partition and broadcast nothing."""
    return settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="2KB",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="2KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__shuffle__partitions="8",
    )


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot_titles(spark):
    """Every title has the word manager; half of the rows are one main."""
    df = spark.range(6000).repartition(8)
    return df.select(
        "id",
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("main_id"),
        (F.col("id") % 200).alias("sub_id"),
        F.concat(F.lit("manager w"), F.col("id") % 3000).alias("title"),
    ).cache()


def test_a_hot_term_is_split_in_the_idf_join(spark, hot_titles):
    docs = hot_titles.select(F.col("id").alias("doc_id"), F.lit(1).alias("copies"), F.col("title").alias("text"))
    terms = durable(text_vectors.term_counts(docs).repartition(8))
    idf = durable(text_vectors.fit_idf(terms, text_vectors.row_total(docs)))
    with tiny_thresholds(spark):
        assert "skew=true" in final_plan(text_vectors.tfidf(terms, idf))


def test_a_hot_term_is_split_when_titles_are_scored(spark, hot_titles):
    model = centroids.fit_title_model(hot_titles.select("main_id", "sub_id", "title"))
    weights = durable(centroids.scoring_weights(hot_titles.select(F.col("title").alias("text")), model).repartition(8))
    with tiny_thresholds(spark):
        scored = centroids.predict_main(weights, model)
        assert "skew=true" in final_plan(scored)
        split = values(scored)
    assert split == values(centroids.predict_main(weights, model))


def test_a_hot_id_is_split_in_lookups(spark, hot_titles):
    names = durable(hot_titles.select("main_id", F.lit("n").alias("name")).distinct())
    rows = durable(hot_titles.repartition(8))
    with tiny_thresholds(spark):
        assert "skew=true" in final_plan(catalog.attach_name(rows, names, "main_id", "name"))


def test_large_sides_are_not_broadcast(spark, hot_titles):
    """Nothing carries a hint: with the threshold off, no join broadcasts."""
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1"):
        for name in ("recent_posts", "titles_by_occupation", "title_shortfall", "predict_member", "similar_docs"):
            assert "BroadcastHashJoin" not in final_plan(QUERIES[name](spark, SMALL))


@pytest.mark.parametrize("name", ["title_counts", "new_titles", "similar_docs", "predict_employer", "cosine_scores", "smote_rows", "apply_rules", "sub_prompt"])
def test_no_cross_joins(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["recent_posts"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert any("GreaterThanOrEqual(o_orderdate" in s for s in scans)
    assert not any("l_extendedprice" in s or "p_retailprice" in s or "c_acctbal" in s for s in scans)


def test_top_up_scans_the_titles_once(spark):
    """All later steps read the small table of distinct titles."""
    from registry.inputs import titles
    from titlelab.plans import topup as jobs

    plan = jobs.new_sub_titles(titles(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "part.parquet" not in plan


def test_a_cluster_needs_the_shared_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_written_tables_go_to_the_shared_folder(spark):
    kept = durable(spark.range(3))
    assert kept.count() == 3
    assert all(shared_dir(spark).removeprefix("file:") in f for f in kept.inputFiles())


def test_existing_titles_of_a_hot_group(spark):
    df = spark.range(50_000).select(F.lit(1).alias("g"), (F.col("id") % 20_000).cast("string").alias("title"))
    assert topup.existing_titles(df, ["g"]).count() == 20_000
    assert topup.title_lists(df, ["g"], 10).count() == 0


def test_a_hot_group_is_split_when_rows_are_numbered(spark, hot_titles):
    from titlelab.operators.ranking import numbered_within

    with tiny_thresholds(spark):
        assert "skew=true" in final_plan(numbered_within(hot_titles, ["main_id"], ["id"]))


def test_a_query_with_many_matches_is_split(spark):
    """One query meets most documents; its candidates are scored in several tasks."""
    from titlelab.operators.similarity import scores_above

    texts = spark.range(4000).repartition(8).select(F.col("id").alias("doc_id"), F.concat(F.lit("common w"), F.col("id") % 900).alias("text"))
    docs = texts.withColumn("copies", F.lit(1))
    terms = durable(text_vectors.term_counts(docs))
    w = durable(text_vectors.tfidf_runs(terms, text_vectors.fit_idf(terms, text_vectors.row_total(docs))))
    q = durable(w.where("doc_id < 30").withColumnRenamed("doc_id", "query_id").union(
        spark.sql("select -1L, 'common', 1.0D, 1.0D, 1")))
    with tiny_thresholds(spark):
        got = scores_above(q, w, 0.05)
        assert "skew=true" in final_plan(got)
        assert got.where("query_id = -1").count() == 4000


def test_a_hot_main_is_split_when_predictions_are_resolved(spark, hot_titles):
    """Half of the distinct titles fall to one main; its lookups use several tasks."""
    from titlelab.plans.predict import Catalog, predict_member

    model = centroids.fit_title_model(hot_titles.select("main_id", "sub_id", "title"))
    main = hot_titles.select("main_id", F.col("main_id").cast("string").alias("main_name")).distinct()
    subs = hot_titles.select("main_id", "sub_id", F.col("sub_id").cast("string").alias("sub_name")).distinct()
    asked = hot_titles.select(F.col("id").alias("request_id"), F.col("title").alias("job_title"))
    with tiny_thresholds(spark):
        got = predict_member(asked, Catalog(main, subs), model)
        assert "skew=true" in final_plan(got)
    assert got.count() == 6000


def test_entries_move_to_their_term_and_back_only(spark):
    """Counting moves the lists of words; entries are shuffled for the join with the terms and for their id."""
    from titlelab.operators import estimators

    df = spark.range(40).select("id", F.array(F.lit("a"), F.concat(F.lit("b"), F.col("id") % 7), F.lit("a")).alias("words"))
    entries = estimators.feature_entries(df.union(df.limit(1)), estimators.fit_features(df), "id")
    plan = entries._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 0 and plan.count("Join") == 1
    lengths = entries.groupBy("id").agg(F.round(F.sum(F.col("w") * F.col("w")), 9).alias("n"), F.count("*").alias("terms"))
    assert {(r.n, r.terms) for r in lengths.collect()} == {(1.0, 2)} and lengths.count() == 40
