"""Joins, components, top-k search and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from titlelab.llm import graph, jaccard, packing, topk


def near_copies(seed):
    """Texts in groups of edited copies, among unrelated ones."""
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    texts = [None, "", "  ", "one", "ONE", "one two three", "one two  three"]
    for group in range(12):
        base = [pick.choice(words) for _ in range(pick.randint(30, 200))]
        for _ in range(pick.randint(1, 9)):
            copy = list(base)
            for _ in range(pick.randint(0, 3)):
                copy[pick.randrange(len(copy))] = pick.choice(words)
            texts.append(" ".join(copy))
    return texts


def brute_force(texts, n, least):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    links, root = [0] * len(texts), list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= least * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return [(i, links[i], root[i]) for i in range(len(texts))]


@pytest.mark.parametrize("block", [2048, 3])
def test_join_equals_brute_force(spark, block):
    texts = near_copies(1)
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, class_id int").repartition(3)
    got = sorted((r["doc_id"], r["n_links"], r["class_id"]) for r in jaccard.join(docs, block=block).collect())
    assert got == brute_force(texts, jaccard.WORDS, jaccard.LEAST)


def test_join_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "A b c"), (None, "a b c"), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_links"], r["class_id"], r["copy_of"]) for r in jaccard.join(docs).collect())
    assert got == [(0, 0, None, None), (1, 1, 1, 1), (2, 1, 1, 1), (3, 0, 3, 3)]
    assert jaccard.join(docs.limit(0)).count() == 0


def test_prefix_is_shortened_until_the_recall_is_met():
    for recall in (0.5, 0.9, 0.99, 0.9999):
        length = jaccard.prefix_length(0.8, 24, 8, recall)
        assert 1 - (1 - 0.8**length) ** 24 >= recall
        assert length == 8 or 1 - (1 - 0.8 ** (length + 1)) ** 24 < recall


def test_components_equal_union_find(spark):
    pick = random.Random(3)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = {k: low if v == high else v for k, v in root.items()}
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def best_by_brute_force(rows, k):
    usable = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in usable:
        if q % 50 == 0:
            ranked = sorted((-sum(a * b for a, b in zip(usable[q], usable[c])), c) for c in usable if c != q and len(usable[c]) == len(usable[q]))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(ranked[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_top_k_equals_brute_force(spark, monkeypatch, scale):
    pick = np.random.default_rng(1)
    rows = [(i, (scale * pick.normal(size=40)).round(2).tolist(), None) for i in range(260)]
    rows += [(1000 + i, [float(scale)] * 40, None) for i in range(60)]  # ties
    rows += [(300, None, None), (350, [], None), (400, [float("nan")] * 40, None), (450, [None] * 40, None), (550, [1.0, float("inf")], None), (600, [1.0], None)]
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 4)
    whole = topk.quantised(vectors(spark, rows), "vec_id", "embedding")
    got = sorted(tuple(r) for r in topk.nearest(whole, whole.where("id % 50 = 0")).collect())
    assert got == best_by_brute_force(rows, 5)


def test_top_k_of_few_rows(spark):
    whole = topk.quantised(vectors(spark, [(0, [1.0], None), (50, [2.0], None), (50, [2.0], None)]), "vec_id", "embedding")
    got = sorted(tuple(r) for r in topk.nearest(whole, whole).collect())
    assert got == [(0, 1, 50, 131072), (50, 1, 0, 131072)]
    assert topk.nearest(whole.limit(0), whole.limit(0)).count() == 0


def test_wide_numbers_are_exact():
    big = np.array([[3.0 * 2**40], [1.0]])
    got = topk.search(big, np.array([[1.0 * 2**20, 2.0], [5.0, 7.0]]), np.array([9]), np.array([1, 2]), 2)
    assert got == [(0, 0, 3 * 2**60 + 5), (0, 1, 3 * 2**41 + 7)]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "1 2 3", "en", "s", 5)], docs.schema)
    docs = docs.unionByName(odd).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        kept = kept.cache()
        assert kept.columns == columns and kept.schema.simpleString() == docs.schema.simpleString()
        assert kept.join(docs, "doc_id", "left_anti").count() == 0
        if name == "language identification":
            assert kept.where("doc_id < 0").count() == 0 and kept.count() == before.where("text rlike '\\\\p{L}'").count()
        if name == "quality classifier":
            bad = spark.read.parquet(f"{SMALL}/labels.parquet").join(kept, "doc_id")
            assert bad.where("quality = 1").count() > 0 and bad.where("quality = 0").count() < 0.1 * docs.count()
        if name == "n-gram Jaccard join":
            texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
            classes = {r[2] for r in brute_force(texts, jaccard.WORDS, jaccard.LEAST)}
            assert kept.count() == len(classes)
        if name == "secret scan":
            assert kept.count() == docs.count()
            assert kept.where(F.col("text").rlike("AKIA[A-Z0-9]{16}|[0-9a-f]{24}")).count() == 0
            assert kept.where("n_chars <> length(text)").count() == 0
        docs = kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(f"n > {packing.SIZE}").count() == 0


def dedup(spark, docs):
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    return stage(spark, docs, SMALL)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicate_stage_keeps_texts_that_share_an_id(spark):
    pick = random.Random(2)
    one, two, three = (" ".join(f"{x}{pick.randrange(10**6)}" for _ in range(60)) for x in "abc")
    rows = [(1, one, "en", "s", 1), (1, two, "en", "s", 2), (1, one.upper(), "de", "s", 3), (2, two, "en", "s", 4), (3, three, "en", "z", 5)]
    rows += [(3, three, "en", "a", 5)] * 3 + [(None, three, "en", "s", 6), (None, "alone", "en", "s", 7), (None, "alone", "en", "s", 7)]
    found = [sorted((r["doc_id"] or 0, r["text"].lower()[:9]) for r in dedup(spark, spark.createDataFrame(rows, DOCS).repartition(n)).collect()) for n in (1, 4)]
    assert found[0] == found[1] == sorted([(1, one[:9]), (1, two[:9]), (3, three[:9]), (0, "alone")])
    kept = [dedup(spark, spark.createDataFrame(rows[::step], DOCS).repartition(n)).where("doc_id = 3").collect() for step in (1, -1) for n in (1, 4)]
    assert all(k == kept[0] for k in kept)


def test_near_duplicate_stage_equals_brute_force_on_shared_ids(spark):
    texts = near_copies(4)
    pick = random.Random(5)
    ids = [pick.choice([None, *range(40)]) for _ in texts]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in zip(ids, texts)], DOCS)
    n_classes = len({r[2] for r in brute_force([t for t in texts if t and t.strip()], jaccard.WORDS, jaccard.LEAST)})
    n_blank = len({(i, t) for i, t in zip(ids, texts) if not (t and t.strip())})
    assert dedup(spark, docs).count() == n_classes + n_blank


def test_pipeline_stages_on_odd_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    clashing = docs.limit(60).selectExpr("*", "1 AS row_key", "'x' AS class_id", "2 AS score", "3 AS predicted", "map('a', 1) AS spans", "4 AS shared_id")
    long_text = " ".join(r["text"] for r in docs.limit(200).collect()) * 5
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, long_text, "en", "s", len(long_text))] * 2, docs.schema
    ).selectExpr("*", "1 AS row_key", "'x' AS class_id", "2 AS score", "3 AS predicted", "map('a', 1) AS spans", "4 AS shared_id")
    for table in (clashing.unionByName(odd), clashing.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, table, SMALL)
            assert kept.columns == table.columns
            table = kept.cache()
        pieces = corpus_pipeline.STAGES[-1][1](spark, table, SMALL)
        assert pieces.select("doc_id").distinct().count() == table.select("doc_id").distinct().count()


def test_pipeline_runs_from_the_tables(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
