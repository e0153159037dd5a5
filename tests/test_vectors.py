import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import values
from titlelab.operators import centroids, similarity, text_vectors, word_vectors
from titlelab.operators.labels import vocabulary
from titlelab.plans import similar as similar_plan
from titlelab.plans.similar import similar


def weights(texts):
    """TF-IDF by hand: {id: {term: w}}."""
    docs = {i: t.split() for i, t in texts.items()}
    df = {}
    for words in docs.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items()}
    out = {}
    for i, words in docs.items():
        raw = {w: words.count(w) * idf[w] for w in set(words)}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out[i] = {w: x / norm for w, x in raw.items()}
    return out, idf


def frame(spark, texts, name="doc_id"):
    return spark.createDataFrame(list(texts.items()), f"{name} long, text string")


def test_idf_and_copies(spark):
    df = frame(spark, {1: "aa bb", 2: "aa cc", 3: "aa cc", 4: ""})
    docs = text_vectors.distinct_texts(df, "doc_id")
    assert values(docs.select("doc_id", "copies")) == [(1, 1), (2, 2), (4, 1)]
    idf = {r.term: (r.df, round(r.idf, 9)) for r in text_vectors.fit_idf(text_vectors.document_terms(docs), text_vectors.row_total(df)).collect()}
    assert idf == {"aa": (3, round(math.log(5 / 4) + 1, 9)), "bb": (1, round(math.log(5 / 2) + 1, 9)), "cc": (2, round(math.log(5 / 3) + 1, 9))}
    two = frame(spark, {1: "aa bb", 2: "aa cc"})
    got = text_vectors.fit_idf(text_vectors.document_terms(text_vectors.distinct_texts(two, "doc_id")), text_vectors.row_total(two))
    assert {r.term: round(r.idf, 9) for r in got.collect()} == {"aa": 1.0, "bb": round(math.log(1.5) + 1, 9), "cc": round(math.log(1.5) + 1, 9)}


def random_texts(n, seed, words=40, longest=9):
    rng = random.Random(seed)
    # Common words are far more likely, as in real titles; some texts repeat.
    vocab = [f"w{i}" for i in range(words)]
    odds = [1 / (i + 1) for i in range(words)]
    texts = {i: " ".join(rng.choices(vocab, odds, k=rng.randint(0, longest))) for i in range(n)}
    for i in range(0, n, 7):
        texts[i] = texts[0] if i % 2 else "w0 w1"
    return texts


@pytest.mark.parametrize("min_score, longest", [(0.2, 9), (0.5, 4), (0.05, 20), (0.9, 3)])
def test_bounded_search_equals_brute_force(spark, min_score, longest):
    texts = random_texts(160, int(min_score * 100), longest=longest)
    w, _ = weights(texts)
    df = frame(spark, texts)
    docs = df.withColumn("copies", F.lit(1))
    terms = text_vectors.term_counts(docs)
    table = text_vectors.tfidf_runs(terms, text_vectors.fit_idf(terms, text_vectors.row_total(df)))
    found = similarity.scores_above(table.withColumnRenamed("doc_id", "query_id"), table, min_score)
    got = {(r.query_id, r.doc_id): r.score for r in found.collect()}
    want = {}
    for a in w:
        for b in w:
            score = sum(x * w[b].get(t, 0) for t, x in w[a].items())
            if round(score, 8) > min_score:
                want[a, b] = round(score, 8)
    assert got == pytest.approx(want, abs=2e-8)


@pytest.mark.parametrize("block", [1024, 9])
def test_similar_report_equals_brute_force(spark, monkeypatch, block):
    top = similarity.top_in_blocks
    monkeypatch.setattr(similar_plan, "top_in_blocks", lambda q, c, n, least: top(q, c, n, least, block))
    corpus, asked = random_texts(120, 1), random_texts(40, 2)
    both, idf = weights(corpus)
    found = similar(frame(spark, asked, "q"), frame(spark, corpus), "q", "doc_id")
    got = sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in found.collect())
    want = []
    for i, text in asked.items():
        words = [t for t in text.split() if t in idf]
        raw = {t: words.count(t) * idf[t] for t in set(words)}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1
        scores = [(round(sum(x / norm * both[d].get(t, 0) for t, x in raw.items()), 8), d) for d in corpus]
        best = sorted([(-s, d) for s, d in scores if s > 0.2])[:3]
        want += [(i, at, d, round(-s, 6)) for at, (s, d) in enumerate(best, 1)]
    assert got == sorted(want)


def test_tasks_that_count_words_grow_with_the_texts(spark, monkeypatch):
    texts = random_texts(120, 3)
    df = frame(spark, texts)
    want = values(similar(df.withColumnRenamed("doc_id", "q"), df, "q", "doc_id"))
    monkeypatch.setattr(text_vectors, "TASK_CHARS", 100)
    rows = similar_plan._keyed(df, "doc_id", "text")
    tasks = text_vectors.counting_tasks(rows)
    assert tasks == -(-sum(map(len, texts.values())) // 100) > 4
    assert similar_plan._counts(similar_plan._representatives(rows), tasks).rdd.getNumPartitions() == tasks
    assert values(similar(df.withColumnRenamed("doc_id", "q"), df, "q", "doc_id")) == want
    assert text_vectors.counting_tasks(rows.limit(0)) == 1
    assert text_vectors.term_counts(rows, ["id"], tasks=7).rdd.getNumPartitions() == 7
    assert values(text_vectors.term_counts(rows, ["id"], tasks=7)) == values(text_vectors.term_counts(rows, ["id"]))


def test_common_terms_alone_pair_nothing(spark):
    """A word in every title meets only titles it could matter for."""
    n = 400
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("manager x"), F.col("id"), F.lit(" y"), F.col("id")).alias("text"))
    docs = text_vectors.distinct_texts(df, "doc_id")
    terms = text_vectors.term_counts(docs)
    w = text_vectors.tfidf_runs(terms, text_vectors.fit_idf(terms, text_vectors.row_total(df)))
    got = similarity.scores_above(w.withColumnRenamed("doc_id", "query_id"), w)
    assert got.count() == n and got.where("query_id <> doc_id").count() == 0


def test_cosine_scores(spark):
    texts = {1: "aa bb", 2: "bb cc", 3: "dd"}
    w, _ = weights(texts)
    df = frame(spark, texts)
    terms = text_vectors.term_counts(df.withColumn("copies", F.lit(1)))
    table = text_vectors.tfidf(terms, text_vectors.fit_idf(terms, text_vectors.row_total(df)))
    scores = similarity.cosine_scores(table.withColumnRenamed("doc_id", "query_id"), table)
    got = {(r.query_id, r.doc_id): round(r.score, 9) for r in scores.collect()}
    assert got[1, 2] == round(w[1]["bb"] * w[2]["bb"], 9) and got[1, 1] == 1.0 and (1, 3) not in got


def test_weights_of_wanted_terms_only(spark):
    """Other terms count for the length; ids that are null or repeated are one document."""
    rows = [(i % 37 if i % 9 else None, t) for i, t in random_texts(60, 5).items()]
    df = spark.createDataFrame([*rows, (50, None), (51, "")], "doc_id long, text string")
    terms = text_vectors.term_counts(df, ["doc_id"])
    idf = text_vectors.fit_idf(terms.withColumn("copies", F.lit(1)), text_vectors.row_total(df))
    wanted = terms.select("term").distinct().orderBy("term").limit(5).union(spark.createDataFrame([("unseen",)], "term string"))
    rounded = lambda t: values(t.withColumn("w", F.round("w", 9)))
    some = text_vectors.tfidf(terms, idf, wanted=wanted)
    assert rounded(some) == rounded(text_vectors.tfidf(terms, idf).join(wanted, "term", "left_semi").select("doc_id", "term", "df", "w"))
    assert "Window" not in some._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_moved_before_they_are_cut_into_terms(spark):
    terms = text_vectors.term_counts(frame(spark, {1: "aa bb aa", 2: "cc"}), ["doc_id"])
    plan = terms._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.find("Generate explode") < plan.find("Exchange")
    assert terms._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_mean_vector_ignores_unknown_words(spark):
    df = spark.createDataFrame([(1, ["a", "zz"]), (2, ["a", "a", "b"]), (3, ["zz"]), (4, [])], "id int, words array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [4.0, 8.0])], "word string, vec array<double>")
    got = {r.id: [round(x, 9) for x in r.vec] for r in word_vectors.mean_vector(df, vectors, "id", "words", 2).collect()}
    assert got == {1: [1.0, 2.0], 2: [2.0, 4.0], 3: [0.0, 0.0], 4: [0.0, 0.0]}


def test_encode_sequence_pads_and_cuts(spark):
    vocab = spark.createDataFrame([("aa", 2), ("bb", 3), ("cc", 4), ("dd", 5)], "term string, term_id int")
    df = spark.createDataFrame([(1, "aa, bb!"), (2, "aa bb cc dd aa"), (3, "zz aa"), (4, "")], "id int, text string")
    got = {r.id: (list(r.input_ids), list(r.attention_mask)) for r in word_vectors.encode_sequence(df, vocab, "id", max_len=4).collect()}
    assert got == {1: ([2, 3, 0, 0], [1, 1, 0, 0]), 2: ([2, 3, 4, 5], [1, 1, 1, 1]), 3: ([1, 2, 0, 0], [1, 1, 0, 0]), 4: ([0, 0, 0, 0], [0, 0, 0, 0])}


def test_vocabulary_orders_by_frequency(spark):
    terms = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9)], "term string, df long")
    assert dict(vocabulary(terms).collect()) == {"c": 2, "a": 3, "b": 4}


def test_top_classes(spark):
    df = spark.createDataFrame([(1, [0.1, 0.4, 0.4, 0.1])], "id int, p array<double>")
    assert values(word_vectors.top_classes(df, "id", "p")) == [(1, 1, 1, 0.4), (1, 2, 2, 0.4), (1, 3, 0, 0.1)]


def test_word2vec_knows_every_word(spark):
    df = spark.createDataFrame([("red rod!",), ("Red bolt",), ("",)], "text string")
    table = word_vectors.word_table(word_vectors.word2vec(df, dim=4)).collect()
    assert sorted(r.word for r in table) == ["bolt", "red", "rod"] and all(len(r.vec) == 4 for r in table)


@pytest.mark.parametrize("iterations", [1, 3])
def test_word2vec_is_a_table_and_brings_neighbours_together(spark, monkeypatch, iterations):
    monkeypatch.setattr(word_vectors, "BLOCK_WORDS", 5_000)
    pick = random.Random(1)
    groups = [[f"{g}{i}" for i in range(10)] for g in "abcd"]
    texts = [" ".join(pick.choices(pick.choice(groups), k=12)) for _ in range(3000)] + ["lonely", None]
    model = word_vectors.word2vec(spark.createDataFrame([(t,) for t in texts], "text string"), dim=16, iterations=iterations, partitions=2)
    assert {r.word: r.times for r in model.vectors.collect()} == Counter(w for t in texts if t for w in t.split())
    unit = {r.word: np.array(r.vec) / np.linalg.norm(r.vec) for r in word_vectors.word_table(model).collect()}
    near = np.mean([unit[a] @ unit[b] for g in groups for a in g for b in g if a != b])
    far = np.mean([unit[a] @ unit[b] for g in groups for h in groups if g != h for a in g for b in h])
    assert near > far + 0.02


def test_hierarchy_stays_inside_the_main(spark):
    data = [(1, 10, "red rod"), (1, 10, "red rod"), (1, 11, "blue rod"), (2, 20, "green nut"), (2, 21, "red nut")]
    history = spark.createDataFrame(data, "main_id int, sub_id int, title string")
    model = centroids.fit_title_model(history)
    asked = spark.createDataFrame([(1, "RED rod!"), (2, "nut red"), (3, "unknown"), (4, "")], "id int, title string")
    got = {r.id: (r.main_id, r.sub_id) for r in centroids.predict_hierarchy(asked, model).collect()}
    assert got == {1: (1, 10), 2: (2, 21), 3: (None, None), 4: (None, None)}


def test_centroids_have_unit_length_and_weigh_copies(spark):
    members = spark.createDataFrame([(1, "aa", 3), (1, "bb", 1)], "main_id int, text string, copies long")
    w = spark.createDataFrame([("aa", "aa", 1.0), ("bb", "bb", 1.0)], "text string, term string, w double")
    sums = centroids.class_sums(members, w, ["main_id"])
    got = {r.term: r.w for r in centroids.fit_centroids(sums, ["main_id"]).collect()}
    assert np.allclose([got["aa"], got["bb"]], np.array([3, 1]) / math.sqrt(10))
