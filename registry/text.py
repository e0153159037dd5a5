"""TF-IDF, similar texts, word vectors, token sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.inputs import TITLES_SQL, col, lit, strip_sql, titles, tokens_sql
from titlelab.functions.text import tokens
from titlelab.operators import text_vectors as tv
from titlelab.operators import word_vectors as wv
from titlelab.operators.labels import vocabulary
from titlelab.operators.ranking import numbered
from titlelab.operators.similarity import SCORE_DIGITS, cosine_scores, scores_above
from titlelab.plans.similar import similar
from titlelab.session import durable
from titlelab.sources.tables import read_table

# Terms, idf and unit weights of the documents table (d, tf, idf) and of benchmark (q).
_IDF = f"""d AS (SELECT doc_id, unnest({tokens_sql(strip_sql('text'))}) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
    idf AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term)"""
_Q = f"""qt AS (SELECT item_id, unnest({tokens_sql(strip_sql('text'))}) AS term FROM benchmark),
    qf AS (SELECT item_id, term, count(*) AS tf FROM qt GROUP BY ALL),
    qr AS (SELECT item_id, term, tf * idf AS x FROM qf JOIN idf USING (term)),
    q AS (SELECT item_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS w FROM qr)"""
_C = """cr AS (SELECT doc_id, term, tf * idf AS x FROM tf JOIN idf USING (term)),
    c AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS w FROM cr)"""


def _documents_idf(spark, sf):
    docs = read_table(spark, "documents", sf)
    return tv.fit_idf(tv.document_terms(tv.distinct_texts(docs, "doc_id")), tv.row_total(docs))


@query("tfidf_idf", f"WITH {_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def tfidf_idf(spark, sf):
    return _documents_idf(spark, sf).select("term", "df", F.round("idf", 6).alias("idf"))


@query("tfidf", f"WITH {_IDF}, {_Q} SELECT item_id, term, round(w, 6) AS w FROM q")
def tfidf(spark, sf):
    """Weights of benchmark texts under the documents' idf."""
    items = read_table(spark, "benchmark", sf).select("item_id", tv.clean_text("text").alias("text"))
    weights = tv.tfidf(tv.term_counts(items, ["item_id"]), _documents_idf(spark, sf), ["item_id"])
    return weights.select("item_id", "term", F.round("w", 6).alias("w"))


@query(
    "similar_docs",
    f"""WITH {_IDF}, {_Q}, {_C}, s AS (SELECT item_id, doc_id, round(sum(q.w * c.w), 8) AS score
      FROM q JOIN c USING (term) GROUP BY ALL),
    r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
      FROM s WHERE score > 0.2)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 3""",
)
def similar_docs(spark, sf):
    found = similar(
        read_table(spark, "benchmark", sf), read_table(spark, "documents", sf), "item_id", "doc_id"
    )
    return found.withColumnRenamed("query_id", "item_id")


@query(
    "benchmark_scores",
    f"""WITH {_IDF}, {_Q}, {_C} SELECT item_id, doc_id, round(sum(q.w * c.w), 8) AS score
      FROM q JOIN c USING (term) GROUP BY ALL""",
)
def benchmark_scores(spark, sf):
    """Every score that is not zero between the benchmark's texts and the documents."""
    docs, items = read_table(spark, "documents", sf), read_table(spark, "benchmark", sf)
    cleaned = docs.select("doc_id", tv.clean_text("text").alias("text"))
    terms = durable(tv.term_counts(cleaned, ["doc_id"], tasks=tv.counting_tasks(docs)))
    idf = tv.fit_idf(terms.select("term", lit(1).alias("copies")), tv.row_total(docs))
    asked = durable(tv.term_counts(items.select(col("item_id").alias("query_id"), tv.clean_text("text").alias("text")), ["query_id"]))
    corpus = tv.tfidf(terms, idf, wanted=asked.select("term").distinct())
    scores = cosine_scores(durable(tv.tfidf(asked, idf, ["query_id"])), corpus)
    return scores.select(col("query_id").alias("item_id"), "doc_id", F.round("score", SCORE_DIGITS).alias("score"))


_TITLE_W = f"""t AS (SELECT title, count(*) AS m FROM (SELECT {strip_sql('title')} AS title FROM ({TITLES_SQL})) GROUP BY ALL),
    tt AS (SELECT title, unnest({tokens_sql('title')}) AS term FROM t),
    tc AS (SELECT title, term, count(*) AS tf FROM tt GROUP BY ALL),
    ti AS (SELECT term, ln((1 + (SELECT sum(m) FROM t)) / (1 + sum(m))) + 1 AS idf FROM tc JOIN t USING (title) GROUP BY term),
    tx AS (SELECT title, term, tf * idf AS x FROM tc JOIN ti USING (term)),
    tw AS (SELECT title, term, x / sqrt(sum(x * x) OVER (PARTITION BY title)) AS w FROM tx)"""


@query(
    "cosine_scores",
    f"""WITH {_TITLE_W} SELECT a.title AS query_id, b.title AS doc_id, round(round(sum(a.w * b.w), 8), 6) AS score
    FROM tw a JOIN tw b USING (term) GROUP BY ALL HAVING round(sum(a.w * b.w), 8) > 0.2""",
)
def cosine_scores_query(spark, sf):
    """Scores above the report's bound between the distinct titles of the parts table."""
    cleaned = titles(spark, sf).select(tv.clean_text("title").alias("text"))
    docs = cleaned.groupBy("text").agg(F.count("*").alias("copies"))
    terms = tv.term_counts(docs.withColumn("doc_id", col("text")))
    w = durable(tv.tfidf_runs(terms, tv.fit_idf(terms, tv.row_total(cleaned))))
    scores = scores_above(w.withColumnRenamed("doc_id", "query_id"), w)
    return scores.withColumn("score", F.round("score", 6))


@query(
    "mean_vector",
    f"""WITH t AS (SELECT id, unnest({tokens_sql('title')}) AS word FROM ({TITLES_SQL})),
    v AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS n FROM (SELECT DISTINCT word FROM t)),
    k AS (SELECT word, embedding FROM v JOIN embeddings ON vec_id = n WHERE n < (SELECT count(*) FROM v) - 2),
    e AS (SELECT id, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM t JOIN k USING (word)),
    m AS (SELECT id, pos, avg(x) AS x FROM e GROUP BY ALL)
    SELECT id, coalesce(round(max(x) FILTER (pos = 1), 6), 0) AS v1, coalesce(round(max(x) FILTER (pos = 2), 6), 0) AS v2,
      coalesce(round(max(x) FILTER (pos = 64), 6), 0) AS v64, coalesce(round(sum(x), 6), 0) AS total
    FROM ({TITLES_SQL}) LEFT JOIN m USING (id) GROUP BY id""",
)
def mean_vector(spark, sf):
    """Words take the embeddings in alphabetical order; the last two stay unknown."""
    rows = titles(spark, sf).select("id", tokens("title").alias("words"))
    words = rows.select(F.explode("words").alias("word")).distinct()
    ranked = numbered(words, ["word"], "_no", distinct=True).withColumn("vec_id", col("_no") - 1)
    known = ranked.where(col("vec_id") < words.agg(F.count("*")).scalar() - 2)
    vectors = read_table(spark, "embeddings", sf).select("vec_id", col("embedding").alias("vec"))
    means = wv.mean_vector(rows, known.join(vectors, "vec_id"), "id", "words", 64)
    total = F.aggregate("vec", lit(0.0), lambda a, x: a + x)
    picked = [F.round(F.get("vec", lit(i - 1)), 6).alias(f"v{i}") for i in (1, 2, 64)]
    return means.select("id", *picked, F.round(total, 6).alias("total"))


@query(
    "encode_sequence",
    f"""WITH {_IDF}, v AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) + 1 AS term_id FROM idf),
    b AS (SELECT item_id, {tokens_sql(strip_sql('text'))}[1:64] AS words FROM benchmark),
    w AS (SELECT item_id, generate_subscripts(words, 1) AS pos, unnest(words) AS term FROM b),
    i AS (SELECT item_id, pos, coalesce(term_id, 1) AS term_id FROM w LEFT JOIN v USING (term)),
    l AS (SELECT item_id, string_agg(CAST(term_id AS VARCHAR), ',' ORDER BY pos) AS ids, count(*) AS n FROM i GROUP BY item_id)
    SELECT item_id, concat(ids, repeat(CASE WHEN ids IS NULL THEN '0,' ELSE ',0' END, 64 - coalesce(n, 0))) AS input_ids,
      CAST(coalesce(n, 0) AS INTEGER) AS n_words FROM benchmark LEFT JOIN l USING (item_id)""",
)
def encode_sequence(spark, sf):
    items = read_table(spark, "benchmark", sf)
    coded = wv.encode_sequence(items, vocabulary(_documents_idf(spark, sf)), "item_id")
    ids = F.concat_ws(",", F.transform("input_ids", lambda x: x.cast("string")))
    mask = F.aggregate("attention_mask", lit(0), lambda a, x: a + x)
    return coded.select("item_id", ids.alias("input_ids"), mask.alias("n_words"))


@query(
    "word2vec",
    f"""SELECT DISTINCT word, 100 AS entries, true AS finite FROM
    (SELECT unnest({tokens_sql(strip_sql('text'))}) AS word FROM documents)""",
)
def word2vec(spark, sf):
    """A vector for every word of the documents; its entries are numeric work SQL can't repeat."""
    words = wv.word_table(wv.word2vec(read_table(spark, "documents", sf)))
    finite = F.forall("vec", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return words.select("word", F.size("vec").alias("entries"), finite.alias("finite"))
