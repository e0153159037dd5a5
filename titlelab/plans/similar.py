"""Similar titles report: the best matches of each query in a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelab.functions.text import tokens
from titlelab.operators.labels import vocabulary
from titlelab.operators.ranking import cap_per_group
from titlelab.operators.similarity import MIN_SCORE, TOP_SIMILAR, top_in_blocks, top_similar
from titlelab.operators.text_vectors import clean_text, counting_tasks, fit_idf
from titlelab.session import durable


def similar(
    queries: DataFrame,
    corpus: DataFrame,
    query_id: str,
    doc_id: str,
    text: str = "text",
    n: int = TOP_SIMILAR,
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: up to ``n`` documents above ``min_score``.

    Either side is read and cleaned once. Copies of a text are scored once; they score alike and
    ties go to the lower id, so the ``n`` best texts, by lowest id, hold the ``n`` best rows. Of the corpus
    only the terms of the queries are kept with their weights; all others count for the length
    of a text and are summed up.
    """
    c_rows, q_rows = _keyed(corpus, doc_id, text), _keyed(queries, query_id, text)
    terms = durable(_counts(_representatives(c_rows), counting_tasks(c_rows)))
    idf = fit_idf(terms, c_rows.agg(F.count("*")).scalar())
    q_terms = _counts(_representatives(q_rows), counting_tasks(q_rows)).join(idf, "term").withColumn("x", F.col("tf") * F.col("idf"))
    q_terms = durable(q_terms.select("id", "term", "df", "x"))
    numbers = vocabulary(q_terms.select("term", "df").distinct(), first_id=0)
    c = _unit(terms.join(idf.drop("df"), "term").withColumn("x", F.col("tf") * F.col("idf")), numbers)
    best = durable(top_in_blocks(_unit(q_terms, numbers), c, n, min_score))

    listed = best.select("doc_id").distinct()
    texts = listed.join(c_rows.groupBy("digest").agg(F.min("id").alias("doc_id")), "doc_id")
    copies = c_rows.select("digest", F.col("id").alias("copy_id")).join(durable(texts), "digest")
    lowest = cap_per_group(copies, ["doc_id"], n, ["copy_id"], "_at").select("doc_id", "copy_id")
    every = best.join(lowest, "doc_id").select("query_id", F.col("copy_id").alias("doc_id"), "score")
    ranked = top_similar(every, n, min_score)
    asked = q_rows.groupBy("digest").agg(F.min("id").alias("query_id"))
    again = q_rows.select("digest", F.col("id").alias("copy_id")).join(durable(asked), "digest")
    return ranked.join(again, "query_id").select(F.col("copy_id").alias("query_id"), "rank", "doc_id", "score")


def _keyed(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, digest, text)`` of every row, cleaned and written once: the only pass over the source."""
    cleaned = df.select(F.col(id_col).alias("id"), clean_text(text).alias("text"))
    return durable(cleaned.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), "text"))


def _representatives(rows: DataFrame) -> DataFrame:
    """One row for each text: its lowest id and its copies. Only these are cut into words."""
    return rows.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("text").alias("text"))


def _counts(rows: DataFrame, tasks: int) -> DataFrame:
    """``(id, copies, term, tf)`` of representatives. They lie by digest, so counting a text's terms with its
    digest among the keys moves nothing; a task holds the terms of a bounded number of characters."""
    each = rows.repartition(tasks, "digest").select("digest", "id", "copies", F.explode(tokens("text")).alias("term"))
    return each.groupBy("digest", "id", "copies", "term").agg(F.count("*").alias("tf")).drop("digest")


def _unit(weighed: DataFrame, numbers: DataFrame) -> DataFrame:
    """``(id, terms, weights)`` of the numbered terms, scaled to the length of all terms, from ``(id, term, x)``."""
    entry = F.when(F.col("term_id").isNotNull(), F.struct("term_id", "x"))
    rows = weighed.join(numbers, "term", "left").groupBy("id").agg(
        F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_norm"), F.array_sort(F.collect_list(entry)).alias("e")
    )
    # as a lambda's argument the norm is computed once for a row
    scaled = F.transform(F.array("_norm"), lambda m: F.transform("e.x", lambda x: x / m))[0]
    return rows.where(F.size("e") > 0).select("id", F.col("e.term_id").alias("terms"), scaled.alias("weights"))
