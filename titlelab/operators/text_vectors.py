"""TF-IDF as tables: one row per (document, term).

Weights are ``tf * (ln((1 + n) / (1 + df)) + 1)``, scaled to unit length per document.
Copies of a text are folded into one document with a ``copies`` count before any term is
produced, so a text that makes up a third of the table costs one row in every later step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from titlelab.functions.text import strip_punct, tokens
from titlelab.session import durable

# Characters of text whose words one task counts; the number of tasks grows with the texts.
TASK_CHARS = 2_000_000


def clean_text(value: Column | str) -> Column:
    """The cleaning applied to both training and query text."""
    return strip_punct(value)


def distinct_texts(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """One row per distinct cleaned text: ``(doc_id, text, copies)``; the lowest id stands
    for all copies."""
    cleaned = df.select(F.col(id_col).alias("doc_id"), clean_text(text).alias("text"))
    folded = cleaned.groupBy("text").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")
    )
    return folded.select("doc_id", "text", "copies")


def counting_tasks(rows: DataFrame, text: str = "text") -> int:
    """Number of tasks that count the words of ``rows``, so that a task's table of terms is bounded."""
    return -(-(rows.agg(F.sum(F.length(text))).first()[0] or 1) // TASK_CHARS)


def term_counts(
    docs: DataFrame, id_cols: Sequence[str] = ("doc_id", "copies"), text: str = "text", tasks: int | None = None
) -> DataFrame:
    """``(ids..., term, tf)`` for cleaned text. Texts are moved to their ids before they are cut into
    terms, so counting moves each text once and no terms; ``tasks`` (see ``counting_tasks``) count them."""
    to = id_cols if tasks is None else (tasks, *id_cols)
    whole = docs.select(*id_cols, F.col(text).alias("_text")).repartition(*to)
    words = whole.select(*id_cols, F.explode(tokens("_text")).alias("term"))
    return words.groupBy(*id_cols, "term").agg(F.count("*").alias("tf"))


def document_terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(copies, term)``, each document's terms once. Enough for an idf table, and
    cheaper than counting: terms are made distinct inside the row."""
    return docs.select("copies", F.explode(F.array_distinct(tokens(text))).alias("term"))


def fit_idf(terms: DataFrame, total: Column) -> DataFrame:
    """Fitted table ``(term, df, idf)`` from rows ``(copies, term)``, one per document and term.

    ``total`` counts every document, copies and documents without terms included.
    """
    counts = terms.groupBy("term").agg(F.sum("copies").alias("df"))
    smoothed = F.log((F.lit(1) + total) / (F.lit(1) + F.col("df"))) + 1
    return durable(counts.withColumn("idf", smoothed))


def row_total(df: DataFrame) -> Column:
    """Number of rows as a scalar subquery (answered from file footers where possible)."""
    return df.agg(F.count("*")).scalar()


def _raw_weights(terms: DataFrame, idf: DataFrame) -> DataFrame:
    """Weights before scaling; unknown terms are dropped here."""
    return terms.join(idf, "term").withColumn("_x", F.col("tf") * F.col("idf"))


def tfidf(terms: DataFrame, idf: DataFrame, id_cols: Sequence[str] = ("doc_id",), wanted: DataFrame | None = None) -> DataFrame:
    """Unit-length weights ``(ids..., term, df, w)``.

    With ``wanted``, a table of distinct ``term``, only these terms' weights are returned; all others count
    for the length of a document and are summed up before they are moved."""
    if wanted is None:
        norm = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(W.partitionBy(*id_cols)))
        return _raw_weights(terms, idf).select(*id_cols, "term", "df", (F.col("_x") / norm).alias("w"))
    marked = durable(idf.join(wanted.select("term", F.lit(True).alias("_wanted")), "term", "left"))
    entry = F.when(F.col("_wanted"), F.struct("term", "df", F.col("_x").alias("x")))
    lists = _raw_weights(terms, marked).groupBy(*id_cols).agg(F.sum(F.col("_x") * F.col("_x")).alias("_square"), F.collect_list(entry).alias("_e"))
    each = lists.select(*id_cols, "_square", F.explode("_e").alias("_e"))
    return each.select(*id_cols, "_e.term", "_e.df", (F.col("_e.x") / F.sqrt("_square")).alias("w"))


def tfidf_runs(terms: DataFrame, idf: DataFrame, id_cols: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Unit-length weights with what a bounded search needs: ``(ids..., term, w, run, pos)``.

    A document's terms are taken from the most to the least common, an order all documents
    share. ``pos`` is a term's place in it; ``run`` adds up the squared weights to there.
    Scaling and order come out of the same shuffle.
    """
    document = W.partitionBy(*id_cols)
    common_first = document.orderBy(F.col("df").desc(), "term")
    square = F.col("_x") * F.col("_x")
    total = F.sum(square).over(document)
    up_to = common_first.rowsBetween(W.unboundedPreceding, W.currentRow)
    return _raw_weights(terms, idf).select(
        *id_cols,
        "term",
        (F.col("_x") / F.sqrt(total)).alias("w"),
        (F.sum(square).over(up_to) / total).alias("run"),
        F.row_number().over(common_first).alias("pos"),
    )
