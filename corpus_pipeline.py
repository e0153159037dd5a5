"""From raw documents to packed training sequences, stage by stage.

Each stage reads what the one before it wrote. The first four return the columns of documents;
the last one returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlelab.llm import jaccard, langid, packing, quality, secrets
from titlelab.llm.common import table
from titlelab.session import durable

#: A document is rejected if its language is less likely than this.
LEAST_SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no clear language, go; a missing ``lang`` is filled in."""
    model = langid.fit(docs)
    judged = langid.predict(docs.select(*_held(docs)), model, text=_name(docs, "text"))
    kept = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE))
    lang = F.coalesce(F.col(_name(docs, "lang")), F.col("lang_pred"))
    return kept.select(*[(lang if c == "lang" else F.col(_name(docs, c))).alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the quality threshold go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality.score(docs.select(*_held(docs)), model, text=_name(docs, "text"))
    return _released(judged.where("predicted = 1"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays.

    Rows are compared by text, also those that share an id or have none: different texts of one id
    are different documents. Where several rows hold the smallest id and the same text, one stays,
    the one whose other columns have the least hash. Documents with an id come before those without.
    """
    named = docs.select(*_held(docs))
    doc_id, text = F.col(_name(docs, "doc_id")), F.col(_name(docs, "text"))
    texts = F.xxhash64(F.coalesce(text, F.lit("")))
    shared = named.groupBy(doc_id.alias("shared_id")).agg(F.min(texts).alias("low"), F.max(texts).alias("high"))
    shared = durable(shared.where("low < high AND shared_id IS NOT NULL").select("shared_id"))
    # ids name their row, unless several texts share one; those rows, and rows without an id, go by a hash
    rows = named.join(shared, doc_id == F.col("shared_id"), "left")
    rows = rows.withColumn("row_key", F.when(F.col("shared_id").isNull(), doc_id)).drop("shared_id")
    rows = durable(rows.withColumn("row_key", F.coalesce("row_key", F.xxhash64(doc_id, text))))

    classes = jaccard.join(rows, text=_name(docs, "text"), key="row_key").select(F.col("doc_id").alias("row_key"), "class_id")
    ids = rows.groupBy("row_key").agg(F.min(doc_id).alias("id"))
    first = classes.join(ids, "row_key").groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row_key"))).alias("first"))
    kept = rows.join(first.select("first.row_key"), "row_key", "left_semi")
    plain = [c for c in named.columns if "map<" not in named.schema[c].dataType.simpleString()]
    one = kept.groupBy("row_key").agg(F.min_by(F.struct(*named.columns), F.xxhash64(*plain)).alias("row"))
    return one.select(*[F.col(f"row.{_name(docs, c)}").alias(c) for c in docs.columns])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; no document goes."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences."""
    return packing.pack(docs)


def _name(docs: DataFrame, column: str) -> str:
    return f"in_{docs.columns.index(column)}"


def _held(docs: DataFrame) -> list:
    """All columns under names that clash with no output."""
    return [F.col(c).alias(_name(docs, c)) for c in docs.columns]


def _released(judged: DataFrame, docs: DataFrame) -> DataFrame:
    return judged.select(*[F.col(_name(docs, c)).alias(c) for c in docs.columns])


STAGES = [
    ("language identification", identify_language),
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scan", mask_secrets),
    ("best-fit packing", pack),
]

#: Models, near duplicates and packing can't be stated in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
