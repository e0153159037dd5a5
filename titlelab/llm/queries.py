"""The operators of this package on their whole tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlelab.llm import bpe, hpylm, html, jaccard, langid, lines, negatives, packing, quality, secrets, spelling, topk, winnow
from titlelab.llm.common import is_part, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return html.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


@query
def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held = is_part("doc_id", 4, 2)
    model = langid.fit(docs.where(~held))
    return langid.predict(docs.select("doc_id", "text"), model, keep=["doc_id"]).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score"
    )


@query
def op3_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op4_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents").select("doc_id", "text"), keep=["doc_id"])


@query
def op5_top_inner_products(spark: SparkSession, sf: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return topk.nearest(vectors, vectors.where("id % 50 = 0"))


@query
def op6_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = secrets.secrets(docs, keep=["doc_id"])

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.spelled("base"), 256).alias("base_sha256"), secrets.spelled("spans").alias("spans"),
    )


@query
def op7_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.join(table(spark, sf, "documents"))


@query
def op8_pitman_yor(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held = is_part("doc_id", 5, 1)
    scored = hpylm.score(docs.select("doc_id", "text"), ~held)
    return scored.select(
        "doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op9_winnowing(spark: SparkSession, sf: str) -> DataFrame:
    found = winnow.compare_edited(table(spark, sf, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        winnow.spelled(F.col("marks")).alias("fingerprint"), winnow.spelled(F.col("edited_marks")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


@query
def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = is_part("doc_id", 5, 0)
    model = quality.fit(docs, labels.where(~held))
    return quality.score(docs.select("doc_id", "text"), model, keep=["doc_id"]).select(
        "doc_id", held.alias("held_out"), "score", "predicted"
    )


@query
def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    words = spelling.vocabulary(spelling.occurrences(table(spark, sf, "documents").select("doc_id", "text")))
    return spelling.variants(words)


@query
def op12_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = lines.dedup(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    rows = negatives.usable(table(spark, sf, "embeddings"), "vec_id", "embedding", label)
    return negatives.mine(rows, rows.where("id % 100 = 0"))


ORACLES["op5_top_inner_products"] = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLES["op12_line_dedup"] = """
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), each AS (
    SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split
), keyed AS (
    SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each
), often AS (
    SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id < o.holder, false) AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLES["op13_hard_negatives"] = """
WITH usable AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.id AS anchor_id, c.id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM usable a JOIN usable c ON a.id <> c.id AND len(a.v) = len(c.v) WHERE a.id % 100 = 0
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
    SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
        AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
