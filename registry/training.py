"""Labels, splits, evaluation, balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.inputs import TITLES_SQL, col, hash_sql, lit, md5_sql, titles
from titlelab.functions.arrays import argmax
from titlelab.operators import balance, evaluate, labels, splits
from titlelab.operators.word_vectors import top_classes
from titlelab.sources.tables import read_table


@query(
    "label_encode",
    f"""SELECT id, main_id, p_size, CAST(dense_rank() OVER (ORDER BY main_id) - 1 AS INTEGER) AS main_label,
      CAST(dense_rank() OVER (ORDER BY p_size) - 1 AS INTEGER) AS size_label, main_id AS decoded
    FROM ({TITLES_SQL}) JOIN part ON p_partkey = id""",
)
def label_encode(spark, sf):
    parts = read_table(spark, "part", sf).select(
        col("p_partkey").alias("id"), col("p_type").alias("main_id"), "p_size"
    )
    mains, sizes = labels.fit_labels(parts, "main_id"), labels.fit_labels(parts, "p_size")
    coded = labels.encode(parts, mains, "main_id").withColumnRenamed("label", "main_label")
    coded = labels.encode(coded, sizes, "p_size").withColumnRenamed("label", "size_label")
    back = mains.withColumnRenamed("main_id", "decoded")
    return labels.decode(coded, back, "main_label", "decoded")


@query(
    "class_distribution",
    """SELECT lang AS class, upper(lang) AS name, count(*) AS n,
      round(count(*) * 100 / (SELECT count(*) FROM documents), 2) AS percent FROM documents GROUP BY lang""",
)
def class_distribution(spark, sf):
    docs = read_table(spark, "documents", sf).select("lang", F.upper("lang").alias("name"))
    return labels.class_distribution(docs, "lang", "name")


@query(
    "class_weights",
    """SELECT quality, count(*) AS n, round((SELECT count(*) FROM labels) /
      ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 6) AS weight FROM labels GROUP BY quality""",
)
def class_weights(spark, sf):
    weights = labels.class_weights(read_table(spark, "labels", sf), "quality")
    return weights.withColumn("weight", F.round("weight", 6))


@query(
    "hash_split",
    f"""SELECT id, CASE WHEN {hash_sql('id')} < 3435973837 THEN 'train' ELSE 'test' END AS part,
      CASE WHEN {hash_sql('id')} < 3758096384 THEN 'train' ELSE 'test' END AS eighth FROM ({TITLES_SQL})""",
)
def hash_split(spark, sf):
    """A fifth, and an eighth, as the test part."""
    eighth = splits.split(titles(spark, sf), "id", 0.125).select("id", col("part").alias("eighth"))
    return splits.split(eighth, "id").select("id", "part", "eighth")


@query(
    "stratified_split",
    f"""SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY {md5_sql('doc_id')}, doc_id)
      <= ceil(round(0.2 * count(*) OVER (PARTITION BY quality), 6)) THEN 'test' ELSE 'train' END AS part FROM labels""",
)
def stratified_split(spark, sf):
    rows = read_table(spark, "labels", sf).select("doc_id", "quality")
    return splits.stratified_split(rows, "quality", "doc_id")


_FOLDS = f"""SELECT doc_id, lang, n_chars, CAST((row_number() OVER (PARTITION BY lang ORDER BY {md5_sql('doc_id')}, doc_id) - 1) % 5
    AS INTEGER) AS fold FROM documents"""


@query("stratified_kfold", f"SELECT doc_id, lang, fold FROM ({_FOLDS})")
def stratified_kfold(spark, sf):
    rows = read_table(spark, "documents", sf).select("doc_id", "lang")
    return splits.kfold(rows, "lang", "doc_id")


_JUDGED = """SELECT l.doc_id, quality AS label, CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END AS prediction
    FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""


def _judged(spark, sf):
    """Text length as a guess of its quality."""
    docs = read_table(spark, "documents", sf).select("doc_id", "n_chars")
    joined = read_table(spark, "labels", sf).join(docs, "doc_id")
    guess = F.when(col("n_chars") >= 500, 1).otherwise(0)
    return joined.select("doc_id", col("quality").alias("label"), guess.alias("prediction"))


@query(
    "accuracy",
    f"SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({_JUDGED})",
)
def accuracy(spark, sf):
    return evaluate.accuracy(_judged(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"))


_GUESSED = "SELECT lang AS label, (['de', 'en', 'fr', 'xx'])[CAST(doc_id % 4 AS INTEGER) + 1] AS prediction FROM documents"
_REPORT = f"""WITH p AS ({_GUESSED}), k AS (SELECT label AS class FROM p UNION SELECT prediction FROM p),
    c AS (SELECT class, (SELECT count(*) FROM p WHERE label = class) AS support,
      (SELECT count(*) FROM p WHERE prediction = class) AS predicted,
      (SELECT count(*) FROM p WHERE prediction = class AND label = class) AS hit FROM k),
    s AS (SELECT class, CASE WHEN predicted = 0 THEN 0 ELSE hit / predicted END AS precision,
      CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall, support FROM c),
    f AS (SELECT class, precision, recall, CASE WHEN precision + recall = 0 THEN 0
      ELSE 2 * precision * recall / (precision + recall) END AS f1, support FROM s)
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM (
      SELECT * FROM f
      UNION ALL SELECT 'accuracy', NULL, NULL, (SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0 END) FROM p), (SELECT count(*) FROM p)
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), sum(support) FROM f)"""


@query("classification_report", _REPORT)
def classification_report(spark, sf):
    """Languages against a guess by id; one guess is no language, one language is never guessed."""
    docs = read_table(spark, "documents", sf)
    names = F.array(*[lit(x) for x in ("de", "en", "fr", "xx")])
    guess = F.get(names, (col("doc_id") % 4).cast("int"))
    report = evaluate.classification_report(docs.select(col("lang").alias("label"), guess.alias("prediction")))
    rounded = {m: F.round(m, 6) for m in ("precision", "recall", "f1")}
    return report.withColumns(rounded)


@query(
    "cv_summary",
    f"""SELECT lang, round(avg(score), 6) AS mean_score, count(*) AS n_folds FROM
    (SELECT lang, fold, avg(CASE WHEN n_chars >= 500 THEN 1.0 ELSE 0.0 END) AS score FROM ({_FOLDS}) GROUP BY ALL) GROUP BY lang""",
)
def cv_summary(spark, sf):
    rows = read_table(spark, "documents", sf).select("doc_id", "lang", "n_chars")
    folds = splits.kfold(rows, "lang", "doc_id")
    judged = folds.withColumns({"label": lit(1), "prediction": (col("n_chars") >= 500).cast("int")})
    summary = evaluate.cv_summary(evaluate.fold_scores(judged, "fold", ("lang",)), ("lang",))
    return summary.withColumn("mean_score", F.round("mean_score", 6))


def _probabilities(spark, sf):
    """Squared embedding entries, scaled to sum to one, as class probabilities."""
    vec = col("embedding").cast("array<double>")
    squares = F.transform(vec, lambda x: x * x)
    total = F.aggregate(squares, lit(0.0), lambda a, x: a + x)
    df = read_table(spark, "embeddings", sf)
    return df.select("vec_id", F.transform(squares, lambda x: F.round(x / total, 8)).alias("probability"))


_PROBABILITY = """e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) AS s FROM embeddings),
    p AS (SELECT vec_id, list_transform(s, lambda x: round(x / list_sum(s), 8)) AS probability FROM e)"""


@query(
    "argmax",
    f"WITH {_PROBABILITY} SELECT vec_id, CAST(list_position(probability, list_max(probability)) - 1 AS INTEGER) AS best FROM p",
)
def argmax_query(spark, sf):
    return _probabilities(spark, sf).select("vec_id", argmax("probability").alias("best"))


@query(
    "top_classes",
    f"""WITH {_PROBABILITY}, u AS (SELECT vec_id, generate_subscripts(probability, 1) - 1 AS class, unnest(probability) AS probability FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY probability DESC, class) AS rank FROM u)
    SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(class AS INTEGER) AS class, probability FROM r WHERE rank <= 3""",
)
def top_classes_query(spark, sf):
    return top_classes(_probabilities(spark, sf), "vec_id", "probability")


@query(
    "smote_counts",
    """WITH c AS (SELECT label, count(*) AS n_before FROM embeddings GROUP BY label)
    SELECT label, n_before, (SELECT max(n_before) FROM c) AS n_after FROM c""",
)
def smote_counts(spark, sf):
    return balance.label_counts_after(read_table(spark, "embeddings", sf), "label")


@query(
    "smote_rows",
    f"""WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v, count(*) OVER (PARTITION BY label) AS n,
      row_number() OVER (PARTITION BY label ORDER BY {md5_sql('vec_id')}, vec_id) - 1 AS no FROM embeddings),
    k AS (SELECT a.label, a.id, b.id AS nid, b.v AS nv, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank
      FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id),
    g AS (SELECT label, n, unnest(range((SELECT max(n) FROM e) - n)) AS i FROM (SELECT DISTINCT label, n FROM e)),
    s AS (SELECT label, i, {hash_sql('label', "'b'", 'i')} % n AS no, {hash_sql('label', "'n'", 'i')} % least(5, n - 1) + 1 AS rank,
      {hash_sql('label', "'s'", 'i')} / 4294967296.0::DOUBLE AS step FROM g),
    o AS (SELECT s.label, i, e.id AS base_id, nid AS neighbour_id, step, v, nv FROM s JOIN e ON e.label = s.label AND e.no = s.no
      JOIN k ON k.id = e.id AND k.rank = s.rank)
    SELECT label, i, base_id, neighbour_id, round(v[1] + step * (nv[1] - v[1]), 4) AS x1, round(v[2] + step * (nv[2] - v[2]), 4) AS x2,
      round(v[3] + step * (nv[3] - v[3]), 4) AS x3, round(v[4] + step * (nv[4] - v[4]), 4) AS x4 FROM o""",
)
def smote_rows(spark, sf):
    made = balance.smote(read_table(spark, "embeddings", sf), "label", "embedding", "vec_id")
    picked = [F.round(F.get("vec", lit(i)), 4).alias(f"x{i + 1}") for i in range(4)]
    return made.select("label", "i", "base_id", "neighbour_id", *picked)
