"""Centroid models and the two prediction jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.catalog import CONTAINS, EXACT, rules_sql
from registry.inputs import TITLES_SQL, business_sql, col, lit, md5_sql, strip_sql, titles, tokens_sql
from titlelab.operators import centroids
from titlelab.operators.evaluate import cv_summary, fold_scores
from titlelab.operators.labels import fit_labels
from titlelab.operators.rules import Rule
from titlelab.operators.splits import kfold
from titlelab.operators.text_vectors import clean_text
from titlelab.plans import predict
from titlelab.plans.categories import top_categories
from titlelab.session import scratch_path
from titlelab.sources import artifacts

# Title weights (w, and q per distinct text), main and sub centroids (mc, sc).
_MODEL = f"""t AS ({TITLES_SQL}),
    r AS (SELECT id, main_id, sub_id, sub_name, title, {strip_sql('title')} AS text FROM t),
    tok AS (SELECT id, unnest({tokens_sql('text')}) AS term FROM r),
    tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
    idf AS (SELECT term, ln((1 + (SELECT count(*) FROM r)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
    raw AS (SELECT id, term, tf * idf AS x FROM tf JOIN idf USING (term)),
    w AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM raw),
    q AS (SELECT text, term, min(w) AS w FROM w JOIN r USING (id) GROUP BY ALL),
    ms AS (SELECT main_id, term, sum(w) AS s FROM w JOIN r USING (id) GROUP BY ALL),
    mc AS (SELECT main_id, term, s / sqrt(sum(s * s) OVER (PARTITION BY main_id)) AS w FROM ms),
    ss AS (SELECT main_id, sub_id, term, sum(w) AS s FROM w JOIN r USING (id) GROUP BY ALL),
    sc AS (SELECT main_id, sub_id, term, s / sqrt(sum(s * s) OVER (PARTITION BY main_id, sub_id)) AS w FROM ss),
    mp AS (SELECT text, main_id, score FROM (SELECT text, main_id, round(sum(q.w * mc.w), 8) AS score FROM q JOIN mc USING (term) GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY text ORDER BY score DESC, main_id) = 1),
    sp AS (SELECT text, main_id, sub_id, score FROM (SELECT text, main_id, sub_id, round(sum(q.w * sc.w), 8) AS score
        FROM q JOIN sc USING (term) GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY text, main_id ORDER BY score DESC, sub_id) = 1)"""


@query(
    "sub_model_predict",
    f"""WITH {_MODEL} SELECT id, main_id, sp.sub_id AS predicted_sub, score FROM r JOIN sp USING (text, main_id)""",
)
def sub_model_predict(spark, sf):
    """Every main's own sub model, applied to its titles."""
    rows = titles(spark, sf)
    model = centroids.fit_title_model(rows)
    keyed = rows.select("id", "main_id", clean_text("title").alias("text"))
    weights = centroids.scoring_weights(keyed, model)
    found = centroids.predict_sub(keyed, weights, model).withColumnRenamed("sub_id", "predicted_sub")
    joined = keyed.join(found, ["text", "main_id"])
    return joined.select("id", "main_id", "predicted_sub", "score")


@query(
    "predict_hierarchy",
    f"""WITH {_MODEL} SELECT id, mp.main_id AS predicted_main, sp.sub_id AS predicted_sub,
      mp.score AS main_score, sp.score AS sub_score
    FROM r JOIN mp USING (text) JOIN sp ON sp.text = mp.text AND sp.main_id = mp.main_id""",
)
def predict_hierarchy(spark, sf):
    rows = titles(spark, sf)
    found = centroids.predict_hierarchy(rows.select("id", "title"), centroids.fit_title_model(rows))
    return found.select(
        "id",
        col("main_id").alias("predicted_main"),
        col("sub_id").alias("predicted_sub"),
        "main_score",
        "sub_score",
    )


@query(
    "saved_model_predict",
    f"""WITH {_MODEL} SELECT id, mp.main_id AS predicted_main, sp.sub_id AS predicted_sub
    FROM r JOIN mp USING (text) JOIN sp ON sp.text = mp.text AND sp.main_id = mp.main_id""",
)
def saved_model_predict(spark, sf):
    """A model that was saved, read again and then applied."""
    rows = titles(spark, sf)
    folder = scratch_path(spark, "title-model")
    artifacts.save_title_model(folder, centroids.fit_title_model(rows))
    found = centroids.predict_hierarchy(rows.select("id", "title"), artifacts.load_title_model(spark, folder))
    return found.select("id", col("main_id").alias("predicted_main"), col("sub_id").alias("predicted_sub"))


@query(
    "top_categories",
    f"""WITH {_MODEL}, a AS (SELECT text, main_id, round(sum(q.w * mc.w), 8) AS score FROM q JOIN mc USING (term) GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, main_id) AS rank FROM a),
    l AS (SELECT main_id, min(main_name) AS main_name, CAST(dense_rank() OVER (ORDER BY main_id) - 1 AS INTEGER) AS label FROM t GROUP BY main_id)
    SELECT id, CAST(rank AS INTEGER) AS rank, label, main_id, l.main_name, score FROM (SELECT id, text FROM r) JOIN b USING (text) JOIN l USING (main_id)
    WHERE rank <= 3""",
)
def top_categories_query(spark, sf):
    """The three best mains of every title, with number, id, name and score."""
    rows = titles(spark, sf)
    names = rows.groupBy("main_id").agg(F.min("main_name").alias("main_name"))
    return top_categories(rows, centroids.fit_title_model(rows), fit_labels(rows, "main_id"), names)


_CV = f"""t AS ({TITLES_SQL}),
    r AS (SELECT id, main_id, sub_id, {strip_sql('title')} AS text, CAST((row_number() OVER (PARTITION BY main_id
      ORDER BY {md5_sql('id')}, id) - 1) % 5 AS INTEGER) AS fold FROM t),
    m AS (SELECT model, id, main_id, sub_id, text FROM r, (SELECT unnest(range(5)) AS model) WHERE model <> fold),
    tok AS (SELECT text, unnest({tokens_sql('text')}) AS term FROM (SELECT DISTINCT text FROM r)),
    tf AS (SELECT text, term, count(*) AS tf FROM tok GROUP BY ALL),
    idf AS (SELECT model, term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM m JOIN tf USING (text)
      JOIN (SELECT model, count(*) AS n FROM m GROUP BY model) USING (model) GROUP BY model, term),
    x AS (SELECT model, text, term, tf * idf AS x FROM tf JOIN idf USING (term)),
    w AS (SELECT model, text, term, x / sqrt(sum(x * x) OVER (PARTITION BY model, text)) AS w FROM x),
    s AS (SELECT model, main_id, sub_id, term, sum(w) AS s FROM m JOIN w USING (model, text) GROUP BY ALL),
    c AS (SELECT model, main_id, sub_id, term, s / sqrt(sum(s * s) OVER (PARTITION BY model, main_id, sub_id)) AS w FROM s),
    d AS (SELECT r.id, c.sub_id, round(sum(w.w * c.w), 8) AS score FROM r JOIN w ON w.model = r.fold AND w.text = r.text
      JOIN c ON c.model = r.fold AND c.main_id = r.main_id AND c.term = w.term GROUP BY ALL),
    b AS (SELECT id, sub_id AS prediction FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, sub_id) = 1),
    f AS (SELECT main_id, fold, avg(CASE WHEN sub_id = prediction THEN 1.0 ELSE 0.0 END) AS score FROM r LEFT JOIN b USING (id) GROUP BY ALL)"""


@query("sub_model_cv", f"WITH {_CV} SELECT main_id, round(avg(score), 6) AS mean_score, count(*) AS n_folds FROM f GROUP BY main_id")
def sub_model_cv(spark, sf):
    """Cross-validated accuracy of each main's own sub model."""
    folds = kfold(titles(spark, sf), "main_id", "id")
    scores = fold_scores(centroids.fold_predictions(folds, "id"), "fold", ("main_id",))
    return cv_summary(scores, ("main_id",)).withColumn("mean_score", F.round("mean_score", 6))


_RULES = predict.RuleSet(EXACT, CONTAINS, (Rule("gizmo", "Brand#9"),))


def _catalog(spark, sf):
    """One main (PROMO) is not in the live catalogue, nor is the sub Brand#7 anywhere."""
    rows = titles(spark, sf)
    main = rows.select("main_id", "main_name").distinct().where(col("main_id") != "PROMO")
    sub = rows.select("main_id", "sub_id", "sub_name").distinct().where(col("sub_name") != "Brand#7")
    return predict.Catalog(main, sub)


# Rule decisions and the last steps shared by both jobs.
_RULE_CTES = f"""lm AS (SELECT DISTINCT main_id, main_name FROM t WHERE main_id <> 'PROMO'),
    ls AS (SELECT DISTINCT main_id, sub_id, sub_name FROM t WHERE sub_name <> 'Brand#7'),
    jt AS (SELECT DISTINCT title AS job_title, text FROM r),
    er AS (SELECT job_title, category FROM jt JOIN {rules_sql(EXACT)} ON lower(trim(job_title)) = pattern),
    cr AS (SELECT job_title, category FROM jt JOIN {rules_sql(CONTAINS)} ON contains(job_title, pattern)
      QUALIFY row_number() OVER (PARTITION BY job_title ORDER BY rank) = 1),
    ru AS (SELECT job_title, text, lm.main_id AS rule_main FROM jt LEFT JOIN er USING (job_title) LEFT JOIN cr USING (job_title)
      LEFT JOIN lm ON regexp_replace(main_name, '\\s*/\\s*', '/', 'g') = regexp_replace(coalesce(er.category, cr.category), '\\s*/\\s*', '/', 'g'))"""
_FINISH = """fin AS (SELECT d.*, lm.main_id AS live_main, main_name AS main_occupation,
      coalesce(CASE WHEN contains(job_title, 'gizmo') THEN hs.sub_id END, sp.sub_id) AS wanted_sub FROM d
      LEFT JOIN lm ON lm.main_id = d.main_id LEFT JOIN ls hs ON hs.main_id = lm.main_id AND hs.sub_name = 'Brand#9'
      LEFT JOIN sp ON sp.text = d.text AND sp.main_id = lm.main_id),
    ans AS (SELECT fin.*, ls.sub_id AS live_sub, ls.sub_name AS sub_occupation_name FROM fin
      LEFT JOIN ls ON ls.main_id = fin.live_main AND ls.sub_id = fin.wanted_sub)"""
_STATUS = """CASE WHEN reject IS NOT NULL THEN 'REJECTED' WHEN live_main IS NULL THEN 'FAILED' WHEN live_sub IS NULL THEN 'PARTIAL' ELSE 'OK' END AS status,
    CASE WHEN reject IS NOT NULL THEN reject WHEN ans.main_id IS NULL THEN 'NO_MATCH' WHEN live_main IS NULL THEN 'NOT_FOUND' ELSE how END AS reason"""


@query(
    "predict_member",
    f"""WITH {_MODEL}, {_RULE_CTES},
    d AS (SELECT job_title, ru.text, coalesce(rule_main, mp.main_id) AS main_id, CASE WHEN rule_main IS NOT NULL THEN 'RULE' ELSE 'MODEL' END AS how
      FROM ru LEFT JOIN mp USING (text)), {_FINISH},
    rq AS (SELECT id AS request_id, CASE WHEN id % 7 = 0 THEN '' WHEN id % 9 = 0 THEN 'zzz' ELSE title END AS job_title FROM t),
    ck AS (SELECT *, CASE WHEN job_title = '' THEN 'NO_TITLE' END AS reject FROM rq)
    SELECT request_id, ck.job_title, live_main AS occupation_id, main_occupation, live_sub AS sub_occupation_id, sub_occupation_name, {_STATUS}
    FROM ck LEFT JOIN ans ON ans.job_title = ck.job_title""",
)
def predict_member(spark, sf):
    """Every title asked; some are blank, some unknown."""
    rows = titles(spark, sf)
    asked = F.when(col("id") % 7 == 0, "").when(col("id") % 9 == 0, "zzz").otherwise(col("title"))
    requests = rows.select(col("id").alias("request_id"), asked.alias("job_title"))
    return predict.predict_member(requests, _catalog(spark, sf), centroids.fit_title_model(rows), _RULES)


@query(
    "predict_employer",
    f"""WITH {_MODEL}, {_RULE_CTES},
    hb AS (SELECT {business_sql('sub_name')} AS business, main_id, id FROM r),
    bs AS (SELECT business, main_id, term, sum(w) AS s FROM w JOIN hb USING (id) GROUP BY ALL),
    bc AS (SELECT business, main_id, term, s / sqrt(sum(s * s) OVER (PARTITION BY business, main_id)) AS w FROM bs),
    rq AS (SELECT id AS request_id, CASE WHEN id % 7 = 0 THEN '' WHEN id % 9 = 0 THEN 'zzz' ELSE title END AS job_title,
      CASE WHEN id % 5 = 0 THEN '' WHEN id % 8 = 0 THEN '!!' WHEN id % 6 = 0 THEN sub_name || ' new' ELSE '  ' || sub_name || '! ' END AS raw_business FROM t),
    ck AS (SELECT *, CASE WHEN job_title = '' THEN 'NO_TITLE' WHEN raw_business = '' THEN 'NO_BUSINESS_TYPE' END AS reject,
      nullif({business_sql('raw_business')}, '') AS bussiness_type FROM rq),
    pr AS (SELECT DISTINCT job_title, {strip_sql('job_title')} AS text, bussiness_type FROM ck WHERE reject IS NULL),
    bp AS (SELECT text, bussiness_type, main_id FROM (SELECT text, bussiness_type, main_id, round(sum(q.w * bc.w), 8) AS score
        FROM (SELECT DISTINCT text, bussiness_type FROM pr) JOIN q USING (text) JOIN bc ON bc.business = bussiness_type AND bc.term = q.term GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY text, bussiness_type ORDER BY score DESC, main_id) = 1),
    d AS (SELECT pr.job_title, pr.text, pr.bussiness_type, coalesce(rule_main, bp.main_id, mp.main_id) AS main_id,
      CASE WHEN rule_main IS NOT NULL THEN 'RULE' WHEN bp.main_id IS NOT NULL THEN 'BUSINESS' ELSE 'FALLBACK' END AS how
      FROM pr LEFT JOIN ru ON ru.job_title = pr.job_title LEFT JOIN bp ON bp.text = pr.text AND bp.bussiness_type IS NOT DISTINCT FROM pr.bussiness_type
      LEFT JOIN mp ON mp.text = pr.text), {_FINISH}
    SELECT request_id, ck.job_title, live_main AS occupation_id, main_occupation, live_sub AS sub_occupation_id, sub_occupation_name,
      ck.bussiness_type, {_STATUS}
    FROM ck LEFT JOIN ans ON ans.job_title = ck.job_title AND ans.bussiness_type IS NOT DISTINCT FROM ck.bussiness_type AND reject IS NULL""",
)
def predict_employer(spark, sf):
    """As above with a business type: some blank, some without history."""
    rows = titles(spark, sf)
    asked = F.when(col("id") % 7 == 0, "").when(col("id") % 9 == 0, "zzz").otherwise(col("title"))
    business = (
        F.when(col("id") % 5 == 0, "")
        .when(col("id") % 8 == 0, "!!")
        .when(col("id") % 6 == 0, F.concat("sub_name", lit(" new")))
        .otherwise(F.concat(lit("  "), "sub_name", lit("! ")))
    )
    requests = rows.select(
        col("id").alias("request_id"), asked.alias("job_title"), business.alias("bussiness_type")
    )
    model = centroids.fit_title_model(rows)
    history = rows.select(col("sub_name").alias("bussiness_type"), "main_id", "title")
    special = predict.fit_business_centroids(history, model)
    return predict.predict_employer(requests, _catalog(spark, sf), model, special, _RULES)
