"""Catalogue, posts, lookups, choices, prompts, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import inputs, query
from registry.inputs import POSTS_SQL, TITLES_SQL, col, lit, titles
from titlelab.operators import catalog as ops
from titlelab.operators import prompts
from titlelab.operators.ranking import cap_per_group
from titlelab.operators.rules import Rule, apply_rules
from titlelab.sources.tables import read_table


@query(
    "active_posts",
    """SELECT o_orderkey AS id, c_nationkey AS occupation_new_id FROM orders
    JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'""",
)
def active_posts(spark, sf):
    return ops.active(inputs.posts(spark, sf)).select("id", "occupation_new_id")


@query(
    "main_catalog",
    """SELECT r_regionkey AS main_id, r_name AS main_name, row_number() OVER (ORDER BY r_name) AS rank
    FROM region""",
)
def main_catalog(spark, sf):
    mains = ops.main_catalog(inputs.occupations(spark, sf), inputs.occupation_names(spark, sf))
    return ops.in_thai_order(mains, "main_name", "main_id")


_SUBS = """SELECT n_regionkey AS main_id, n_nationkey AS sub_id, n_name AS sub_name FROM nation
    WHERE n_nationkey % 5 <> 4 AND n_nationkey <> 3"""


def _subs(spark, sf):
    return ops.sub_catalog(inputs.subs(spark, sf), inputs.sub_names(spark, sf))


@query("sub_catalog", f"SELECT *, row_number() OVER (ORDER BY sub_name) AS rank FROM ({_SUBS})")
def sub_catalog(spark, sf):
    return ops.in_thai_order(_subs(spark, sf), "sub_name", "sub_id")


@query("subs_of_main", f"SELECT * FROM ({_SUBS}) WHERE main_id = 1")
def subs_of_main(spark, sf):
    return ops.subs_of(_subs(spark, sf), 1)


@query(
    "recent_posts",
    f"""SELECT id, main_id, title FROM ({POSTS_SQL}) WHERE created_at >= TIMESTAMP '2001-08-01' - INTERVAL 3 MONTH
    AND main_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 1))
    ORDER BY id, title LIMIT 500""",
)
def recent_posts(spark, sf):
    """Posts of two main occupations in the three months before the last day of the table."""
    ids = read_table(spark, "nation", sf).where(col("n_regionkey").isin(0, 1))
    ids = ids.select(col("n_nationkey").alias("main_id"))
    as_of = lit("2001-08-01").cast("timestamp_ntz")
    posts, text = inputs.posts(spark, sf), inputs.post_descriptions(spark, sf)
    return ops.recent_posts(posts, text, ids, as_of)


@query(
    "titles_by_occupation",
    f"""SELECT main_id, n_name AS main_name, title, CAST(rank AS INTEGER) AS rank FROM
    (SELECT *, row_number() OVER (PARTITION BY main_id ORDER BY id, l_linenumber, title) AS rank FROM ({POSTS_SQL}))
    JOIN nation ON n_nationkey = main_id WHERE rank <= 200""",
)
def titles_by_occupation(spark, sf):
    nations = read_table(spark, "nation", sf)
    listed = nations.select(col("n_nationkey").alias("main_id"), col("n_name").alias("main_name"))
    posts = ops.active(inputs.posts(spark, sf)).select("id", col("occupation_new_id").alias("main_id"))
    text = inputs.post_descriptions(spark, sf).withColumnRenamed("position", "title")
    rows = posts.join(text, col("id") == col("jobpost_id"))
    return ops.titles_by_occupation(listed, rows, ["id", "l_linenumber", "title"])


@query(
    "cap_per_group",
    f"""SELECT main_id, id, CAST(rank AS INTEGER) AS rank FROM
    (SELECT *, row_number() OVER (PARTITION BY main_id ORDER BY title, id) AS rank FROM ({TITLES_SQL}))
    WHERE rank <= 100""",
)
def cap_titles(spark, sf):
    return cap_per_group(titles(spark, sf), ["main_id"], 100, ["title", "id"]).select(
        "main_id", "id", "rank"
    )


@query("category_mapping", "SELECT DISTINCT p_type AS main_id, 'Main ' || p_type AS main_name FROM part")
def category_mapping(spark, sf):
    return ops.category_mapping(titles(spark, sf), "main_id", "main_name")


@query(
    "attach_name",
    f"""SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey < 20 THEN n_name ELSE '{ops.NAME_MISSING}' END AS name
    FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def attach_name(spark, sf):
    names = read_table(spark, "nation", sf).select(
        col("n_nationkey").alias("c_nationkey"), F.when(col("n_nationkey") < 20, col("n_name")).alias("name")
    )
    people = read_table(spark, "customer", sf).select("c_custkey", "c_nationkey")
    return ops.attach_name(people, names, "c_nationkey", "name")


def _choice_table(spark, sf):
    """Event properties as choice replies: some quoted, renamed, headless or cut short."""
    renamed = F.regexp_replace("props", '"k"', '"id"')
    quoted = F.when(col("event_id") % 5 == 0, F.regexp_replace("t", r"(\d+)", '"$1"')).otherwise(col("t"))
    other = F.when(col("event_id") % 3 == 0, F.regexp_replace("t", '"id"', '"id": null, "occupation_id"'))
    headless = F.when(col("event_id") % 7 == 0, F.expr("substr(t, 2)")).otherwise(col("t"))
    cut = F.when(col("event_id") % 11 == 0, F.expr("left(t, length(t) - 1)")).otherwise(col("t"))
    df = read_table(spark, "events", sf).select("event_id", renamed.alias("t"))
    for step in (quoted, other.otherwise(col("t")), headless, cut):
        df = df.withColumn("t", step)
    return df.withColumnRenamed("t", "text")


_CHOICES = """a AS (SELECT event_id, replace(props, '"k"', '"id"') AS t FROM events),
    b AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN regexp_replace(t, '(\\d+)', '"\\1"') ELSE t END AS t FROM a),
    c AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN replace(t, '"id"', '"id": null, "occupation_id"') ELSE t END AS t FROM b),
    d AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN substr(t, 2) ELSE t END AS t FROM c),
    e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN left(t, length(t) - 1) ELSE t END AS t FROM d),
    f AS (SELECT event_id, t, CASE WHEN json_valid(t) THEN t ELSE '{}' END AS j, json_valid(t) AS good FROM e),
    g AS (SELECT *, CASE WHEN coalesce(json_type(j, '$.id'), 'NULL') <> 'NULL' THEN '$.id' ELSE '$.occupation_id' END AS path FROM f),
    h AS (SELECT *, json_type(j, path) AS kind, json_extract_string(j, path) AS v FROM g),
    choices AS (SELECT event_id, CASE WHEN NOT starts_with(t, '{') THEN 'NOT_JSON' WHEN NOT good THEN 'BAD_JSON'
        WHEN kind IS NULL OR kind = 'NULL' OR (kind <> 'VARCHAR' AND v = '0') THEN 'NO_ID' END AS reply_reason,
      CASE WHEN kind IN ('UBIGINT', 'BIGINT') AND starts_with(t, '{') AND good AND v <> '0' THEN CAST(v AS BIGINT) END AS reply_id FROM h)"""


@query("parse_choice_reply", f"WITH {_CHOICES} SELECT event_id, reply_reason, CAST(reply_id AS VARCHAR) AS reply_id FROM choices")
def parse_choice_reply(spark, sf):
    parsed = prompts.parse_choice_reply(_choice_table(spark, sf))
    return parsed.withColumn("reply_id", col("reply_id").cast("string"))


@query(
    "resolve_prediction",
    f"""WITH {_CHOICES} SELECT event_id, CAST(n_nationkey AS VARCHAR) AS occupation_id, n_name AS occupation_name,
      coalesce(reply_reason, CASE WHEN n_nationkey IS NULL THEN 'NOT_FOUND' ELSE 'OK' END) AS reason
    FROM choices LEFT JOIN nation ON n_nationkey = reply_id""",
)
def resolve_prediction(spark, sf):
    replies = prompts.parse_choice_reply(_choice_table(spark, sf))
    nations = read_table(spark, "nation", sf)
    found = ops.resolve_id(replies, nations, "reply_id", "n_nationkey", "n_name")
    missing = F.when(col("resolved_id").isNull(), "NOT_FOUND").otherwise("OK")
    return found.select(
        "event_id",
        col("resolved_id").cast("string").alias("occupation_id"),
        col("resolved_name").alias("occupation_name"),
        F.coalesce("reply_reason", missing).alias("reason"),
    )


_MAIN_OPTIONS = """SELECT string_agg(line, chr(10) ORDER BY n) AS options FROM (SELECT n, n || '. {"id": ' || r_regionkey
    || ', "name": "' || r_name || '"}' AS line FROM (SELECT *, row_number() OVER (ORDER BY r_name) AS n FROM region))"""
_SUB_OPTIONS = f"""SELECT main_id, string_agg(line, chr(10) ORDER BY n) AS options FROM (SELECT main_id, n,
    n || '. {{"id": ' || sub_id || ', "name": "a\\"' || sub_name || '"}}' AS line FROM
    (SELECT *, row_number() OVER (PARTITION BY main_id ORDER BY sub_name) AS n FROM ({_SUBS}))) GROUP BY main_id"""


def _main_options(spark, sf):
    return prompts.option_list(main_catalog(spark, sf), [], "main_id", "main_name", ["rank"])


def _sub_options(spark, sf):
    quoted = sub_catalog(spark, sf).withColumn("sub_name", F.concat(lit('a"'), "sub_name"))
    return prompts.option_list(quoted, ["main_id"], "sub_id", "sub_name", ["rank"])


@query("option_list", f"SELECT * FROM ({_SUB_OPTIONS})")
def option_list(spark, sf):
    return _sub_options(spark, sf)


def _sql_text(template: str, **parts: str) -> str:
    """The template as an SQL concatenation."""
    pieces = prompts._PLACE.split(template)
    out = []
    for at, piece in enumerate(pieces):
        out.append(parts[piece] if at % 2 else "'" + piece.replace("'", "''") + "'")
    return " || ".join(out)


_GUIDE = "'" + prompts.guidance().replace("'", "''") + "'"


@query(
    "main_prompt",
    f"""SELECT p_partkey AS id, md5({_sql_text(prompts.MAIN_TEMPLATE_BUSINESS, job_title='p_name', bussiness_type='p_brand',
        guidance=_GUIDE, options='options')}) AS digest
    FROM part, ({_MAIN_OPTIONS})""",
)
def main_prompt(spark, sf):
    asked = titles(spark, sf).select(
        "id", col("title").alias("job_title"), col("sub_name").alias("bussiness_type")
    )
    done = prompts.main_prompts(asked, _main_options(spark, sf), prompts.MAIN_TEMPLATE_BUSINESS)
    return done.select("id", F.md5("prompt").alias("digest"))


@query(
    "sub_prompt",
    f"""SELECT c_custkey AS id, {_sql_text(prompts.SUB_TEMPLATE, job_title='c_name', main_occupation='r_name',
        options="coalesce(options, '')")} AS prompt
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    LEFT JOIN ({_SUB_OPTIONS}) ON main_id = n_regionkey""",
)
def sub_prompt(spark, sf):
    """Each customer's name asked within its nation's main occupation."""
    place = read_table(spark, "nation", sf).join(
        read_table(spark, "region", sf), col("n_regionkey") == col("r_regionkey")
    )
    people = read_table(spark, "customer", sf).join(place, col("c_nationkey") == col("n_nationkey"))
    asked = people.select(
        col("c_custkey").alias("id"),
        col("c_name").alias("job_title"),
        col("r_name").alias("main_occupation"),
        col("n_regionkey").alias("main_id"),
    )
    return prompts.sub_prompts(asked, _sub_options(spark, sf)).select("id", "prompt")


EXACT = (
    Rule("Red Widget", "Main SMALL"),
    Rule("blue bolt", "Main LARGE"),
    Rule("old gear", "Main  / PROMO"),
    Rule("hot rod", "Main PROMO"),
    Rule("cold anvil", "Main ECONOMY"),
)
CONTAINS = (Rule("anvil", "Main LARGE"), Rule("hot", "Main SMALL"), Rule("gizmo", "Main MEDIUM"))


def rules_sql(rules) -> str:
    rows = ", ".join(f"({i}, '{r.pattern.lower()}', '{r.category}')" for i, r in enumerate(rules, 1))
    return f"(VALUES {rows}) AS v(rank, pattern, category)"


_RULED = f"""SELECT id, title, CASE WHEN e.rank IS NOT NULL THEN 'exact' WHEN c.rank IS NOT NULL THEN 'contains' END AS rule_kind,
      coalesce(e.rank, c.rank) AS rule_rank, coalesce(e.category, c.category) AS rule_category
    FROM ({TITLES_SQL}) t LEFT JOIN {rules_sql(EXACT).replace('AS v(', 'AS e(')} ON lower(trim(title)) = e.pattern
    LEFT JOIN (SELECT title AS ct, rank, category FROM (SELECT title, rank, category,
        row_number() OVER (PARTITION BY title ORDER BY rank) AS rn FROM (SELECT DISTINCT p_name AS title FROM part)
        JOIN {rules_sql(CONTAINS)} ON contains(title, pattern)) WHERE rn = 1) c ON ct = title"""


@query("apply_rules", f"SELECT id, rule_kind, CAST(rule_rank AS VARCHAR) AS rule_rank, rule_category FROM ({_RULED})")
def apply_rules_query(spark, sf):
    return apply_rules(titles(spark, sf), "title", EXACT, CONTAINS).select(
        "id", "rule_kind", col("rule_rank").cast("string").alias("rule_rank"), "rule_category"
    )
