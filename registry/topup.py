"""Counting, shortfall, new titles, filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.inputs import TITLES_SQL, col, lit, titles
from titlelab.operators import prompts
from titlelab.operators import topup as ops
from titlelab.plans import topup as jobs

_KEYS = ["main_id", "sub_id"]


@query(
    "title_counts",
    f"SELECT main_id, sub_id, sub_name, count(DISTINCT title) AS n_titles FROM ({TITLES_SQL}) GROUP BY ALL",
)
def title_counts(spark, sf):
    return ops.title_counts(titles(spark, sf), ["main_id", "sub_id", "sub_name"])


@query(
    "title_shortfall",
    f"""SELECT main_id, main_name, sub_id, sub_name, count(DISTINCT title) AS n_titles,
      10 - count(DISTINCT title) AS need FROM ({TITLES_SQL}) GROUP BY ALL HAVING count(DISTINCT title) < 10""",
)
def title_shortfall(spark, sf):
    uses = ops.title_uses(titles(spark, sf), ["main_id", "main_name", "sub_id", "sub_name"])
    return ops.title_shortfall(uses)


@query(
    "title_shortfall_shared_sub",
    f"""WITH t AS (SELECT main_id, main_name, sub_name AS sub_id, sub_name, title FROM ({TITLES_SQL})),
    c AS (SELECT main_id, sub_id, sub_name, count(DISTINCT title) AS n_titles FROM t GROUP BY ALL),
    p AS (SELECT sub_id, greatest(60 - count(DISTINCT title), 0) AS need FROM t GROUP BY ALL),
    n AS (SELECT DISTINCT main_id AS m, sub_id, main_name FROM t)
    SELECT main_id, main_name, sub_id, sub_name, n_titles, need FROM c JOIN n USING (sub_id) JOIN p USING (sub_id)
    WHERE n_titles < 60""",
)
def title_shortfall_shared_sub(spark, sf):
    """Sub ids that several mains share: the one-key name join returns a row per main."""
    shared = titles(spark, sf).withColumn("sub_id", col("sub_name"))
    return ops.title_shortfall(shared, target=60)


@query("existing_titles", f"SELECT DISTINCT main_id, sub_id, title FROM ({TITLES_SQL})")
def existing_titles(spark, sf):
    return ops.existing_titles(titles(spark, sf), _KEYS)


@query(
    "title_lists",
    f"""SELECT main_id, sub_id, array_to_string(list_sort(list(DISTINCT title)), '|') AS titles
    FROM ({TITLES_SQL}) GROUP BY ALL HAVING count(DISTINCT title) < 10""",
)
def title_lists(spark, sf):
    """Lists of the groups still short of ten titles."""
    lists = ops.title_lists(titles(spark, sf), _KEYS, 10)
    return lists.select(*_KEYS, F.array_join("titles", "|").alias("titles"))


@query(
    "title_summary",
    f"""SELECT count(*) AS n_rows, count(DISTINCT main_id) AS n_mains, count(DISTINCT title) AS n_titles
    FROM ({TITLES_SQL})""",
)
def title_summary(spark, sf):
    return ops.title_summary(titles(spark, sf))


_NEW = f"""t AS ({TITLES_SQL}),
    c AS (SELECT main_id, main_name, sub_id, sub_name, 10 - count(DISTINCT title) AS need FROM t
      GROUP BY ALL HAVING count(DISTINCT title) < 10),
    f AS (SELECT main_id, title, count(*) AS used FROM t GROUP BY ALL),
    r AS (SELECT c.*, title, row_number() OVER (PARTITION BY main_id, sub_id ORDER BY used DESC, title) AS rank
      FROM c JOIN f USING (main_id) WHERE NOT EXISTS (SELECT 1 FROM t
        WHERE t.main_id = c.main_id AND t.sub_id = c.sub_id AND t.title = f.title)),
    fresh AS (SELECT main_id, main_name, sub_id, sub_name, title FROM r WHERE rank <= need)"""


@query("new_titles", f"WITH {_NEW} SELECT * FROM fresh")
def new_titles(spark, sf):
    return jobs.new_sub_titles(titles(spark, sf))


@query(
    "first_candidate",
    f"""SELECT main_id, min_by(title, id) AS title FROM ({TITLES_SQL}) GROUP BY main_id""",
)
def first_candidate(spark, sf):
    """The first title offered for each main when titles are offered by id."""
    offered = titles(spark, sf).select("main_id", col("id").alias("pos"), "title")
    return ops.first_candidate(offered, ["main_id"])


# Some cells end in a separator, hold a blank only, or are padded.
_ODD = f"""SELECT id, main_id, main_name, sub_id, sub_name, CASE WHEN id % 13 = 0 THEN title || ' . ' WHEN id % 17 = 0 THEN '   '
    WHEN id % 19 = 0 THEN '  ' || title || ' .  . x' ELSE title END AS cell FROM ({TITLES_SQL})"""
_ODD_NEW = _NEW.replace(
    f"t AS ({TITLES_SQL})",
    f"""o AS (SELECT main_id, main_name, sub_id, sub_name, unnest(string_split(cell, ' . ')) AS part FROM ({_ODD})),
    t AS (SELECT main_id, main_name, sub_id, sub_name, trim(part) AS title FROM o WHERE trim(part) <> '')""",
)


@query(
    "topped_up",
    f"""WITH {_ODD_NEW} SELECT main_id, main_name, sub_id, sub_name, title FROM t
    UNION ALL SELECT * FROM fresh""",
)
def topped_up(spark, sf):
    """Cells with several, blank and padded titles among ordinary ones."""
    cell = (
        F.when(col("id") % 13 == 0, F.concat("title", lit(" . ")))
        .when(col("id") % 17 == 0, "   ")
        .when(col("id") % 19 == 0, F.concat(lit("  "), "title", lit(" .  . x")))
        .otherwise(col("title"))
    )
    return jobs.top_up_sub(titles(spark, sf).withColumn("title", cell))


_BRANDS = """SELECT p_partkey AS id, p_brand AS main_id, 'Main ' || p_brand AS main_name,
    CASE WHEN p_partkey % 23 = 0 THEN '--' WHEN p_partkey % 29 = 0 THEN '- ' ELSE repeat('-', CAST(p_partkey % 2 AS BIGINT)) || p_name END AS bulleted
    FROM part"""


@query(
    "topped_up_main",
    f"""WITH t AS (SELECT id, main_id, main_name, trim(regexp_replace(bulleted, '^-+', '')) AS title FROM ({_BRANDS})
      WHERE trim(regexp_replace(bulleted, '^-+', '')) <> ''),
    c AS (SELECT main_id, main_name, 100 - count(DISTINCT title) AS need FROM t GROUP BY ALL HAVING count(DISTINCT title) < 100),
    f AS (SELECT title, count(*) AS used FROM t GROUP BY ALL),
    r AS (SELECT c.*, title, row_number() OVER (PARTITION BY main_id ORDER BY used DESC, title) AS rank
      FROM c, f WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.main_id = c.main_id AND t.title = f.title)),
    u AS (SELECT main_id, main_name, title FROM t UNION ALL
      SELECT main_id, main_name, title FROM r WHERE rank <= need)
    SELECT *, row_number() OVER (ORDER BY main_name, title, main_id) AS row_no FROM u""",
)
def topped_up_main(spark, sf):
    """Brands as main occupations; half of the titles carry a bullet, some are nothing else."""
    df = titles(spark, sf)
    bullets = F.expr("repeat('-', cast(id % 2 as int))")
    brands = df.select(
        "id",
        col("sub_name").alias("main_id"),
        F.concat(lit("Main "), "sub_name").alias("main_name"),
        F.when(col("id") % 23 == 0, "--").when(col("id") % 29 == 0, "- ").otherwise(F.concat(bullets, "title")).alias("title"),
    )
    return jobs.top_up_main(brands)


@query(
    "fill_missing_titles",
    f"""WITH t AS (SELECT id, main_id, CASE WHEN id % 11 = 0 THEN NULL ELSE title END AS title FROM ({TITLES_SQL})),
    m AS (SELECT id, main_id, row_number() OVER (PARTITION BY main_id ORDER BY id) AS n FROM t WHERE title IS NULL),
    u AS (SELECT main_id, title, count(*) AS used FROM ({TITLES_SQL}) GROUP BY ALL),
    o AS (SELECT main_id, 'Senior ' || title AS title, 1000000 - used AS pos FROM u WHERE used >= 5
      UNION ALL SELECT main_id, title, 0 FROM u),
    k AS (SELECT main_id, title, row_number() OVER (PARTITION BY main_id ORDER BY pos, title) AS n FROM o
      WHERE title NOT IN (SELECT title FROM t WHERE title IS NOT NULL))
    SELECT id, main_id, title FROM t WHERE title IS NOT NULL UNION ALL
    SELECT m.id, m.main_id, coalesce(k.title, '{ops.TITLE_MISSING}') FROM m LEFT JOIN k ON k.main_id = m.main_id AND k.n = m.n""",
)
def fill_missing_titles(spark, sf):
    """Candidates: every title of the main (all but the unused ones are skipped), then a
    'Senior' form of those used five times or more."""
    every = titles(spark, sf).select("id", "main_id", "title")
    df = every.withColumn("title", F.when(col("id") % 11 != 0, col("title")))
    used = every.groupBy("main_id", "title").agg(F.count("*").alias("used"))
    senior = used.where(col("used") >= 5).select(
        "main_id", F.concat(lit("Senior "), "title").alias("title"), (lit(1000000) - col("used")).alias("pos")
    )
    plain = used.select("main_id", "title", lit(0).cast("bigint").alias("pos"))
    return ops.fill_missing_titles(df, senior.unionByName(plain))


@query(
    "ordered_titles",
    f"SELECT id, row_number() OVER (ORDER BY main_name, title, id) AS row_no FROM ({TITLES_SQL})",
)
def ordered_titles(spark, sf):
    return ops.ordered_titles(titles(spark, sf), ["main_name", "title", "id"]).select("id", "row_no")


@query(
    "more_titles_prompt",
    f"""SELECT main_id, sub_id, n_titles, need, 'Write ' || need || ' job titles for the occupation ' || sub_name || '.' || chr(10)
      || 'Do not repeat: ' || existing || chr(10) || 'Answer with one title per line and no numbers.' AS prompt
    FROM (SELECT main_id, sub_id, sub_name, count(DISTINCT title) AS n_titles, 10 - count(DISTINCT title) AS need,
      array_to_string(list_sort(list(DISTINCT title)), ', ') AS existing FROM ({TITLES_SQL}) GROUP BY ALL) WHERE need > 0""",
)
def more_titles_prompt(spark, sf):
    """Requests for new titles, one per short group."""
    uses = ops.title_uses(titles(spark, sf), ["main_id", "main_name", "sub_id", "sub_name"])
    asked = prompts.more_titles_prompts(
        ops.title_shortfall(uses), ops.title_lists(uses, _KEYS, 10), _KEYS, "sub_name"
    )
    return asked.select(*_KEYS, "n_titles", "need", "prompt")
