"""Sources, cleaning and column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.inputs import TITLES_SQL, business_sql, col, lit, strip_sql, titles, tokens_sql, trim_sql
from titlelab.functions.text import clean_business_type, strip_bullet, strip_punct, tokens
from titlelab.operators import cleaning as ops
from titlelab.session import scratch_path
from titlelab.sources.tables import null_tokens, read_table, read_titles, write_titles


@query(
    "titles_csv_roundtrip",
    f"""SELECT id, main_id, main_name, sub_id, sub_name,
      CASE WHEN id % 5 = 0 THEN title || ' "a", ' || chr(10) || 'b' ELSE title END AS title
    FROM ({TITLES_SQL})""",
)
def titles_csv_roundtrip(spark, sf):
    """Titles with quotes, commas and line breaks survive a CSV write and read."""
    df = titles(spark, sf)
    odd = F.concat(col("title"), lit(' "a", \nb'))
    df = df.withColumn("title", F.when(col("id") % 5 == 0, odd).otherwise(col("title")))
    path = scratch_path(spark, "titles-csv")
    write_titles(df, path)
    schema = "id bigint, main_id string, main_name string, sub_id string, sub_name string, title string"
    return read_titles(spark, path, schema, multi_line=True)


@query(
    "null_tokens",
    f"""SELECT id, CASE WHEN id % 13 = 0 OR id % 17 = 0 THEN NULL ELSE title END AS title
    FROM ({TITLES_SQL})""",
)
def null_tokens_query(spark, sf):
    marked = (
        F.when(col("id") % 13 == 0, "N/A").when(col("id") % 17 == 0, "null").otherwise(col("title"))
    )
    df = titles(spark, sf).select("id", marked.alias("title"))
    return null_tokens(df, ["title"])


def _marked(spark, sf):
    """Some titles carry an invisible mark, some are blank, some are missing."""
    title = (
        F.when(col("id") % 11 == 0, "")
        .when(col("id") % 19 == 0, lit(None))
        .when(col("id") % 3 == 0, F.concat("title", lit("\u200e")))
        .otherwise(col("title"))
    )
    return titles(spark, sf).select("id", "main_id", title.alias("title"))


@query("trim_columns", f"SELECT id, main_id, title FROM ({TITLES_SQL})")
def trim_columns(spark, sf):
    """Column names that came with blanks around them."""
    padded = titles(spark, sf).select(col("id").alias(" id"), col("main_id").alias("main_id  "), col("title").alias(" title "))
    return ops.trim_columns(padded)


@query(
    "clean_titles",
    f"SELECT id, main_id, title FROM ({TITLES_SQL}) WHERE id % 11 <> 0 AND id % 19 <> 0",
)
def clean_titles(spark, sf):
    df = ops.strip_marks(ops.fill_blank(_marked(spark, sf)))
    return ops.drop_incomplete(ops.trim_columns(df))


@query(
    "require_title",
    f"""SELECT id, main_id, CASE WHEN id % 3 = 0 THEN title || chr(8206) ELSE title END AS title
    FROM ({TITLES_SQL}) WHERE id % 11 <> 0 AND id % 19 <> 0""",
)
def require_title(spark, sf):
    return ops.require_title(_marked(spark, sf))


@query(
    "training_view",
    f"SELECT title AS job_title, main_name AS category FROM ({TITLES_SQL}) WHERE id % 11 <> 0",
)
def training_view(spark, sf):
    df = titles(spark, sf)
    return ops.training_view(df.withColumn("title", F.when(col("id") % 11 != 0, col("title"))))


@query("strip_punct", f"SELECT doc_id, {strip_sql('text')} AS clean FROM documents")
def strip_punct_query(spark, sf):
    return read_table(spark, "documents", sf).select("doc_id", strip_punct("text").alias("clean"))


@query(
    "tokens",
    f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS digest
    FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)""",
)
def tokens_query(spark, sf):
    df = read_table(spark, "documents", sf).select("doc_id", tokens("text").alias("t"))
    return df.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.concat_ws(" ", "t")).alias("digest"))


@query(
    "clean_business_type",
    f"""SELECT 'page' AS kind, page_id AS id, {business_sql("'  ' || url || '! '")} AS business FROM pages
    UNION ALL
    SELECT 'document', doc_id, {business_sql("chr(160) || source || ' / ก่อสร้าง! '")} FROM documents""",
)
def clean_business_type_query(spark, sf):
    page = F.concat(lit("  "), col("url"), lit("! "))
    doc = F.concat(lit("\u00a0"), col("source"), lit(" / ก่อสร้าง! "))
    pages = read_table(spark, "pages", sf).select(
        lit("page").alias("kind"), col("page_id").alias("id"), clean_business_type(page).alias("business")
    )
    docs = read_table(spark, "documents", sf).select(
        lit("document"), "doc_id", clean_business_type(doc)
    )
    return pages.union(docs)


@query(
    "strip_bullet",
    f"""SELECT id, {trim_sql("regexp_replace(repeat('-', CAST(id % 4 AS BIGINT)) || ' ' || title || ' ', '^-+', '')")} AS title
    FROM ({TITLES_SQL})""",
)
def strip_bullet_query(spark, sf):
    hyphens = F.expr("repeat('-', cast(id % 4 as int))")
    df = titles(spark, sf)
    return df.select("id", strip_bullet(F.concat(hyphens, lit(" "), col("title"), lit(" "))).alias("title"))


@query(
    "validate_requests",
    f"""SELECT id AS request_id, CASE WHEN id % 7 = 0 THEN 'NO_TITLE'
      WHEN id % 5 = 0 THEN 'NO_BUSINESS_TYPE' END AS reason FROM ({TITLES_SQL})""",
)
def validate_requests(spark, sf):
    df = titles(spark, sf).select(
        col("id").alias("request_id"),
        F.when(col("id") % 7 != 0, col("title")).alias("job_title"),
        F.when(col("id") % 5 == 0, "").otherwise(col("sub_name")).alias("bussiness_type"),
    )
    return ops.validate_requests(df, need_business=True).select("request_id", "reason")


@query(
    "explode_titles",
    f"""SELECT id, unnest(string_split_regex(title || ' . ' || main_id || ' - ' || sub_name, ' . ')) AS title
    FROM ({TITLES_SQL})""",
)
def explode_titles(spark, sf):
    cell = F.concat("title", lit(" . "), "main_id", lit(" - "), "sub_name")
    return ops.explode_titles(titles(spark, sf).select("id", cell.alias("title")))


@query(
    "parse_list_reply",
    rf"""WITH r AS (SELECT conv_id, turn, list_transform(string_split(text, chr(10)),
        lambda x, i: CASE WHEN i % 2 = 0 THEN CAST(i AS VARCHAR) || '. ' || x ELSE x END) AS lines
      FROM conversations WHERE role = 'assistant'),
    s AS (SELECT conv_id, turn, string_split({trim_sql("array_to_string(lines, chr(10))")}, chr(10)) AS lines FROM r),
    k AS (SELECT conv_id, turn, list_filter(lines, lambda x: {trim_sql('x')} <> ''
        AND NOT regexp_matches(x, '^\p{{Nd}}')) AS lines FROM s)
    SELECT conv_id, turn, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS pos,
      {trim_sql('unnest(lines)')} AS item FROM k""",
)
def parse_list_reply(spark, sf):
    """Assistant turns as replies; every second line is numbered and must be dropped."""
    turns = read_table(spark, "conversations", sf).where(col("role") == "assistant")
    numbered = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(i % 2 == 1, F.concat((i + 1).cast("string"), lit(". "), x)).otherwise(x),
    )
    replies = turns.select("conv_id", "turn", F.array_join(numbered, "\n").alias("text"))
    return ops.parse_list_reply(replies)
