import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import values
from titlelab.operators import catalog, prompts, rules
from titlelab.sources.tables import JdbcSource, null_tokens, read_mapping, read_titles, write_mapping, write_titles

FLAGS = "is_status string, is_flags string, is_online string"


def test_main_catalog_filters_flags_and_language(spark):
    occ = spark.createDataFrame([(1, "1", "0", "1"), (2, "0", "0", "1"), (3, "1", "1", "1"), (4, "1", "0", "0")], f"id bigint, {FLAGS}")
    desc = spark.createDataFrame([(1, "1", "ก"), (1, "2", "a"), (2, "1", "ข"), (3, "1", "ค"), (4, "1", "ง")], "occupation_id bigint, language_id string, name string")
    assert values(catalog.main_catalog(occ, desc)) == [(1, "ก")]


def test_thai_order(spark):
    names = ["แก", "กา", "ขา", "เกม", "ก่า", "ไข่"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    ranked = catalog.in_thai_order(df, "name", "id").orderBy("rank").collect()
    assert [r.name for r in ranked] == ["กา", "ก่า", "เกม", "แก", "ขา", "ไข่"]


def test_recent_keeps_the_time_of_day(spark):
    rows = [(1, dt.datetime(2024, 2, 29, 9, 59)), (2, dt.datetime(2024, 2, 29, 10, 0))]
    df = spark.createDataFrame(rows, "id int, created_at timestamp_ntz")
    as_of = F.lit("2024-05-31 10:00:00").cast("timestamp_ntz")
    assert values(catalog.recent(df, "created_at", as_of).select("id")) == [(2,)]


def test_recent_posts_limit(spark):
    posts = spark.range(900).select(
        "id", (F.col("id") % 2).alias("occupation_new_id"), F.lit("1").alias("is_status"), F.lit("0").alias("is_flags"),
        F.lit("1").alias("is_online"), F.lit("2024-05-01").cast("timestamp_ntz").alias("created_at"))
    desc = posts.select(F.col("id").alias("jobpost_id"), F.lit("t").alias("position"))
    got = catalog.recent_posts(posts, desc, posts.limit(1).select(F.lit(0).cast("bigint").alias("main_id")), F.lit("2024-05-31").cast("timestamp_ntz"), limit=300)
    assert [r.id for r in got.orderBy("id").collect()] == list(range(0, 600, 2))


def test_titles_by_occupation_caps_a_hot_occupation(spark):
    posts = spark.range(5000).select("id", F.when(F.col("id") % 100 == 0, 2).otherwise(1).alias("main_id"), F.concat(F.lit("t"), "id").alias("title"))
    cat = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "main_id int, main_name string")
    got = catalog.titles_by_occupation(cat, posts, ["id"])
    assert values(got.groupBy("main_id").count()) == [(1, 200), (2, 50)]


def test_resolve_id_and_attach_name(spark):
    cat = spark.createDataFrame([(3, "x"), (3, "a"), (7, "y")], "id bigint, name string")
    df = spark.createDataFrame([(1, 3), (2, 9), (3, None)], "key int, pid bigint")
    got = catalog.resolve_id(df, cat, "pid", "id", "name").select("key", "resolved_id", "resolved_name")
    assert values(got) == [(1, 3, "a"), (2, None, None), (3, None, None)]
    named = catalog.attach_name(df.select(F.col("pid").alias("id")), cat, "id", "name").select("name")
    assert values(named) == [("a",), (catalog.NAME_MISSING,), (catalog.NAME_MISSING,)]


REPLIES = {
    '{"id": 3}': ("OK", 3),
    ' {"id": 3, "name": "q"}\n': ("OK", 3),
    '{"id": 0, "occupation_id": 7}': ("OK", 7),
    '{"id": "", "occupation_id": 7}': ("OK", 7),
    '{"id": null, "occupation_id": 7}': ("OK", 7),
    '{"id": 3.0}': ("OK", 3),
    "hello": ("NOT_JSON", None),
    '{"id": 3': ("BAD_JSON", None),
    '{"id": "3"}': ("NOT_FOUND", None),
    '{"id": "3", "occupation_id": 7}': ("NOT_FOUND", None),
    '{"name":"q"}': ("NO_ID", None),
    '{"id": ""}': ("NO_ID", None),
    '{"id": []}': ("NO_ID", None),
    '{"id": {}}': ("NO_ID", None),
    '{"id": false}': ("NO_ID", None),
    '{"id": [3]}': ("NOT_FOUND", None),
    '{"id": 3.5}': ("NOT_FOUND", None),
    '{"id": 99}': ("NOT_FOUND", None),
    "[1]": ("NOT_JSON", None),
    "": ("NOT_JSON", None),
    None: ("NOT_JSON", None),
}


def test_choice_replies(spark):
    cat = spark.createDataFrame([(3, "x"), (7, "y")], "id bigint, name string")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(REPLIES)], "key int, text string")
    got = catalog.resolve_id(prompts.parse_choice_reply(df), cat, "reply_id", "id", "name")
    found = F.when(F.col("resolved_id").isNull(), "NOT_FOUND").otherwise("OK")
    rows = got.select(F.coalesce("reply_reason", found), "resolved_id").withColumn("k", F.lit(0))
    by_key = {r.key: (r.reply_reason or ("NOT_FOUND" if r.resolved_id is None else "OK"), r.resolved_id) for r in got.collect()}
    assert rows.count() == len(REPLIES)
    assert [by_key[i] for i in range(len(REPLIES))] == list(REPLIES.values())


def test_option_list_is_python_style_json(spark):
    cat = spark.createDataFrame([(1, 5, 'ช่าง "x"', 2), (1, 4, "a\\b", 1), (2, 9, "z", 1)], "main_id int, sub_id int, sub_name string, rank int")
    got = dict(prompts.option_list(cat, ["main_id"], "sub_id", "sub_name", ["rank"]).collect())
    assert got[1] == "\n".join(f"{i}. {json.dumps({'id': a, 'name': b}, ensure_ascii=False)}" for i, (a, b) in enumerate([(4, "a\\b"), (5, 'ช่าง "x"')], 1))
    assert got[2] == '1. {"id": 9, "name": "z"}'


def test_prompts_fill_every_place(spark):
    cat = spark.createDataFrame([(1, "a", 1)], "main_id int, main_name string, rank int")
    options = prompts.option_list(cat, [], "main_id", "main_name", ["rank"])
    asked = spark.createDataFrame([("{options}", "b")], "job_title string, bussiness_type string")
    text = prompts.main_prompts(asked, options, prompts.MAIN_TEMPLATE_BUSINESS).first().prompt
    assert "Job title: {options}\n" in text and '1. {"id": 1, "name": "a"}' in text
    assert "- AE => ขาย / บริหารการขาย" in text and "{guidance}" not in text


@pytest.mark.parametrize(
    "title, kind, category",
    [
        (" ae ", "exact", "ขาย / บริหารการขาย"),
        ("Store", "exact", "ขนส่ง / คลังสินค้า"),
        ("store manager", None, None),
        ("ผู้จัดการฝ่ายขาย", "contains", "ขาย"),
        ("ผู้จัดการโรงงานขาย", "contains", "บริหาร/ผู้จัดการ"),
        ("หัวหน้าช่างปูน", "contains", "ช่าง/ช่างเทคนิค/อิเลคโทรนิค"),
        ("วิศวกรควบคุมงานก่อสร้าง", "contains", "ก่อสร้าง"),
        ("ผู้ช่วยผู้จัดการ", "contains", "บริหาร/ผู้จัดการ"),
        (None, None, None),
    ],
)
def test_rules(spark, title, kind, category):
    df = spark.createDataFrame([(title,)], "job_title string")
    got = rules.apply_rules(df).first()
    assert (got.rule_kind, got.rule_category) == (kind, category)


def test_category_names_ignore_blanks_around_a_slash(column):
    assert column(rules.name_key, "ขาย / บริหาร", " Part-time/ X ") == ["ขาย/บริหาร", "part-time/x"]


def test_null_tokens(spark):
    df = spark.createDataFrame([("",), ("NA",), ("null",), ("None",), ("Nancy",), (None,)], "t string")
    assert [r.t for r in null_tokens(df, ["t"]).collect()] == [None, None, None, None, "Nancy", None]


def test_titles_file_round_trip(spark, tmp_path):
    rows = [(1, "a", 2, 'say "hi", x', "two\nlines"), (3, "ไทย", 4, None, " pad ")]
    df = spark.createDataFrame(rows, "main_id bigint, main_name string, sub_id bigint, sub_name string, title string")
    write_titles(df, str(tmp_path / "t"))
    assert values(read_titles(spark, str(tmp_path / "t"), multi_line=True)) == sorted(rows, key=repr)
    write_mapping(df, str(tmp_path / "m"))
    assert values(read_mapping(spark, str(tmp_path / "m"))) == [(1, "a"), (3, "ไทย")]


def test_titles_file_with_byte_order_mark(spark, tmp_path):
    file = tmp_path / "bom.csv"
    file.write_text("﻿main_id,main_name,title\n1,ก,x\n", encoding="utf-8")
    assert values(read_titles(spark, str(file), "main_id bigint, main_name string, title string")) == [(1, "ก", "x")]


def test_jdbc_reads_are_split_when_asked():
    source = JdbcSource({"url": "jdbc:x", "user": "u"}, {"jobpost": ("id", 1, 1000, 16)})
    options = source.read_options("jobpost")
    assert options["numPartitions"] == "16" and options["dbtable"] == "jobpost"
    with pytest.raises(ValueError, match="occupation has no split"):
        source.read_options("occupation")
    source.single = ("occupation",)
    assert "partitionColumn" not in source.read_options("occupation")
