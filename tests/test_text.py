import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import values
from titlelab.functions import text
from titlelab.operators import cleaning


def test_split_titles_uses_the_separator_as_a_pattern(column):
    got = column(text.split_titles, "a . b", "a - b", "Grade A Teacher", "x.y", "a .b", "a . ", "p \r q")
    assert got == [["a", "b"], ["a", "b"], ["Grade", "Teacher"], ["x.y"], ["a .b"], ["a", ""], ["p", "q"]]


def test_strip_punct_drops_thai_marks(column):
    assert column(text.strip_punct, "ช่างไม้", "C++ dev", "foo_bar") == ["ชางไม", "C dev", "foo_bar"]


def test_patterns_agree_with_python(column):
    rng = random.Random(3)
    letters = "aZ9_ -+#\t\n ‎\x1c\x1f。ก่ไม้ๆ๙éß٣²①"
    texts = ["".join(rng.choices(letters, k=20)) for _ in range(200)]
    assert column(text.strip_punct, *texts) == [re.sub(r"[^\w\s]", "", t) for t in texts]
    assert column(text.trim_blank, *texts) == [t.strip() for t in texts]
    wanted = [re.sub(r"[^\w\sก-๙]", "", t.strip()) for t in texts]
    assert column(text.clean_business_type, *texts) == wanted
    assert column(text.tokens, *texts) == [re.findall(r"\b\w\w+\b", t.lower()) for t in texts]


def test_tokens(column):
    got = column(text.tokens, "Sales AE x", "ช่างไม้ a1", "foo_bar b", "é à ici", "")
    assert got == [["sales", "ae"], ["างไม", "a1"], ["foo_bar"], ["ici"], []]


def test_clean_business_type(column):
    assert column(text.clean_business_type, "  ก่อสร้าง/รับเหมา!  ") == ["ก่อสร้างรับเหมา"]


def test_strip_bullet(column):
    assert column(text.strip_bullet, "- x ", "--y", "- - z", " -w") == ["x", "y", "- z", "-w"]


def test_list_items_test_the_untrimmed_line(column):
    reply = "Alpha\n1. Beta\n  2. Gamma\n\n๓ Delta\n② Eps"
    assert column(text.list_items, reply, "  7. x\n y ") == [["Alpha", "2. Gamma"], ["y"]]


def test_json_text(column):
    import json

    texts = ['a "b"', "back\\slash", "ไทย", "", "tab\t"]
    assert column(text.json_text, *texts) == [json.dumps(t, ensure_ascii=False) for t in texts]
    assert column(text.json_text, None) == ["null"]


def test_cleaning_treats_blank_and_null_alike(spark):
    df = spark.createDataFrame(
        [(1, "a‎", "x"), (2, "", "x"), (3, None, "x"), (4, "b", ""), (5, "‎", "x")],
        " id int, title string, name string",
    )
    assert values(cleaning.clean_titles(df)) == [(1, "a", "x")]
    assert values(cleaning.require_title(df).select("id")) == [(1,), (4,), (5,)]
    kept = cleaning.drop_incomplete(cleaning.strip_marks(cleaning.fill_blank(df)))
    assert values(kept.select("id")) == [(1,)]
    assert values(cleaning.training_view(df, "title", "name"))[0] == ("", "x")


def test_trim_columns(spark):
    assert cleaning.trim_columns(spark.createDataFrame([(1,)], ["  a "])).columns == ["a"]


@pytest.mark.parametrize("business", [False, True])
def test_validate_requests(spark, business):
    df = spark.createDataFrame([("a", "b"), ("", "b"), (None, "b"), ("a", ""), ("a", None)], "job_title string, bussiness_type string")
    got = [r.reason for r in cleaning.validate_requests(df, business).collect()]
    late = "NO_BUSINESS_TYPE" if business else None
    assert got == [None, "NO_TITLE", "NO_TITLE", late, late]


def test_parse_list_reply_keeps_positions(spark):
    df = spark.createDataFrame([(1, "x\n\n y"), (2, "1. z")], "key int, text string")
    assert values(cleaning.parse_list_reply(df)) == [(1, 0, "x"), (1, 1, "y")]


def test_append_titles_matches_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "main_id int, title string")
    b = spark.createDataFrame([("y", 2)], "title string, main_id int")
    assert values(cleaning.append_titles(a, b)) == [(1, "x"), (2, "y")]


def test_marks_are_removed_inside_text(spark):
    df = spark.range(1).select(F.lit("a‎b").alias("t"))
    assert cleaning.strip_marks(df).first().t == "ab"
