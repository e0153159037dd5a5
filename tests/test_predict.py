import pytest
from pyspark.sql import functions as F

from conftest import values
from titlelab.operators import centroids
from titlelab.operators.rules import Rule
from titlelab.plans import predict
from titlelab.sources import artifacts

HISTORY = [
    (1, 10, "ขาย หน้าร้าน", "ร้านค้า"), (1, 11, "sales engineer", "โรงงาน"), (2, 20, "site engineer", "ก่อสร้าง"),
    (2, 21, "carpenter site", "ก่อสร้าง"), (3, 30, "retired clerk", "โรงงาน"), (3, 30, "clerk", "โรงงาน"),
]


@pytest.fixture(scope="module")
def world(spark):
    history = spark.createDataFrame(HISTORY, "main_id int, sub_id int, title string, bussiness_type string")
    main = spark.createDataFrame([(1, "ขาย/บริหารการขาย"), (2, "ก่อสร้าง"), (4, "บริหาร/ผู้จัดการ")], "main_id int, main_name string")
    sub = spark.createDataFrame([(1, 10, "หน้าร้าน"), (1, 11, "sales"), (2, 20, "วิศวกร"), (2, 29, "ช่างเทคนิค")], "main_id int, sub_id int, sub_name string")
    model = centroids.fit_title_model(history)
    return predict.Catalog(main, sub), model, predict.fit_business_centroids(history, model)


def member(spark, world, *titles):
    df = spark.createDataFrame(list(enumerate(titles)), "request_id int, job_title string")
    got = predict.predict_member(df, world[0], world[1])
    return [(r.occupation_id, r.sub_occupation_id, r.status, r.reason) for r in got.orderBy("request_id").collect()]


def test_member_outcomes(spark, world):
    got = member(spark, world, "AE", "Sales Engineer!", "", None, "retired", "qqq", "ผู้จัดการโรงงาน", "carpenter site")
    assert got == [
        (1, None, "PARTIAL", "RULE"),  # rule names the main; no known word picks a sub
        (1, 11, "OK", "MODEL"),
        (None, None, "REJECTED", "NO_TITLE"),
        (None, None, "REJECTED", "NO_TITLE"),
        (None, None, "FAILED", "NOT_FOUND"),  # main 3 is not in the live catalogue
        (None, None, "FAILED", "NO_MATCH"),
        (4, None, "PARTIAL", "RULE"),
        (2, None, "PARTIAL", "MODEL"),  # sub 21 is not live
    ]


def test_sub_rule_prefers_the_exact_sub(spark, world):
    catalog, model, _ = world
    rules = predict.RuleSet(exact=(Rule("ช่างไม้", "ก่อสร้าง"),))
    df = spark.createDataFrame([(1, "ช่างไม้")], "request_id int, job_title string")
    assert predict.predict_member(df, catalog, model, rules).first().sub_occupation_id == 29
    exact = predict.Catalog(catalog.main, catalog.sub.union(spark.createDataFrame([(2, 25, "ช่างไม้")], catalog.sub.schema)))
    assert predict.predict_member(df, exact, model, rules).first().sub_occupation_id == 25


def test_every_request_is_answered_once(spark, world):
    df = spark.range(3000).select(F.col("id").alias("request_id"), F.when(F.col("id") % 3 > 0, "sales engineer").otherwise(F.concat(F.lit("site "), "id")).alias("job_title"))
    got = predict.predict_member(df, world[0], world[1])
    assert got.count() == 3000 and got.select("request_id").distinct().count() == 3000


def test_employer_uses_the_business_type_then_falls_back(spark, world):
    catalog, model, special = world
    data = [(1, "engineer", " ก่อสร้าง! "), (2, "engineer", "โรงงาน"), (3, "site engineer", "ธนาคาร"), (4, "engineer", ""), (5, "", "x"), (6, "AE", "โรงงาน"), (7, "site", "โรงงาน"), (8, "qqq", "โรงงาน"), (9, "engineer", "!?"), (10, "engineer", None)]
    df = spark.createDataFrame(data, "request_id int, job_title string, bussiness_type string")
    got = {r.request_id: (r.occupation_id, r.bussiness_type, r.status, r.reason) for r in predict.predict_employer(df, catalog, model, special).collect()}
    assert got[1] == (2, "ก่อสร้าง", "OK", "BUSINESS")
    assert got[2] == (1, "โรงงาน", "OK", "BUSINESS")
    assert got[3] == (2, "ธนาคาร", "OK", "FALLBACK")
    assert got[4][2:] == ("REJECTED", "NO_BUSINESS_TYPE") and got[5][2:] == ("REJECTED", "NO_TITLE")
    assert got[6][0] == 1 and got[6][3] == "RULE"
    assert got[7][0] == 2 and got[7][3] == "FALLBACK"
    assert got[8][2:] == ("FAILED", "NO_MATCH")
    assert got[9][1] is None and got[9][3] == "FALLBACK" and got[9][0] in (1, 2)
    assert got[10] == (None, None, "REJECTED", "NO_BUSINESS_TYPE")


def test_saved_model_predicts_the_same(spark, world, tmp_path):
    artifacts.save_title_model(str(tmp_path), world[1])
    loaded = artifacts.load_title_model(spark, str(tmp_path))
    df = spark.createDataFrame([(i, t) for i, (_, _, t, _) in enumerate(HISTORY)], "request_id int, job_title string")
    assert values(predict.predict_member(df, world[0], loaded)) == values(predict.predict_member(df, *world[:2]))
