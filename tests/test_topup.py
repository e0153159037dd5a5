import pytest
from pyspark.sql import functions as F

from conftest import values
from titlelab.operators import topup
from titlelab.plans import topup as jobs

SUB = "main_id int, main_name string, sub_id int, sub_name string, title string"


def rows(main, sub, titles):
    return [(main, f"m{main}", sub, f"s{sub}", t) for t in titles]


@pytest.fixture(scope="module")
def catalog(spark):
    """Main 1: subs with 9, 10 and 11 titles, one of which is very common. Main 2: one title."""
    data = rows(1, 1, [f"t{i:02d}" for i in range(9)])
    data += rows(1, 2, [f"t{i:02d}" for i in range(10)])
    data += rows(1, 3, [f"u{i:02d}" for i in range(10)]) + rows(1, 3, ["hot"] * 500)
    data += rows(2, 4, ["only"])
    return spark.createDataFrame(data, SUB).cache()


def test_shortfall_picks_groups_under_target(catalog):
    got = topup.title_shortfall(catalog).select("sub_id", "n_titles", "need")
    assert values(got) == [(1, 9, 1), (4, 1, 9)]


def test_shortfall_of_a_sub_under_two_mains(spark):
    df = spark.createDataFrame(rows(1, 5, ["a"]) + rows(2, 5, ["b", "c"]), SUB)
    by_sub = topup.title_shortfall(df, 3).select("main_id", "main_name", "n_titles", "need")
    assert values(by_sub) == [(1, "m1", 1, 0), (1, "m2", 1, 0), (2, "m1", 2, 0), (2, "m2", 2, 0)]
    by_both = topup.title_shortfall(df, 3, ("main_id", "sub_id"))
    assert values(by_both.select("main_id", "main_name")) == [(1, "m1"), (2, "m2")]


def test_counts(catalog):
    assert values(topup.title_counts(catalog, ["sub_id"])) == [(1, 9), (2, 10), (3, 11), (4, 1)]
    close = topup.title_counts(catalog, ["sub_id"], approximate=True)
    assert dict(close.collect())[3] in (10, 11, 12)
    assert topup.title_summary(catalog).first().asDict() == {"n_rows": 530, "n_mains": 2, "n_titles": 22}


def test_lists_cover_only_short_groups(catalog):
    lists = dict(topup.title_lists(catalog, ["sub_id"], 10).collect())
    assert sorted(lists) == [1, 4] and lists[1] == [f"t{i:02d}" for i in range(9)]


def test_new_titles_come_from_siblings_by_use(catalog):
    got = jobs.new_sub_titles(catalog).select("sub_id", "title")
    assert values(got) == [(1, "hot")]


def test_donors_equal_the_full_ranking(spark):
    """The short donor list gives the same answer as ranking every sibling title."""
    import random

    rng = random.Random(5)
    data = [r for sub in range(30) for r in rows(sub % 3, sub, [f"t{rng.randint(0, 40)}" for _ in range(rng.randint(1, 14))])]
    df = spark.createDataFrame(data, SUB)
    got = values(jobs.new_sub_titles(df).select("sub_id", "title"))
    used, have = {}, {}
    for main, _, sub, _, title in data:
        used[main, title] = used.get((main, title), 0) + 1
        have.setdefault((main, sub), set()).add(title)
    want = []
    for (main, sub), own in have.items():
        offers = sorted((-n, t) for (m, t), n in used.items() if m == main and t not in own)
        want += [(sub, t) for _, t in offers[: max(0, 10 - len(own))]]
    assert got == sorted(want, key=repr)


def test_given_candidates_are_deduplicated(spark):
    df = spark.createDataFrame(rows(1, 1, ["x"]), SUB)
    offered = spark.createDataFrame([(1, 1, 0, "x"), (1, 1, 1, "y"), (1, 1, 2, "y"), (1, 1, 3, "z")], "main_id int, sub_id int, pos int, title string")
    got = jobs.new_sub_titles(df, target=2, candidates=offered)
    assert values(got.select("title")) == [("y",)]
    assert values(topup.first_candidate(offered, ["sub_id"])) == [(1, "x")]


def test_second_run_adds_nothing(catalog):
    once = jobs.top_up_sub(catalog)
    assert jobs.new_sub_titles(once).count() == 0
    counts = dict(topup.title_counts(once, ["sub_id"]).collect())
    assert counts == {1: 10, 2: 10, 3: 11, 4: 1}


def test_cells_with_several_titles_are_split_first(spark):
    df = spark.createDataFrame([(1, "m", 1, "s", "a . b - c‎"), (1, "m", 1, "s", "")], SUB)
    assert values(jobs.prepared_sub_titles(df).select("title")) == [("a",), ("b",), ("c",)]


def test_main_job_strips_bullets_and_numbers_rows(spark):
    df = spark.createDataFrame([(1, "A", "- x "), (1, "A", "y"), (2, "B", "z"), (2, "B", ""), (2, "B", None)], "main_id int, main_name string, title string")
    got = jobs.top_up_main(df, target=3)
    assert [tuple(r) for r in got.orderBy("row_no").collect()] == [
        (1, "A", "x", 1), (1, "A", "y", 2), (1, "A", "z", 3),
        (2, "B", "x", 4), (2, "B", "y", 5), (2, "B", "z", 6),
    ]


def test_fill_gives_each_row_its_own_candidate(spark):
    data = [(i, 1, None) for i in range(1, 5)] + [(5, 2, ""), (6, 1, "used"), (7, 3, None)]
    df = spark.createDataFrame(data, "id int, main_id int, title string")
    offered = spark.createDataFrame([(1, 1, "used"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a"), (2, 1, "c")], "main_id int, pos int, title string")
    got = topup.fill_missing_titles(df, offered).select("id", "title")
    miss = topup.TITLE_MISSING
    assert values(got) == [(1, "a"), (2, "b"), (3, miss), (4, miss), (5, "c"), (6, "used"), (7, miss)]


def test_fill_handles_a_category_with_most_rows(spark):
    df = spark.range(30_000).select("id", F.lit(1).alias("main_id"), F.lit(None).cast("string").alias("title"))
    offered = spark.range(20_000).select(F.lit(1).alias("main_id"), F.col("id").alias("pos"), F.concat(F.lit("c"), "id").alias("title"))
    got = topup.fill_missing_titles(df, offered)
    right = F.when(F.col("id") < 20_000, F.concat(F.lit("c"), "id")).otherwise(topup.TITLE_MISSING)
    assert got.where(F.col("title") != right).count() == 0 and got.count() == 30_000


def test_blank_parts_of_cells_are_no_titles(spark):
    rows = [(1, "M", 1, "a", "x . "), (1, "M", 1, "a", "   "), (1, "M", 1, "a", " yy . z "), (1, "M", 2, "b", "q")]
    done = jobs.top_up_sub(spark.createDataFrame(rows, SUB), target=4)
    assert values(done.select("sub_id", "title")) == [(1, "q"), (1, "x"), (1, "yy"), (1, "z"), (2, "q"), (2, "x"), (2, "yy"), (2, "z")]
    again = jobs.top_up_sub(done, target=4)
    assert values(again) == values(done)


def test_main_titles_are_compared_without_bullets(spark):
    rows = [(1, "M", "x"), (1, "M", "-x"), (1, "M", "--"), (1, "M", "- "), (2, "N", "q"), (2, "N", "- w")]
    done = jobs.top_up_main(spark.createDataFrame(rows, "main_id int, main_name string, title string"), target=3)
    assert values(done.select("main_id", "title")) == [(1, "q"), (1, "w"), (1, "x"), (1, "x"), (2, "q"), (2, "w"), (2, "x")]
    again = jobs.top_up_main(done.drop("row_no"), target=3)
    assert values(again) == values(done)


def test_given_candidates_may_hold_blanks_and_bullets(spark):
    rows = spark.createDataFrame([(1, "M", "x")], "main_id int, main_name string, title string")
    offered = spark.createDataFrame([(1, 1, "--"), (1, 2, "-x"), (1, 3, " - y")], "main_id int, pos int, title string")
    done = jobs.top_up_main(rows, target=2, candidates=offered)
    assert values(done.select("title")) == [("- y",), ("x",)]
