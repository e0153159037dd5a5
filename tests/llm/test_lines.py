"""Line dedup against a plain version and its SQL twin."""

import random

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from conftest import SMALL
from titlelab.llm import lines


def plain(rows, least_chars, least_docs):
    """(doc_id, n_lines, n_dropped, kept) of (doc_id, text) rows; a null id is the least."""
    fold = str.maketrans(lines.UPPER, lines.LOWER)
    order = lambda d: (d is not None, d or 0)
    split = [(d, (t or "").split("\n")) for d, t in rows]
    docs = {}
    for d, found in split:
        for line in found:
            docs.setdefault(line.strip(lines.SPACE).translate(fold), set()).add(order(d))
    out = []
    for d, found in split:
        stay = [
            x for x in found
            if len(k := x.strip(lines.SPACE).translate(fold)) < least_chars or len(docs[k]) < least_docs or max(docs[k]) == order(d)
        ]
        out.append((d, len(found), len(found) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def run(spark, rows, least_chars=4, least_docs=3, parts=3):
    docs = spark.createDataFrame([(d, t, "x", 9) for d, t in rows], "doc_id long, text string, keep string, n_lines int")
    found = lines.dedup(docs.repartition(parts), least_chars=least_chars, least_docs=least_docs)
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in found.collect()), key=repr)


EDGES = [
    (None, None), (1, None), (2, ""), (3, "\n"), (4, "same line\r\nsame LINE\n\n"), (5, " Same line\t\nother"), (6, "same line"),
    (6, "same line"), (6, "same line\nÉcole normale"), (7, "école normale\nÉCOLE normale"), (8, "École normale"), (None, "same line"),
    (9, "École Normale\n same line"), (10, "abc\n" * 3), (11, "abc"), (12, "abc"),
]


@pytest.mark.parametrize("least_docs", [2, 3, 5])
def test_edges_equal_plain_version(spark, least_docs):
    assert run(spark, EDGES, least_docs=least_docs) == plain(EDGES, 4, least_docs)


def test_random_texts_equal_plain_version(spark):
    pick = random.Random(5)
    pool = [f"{pick.choice(['Line', 'line', ' LINE '])} number {i}" for i in range(40)]
    rows = [(pick.randrange(60), "\n".join(pick.choices(pool, k=pick.randrange(9)))) for _ in range(150)]
    assert run(spark, rows, 20 - 8) == plain(rows, 12, 3)


def test_frequent_keys_are_folded_alike(spark, monkeypatch):
    rows = [(i, f"everywhere the same line\nown line of document {i}\nrare line {i % 40} of some") for i in range(120)]
    expected = plain(rows, 20, 3)
    assert run(spark, rows, 20) == expected
    monkeypatch.setattr(lines, "RANGE_LINES", 16)
    monkeypatch.setattr(lines, "HOT_SHARE", 8)
    assert run(spark, rows, 20) == expected


def test_long_text_and_empty_table(spark):
    long = "\n".join(f"line {i} of a long text" if i % 3 else "a line that all texts hold" for i in range(60_000))
    rows = [(1, long), (2, long), (3, "a line that all texts hold"), (4, long + "\nend")]
    assert run(spark, rows, 10) == plain(rows, 10, 3)
    assert run(spark, rows[:0]) == []


def test_bitmaps_hold_runs_of_kept_lines(spark):
    docs = spark.createDataFrame([(i, f"x y z\nkept {i} one\nx y z" if i < 3 else "x y z") for i in range(4)], "doc_id long, text string")
    maps = {r["_id"]: (r["n_dropped"], [tuple(k) for k in r["keep"]]) for r in lines.keep_bitmaps(docs, least_chars=5).collect()}
    assert maps[0] == (2, [(1, 1), (3, lines._TO_END - 3)]) and 3 not in maps


def test_query_equals_sql(spark):
    name = "op12_line_dedup"
    assert compare(spark, connect(SMALL), SMALL, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_main_path_runs_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = lines.dedup(docs)._jdf.queryExecution().toString() + lines.keep_bitmaps(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))
