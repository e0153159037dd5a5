"""Hard negatives against brute force over all rows."""

import random

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from conftest import SMALL
from pyspark.sql import functions as F

from titlelab.llm import negatives


def brute_force(rows, anchors, n_positives=5, n_negatives=10):
    """rows: {id: (label, whole numbers)}."""
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
    out = []
    for a in anchors:
        label, v = rows[a]
        others = sorted((-dot(v, w), i, m) for i, (m, w) in rows.items() if i != a and len(w) == len(v))
        for score, p, _ in [x for x in others if x[2] == label][:n_positives]:
            inside = [x for x in others if x[2] != label and -30 * score <= -100 * x[0] <= -90 * score][:n_negatives]
            out += [(a, p, r, i, -score, -s) for r, (s, i, _) in enumerate(inside, 1)]
    return sorted(out)


def run(spark, rows, every=3, parts=3):
    data = [(i, [float(x) / 256 for x in v], m) for i, (m, v) in rows.items()]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(parts)
    ready = negatives.usable(df, "vec_id", "embedding", F.col("label"))
    got = negatives.mine(ready, ready.where(f"id % {every} = 0")).collect()
    return sorted(tuple(r) for r in got)


def random_rows(seed, n, dims, top, labels=3):
    pick = random.Random(seed)
    return {i: (pick.randrange(labels), [pick.randint(-top, top) for _ in range(dims)]) for i in range(n)}


@pytest.mark.parametrize(("dims", "top"), [(1, 3), (2, 2), (6, 40), (3, 0)])
def test_equals_brute_force(spark, monkeypatch, dims, top):
    rows = random_rows(dims, 90, dims, top)
    assert run(spark, rows) == brute_force(rows, [i for i in rows if i % 3 == 0])
    monkeypatch.setattr(negatives, "CELLS", 16 * dims)
    monkeypatch.setattr(negatives, "ANCHOR_CELLS", 8 * dims)
    monkeypatch.setattr(negatives, "STRETCH", 2)
    assert run(spark, rows) == brute_force(rows, [i for i in rows if i % 3 == 0])


def test_ties_and_a_frequent_vector(spark):
    rows = random_rows(1, 40, 4, 20) | {i: (i % 2, [7, -3, 0, 5]) for i in range(40, 300)}
    assert run(spark, rows, 10) == brute_force(rows, range(0, 300, 10))


def test_scores_beyond_floating_point(spark):
    rows = random_rows(4, 24, 3, 1 << 40)
    got = run(spark, rows)
    expected = brute_force(rows, [i for i in rows if i % 3 == 0])
    inside = [r for r in expected if abs(r[4]) < 1 << 62]
    assert [r for r in got if abs(r[4]) < 1 << 62] == inside


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (0, [1.0, 0.0], 1, "a"), (1, [1.0, 0.5], 1, "b"), (2, [0.5, 0.0], 2, "c"), (3, None, 1, "d"), (4, [nan, 1.0], 2, "e"),
        (5, [1.0, None], 2, "f"), (6, [inf, 1.0], 1, "g"), (7, [1.0, 1.0], None, "h"), (None, [1.0, 1.0], 1, "i"), (8, [], 1, "j"),
        (9, [0.5, 0.1, 0.0], 2, "k"), (2, [0.5, 0.0], 2, "again"),
    ]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, id string")
    ready = negatives.usable(df, "vec_id", "embedding", F.col("label"))
    assert sorted(r["id"] for r in ready.collect()) == [0, 1, 2, 9]
    got = [tuple(r) for r in negatives.mine(ready, ready.where("id = 0")).collect()]
    assert got == [(0, 1, 1, 2, 65536, 32768)]
    assert negatives.mine(ready.where("id < 0"), ready.where("id < 0")).count() == 0


def test_a_block_is_left_early():
    """Rows behind the threshold are never scored."""
    import numpy as np

    n = 5000
    matrix = np.zeros((n, 2))
    matrix[:, 0] = np.arange(n)
    lists = negatives.Lists(np.arange(n), np.zeros(n, np.int64), matrix)
    scored = []
    exact = lists.scores
    lists.scores = lambda a, rows: scored.extend(rows) or exact(a, rows)
    (scores, ids), = lists.best(np.array([2.0, 0.0]), np.ones(n, bool), [(0, 10**9)], 5)
    assert ids.tolist() == [4999, 4998, 4997, 4996, 4995] and scores[0] == 9998 and len(scored) == negatives.STRETCH


def test_query_equals_sql(spark):
    name = "op13_hard_negatives"
    assert compare(spark, connect(SMALL), SMALL, entry.queries()[name], entry.oracle_sql()[name]) is None
