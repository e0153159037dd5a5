"""Exact top-k inner-product search by columnar branch and bound.

Vectors become integers. Candidates and queries are packed into blocks of bounded size, one row
a block, and every query block meets every candidate block once. In a block the candidates lie
dimension by dimension; scores grow one group of dimensions at a time, the groups of greatest
mass first. After each group a candidate's score is bounded from both sides by what the
remaining dimensions can add (the product of the remaining norms). Candidates whose upper bound
is under the k-th best lower bound leave, and the columns of the rest are compacted. Scores are
exact integers, so ties go to the smaller id. Each block sends k rows a query to the final rank.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no
part, nor do rows with a null id. Vectors of different lengths don't meet. A row is no
candidate of its own id. Rows repeated under one id count once (the greatest vector); ids with
fewer than k candidates get all. Scores outside 64 bits are cut to the nearest bound.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from titlelab.session import durable

SCALE = 256
TOP = 5
CANDIDATES, QUERIES = 16_384, 1_024
#: Dimensions added between two looks at the bounds.
GROUP = 16


def quantised(rows: DataFrame, key: str, vector: str, scale: int = SCALE, keep: Sequence[str] = ()) -> DataFrame:
    """(id, v) and the columns to keep: usable vectors as whole numbers floor(scale * x)."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = rows.where(F.col(key).isNotNull() & (F.size(vector) > 0) & F.coalesce(usable, F.lit(False)))
    return kept.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: _floor(x, scale)).alias("v"), *keep)


def _floor(x, scale: int):
    """floor(scale * x) as a double, exact for any size; the bigint floor would overflow."""
    y = x.cast("double") * scale
    return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)


def packed(vectors: DataFrame, rows: int, size: int, name: str) -> DataFrame:
    """One row for each block: (dims, block, ids, matrix), dimension by dimension."""
    blocks = max(1, -(-rows // size))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = vectors.select(F.size("v").alias("dims"), block.alias(name), "id", "v")

    def pack(table):
        import pyarrow as pa

        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        dims = table.column("dims")[0].as_py()
        flat = pa.concat_arrays([c.flatten() for c in table.column("v").chunks]).to_numpy(zero_copy_only=False)
        matrix = np.ascontiguousarray(flat.reshape(len(ids), dims)[order].T)
        return pa.table({
            "dims": pa.array([dims], pa.int32()), name: pa.array([table.column(name)[0].as_py()], pa.int32()),
            f"{name}_ids": pa.array([ids[order].astype("<i8").tobytes()]), f"{name}_matrix": pa.array([_bytes(matrix)]),
        })

    return dealt.groupBy("dims", name).applyInArrow(pack, f"dims int, {name} int, {name}_ids binary, {name}_matrix binary")


def _bytes(matrix: np.ndarray) -> bytes:
    """Single precision where that holds whole numbers exactly."""
    return matrix.astype("<f4" if np.abs(matrix).max(initial=0) < 2.0**24 else "<f8").tobytes()


def _matrix(raw: bytes, dims: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<f4" if len(raw) == 4 * dims * n else "<f8").reshape(dims, n).astype(float)


def search(queries: np.ndarray, candidates: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int):
    """Best ``k`` of the candidates (dims x n, ids ascending) for each query (dims x m).

    Returns (query position, candidate position, score) triples.
    """
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * len(queries)
    if top >= 2.0**53:
        return _wide(queries, candidates, own, ids, k)
    kind = np.float32 if top < 2.0**24 else np.float64  # whole numbers are exact below these
    order = np.argsort(-(candidates**2).sum(1), kind="stable")
    queries, candidates = queries[order], candidates[order]
    squares_q, squares_c = queries**2, candidates**2
    out = []
    for first in range(0, queries.shape[1], 64):
        q = queries[:, first : first + 64]
        live = np.arange(candidates.shape[1])
        partial = np.zeros((q.shape[1], len(live)), kind)
        columns = candidates.astype(kind)
        for at in range(0, len(q), GROUP):
            partial += q[at : at + GROUP].T.astype(kind) @ columns[at : at + GROUP]
            if at + GROUP >= len(q) or len(live) <= 4 * k:
                continue
            left_q = np.sqrt(squares_q[at + GROUP :, first : first + 64].sum(0))
            left_c = np.sqrt(squares_c[at + GROUP :, live].sum(0))
            # the k+1 best lower bounds leave room for the query's own row among them
            rest = left_q[:, None] * left_c[None, :] * (1 + 1e-6) + 1e-6
            low = np.partition(partial - rest, len(live) - k - 1, axis=1)[:, len(live) - k - 1]
            stay = ((partial + rest) >= low[:, None]).any(0)
            if stay.mean() < 0.7:
                live, partial, columns = live[stay], partial[:, stay], columns[:, stay]
        for j in range(q.shape[1]):
            out += _best(first + j, partial[j], live, own[first + j], ids, k)
    return out


def _best(query: int, scores: np.ndarray, live: np.ndarray, own: int, ids: np.ndarray, k: int) -> list[tuple]:
    other = np.flatnonzero(ids[live] != own)
    if len(other) > k:
        least = np.partition(scores[other], len(other) - k)[len(other) - k]
        other = other[scores[other] >= least]
    # positions ascend with ids, so a stable sort keeps the smaller id first
    best = other[np.argsort(-scores[other], kind="stable")][:k]
    return [(query, int(live[x]), int(scores[x])) for x in best]


def _wide(queries, candidates, own, ids, k):
    """The same for numbers too great for exact floating point."""
    whole_q = [[int(x) for x in column] for column in queries.T]
    whole_c = [[int(x) for x in column] for column in candidates.T]
    most = (1 << 63) - 1
    out = []
    for j, q in enumerate(whole_q):
        scores = [max(-most - 1, min(most, sum(a * b for a, b in zip(q, c)))) for c in whole_c]
        best = sorted((x for x in range(len(ids)) if ids[x] != own[j]), key=lambda x: (-scores[x], ids[x]))[:k]
        out += [(j, x, scores[x]) for x in best]
    return out


def nearest(candidates: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` greatest inner products of each query.

    Both tables are (id, v) of whole numbers.
    """
    # one vector for each id; a rerun of a task must see the same rows
    candidates = durable(candidates.groupBy("id").agg(F.max("v").alias("v")))
    queries = durable(queries.groupBy("id").agg(F.max("v").alias("v")))
    n, m = candidates.count(), queries.count()
    left = packed(candidates, n, CANDIDATES, "c")
    right = packed(queries, m, QUERIES, "q")
    # each query block is sent to every block of candidates
    blocks = max(1, -(-n // CANDIDATES))
    sent = right.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = sent.join(left, ["dims", "c"]).select("dims", "q_ids", "q_matrix", "c_ids", "c_matrix")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                own, ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["c_ids"], "<i8")
                q, c = _matrix(row["q_matrix"], row["dims"], len(own)), _matrix(row["c_matrix"], row["dims"], len(ids))
                found = search(q, c, own, ids, k)
                if found:
                    a, b, s = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[list(a)]), pa.array(ids[list(b)]), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"]
                    )

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
