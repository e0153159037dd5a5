"""Hard-negative mining by Fagin's threshold algorithm over blocks of vectors.

An anchor's positives are the rows of its own label with the greatest inner products. For each
positive a window of scores is open, ``least`` to ``most`` hundredths of the positive's score, and
the anchor's hard negatives are the best rows of other labels inside it.

Vectors are packed into blocks of bounded size. In a block every dimension is a list of rows sorted
by their component. An anchor reads each list from the end its own component's sign points to,
a stretch at a time, and scores each row it meets for the first time exactly, by random access.
The threshold is what a row not yet met could still score at most: the sum over dimensions of the
anchor's component times the last one read. The anchor stops in a block once the threshold lies strictly
below the k-th score of each of its windows (or below a window's least score, where nothing more
can fall in), so rows that tie with the k-th are all met. Positives are one such window without an upper end,
over the lists of the anchor's label. Each block sends at most k rows a window to the final rank.

Blocks of anchors meet every block of rows: a stated query set against all rows. No group is larger
than a block, whatever share of the rows a label or a vector has.

Defined results: rows with a null id, a null label, or a vector that is null, empty or holds a null
or non-finite component take no part. Rows repeated under one id count once (the greatest vector
and label). Vectors of different lengths don't meet. Ties go to the smaller id. An anchor without
positives, and a positive without negatives, has no rows. A positive score of zero asks for
negatives of score zero; a negative one has an empty window. Components become whole numbers; sums beyond
2^53 are formed in Python's integers, and scores outside 64 bits are cut to the nearest bound.
Text plays no part, so long texts don't arise; columns other than the three named are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from titlelab.llm.topk import quantised
from titlelab.session import durable

#: Rows of the result, and the window in hundredths of a positive's score.
POSITIVES, NEGATIVES = 5, 10
LEAST, MOST = 30, 90
#: Numbers in a block of rows and in a block of anchors.
CELLS, ANCHOR_CELLS = 1 << 20, 1 << 16
#: Rows read from each list in the first stretch; each further stretch is as long as all before it.
STRETCH = 64

_TOP = (1 << 63) - 1


def usable(rows: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(id, v, label): the rows that take part, one for each id, as whole numbers."""
    # the number is read from the struct, so the vector column is computed once
    labelled = rows.select(F.col(key).alias("_key"), F.col(vector).alias("_vector"), label.cast("long").alias("label")).where("label IS NOT NULL")
    numbers = quantised(labelled, "_key", "_vector", keep=["label"])
    return numbers.groupBy("id").agg(F.max(F.struct("v", "label")).alias("r")).select("id", "r.v", "r.label")


def packed(vectors: DataFrame, cells: int, name: str, more: dict[str, str] | None = None) -> DataFrame:
    """One row for each block: (dims, name, ids, labels, matrix), rows in order of id.

    ``more`` names further columns of longs arrays that are passed on, row by row.
    """
    sized = vectors.withColumn("dims", F.size("v"))
    counts = durable(sized.groupBy("dims").agg(F.count("*").alias("_n")))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_n") * F.col("dims") / F.lit(cells))).cast("int")
    dealt = sized.join(counts.select("dims", blocks.alias("_blocks")), "dims").withColumn(name, F.pmod(F.xxhash64("id"), "_blocks").cast("int"))
    extra = list(more or {})

    def pack(table):
        import pyarrow as pa

        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        dims = table.column("dims")[0].as_py()
        flat = pa.concat_arrays([c.flatten() for c in table.column("v").chunks]).to_numpy(zero_copy_only=False)
        matrix = np.ascontiguousarray(flat.reshape(len(ids), dims)[order], "<f8")
        table = table.take(pa.array(order))
        row = {
            "dims": pa.array([dims], pa.int32()), name: pa.array([table.column(name)[0].as_py()], pa.int32()),
            "ids": pa.array([ids[order].tolist()], pa.list_(pa.int64())),
            "labels": pa.array([table.column("label").to_pylist()], pa.list_(pa.int64())),
            "matrix": pa.array([matrix.tobytes()], pa.binary()),
        }
        for column in extra:
            row[column] = pa.array([table.column(column).to_pylist()], pa.list_(pa.list_(pa.int64())))
        return pa.table(row)

    kinds = f"dims int, {name} int, ids array<long>, labels array<long>, matrix binary" + "".join(f", {c} array<array<long>>" for c in extra)
    return dealt.select("dims", name, "id", "v", "label", *extra).groupBy("dims", name).applyInArrow(pack, kinds)


class Lists:
    """The sorted lists of one block of rows, and the exact score of any of them."""

    def __init__(self, ids, labels, matrix):
        self.ids, self.labels, self.matrix = ids, labels, matrix
        self.order = np.argsort(matrix, axis=0, kind="stable").T.astype(np.int32)  # dims x rows, least first
        self.largest = np.abs(matrix).max(initial=0)

    def part(self, rows):
        return Lists(self.ids[rows], self.labels[rows], self.matrix[rows])

    def scores(self, anchor, rows):
        """Exact inner products; Python's integers where floating point would round."""
        if self.exact(anchor):
            return (self.matrix[rows] @ anchor).astype(np.int64)
        whole = [int(x) for x in anchor]
        return np.array([_cut(sum(a * int(x) for a, x in zip(whole, row))) for row in self.matrix[rows]], np.int64)

    def exact(self, anchor):
        return float(np.abs(anchor).max(initial=0)) * float(self.largest) * len(anchor) < 2.0**53

    def best(self, anchor, allowed, windows, k):
        """For each window (least, most): the ``k`` best (score, id) among rows that ``allowed`` marks."""
        n, found = len(self.ids), [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in windows]
        used = np.flatnonzero(anchor)
        rising = anchor[used] > 0
        seen = np.zeros(n, bool)
        at, step = 0, STRETCH
        while at < n:
            to = min(n, at + step)
            stretch = [self.order[d, n - to : n - at] if up else self.order[d, at:to] for d, up in zip(used, rising)]
            if not len(used):  # every row scores 0
                stretch, to = [np.arange(n)], n
            fresh = np.zeros(n, bool)
            for rows in stretch:
                fresh[rows] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh & allowed)
            scores = self.scores(anchor, new)
            for w, (least, most) in enumerate(windows):
                inside = (scores >= least) & (scores <= most)
                s = np.concatenate([found[w][0], scores[inside]])
                ids = np.concatenate([found[w][1], self.ids[new[inside]]])
                keep = np.lexsort((ids, -s.astype(float) if self.exact(anchor) else _falling(s)))[:k]
                found[w] = s[keep], ids[keep]
            if to == n:
                break
            last = [self.matrix[rows[0] if up else rows[-1], d] for rows, d, up in zip(stretch, used, rising)]
            # what any row not met yet can score at most
            bound = sum(int(a) * int(x) for a, x in zip(anchor[used], last))
            if all(bound < least or (len(s) == k and bound < s[-1]) for (least, _), (s, _) in zip(windows, found)):
                break
            at, step = to, to
        return found


def _falling(scores):
    """Ranks that sort scores from the greatest to the least without leaving the integers."""
    return -np.unique(scores, return_inverse=True)[1]


def _cut(value: int) -> int:
    return max(-_TOP - 1, min(_TOP, value))


def window_of(score: int, least: int = LEAST, most: int = MOST) -> tuple[int, int]:
    """Least and greatest whole score with ``least * score <= 100 * x <= most * score``."""
    return _cut(-((-least * score) // 100)), _cut((most * score) // 100)


def positives(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the ``k`` best other rows of each anchor's label."""

    def search(anchors, rows):
        of_label: dict = {}
        for anchor_id, label, anchor in zip(anchors.ids, anchors.labels, anchors.matrix):
            if label not in of_label:
                of_label[label] = rows.part(np.flatnonzero(rows.labels == label))
            own = of_label[label]
            for score, other in zip(*own.best(anchor, own.ids != anchor_id, [(-_TOP - 1, _TOP)], k)[0]):
                yield int(anchor_id), int(other), int(score)

    found = _met(left, right, search, [], "anchor_id long, positive_id long, positive_score long")
    return _first(found, ["anchor_id"], ["positive_score", "positive_id"], k).drop("rank")


def negatives(left: DataFrame, right: DataFrame, k: int, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Hard negatives for anchors packed with their ``positives`` and ``scores``."""

    def search(anchors, rows):
        for i, (anchor_id, label, anchor) in enumerate(zip(anchors.ids, anchors.labels, anchors.matrix)):
            windows = [window_of(s, least, most) for s in anchors.scores[i]]
            open_ = [w for w, (low, high) in enumerate(windows) if low <= high]
            if not open_:
                continue
            found = rows.best(anchor, rows.labels != label, [windows[w] for w in open_], k)
            for w, pairs in zip(open_, found):
                for score, other in zip(*pairs):
                    yield int(anchor_id), int(anchors.positives[i][w]), int(other), int(anchors.scores[i][w]), int(score)

    kinds = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    found = _met(left, right, search, ["positives", "scores"], kinds)
    return _first(found, ["anchor_id", "positive_id"], ["negative_score", "negative_id"], k)


def _first(found: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    best = W.partitionBy(*keys).orderBy(F.desc(order[0]), order[1])
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _met(left: DataFrame, right: DataFrame, search, more: list[str], kinds: str) -> DataFrame:
    """Rows that ``search(anchors, rows)`` yields, for every block of anchors and every block of rows."""
    names = [c.split()[0] for c in kinds.split(", ")]
    blocks = right.groupBy("dims").agg((F.max("block") + 1).alias("_blocks"))
    sent = left.join(blocks, "dims").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    a = sent.select("dims", "block", *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "matrix")], *more)
    met = a.join(right, ["dims", "block"])

    def run(batches):
        import pyarrow as pa

        class Anchors:
            pass

        last, rows = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at] for c in batch.schema.names}
                dims, block = row["dims"].as_py(), row["block"].as_py()
                if last != (dims, block):  # a block of rows serves the anchors that follow it
                    ids, labels = _longs(row["ids"]), _longs(row["labels"])
                    matrix = np.frombuffer(row["matrix"].as_buffer(), "<f8").reshape(-1, dims)
                    last, rows = (dims, block), Lists(ids, labels, matrix)
                anchors = Anchors()
                anchors.ids, anchors.labels = _longs(row["a_ids"]), _longs(row["a_labels"])
                anchors.matrix = np.frombuffer(row["a_matrix"].as_buffer(), "<f8").reshape(-1, dims)
                for c in more:
                    setattr(anchors, c, row[c].as_py())
                found = list(search(anchors, rows))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=names)

    return met.mapInArrow(run, kinds)


def _longs(scalar) -> np.ndarray:
    return scalar.values.to_numpy()


def mine(
    vectors: DataFrame, anchors: DataFrame, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
    least: int = LEAST, most: int = MOST,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Both tables are (id, v, label) as ``usable`` gives them, the anchors among the vectors.
    """
    vectors, anchors = durable(vectors), durable(anchors)
    rows = durable(packed(vectors, CELLS, "block"))
    found = durable(positives(durable(packed(anchors, ANCHOR_CELLS, "part")), rows, n_positives))
    ranked = F.array_sort(F.collect_list(F.struct(F.bitwise_not("positive_score").alias("less"), "positive_id", "positive_score"))).alias("p")
    of_anchor = durable(found.groupBy(F.col("anchor_id").alias("id")).agg(ranked))
    asked = anchors.join(of_anchor, "id").select("id", "v", "label", F.col("p.positive_id").alias("positives"), F.col("p.positive_score").alias("scores"))
    asked = durable(packed(asked, ANCHOR_CELLS, "part", {"positives": "", "scores": ""}))
    return negatives(asked, rows, n_negatives, least, most).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
