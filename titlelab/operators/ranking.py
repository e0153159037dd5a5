"""Ranks, caps and row numbers that hold when one group owns a large share of the rows.

A plain ``row_number() over (partition by key ...)`` sorts each group in one task. The
three operators here never do that:

* ``cap_per_group`` first ranks inside (key, slot) pieces of a group, so the last window
  sees at most ``spread * k`` rows of any group;
* ``numbered`` / ``numbered_within`` sort by range over the whole table, with a hash of the row
  behind the sort keys, so a hot group, or a hot sort key, is spread over as many tasks as its
  size asks for, and add per-partition offsets;
* ``hash_ranked`` ranks in md5 order, which cuts every group into even buckets.

Order items are column names; a leading ``-`` means descending.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from titlelab.functions.hashing import hash32, seeded_md5
from titlelab.session import durable

_IN_PARTITION = (1 << 33) - 1
# Equal rows that stay together when rows are numbered.
_PIECE_COPIES = 10_000


def order_name(item: str) -> str:
    return item.removeprefix("-")


def sort_columns(order: Sequence[str]) -> list[Column]:
    return [F.col(order_name(o)).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` treating nulls as equal; keeps the left side's key columns.

    Still an equi join for the planner, so Catalyst picks broadcast only under its size
    threshold and adaptive execution may split a skewed left side.
    """
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def cap_per_group(
    df: DataFrame,
    keys: Sequence[str],
    k: int,
    order: Sequence[str],
    rank: str = "rank",
    spread: int = 32,
) -> DataFrame:
    """The first ``k`` rows of each group in ``order`` (which must be total), ranked 1..k."""
    slot = F.pmod(F.xxhash64(*[order_name(o) for o in order]), F.lit(spread))
    by = sort_columns(order)
    pieces = (
        df.withColumn("_slot", slot)
        .withColumn("_piece", F.row_number().over(W.partitionBy(*keys, "_slot").orderBy(*by)))
        .where(F.col("_piece") <= k)
        .drop("_slot", "_piece")
    )
    ranked = pieces.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*by)))
    return ranked.where(F.col(rank) <= k)


def numbered(df: DataFrame, order: Sequence[str], name: str = "row_no", distinct: bool = False) -> DataFrame:
    """Number all rows 1..n in ``order`` without moving them through one task.

    Rows are range-partitioned and sorted, the placement is fixed by writing it down, and
    each partition's numbers are shifted by the row count before it. The only
    single-task step handles one row per partition. A hash of the whole row is the last
    range column: rows with equal sort keys are spread over as many partitions as their number
    asks for, and a row goes to the same place whenever a lost task is run again. Equal rows
    have nothing to tell them apart, so they are folded to one with a count, cut into pieces of
    ``_PIECE_COPIES`` that are spread, and unfolded with a number for each copy; ``distinct`` says
    that there are none.
    """
    by = sort_columns(order)
    if distinct:
        pieces = df.withColumn("_place", F.xxhash64(*df.columns))
    else:
        folded = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
        last = F.floor((F.col("_copies") - 1) / _PIECE_COPIES).cast("int")
        cut = folded.withColumn("_piece", F.explode(F.sequence(F.lit(0), last)))
        in_piece = F.least(F.lit(_PIECE_COPIES).cast("bigint"), F.col("_copies") - F.col("_piece").cast("bigint") * _PIECE_COPIES).cast("int")
        spread = cut.select(*df.columns, in_piece.alias("_in_piece"), F.xxhash64(*df.columns, "_piece").alias("_place")).repartition("_place")
        copies = spread.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_in_piece"))))
        pieces = copies.select(*df.columns, F.xxhash64("_place", "_copy").alias("_place"))
    ranged = pieces.repartitionByRange(*by, "_place").sortWithinPartitions(*by, "_place")
    placed = ranged.select(*df.columns, F.monotonically_increasing_id().alias("_at"))
    placed = durable(placed).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    position = F.col("_at").bitwiseAND(F.lit(_IN_PARTITION))
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("_before") + position + 1)
        .drop("_at", "_part", "_before")
    )


def numbered_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank", distinct: bool = False
) -> DataFrame:
    """Number the rows of each group 1..n in ``order``, for groups of any size."""
    rows = numbered(df, [*keys, *order], "_no", distinct)
    first = durable(rows.groupBy(*keys).agg(F.min("_no").alias("_first")))
    joined = attach(rows, first, keys)
    return joined.withColumn(name, F.col("_no") - F.col("_first") + 1).drop("_no", "_first")


def hash_ranked(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    seed: int = 42,
    rank: str = "rank",
    size: str = "group_size",
    bits: int = 16,
) -> DataFrame:
    """Rank each group's rows 1..n in seeded md5 order of ``id_col``; adds the group size.

    The leading ``bits`` bits of the digest cut a group into ``2^bits`` even buckets, so
    the sort inside a bucket stays small even for a group with most of the rows. At very
    large row counts raise ``bits``; the result does not depend on it.
    """
    digest = seeded_md5(seed, F.col(id_col))
    rows = df.withColumn("_md5", digest).withColumn(
        "_bucket", F.shiftright(hash32(F.col("_md5")), 32 - bits)
    )
    in_bucket = W.partitionBy(*keys, "_bucket").orderBy("_md5", id_col)
    rows = rows.withColumn("_pos", F.row_number().over(in_bucket))
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    group = W.partitionBy(*keys)
    earlier = group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias(size),
    )
    joined = attach(rows, offsets, [*keys, "_bucket"])
    return joined.withColumn(rank, F.col("_pos") + F.col("_before")).drop(
        "_md5", "_bucket", "_pos", "_before"
    )
