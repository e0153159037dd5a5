"""Occupation catalogue, job posts and lookups against them.

Joins carry no broadcast hint: the catalogue side is broadcast only when its measured
size is under ``spark.sql.autoBroadcastJoinThreshold``; otherwise the planner shuffles,
and adaptive execution splits a hot occupation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlelab.operators.ranking import cap_per_group, numbered
from titlelab.session import durable

# The flag settings of a live catalogue row or post, the language id
# of the descriptions in use, and the text shown for a missing name.
ACTIVE = {"is_status": "1", "is_flags": "0", "is_online": "1"}
LANGUAGE = "1"
NAME_MISSING = "ไม่พบข้อมูล"


def active(df: DataFrame) -> DataFrame:
    """Rows whose three flags say they are live."""
    for name, value in ACTIVE.items():
        df = df.where(F.col(name) == value)
    return df


def language(df: DataFrame, language_id: str = LANGUAGE) -> DataFrame:
    return df.where(F.col("language_id") == language_id)


def subs_of(df: DataFrame, main_id) -> DataFrame:
    """Sub occupations of one main occupation."""
    return df.where(F.col("main_id") == F.lit(main_id))


def recent(df: DataFrame, ts: str, as_of: Column, months: int = 3) -> DataFrame:
    """Rows not older than ``months`` months at ``as_of``, time of day included."""
    return df.where(F.col(ts) >= as_of - F.make_ym_interval(F.lit(0), F.lit(months)))


def in_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose ``on`` value appears in ``ids`` (a table, not an inlined list)."""
    return df.join(ids.select(on), on, "left_semi")


def thai_order(name: Column | str) -> Column:
    """Sort key giving Thai dictionary order."""
    return F.collate(name, "th")


def main_catalog(occupations: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Live main occupations with their name: ``(main_id, main_name)``."""
    described = language(descriptions).select("occupation_id", F.col("name").alias("main_name"))
    live = active(occupations).select(F.col("id").alias("main_id"))
    return live.join(described, F.col("main_id") == F.col("occupation_id")).drop("occupation_id")


def sub_catalog(subs: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Live sub occupations of every parent: ``(main_id, sub_id, sub_name)``."""
    described = language(descriptions).select("occupation_sub_id", F.col("name").alias("sub_name"))
    live = active(subs).select(F.col("occupation_id").alias("main_id"), F.col("id").alias("sub_id"))
    joined = live.join(described, F.col("sub_id") == F.col("occupation_sub_id"))
    return joined.drop("occupation_sub_id")


def in_thai_order(df: DataFrame, name: str, id_col: str, rank: str = "rank") -> DataFrame:
    """Number rows by name in Thai dictionary order, ids breaking ties."""
    return numbered(df.withColumn("_key", thai_order(name)), ["_key", id_col], rank, distinct=True).drop("_key")


def live_posts(posts: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Live posts with their position text: ``(id, main_id, created_at, title)``."""
    live = active(posts).select("id", F.col("occupation_new_id").alias("main_id"), "created_at")
    text = descriptions.select(F.col("jobpost_id"), F.col("position").alias("title"))
    return live.join(text, F.col("id") == F.col("jobpost_id")).drop("jobpost_id")


def recent_posts(
    posts: DataFrame,
    descriptions: DataFrame,
    ids: DataFrame,
    as_of: Column,
    months: int = 3,
    limit: int = 500,
) -> DataFrame:
    """Live posts of the listed occupations from the last months, first ``limit`` by id.

    ``ids`` has a ``main_id`` column. The limit is the query's own; ordering by id and
    title makes it repeatable (one heap per task, no global sort).
    """
    rows = live_posts(recent(posts, "created_at", as_of, months), descriptions)
    rows = in_ids(rows, ids, "main_id")
    return rows.orderBy("id", "title").limit(limit).select("id", "main_id", "title")


def titles_by_occupation(
    catalog: DataFrame,
    posts: DataFrame,
    order: Sequence[str],
    cap: int = 200,
) -> DataFrame:
    """Up to ``cap`` post titles for each catalogue entry: ``(main_id, main_name, title)``.

    ``posts`` holds ``main_id``, ``title`` and the ``order`` columns. The cap is applied
    before the names are joined on, so the join sees only rows that are returned.
    """
    listed = in_ids(posts, catalog, "main_id")
    capped = cap_per_group(listed, ["main_id"], cap, order)
    return capped.join(catalog, "main_id").select("main_id", "main_name", "title", "rank")


def resolve_id(
    df: DataFrame, catalog: DataFrame, id_col: str, catalog_id: str, catalog_name: str
) -> DataFrame:
    """Match predicted ids with the catalogue; adds ``resolved_id`` and ``resolved_name``.

    Both stay null for an unknown id. A repeated catalogue id gives one match.
    """
    known = durable(
        catalog.groupBy(F.col(catalog_id).alias("resolved_id")).agg(
            F.min(catalog_name).alias("resolved_name")
        )
    )
    return df.join(known, F.col(id_col) == F.col("resolved_id"), "left")


def attach_name(
    df: DataFrame, mapping: DataFrame, on: str, name: str, default: str = NAME_MISSING
) -> DataFrame:
    """Add the name of an id, or the default text when it has none."""
    names = durable(mapping.groupBy(on).agg(F.min(name).alias(name)))
    joined = df.join(names, on, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(default)))


def category_mapping(df: DataFrame, id_col: str, name: str) -> DataFrame:
    """Distinct (id, name) pairs."""
    return df.select(id_col, name).distinct()
