"""Topping up titles: ten per sub occupation, or a hundred per main occupation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelab.functions.text import strip_bullet, trim_blank
from titlelab.operators.cleaning import append_titles, clean_titles, explode_titles, require_title
from titlelab.operators.topup import (
    MAIN_TARGET,
    SUB_TARGET,
    common_donors,
    existing_titles,
    new_only,
    ordered_titles,
    shortfall,
    sibling_donors,
    take_needed,
    title_counts,
    title_shortfall,
    title_uses,
    under_target,
)
from titlelab.session import durable

SUB_COLUMNS = ("main_id", "main_name", "sub_id", "sub_name", "title")
MAIN_COLUMNS = ("main_id", "main_name", "title")


def prepared_sub_titles(df: DataFrame) -> DataFrame:
    """Clean rows, one per title; a cell's blank parts are no titles."""
    every = explode_titles(clean_titles(df.select(*SUB_COLUMNS)))
    return require_title(every.withColumn("title", trim_blank("title")))


def prepared_main_titles(df: DataFrame) -> DataFrame:
    """Clean rows without bullets. What is nothing but a bullet is no title."""
    cleaned = clean_titles(df.select(*MAIN_COLUMNS), keep_blank=MAIN_COLUMNS)
    return require_title(cleaned.withColumn("title", strip_bullet("title")))


def new_sub_titles(
    titles: DataFrame, target: int = SUB_TARGET, candidates: DataFrame | None = None
) -> DataFrame:
    """Rows to add so that each sub occupation reaches ``target`` distinct titles.

    ``candidates`` is ``(main_id, sub_id, pos, title)``; without it, titles of sibling
    groups are used.
    """
    keys = ["main_id", "sub_id"]
    uses = title_uses(titles, SUB_COLUMNS[:-1])
    short = durable(title_shortfall(uses, target, keys))
    if candidates is None:
        candidates = sibling_donors(uses, short, target)
    fresh = new_only(candidates, existing_titles(uses, keys), keys)
    picked = take_needed(fresh, short, keys, target)
    return picked.join(short.drop("need", "n_titles"), keys).select(*SUB_COLUMNS)


def top_up_sub(
    df: DataFrame, target: int = SUB_TARGET, candidates: DataFrame | None = None
) -> DataFrame:
    """All titles, existing and new. A second run adds nothing."""
    titles = prepared_sub_titles(df)
    if candidates is not None:
        candidates = require_title(candidates.withColumn("title", trim_blank("title")))
    return append_titles(titles, new_sub_titles(titles, target, candidates))


def new_main_titles(
    titles: DataFrame, target: int = MAIN_TARGET, candidates: DataFrame | None = None
) -> DataFrame:
    """Rows to add so that each main occupation reaches ``target`` distinct titles.

    ``candidates`` is ``(main_id, pos, title)``; without it, the most used titles of the
    other main occupations are offered.
    """
    keys = ["main_id"]
    uses = title_uses(titles, MAIN_COLUMNS[:-1])
    short = durable(shortfall(under_target(title_counts(uses, keys), target), target))
    if candidates is None:
        candidates = common_donors(uses, short, target)
    fresh = new_only(candidates, existing_titles(uses, keys), keys)
    picked = take_needed(fresh, short, keys, target)
    names = uses.groupBy("main_id").agg(F.min("main_name").alias("main_name"))
    return picked.join(names, "main_id").select(*MAIN_COLUMNS)


def top_up_main(
    df: DataFrame, target: int = MAIN_TARGET, candidates: DataFrame | None = None
) -> DataFrame:
    """All titles, existing and new, bullets stripped, numbered by main name and title.

    Bullets go before anything is counted or compared, so a second run adds nothing.
    """
    titles = prepared_main_titles(df)
    if candidates is not None:
        candidates = require_title(candidates.withColumn("title", strip_bullet("title")))
    every = append_titles(titles, new_main_titles(titles, target, candidates))
    return ordered_titles(every, ["main_name", "title", "main_id"])
