"""Row and column cleaning for titles tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlelab.functions.text import (
    TITLE_SEPARATOR,
    blank_to_null,
    list_items,
    split_titles,
    strip_mark,
)

NO_TITLE = "NO_TITLE"
NO_BUSINESS_TYPE = "NO_BUSINESS_TYPE"


def string_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "string"]


def _on_strings(df: DataFrame, change) -> DataFrame:
    return df.withColumns({name: change(F.col(name)) for name in string_columns(df)})


def trim_columns(df: DataFrame) -> DataFrame:
    """Cut white space around column names."""
    return df.toDF(*[name.strip() for name in df.columns])


def fill_blank(df: DataFrame) -> DataFrame:
    """Missing strings become empty strings."""
    return df.na.fill("", string_columns(df))


def strip_marks(df: DataFrame) -> DataFrame:
    """Remove the left-to-right mark from every string column."""
    return _on_strings(df, strip_mark)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with a null or empty value in any column."""
    return _on_strings(df, blank_to_null).na.drop("any")


def require_title(df: DataFrame, title: str = "title") -> DataFrame:
    """Drop rows whose title is null or empty."""
    return df.where(F.col(title).isNotNull() & (F.col(title) != ""))


def training_view(df: DataFrame, title: str = "title", category: str = "main_name") -> DataFrame:
    """Title and category only, both present, under the names model jobs use."""
    view = df.select(F.col(title).alias("job_title"), F.col(category).alias("category"))
    return view.na.drop("any", subset=["job_title", "category"])


def explode_titles(
    df: DataFrame, title: str = "title", separator: str = TITLE_SEPARATOR
) -> DataFrame:
    """One row per title for cells that hold several."""
    return df.withColumn(title, F.explode(split_titles(title, separator)))


def parse_list_reply(df: DataFrame, text: str = "text", item: str = "item") -> DataFrame:
    """One row per item of a free-text list reply, with its position from 0."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(list_items(text)).alias("pos", item))


def validate_requests(
    df: DataFrame,
    need_business: bool = False,
    title: str = "job_title",
    business: str = "bussiness_type",
) -> DataFrame:
    """Add ``reason``: why a request is rejected, or null when it is complete."""

    def missing(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    reason = F.when(missing(title), NO_TITLE)
    if need_business:
        reason = reason.when(missing(business), NO_BUSINESS_TYPE)
    return df.withColumn("reason", reason)


def append_titles(df: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows plus new ones, matched by column name."""
    return df.unionByName(new, allowMissingColumns=True)


def clean_titles(df: DataFrame, keep_blank: Sequence[str] = ()) -> DataFrame:
    """Marks removed, column names trimmed, incomplete rows dropped.

    Columns in ``keep_blank`` may stay empty.
    """
    df = trim_columns(strip_marks(df))
    needed = [c for c in df.columns if c not in keep_blank]
    blanked = df.withColumns({c: blank_to_null(c) for c in string_columns(df) if c in needed})
    return blanked.na.drop("any", subset=needed) if needed else blanked
