"""Parsing a JSON choice such as ``{"id": 3, "name": "..."}``.

Split into small column steps so that a caller can put each in its own projection: the
text is then parsed once per row, not once per use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_JSON = "NOT_JSON"
BAD_JSON = "BAD_JSON"
NO_ID = "NO_ID"
NOT_FOUND = "NOT_FOUND"
OK = "OK"


def member(parsed: Column, path: str) -> Column:
    """A member of a parsed reply as text, number, whole number and type name."""
    return F.struct(
        F.schema_of_variant(F.try_variant_get(parsed, path, "variant")).alias("kind"),
        F.try_variant_get(parsed, path, "string").alias("text"),
        F.try_variant_get(parsed, path, "double").alias("number"),
        F.try_variant_get(parsed, path, "bigint").alias("whole"),
    )


def is_filled(m: Column) -> Column:
    """True when the member exists and is not zero, empty or false."""
    kind = m["kind"]
    empty = (
        F.when(kind == "STRING", m["text"] == "")
        .when(kind == "BOOLEAN", m["text"] == "false")
        .when(kind.isin("VOID", "ARRAY<VOID>", "OBJECT<>"), F.lit(True))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit(False))
        .otherwise(m["number"] == 0)
    )
    return kind.isNotNull() & ~F.coalesce(empty, F.lit(True))


def as_id(m: Column) -> Column:
    """The member as an id; text never counts as a number, a fraction never matches."""
    kind, number = m["kind"], m["number"]
    fraction = (kind == "DOUBLE") | kind.startswith("DECIMAL")
    return (
        F.when(kind == "BIGINT", m["whole"])
        .when(fraction, F.when(number == F.floor(number), m["whole"]))
        .when(kind == "BOOLEAN", F.lit(1).cast("bigint"))
    )


def reply_reason(body: Column, parsed: Column, filled: Column) -> Column:
    """Why a reply gives no id, or null when it does."""
    opens = F.coalesce(body.startswith("{"), F.lit(False))
    return F.when(~opens, NOT_JSON).when(parsed.isNull(), BAD_JSON).when(~filled, NO_ID)
