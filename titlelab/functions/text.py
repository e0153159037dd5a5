"""Text columns: cleaning, tokens, trimming.

The patterns give Python's ``\\w``/``\\s`` meaning under Java's engine, where the plain
classes differ (Thai vowel and tone marks are the important case).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that must select the same characters as the reference's.
PUNCTUATION = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]"
NOT_BUSINESS_TEXT = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1fก-๙]"
BLANK = r"(?U)[\s\x1c-\x1f]"
TOKEN = r"[\p{L}\p{N}_]{2,}"
LEFT_TO_RIGHT_MARK = "\u200e"
TITLE_SEPARATOR = " . "
LEADING_DIGIT = (
    r"^[\p{Nd}\x{B2}-\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}"
    r"\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}]"
)


def _as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_blank(value: Column | str) -> Column:
    """Cut every kind of white space at both ends (``trim`` cuts U+0020 only)."""
    return F.regexp_replace(_as_column(value), f"^{BLANK}+|{BLANK}+$", "")


def strip_punct(value: Column | str) -> Column:
    """Delete everything that is not a letter, digit, underscore or white space."""
    return F.regexp_replace(_as_column(value), PUNCTUATION, "")


def clean_business_type(value: Column | str) -> Column:
    """Trim, then keep word characters, white space and the Thai block."""
    return F.regexp_replace(trim_blank(value), NOT_BUSINESS_TEXT, "")


def strip_bullet(value: Column | str) -> Column:
    """Delete leading hyphens, then the white space around the rest."""
    return trim_blank(F.regexp_replace(_as_column(value), "^-+", ""))


def strip_mark(value: Column | str) -> Column:
    """Delete the invisible left-to-right mark."""
    return F.translate(_as_column(value), LEFT_TO_RIGHT_MARK, "")


def blank_to_null(value: Column | str) -> Column:
    value = _as_column(value)
    return F.when(value != "", value)


def split_titles(value: Column | str, separator: str = TITLE_SEPARATOR) -> Column:
    """Split a cell holding several titles; the separator is a regular expression."""
    return F.split(_as_column(value), f"(?d){separator}")


def tokens(value: Column | str) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_as_column(value)), F.lit(TOKEN), F.lit(0))


def list_items(reply: Column | str) -> Column:
    """Items of a free-text list reply.

    One item per line, trimmed; blank lines and lines that begin with a digit are
    dropped. The digit test looks at the line before trimming, so an indented number
    passes.
    """
    lines = F.split(trim_blank(reply), "\n")
    kept = F.filter(lines, lambda line: (trim_blank(line) != "") & ~line.rlike(LEADING_DIGIT))
    return F.transform(kept, trim_blank)


def json_text(value: Column | str) -> Column:
    """A string as a JSON literal: quotes and back slashes escaped, other text kept."""
    wrapped = F.to_json(F.struct(_as_column(value).cast("string").alias("v")))
    literal = F.substring(wrapped, F.lit(len('{"v":') + 1), F.length(wrapped) - len('{"v":}'))
    return F.when(_as_column(value).isNull(), F.lit("null")).otherwise(literal)
