"""Fixed guidance rules: titles that decide a category directly.

The rules are a short constant list, so they become one CASE expression: no join, no
shuffle, evaluated while the titles are scanned.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlelab.functions.text import trim_blank

EXACT, CONTAINS = "exact", "contains"


class Rule(NamedTuple):
    pattern: str
    category: str


# Titles with one agreed main occupation.
EXACT_RULES = (
    Rule("AE", "ขาย / บริหารการขาย"),
    Rule("Chinese Speaking", "มนุษยศาสตร์ / ล่าม"),
    Rule("Internship", "Part-time / พนักงานสัญญาจ้าง"),
    Rule("นักศึกษาฝึกงาน", "Part-time / พนักงานสัญญาจ้าง"),
    Rule("นักศึกษาสหกิจ", "Part-time / พนักงานสัญญาจ้าง"),
    Rule("ครีเอทีฟ", "โฆษณา / สื่อ"),
    Rule("แคชเชียร์", "ห้างสรรพสินค้า"),
    Rule("เจ้าหน้าที่นิติบุคคล", "ธุรการ / จัดการทั่วไป"),
    Rule("store", "ขนส่ง / คลังสินค้า"),
    Rule("ประสานงานภาษาจีน", "มนุษยศาสตร์ / ล่าม"),
    Rule("พนักงานห้าง", "ห้างสรรพสินค้า"),
    Rule("เร่งรัดหนี้สิน", "เจ้าหน้าที่เร่งรัดหนี้สิน"),
)

# Words that decide the main occupation, most important first.
CONTAINS_RULES = (
    Rule("ผู้จัดการโรงงาน", "บริหาร/ผู้จัดการ"),
    Rule("การขาย", "ขาย"),
    Rule("ขาย", "ขาย"),
    Rule("ช่างไม้", "ช่าง/ช่างเทคนิค/อิเลคโทรนิค"),
    Rule("ช่างปูน", "ช่าง/ช่างเทคนิค/อิเลคโทรนิค"),
    Rule("ช่างแอร์", "ช่าง/ช่างเทคนิค/อิเลคโทรนิค"),
    Rule("ควบคุมงานก่อสร้าง", "ก่อสร้าง"),
    Rule("ผู้จัดการ", "บริหาร/ผู้จัดการ"),
    Rule("ผู้ช่วยผู้จัดการ", "บริหาร/ผู้จัดการ"),
)

# The sub occupation to use when no sub of that exact name exists.
SUB_RULES = (Rule("ช่างไม้", "ช่างเทคนิค"),)


def rule_key(value: Column | str) -> Column:
    """Form in which titles and patterns are compared."""
    return F.lower(trim_blank(value))


def name_key(value: Column | str) -> Column:
    """Category names are compared without blanks around ``/``."""
    return F.lower(trim_blank(F.regexp_replace(value, r"\s*/\s*", "/")))


def _first_match(title: Column, rules: Sequence[Rule], how: str) -> Column:
    """Number (from 1) of the first rule that applies, or null."""
    found: Column = F.lit(None).cast("int")
    for number in range(len(rules), 0, -1):
        pattern = F.lit(rules[number - 1].pattern.strip().lower())
        hit = title == pattern if how == EXACT else F.contains(title, pattern)
        found = F.when(hit, F.lit(number)).otherwise(found)
    return found


def match_rule(title: Column | str, rules: Sequence[Rule], how: str) -> Column:
    """Struct ``(rank, pattern, category)`` of the first rule that applies, or null."""
    number = _first_match(rule_key(title), rules, how)
    table = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("rank"), F.lit(r.pattern).alias("pattern"), F.lit(r.category).alias("category")
            )
            for i, r in enumerate(rules)
        ]
    )
    return F.when(number.isNotNull(), F.get(table, number - 1))


def apply_rules(
    df: DataFrame,
    title: str = "job_title",
    exact: Sequence[Rule] = EXACT_RULES,
    contains: Sequence[Rule] = CONTAINS_RULES,
) -> DataFrame:
    """Add ``rule_kind``, ``rule_rank``, ``rule_category``; exact rules come first."""
    by_title = match_rule(title, exact, EXACT)
    by_word = match_rule(title, contains, CONTAINS)
    best = F.coalesce(by_title, by_word)
    kind = F.when(by_title.isNotNull(), EXACT).when(by_word.isNotNull(), CONTAINS)
    return df.withColumns(
        {"rule_kind": kind, "rule_rank": best["rank"], "rule_category": best["category"]}
    )
