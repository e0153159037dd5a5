"""Option lists and prompt texts; templates are data.

A placeholder is a column name in braces, such as ``{job_title}``, ``{bussiness_type}``,
``{main_occupation}`` or ``{options}``; ``{guidance}`` gives the direct rules.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlelab.functions.choices import as_id, is_filled, member, reply_reason
from titlelab.functions.text import json_text, trim_blank
from titlelab.operators.rules import EXACT_RULES, Rule

MAIN_TEMPLATE = (
    "Job title: {job_title}\n"
    "Choose one main occupation from the list.\n"
    "{guidance}\n"
    "{options}\n"
    'Answer with the JSON of the choice only, such as {"id": 0, "name": "..."}'
)
MAIN_TEMPLATE_BUSINESS = "Business type: {bussiness_type}\n" + MAIN_TEMPLATE
SUB_TEMPLATE = (
    "Job title: {job_title}\n"
    "Main occupation: {main_occupation}\n"
    "Choose one sub occupation from the list.\n"
    "{options}\n"
    'Answer with the JSON of the choice only, such as {"id": 0, "name": "..."}'
)
SUB_TEMPLATE_BUSINESS = "Business type: {bussiness_type}\n" + SUB_TEMPLATE
MORE_TITLES_TEMPLATE = (
    "Write {need} job titles for the occupation {occupation}.\n"
    "Do not repeat: {existing}\n"
    "Answer with one title per line and no numbers."
)

_PLACE = re.compile(r"\{([a-z_]+)\}")


def guidance(rules: Sequence[Rule] = EXACT_RULES) -> str:
    """The direct rules as prompt lines."""
    return "\n".join(f"- {r.pattern} => {r.category}" for r in rules)


def _id_text(value: Column, kind: str) -> Column:
    return json_text(value) if kind == "string" else value.cast("string")


def option_list(
    catalog: DataFrame, keys: Sequence[str], id_col: str, name: str, order: Sequence[str]
) -> DataFrame:
    """``(keys..., options)``: numbered JSON lines, one list per parent.

    A list is the text of one prompt, so it is as long as one parent's catalogue entry.
    """
    kind = dict(catalog.dtypes)[id_col]
    entry = F.struct(*order, F.col(id_col).alias("_id"), F.col(name).alias("_name"))
    listed = catalog.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    lines = F.transform(
        "_entries",
        lambda e, i: F.concat(
            (i + 1).cast("string"), F.lit('. {"id": '), _id_text(e["_id"], kind),
            F.lit(', "name": '), json_text(e["_name"]), F.lit("}"),
        ),
    )
    return listed.select(*keys, F.concat_ws("\n", lines).alias("options"))


def build_prompts(
    df: DataFrame, template: str, name: str = "prompt", rules: Sequence[Rule] = EXACT_RULES
) -> DataFrame:
    """Add the template's text with its placeholders taken from the row's columns."""
    pieces = _PLACE.split(template)
    parts = []
    for at, piece in enumerate(pieces):
        if at % 2 == 0:
            parts.append(F.lit(piece))
        elif piece == "guidance":
            parts.append(F.lit(guidance(rules)))
        else:
            parts.append(F.coalesce(F.col(piece).cast("string"), F.lit("")))
    return df.withColumn(name, F.concat(*parts))


def main_prompts(df: DataFrame, options: DataFrame, template: str = MAIN_TEMPLATE) -> DataFrame:
    """Prompt per row from the single main list (``options`` has one row)."""
    text = options.agg(F.first("options")).scalar()
    return build_prompts(df.withColumn("options", text), template).drop("options")


def sub_prompts(df: DataFrame, options: DataFrame, template: str = SUB_TEMPLATE) -> DataFrame:
    """Prompt per row from its main occupation's list, joined on ``main_id``."""
    return build_prompts(df.join(options, "main_id", "left"), template).drop("options")


def more_titles_prompts(
    short: DataFrame, lists: DataFrame, keys: Sequence[str], name: str,
    template: str = MORE_TITLES_TEMPLATE,
) -> DataFrame:
    """Prompt per group that lacks titles: how many, for which occupation, and those it has.

    ``short`` comes from the shortfall operators, ``lists`` from ``title_lists`` with the
    same target, so a prompt names fewer titles than the target.
    """
    listed = lists.select(*keys, F.concat_ws(", ", "titles").alias("existing"))
    asked = short.join(listed, list(keys), "left").withColumn("occupation", F.col(name))
    return build_prompts(asked, template).drop("existing", "occupation")


def parse_choice_reply(df: DataFrame, text: str = "text", alt_key: str = "occupation_id") -> DataFrame:
    """Add ``reply_reason`` (null when an id was given) and ``reply_id``.

    ``id`` falls back to ``alt_key`` when it is missing or empty. ``reply_id`` stays null
    for an id of the wrong type, which no catalogue row can match.
    """
    others = [c for c in df.columns if c != text]
    body = df.select(*others, trim_blank(text).alias("_body"))
    parsed = body.select("*", F.try_parse_json("_body").alias("_parsed"))
    members = parsed.select(
        "*",
        member(F.col("_parsed"), "$.id").alias("_id"),
        member(F.col("_parsed"), f"$.{alt_key}").alias("_alt"),
    )
    chosen = F.when(is_filled(F.col("_id")), F.col("_id")).otherwise(F.col("_alt"))
    picked = members.select(*others, "_body", "_parsed", chosen.alias("_m"))
    reason = reply_reason(F.col("_body"), F.col("_parsed"), is_filled(F.col("_m")))
    judged = picked.select(*others, reason.alias("reply_reason"), as_id(F.col("_m")).alias("_value"))
    value = F.when(F.col("reply_reason").isNull(), F.col("_value"))
    return judged.select(*others, "reply_reason", value.alias("reply_id"))
