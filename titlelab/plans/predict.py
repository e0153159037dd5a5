"""Main and sub occupation for whole tables of requests.

Decisions are made once per distinct title (and business type) and joined back, so a
title asked for very often is scored once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelab.functions.text import blank_to_null, clean_business_type
from titlelab.operators.catalog import resolve_id
from titlelab.operators.centroids import (
    TitleModel,
    best_class,
    class_sums,
    fit_centroids,
    predict_main,
    predict_sub,
    scoring_weights,
    title_weights,
)
from titlelab.operators.cleaning import validate_requests
from titlelab.operators.ranking import attach
from titlelab.operators.rules import (
    CONTAINS,
    CONTAINS_RULES,
    EXACT_RULES,
    SUB_RULES,
    Rule,
    apply_rules,
    match_rule,
    name_key,
)
from titlelab.operators.text_vectors import clean_text
from titlelab.session import durable

OK, REJECTED, FAILED, PARTIAL = "OK", "REJECTED", "FAILED", "PARTIAL"
RULE, MODEL, BUSINESS, FALLBACK = "RULE", "MODEL", "BUSINESS", "FALLBACK"
NO_MATCH, NOT_FOUND = "NO_MATCH", "NOT_FOUND"

RECORD = (
    "job_title", "occupation_id", "main_occupation", "sub_occupation_id", "sub_occupation_name",
)


@dataclass
class Catalog:
    """``main``: (main_id, main_name). ``sub``: (main_id, sub_id, sub_name)."""

    main: DataFrame
    sub: DataFrame


@dataclass
class RuleSet:
    exact: Sequence[Rule] = EXACT_RULES
    contains: Sequence[Rule] = CONTAINS_RULES
    sub: Sequence[Rule] = SUB_RULES


def fit_business_centroids(history: DataFrame, model: TitleModel) -> DataFrame:
    """Main centroids per business type, from ``(bussiness_type, main_id, title)`` rows."""
    members = (
        history.select(
            clean_business_type("bussiness_type").alias("business"),
            "main_id",
            clean_text("title").alias("text"),
        )
        .groupBy("business", "main_id", "text")
        .agg(F.count("*").alias("copies"))
    )
    weights = title_weights(members.select("text").distinct(), model.idf)
    keys = ["business", "main_id"]
    return fit_centroids(durable(class_sums(members, weights, keys)), keys)


def _by_rule(titles: DataFrame, catalog: Catalog, rules: RuleSet) -> DataFrame:
    """Add ``text`` and the main id a rule gives, if its category is in the catalogue."""
    names = durable(
        catalog.main.groupBy(name_key("main_name").alias("_key")).agg(
            F.min("main_id").alias("rule_main_id")
        )
    )
    ruled = apply_rules(titles, "job_title", rules.exact, rules.contains)
    ruled = ruled.withColumn("_key", name_key("rule_category"))
    kept = [*titles.columns, "rule_main_id"]
    return ruled.join(names, "_key", "left").select(*kept, clean_text("job_title").alias("text"))


def _model_main(weights: DataFrame, model: TitleModel) -> DataFrame:
    return predict_main(weights, model).select("text", F.col("main_id").alias("model_main_id"))


def _with_sub(
    decided: DataFrame, weights: DataFrame, catalog: Catalog, model: TitleModel, rules: RuleSet
) -> DataFrame:
    """Resolve the main, then choose and resolve a sub inside it."""
    decided = durable(decided)
    named = resolve_id(decided, catalog.main, "main_id", "main_id", "main_name")
    named = named.withColumnsRenamed({"resolved_id": "live_main", "resolved_name": "main_occupation"})

    scored = predict_sub(named.where(F.col("live_main").isNotNull()), weights, model)
    scored = scored.select("text", F.col("main_id").alias("live_main"), F.col("sub_id").alias("model_sub"))
    subs = durable(
        catalog.sub.groupBy(
            F.col("main_id").alias("live_main"), name_key("sub_name").alias("_name")
        ).agg(F.min("sub_id").alias("_sub"))
    )
    hint = match_rule("job_title", rules.sub, CONTAINS)
    same = subs.withColumnsRenamed({"_name": "_same", "_sub": "same_sub"})
    near = subs.withColumnsRenamed({"_name": "_near", "_sub": "near_sub"})
    chosen = (
        named.join(scored, ["text", "live_main"], "left")
        .withColumns({"_same": name_key(hint["pattern"]), "_near": name_key(hint["category"])})
        .join(same, ["live_main", "_same"], "left")
        .join(near, ["live_main", "_near"], "left")
        .withColumn("sub_id", F.coalesce("same_sub", "near_sub", "model_sub"))
    )
    known = durable(
        catalog.sub.groupBy(
            F.col("main_id").alias("live_main"), F.col("sub_id").alias("sub_id")
        ).agg(F.min("sub_name").alias("sub_occupation_name"))
    )
    return chosen.join(known, ["live_main", "sub_id"], "left").withColumn(
        "sub_id", F.when(F.col("sub_occupation_name").isNotNull(), F.col("sub_id"))
    )


def prediction_record(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The fields of one answer, plus ``status`` and ``reason``."""
    status = (
        F.when(F.col("reject").isNotNull(), REJECTED)
        .when(F.col("live_main").isNull(), FAILED)
        .when(F.col("sub_id").isNull(), PARTIAL)
        .otherwise(OK)
    )
    reason = (
        F.when(F.col("reject").isNotNull(), F.col("reject"))
        .when(F.col("main_id").isNull(), NO_MATCH)
        .when(F.col("live_main").isNull(), NOT_FOUND)
        .otherwise(F.col("how"))
    )
    return df.select(
        "request_id",
        "job_title",
        F.col("live_main").alias("occupation_id"),
        "main_occupation",
        F.col("sub_id").alias("sub_occupation_id"),
        "sub_occupation_name",
        *extra,
        status.alias("status"),
        reason.alias("reason"),
    )


def _answer(checked: DataFrame, done: DataFrame, keys: Sequence[str], extra: Sequence[str]) -> DataFrame:
    fields = ["main_id", "live_main", "main_occupation", "sub_id", "sub_occupation_name", "how"]
    joined = attach(checked, done.select(*keys, *fields), keys, "left")
    valid = F.col("reject").isNull()
    return prediction_record(joined.withColumns({f: F.when(valid, F.col(f)) for f in fields}), extra)


def predict_member(
    requests: DataFrame, catalog: Catalog, model: TitleModel, rules: RuleSet = RuleSet()
) -> DataFrame:
    """Answer each ``(request_id, job_title)``: rules first, then the title model."""
    checked = validate_requests(requests).withColumnRenamed("reason", "reject")
    titles = checked.where(F.col("reject").isNull()).select("job_title").distinct()
    ruled = _by_rule(titles, catalog, rules)
    weights = scoring_weights(ruled, model)
    decided = ruled.join(_model_main(weights, model), "text", "left").select(
        "job_title",
        "text",
        F.coalesce("rule_main_id", "model_main_id").alias("main_id"),
        F.when(F.col("rule_main_id").isNotNull(), RULE).otherwise(MODEL).alias("how"),
    )
    done = _with_sub(decided, weights, catalog, model, rules)
    return _answer(checked, done, ["job_title"], ())


def predict_employer(
    requests: DataFrame,
    catalog: Catalog,
    model: TitleModel,
    business_centroids: DataFrame,
    rules: RuleSet = RuleSet(),
) -> DataFrame:
    """Answer each ``(request_id, job_title, bussiness_type)``.

    The main occupation comes from a rule, else from titles of the same business type,
    else from the title model alone, which the reason then calls ``FALLBACK``.
    """
    checked = validate_requests(requests, need_business=True).withColumnRenamed("reason", "reject")
    # Nothing left after cleaning counts as no business type given: the title decides.
    cleaned = blank_to_null(clean_business_type("bussiness_type"))
    checked = checked.withColumn("bussiness_type", cleaned)
    wanted = (
        checked.where(F.col("reject").isNull())
        .select("job_title", F.col("bussiness_type").alias("business"))
        .distinct()
    )
    ruled = _by_rule(wanted, catalog, rules)
    weights = scoring_weights(ruled, model)
    pairs = ruled.select("text", "business").distinct()
    scoped = pairs.join(weights.select("text", "term", "w"), "text")
    special = best_class(scoped, business_centroids, ["text"], ["business"], "main_id").select(
        "text", "business", F.col("main_id").alias("business_main_id")
    )
    how = (
        F.when(F.col("rule_main_id").isNotNull(), RULE)
        .when(F.col("business_main_id").isNotNull(), BUSINESS)
        .otherwise(FALLBACK)
    )
    decided = (
        ruled.join(special, ["text", "business"], "left")
        .join(_model_main(weights, model), "text", "left")
        .select(
            "job_title",
            "text",
            F.col("business").alias("bussiness_type"),
            F.coalesce("rule_main_id", "business_main_id", "model_main_id").alias("main_id"),
            how.alias("how"),
        )
    )
    done = _with_sub(decided, weights, catalog, model, rules)
    return _answer(checked, done, ["job_title", "bussiness_type"], ["bussiness_type"])
