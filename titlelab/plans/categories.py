"""From titles to named categories with scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelab.operators.centroids import TitleModel, class_scores, scoring_weights
from titlelab.operators.labels import decode, encode
from titlelab.operators.ranking import cap_per_group
from titlelab.operators.text_vectors import clean_text
from titlelab.session import durable

TOP_CATEGORIES = 3


def top_categories(
    titles: DataFrame, model: TitleModel, labels: DataFrame, names: DataFrame, id_col: str = "id",
    title: str = "title", n: int = TOP_CATEGORIES,
) -> DataFrame:
    """``(id, rank, label, main_id, main_name, score)``: the ``n`` best categories of every title.

    ``labels`` is ``(main_id, label)`` as the model was trained with, ``names`` ``(main_id,
    main_name)``. Each distinct title is scored once; only its best classes are named and
    joined back to its rows.
    """
    keyed = titles.select(F.col(id_col).alias("id"), clean_text(title).alias("text"))
    scores = class_scores(scoring_weights(keyed, model), model)
    best = cap_per_group(scores, ["text"], n, ["-score", "main_id"])
    numbered = encode(best, labels, "main_id").drop("main_id")
    named = decode(numbered, labels, "label", "main_id").join(names, "main_id", "left")
    return keyed.join(durable(named), "text").select("id", "rank", "label", "main_id", "main_name", "score")
