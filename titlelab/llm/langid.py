"""Language identification by multinomial naive Bayes over hashed character n-grams.

Text is reduced to lower-case letters; anything else is a gap. n-grams of 1 to ``ORDERS``
characters fall into ``buckets`` hash buckets. Training counts buckets for each language with
Spark; the log-probability matrix (languages x buckets, so of bounded size) goes to the tasks,
which score whole texts as sparse count rows against it.

Defined results: null text or text without a letter is ``und`` with score 0; so is everything
if there is nothing to learn from. Equal texts get equal results. Ties go to the language that
sorts first. Rows of the input stay one to one, repeated rows included; an input column with
an output's name is replaced. A very long text is scored whole, piece by piece; the pieces begin at
fixed places of the text, so that equal texts have equal sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelab.llm.common import code_points, hash_share, map_columns, slices

ORDERS = 3
BUCKETS = 1 << 16
#: Characters a task takes through numpy at a time, and cells (characters x languages) it gathers.
PIECE = 1 << 19
CELLS = 1 << 22
#: Most cells of the matrix sent to tasks (float32, so 64 MB).
MAX_CELLS = 1 << 24


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray  # languages
    logp: np.ndarray  # (buckets + 1) x languages; the last row is for what is no n-gram


@cache
def _letters() -> np.ndarray:
    """Code point to lower-case letter; 32 for anything that is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def _grams(texts: list[str], letters: np.ndarray, buckets: int, most: int):
    """(first text, starts of its texts, buckets of each order, letters) of each piece: several whole
    texts, or a part of one that is longer than ``most`` characters."""
    for part in slices(texts, most):
        group = texts[part]
        codes = letters[code_points("".join(f" {t} " for t in group))]
        starts = np.concatenate([[0], np.cumsum([len(t) + 2 for t in group])[:-1]])
        step = most if len(group) == 1 else len(codes)
        for first in range(0, len(codes), step):
            reach = min(first, ORDERS - 1)  # characters of the piece before that grams begin in
            rows = _buckets(codes[first - reach : first + step], starts if first == 0 else starts[:0], buckets)
            yield part.start, starts if first == 0 else np.zeros(1, np.int64), [r[reach:] for r in rows], codes[first : first + step] != 32


def _buckets(codes: np.ndarray, starts: np.ndarray, buckets: int) -> list[np.ndarray]:
    """For each order, the bucket of the gram that ends at each place."""
    letter = codes != 32
    shift = np.uint64(64 - int(math.log2(buckets)))
    h = codes.astype(np.uint64)
    hashed, some = np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
    rows = []
    for order in range(1, ORDERS + 1):
        # one that crosses into the text before holds its end gap
        hashed = hashed * np.uint64(0x100000001B3) + np.roll(h, order - 1) + np.uint64(1)
        some = some | np.roll(letter, order - 1)
        inside = some.copy()
        for back in range(order - 1):
            at = starts + back
            inside[at[at < len(h)]] = False
        bucket = ((hashed * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int32)
        rows.append(np.where(inside, bucket, np.int32(buckets)))
    return rows


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
        buckets: int = BUCKETS, max_train: int | None = None) -> Model:
    """Learn from all rows with a text and a language; only if ``max_train`` is given, from about as many."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    if max_train is not None:
        there = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(key).count()
        rows = rows.where(hash_share("key", there, max_train))
    rows = rows.select("text", "lang")
    alphabet = docs.sparkSession.sparkContext.broadcast(_letters())

    def run(batches):
        import pyarrow as pa

        letters, counts, docs_of = alphabet.value, {}, {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by: dict[str, list[str]] = {}
            for t, k in zip(texts, langs):
                by.setdefault(k, []).append(t)
            for k, group in by.items():
                docs_of[k] = docs_of.get(k, 0) + len(group)
                total = counts.setdefault(k, np.zeros(buckets + 1, np.int64))
                for _, _, rows_of, _ in _grams(group, letters, buckets, PIECE):
                    for grams in rows_of:
                        total += np.bincount(grams, minlength=buckets + 1)
        for k, total in counts.items():
            at = np.flatnonzero(total[:buckets])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(total[at], docs_of[k]))],
                names=["lang", "bucket", "n"],
            )

    counted = rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    if len(langs) * (buckets + 1) > MAX_CELLS:
        raise ValueError(f"{len(langs)} languages x {buckets} buckets are more than {MAX_CELLS} cells; use fewer buckets")
    place = {k: i for i, k in enumerate(langs)}
    cells, prior = np.zeros((buckets + 1, len(langs))), np.zeros(len(langs))
    at = np.array([place[k] for k in got.column("lang").to_pylist()], np.int64)
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    docs_row = bucket < 0
    prior[at[docs_row]] = n[docs_row]
    cells[bucket[~docs_row], at[~docs_row]] = n[~docs_row]
    smooth = 0.1
    logp = np.log(cells + smooth) - np.log(cells[:buckets].sum(0) + smooth * buckets)
    logp[buckets] = 0
    return Model(langs, np.log(prior / prior.sum()) if len(langs) else prior, logp.astype(np.float32))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and its posterior probability ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast((model, _letters()))

    def start():
        known, letters = shared.value
        buckets = len(known.logp) - 1

        def compute(column):
            texts = [t or "" for t in column.to_pylist()]
            if not known.langs:
                return [["und"] * len(texts), [0.0] * len(texts)]
            total, has = np.tile(known.prior, (len(texts), 1)), np.zeros(len(texts), bool)
            most = min(PIECE, max(1, CELLS // len(known.langs)))
            for at, starts, rows, letter in _grams(texts, letters, buckets, most):
                here = slice(at, at + len(starts))
                has[here] |= np.logical_or.reduceat(letter, starts)
                for grams in rows:
                    total[here] += np.add.reduceat(known.logp[grams], starts, axis=0, dtype=np.float64)
            best = total.argmax(1)
            share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            langs = [known.langs[b] if h else "und" for b, h in zip(best, has)]
            scores = [float(s) if h else 0.0 for s, h in zip(share, has)]
            return [langs, scores]

        return compute

    return map_columns(docs, [text], "lang_pred string, score double", start, keep)
