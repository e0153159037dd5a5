"""Document quality by Bradley-Terry pairwise ranking.

Each text becomes a short vector of surface features. Pairs (a good row, a bad row) are drawn
from the labelled rows, each row in two of them at least, and the utility weights minimise the logistic loss on
the difference of their features. Features, pairs and the sums of each Newton step are made by Spark from all
labelled rows; only sums come to the driver. The threshold is the utility's quantile at the share of bad rows;
scores are the logistic of the distance from it, shifted so that the threshold scores ``CUT``.

Defined results: null text counts as empty; the empty text has a score like any other. Equal
texts have equal scores. Without both labels in the training rows every utility is 0 and every
score is 0.5. A row labelled more than once counts as often; null labels are left out. Rows of
the input stay one to one; an input column with an output's name is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelab.llm.common import code_points, map_columns, slices
from titlelab.operators.ranking import numbered
from titlelab.session import durable

#: Pairs at least, and pairs a row of the larger class is in at least.
PAIRS, PAIRS_OF_ROW = 200_000, 2
#: Steps into which the range of utilities is cut, twice, to find a quantile.
STEPS = 50_000
CUT = 0.3
N_CLASSES = 8  # lower, upper, other letter, digit, space, line break, sentence mark, symbol


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float


def _classes() -> np.ndarray:
    out = np.full(0x110000, 7, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = 0 if c.islower() else 1 if c.isupper() else 2
        elif c.isdigit():
            out[i] = 3
        elif c == "\n":
            out[i] = 5
        elif c.isspace():
            out[i] = 4
        elif c in ".,;:'\"()-?":
            out[i] = 6
    return out


def features(texts: list[str], classes: np.ndarray) -> np.ndarray:
    """One row of surface features for each text; whole texts, no prefix."""
    out = []
    for part in slices(texts):
        group = texts[part]
        codes = classes[code_points("\n".join([*group, ""]))]
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in group])[:-1]])
        share = np.stack([np.add.reduceat(codes == k, starts, dtype=np.float64) for k in range(N_CLASSES)], 1)
        share[:, 5] -= 1
        size = np.array([max(1, len(t)) for t in group], float)
        share /= size[:, None]
        words = np.array([_words(t) for t in group])
        with np.errstate(divide="ignore"):
            out.append(np.concatenate([share, np.log1p(20 * share), words, np.log1p(size)[:, None]], 1))
    return np.concatenate(out) if out else np.zeros((0, 0))


def _words(text: str) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    pairs = max(1, len(words) - 1)
    kinds = len(set(words))
    twice = 1 - len(set(zip(words, words[1:]))) / pairs if len(words) > 1 else 0.0
    same = sum(map(eq, words, words[1:])) / pairs
    lone = text.count(" | ") / n
    doubled = 1 - len(set(lines)) / len(lines) if lines else 0.0
    return [
        kinds / n, kinds / n**0.5, twice, same, np.log1p(20 * same), lone, np.log1p(20 * lone),
        doubled, np.log1p(20 * doubled), len(text) / n / 10, np.log1p(n), np.log1p(n) ** 2 / 10,
    ]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
        label: str = "quality", pairs: int = PAIRS, seed: int = 7) -> Model:
    """Learn from all labelled rows."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    known = known.where("key IS NOT NULL AND label IS NOT NULL")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key IS NOT NULL")

    def start():
        classes = _classes()

        def compute(column):
            return [list(features([t or "" for t in column.to_pylist()], classes))]

        return compute

    # texts stay where they are read; only their features are shuffled to the labels
    featured = map_columns(texts, ["text"], "x array<double>", start, ["key"])
    rows = durable(featured.join(known, "key").withColumn("good", F.col("label") > 0))
    size = features([""], _classes()).shape[1]
    sums = [f(F.get("x", F.lit(i))) for f in (F.avg, F.stddev_pop) for i in range(size)]
    n, n_good, *moments = rows.agg(F.count("*"), F.count_if("good"), *sums).first()
    if not n:
        return Model(np.zeros(0), np.ones(0), np.zeros(0), 0.0, 0.0)
    mean, scale = np.array(moments[:size]), np.array(moments[size:]) + 1e-9
    n_bad = n - n_good
    if not n_good or not n_bad:
        return Model(mean, scale, np.zeros(size), 0.0, 0.0)

    def scaled():
        return lambda column: [list(np.clip((column.flatten().to_numpy().reshape(-1, size) - mean) / scale, -6, 6))]

    z = durable(map_columns(rows, ["x"], "z array<double>", scaled, ["key", "good"]))
    weights = _newton(_sums(_pairs(z, n_good, n_bad, pairs, seed), size), size)

    def utilities():
        return lambda column: [column.flatten().to_numpy().reshape(-1, size) @ weights]

    utility = durable(map_columns(z, ["z"], "u double", utilities, []))
    spread = utility.agg(F.stddev_pop("u")).first()[0]
    return Model(mean, scale, weights, _quantile(utility, n_bad / n), float(1 / (spread + 1e-9)) * 2)


def _pairs(z: DataFrame, n_good: int, n_bad: int, least: int, seed: int) -> DataFrame:
    """``d``, the features of a good row less those of a bad one. Both classes are in hash order; the rows of the
    larger one are taken in turn, again and again, and those of the smaller one move on from turn to turn."""
    larger, smaller = max(n_good, n_bad), min(n_good, n_bad)
    turns = max(PAIRS_OF_ROW, -(-least // larger))
    order = z.withColumn("h", F.xxhash64(F.lit(seed), "key", "z"))
    sides = {}
    for good, name in ((True, "g"), (False, "b")):
        own = numbered(order.where(F.col("good") == good).select("h", "z"), ["h"], "no")
        sides[good] = durable(own.select((F.col("no") - 1).alias(f"no_{name}"), F.col("z").alias(name)))
    at, turn = F.pmod("id", F.lit(larger)), F.floor(F.col("id") / larger)
    other = F.pmod(F.col("id") + turn * 7919, F.lit(smaller))
    drawn = z.sparkSession.range(larger * turns).select((at if n_good >= n_bad else other).alias("no_g"), (other if n_good >= n_bad else at).alias("no_b"))
    met = drawn.join(sides[True], "no_g").join(sides[False], "no_b")
    return durable(met.select(F.zip_with("g", "b", lambda g, b: g - b).alias("d")))


def _loss(differences: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums of log(1 + exp(-w.d)), its slope and its curvature."""
    product = differences @ weights
    p = 1 / (1 + np.exp(np.clip(product, -50, 50)))  # of the wrong order
    return np.logaddexp(0, -product).sum(), -(differences * p[:, None]).sum(0), (differences * (p * (1 - p))[:, None]).T @ differences


def _sums(pairs: DataFrame, size: int):
    """Function from weights to the number of pairs, loss, slope and curvature, summed up by Spark."""
    loss = _loss

    def at(weights):
        def run(batches):
            import pyarrow as pa

            total = np.zeros(2 + size + size * size)
            for batch in batches:
                d = batch.column("d").flatten().to_numpy().reshape(-1, size)
                value, slope, curve = loss(d, weights)
                total += np.concatenate([[len(d), value], slope, curve.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

        got = pairs.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # a row for each number
        total = np.zeros(2 + size + size * size)
        total[got.column("i").to_numpy()] = got.column("v").to_numpy()
        return total[0], total[1], total[2 : 2 + size], total[2 + size :].reshape(size, size)

    return at


def _quantile(utility: DataFrame, share: float) -> float:
    """The quantile of ``u``, between the two rows next to it in ascending order."""
    low, high, n = utility.agg(F.min("u"), F.max("u"), F.count("*")).first()
    at = share * (n - 1)
    below, above = (_ranked(utility, r, low, high) for r in (int(at), min(int(at) + 1, n - 1)))
    return below + (at - int(at)) * (above - below)


def _ranked(utility: DataFrame, rank: int, low: float, high: float) -> float:
    """The value of ``u`` that has ``rank`` rows before it, up to a step of a step of the range."""
    for _ in range(2):
        if high <= low:
            break
        width = (high - low) / STEPS
        place = F.least(F.lit(STEPS - 1), F.floor((F.col("u") - low) / width)).cast("int")
        counts = utility.where(F.col("u").between(low, high)).groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min("u").alias("low"), F.max("u").alias("high"))
        for row in sorted(counts.collect()):  # at most a row for each step
            if rank < row["n"]:
                low, high = row["low"], row["high"]
                break
            rank -= row["n"]
    return float(low)


def _newton(sums, size: int, penalty: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights that minimise mean log(1 + exp(-w.d)) + penalty/2 |w|^2, by damped Newton steps."""

    def at(weights):
        n, value, slope, curve = sums(weights)
        return value / n + penalty / 2 * weights @ weights, slope / n + penalty * weights, curve / n + penalty * np.eye(size)

    weights = np.zeros(size)
    now, slope, curve = at(weights)
    for _ in range(rounds):
        step, rate = np.linalg.solve(curve, slope), 1.0
        found = at(weights - step)
        while found[0] > now and rate > 1e-4:
            rate /= 2
            found = at(weights - rate * step)
        before = now
        weights, (now, slope, curve) = weights - rate * step, found
        if before - now < 1e-9:
            break
    return weights


def bradley_terry(differences: np.ndarray, penalty: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """The weights for pairs that are given as an array."""
    return _newton(lambda w: (len(differences), *_loss(differences, w)), differences.shape[1], penalty, rounds)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``utility``, ``score`` (0 to 1) and ``predicted`` (1 if score >= CUT)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shift = float(np.log(CUT / (1 - CUT)))

    def start():
        known, classes = shared.value, _classes()

        def compute(column):
            texts = [t or "" for t in column.to_pylist()]
            if not len(known.weights) or not known.spread:
                utility = np.zeros(len(texts))
                chance = np.full(len(texts), 0.5)
            else:
                z = np.clip((features(texts, classes) - known.mean) / known.scale, -6, 6)
                utility = z @ known.weights
                chance = 1 / (1 + np.exp(-np.clip(known.spread * (utility - known.threshold) + shift, -30, 30)))
            return [utility, chance, (chance >= CUT).astype(np.int32)]

        return compute

    return map_columns(docs, [text], "utility double, score double, predicted int", start, keep)
