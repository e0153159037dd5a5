"""Document fingerprints by winnowing, in built-in expressions only.

A text is a sequence of units: runs of up to ``UNIT`` characters without white space, so words.
A longer run, as in scripts without gaps, is cut by its content: before each character whose hash
with the next ``CUT - 1`` is less than those of the ``CUT_REACH`` characters on either side, and at
``UNIT`` characters where no such place comes. So a shift or an inserted character changes the
units near it only, and two such runs that share a passage share its units from the first cut on
whose sides are shared too. Every run of ``gram`` units is hashed; of every ``window``
consecutive hashes the least one is kept, the rightmost of equal ones, with its position. So any
two texts that share ``gram + window - 1`` units share a mark. A mark is one long: position (24
bits, above) and hash (39 bits). Positions past 2^24 wrap around; which hash is kept does not
depend on it except between equal hashes at the wrap.

The least hash of each window is found by doubling: minima of 2, 4, ... ``window`` neighbours,
each from the step before, so a text costs a few linear passes however long it is.

Defined results: null text counts as empty; a text without units has no marks, one with fewer
than ``gram`` has one hash of all of them, one with fewer hashes than a window keeps the least.
Two texts without marks have likeness 1, one without and one with marks 0. Equal texts have
equal marks. Rows are ordered by id with nulls last, equal ids by text, and each row, repeated
or not, is followed by the next one in that order, the last by the first; a single row is
followed by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from titlelab.session import durable

GRAM, WINDOW = 5, 4
UNIT = 32
#: Characters hashed for a cut, and characters on either side whose hashes it must undercut.
CUT, CUT_REACH = 4, 8
HASH_BITS, PLACE_BITS = 39, 24
_PLACES = (1 << PLACE_BITS) - 1
_HASHES = (1 << HASH_BITS) - 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def units(text: Column) -> Column:
    gapped = F.when(text.rlike(rf"\S{{{UNIT + 1}}}"), spaced(text)).otherwise(text)
    return F.regexp_extract_all(gapped, F.lit(rf"\S{{1,{UNIT}}}"), F.lit(0))


def spaced(text: Column) -> Column:
    """The text's runs with blanks between, and at the cuts within those longer than ``UNIT``."""
    found = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    return F.array_join(F.transform(found, lambda run: F.when(F.length(run) > UNIT, cut(run)).otherwise(run)), " ")


def cut(run: Column) -> Column:
    def hashed(c):
        return F.transform(F.slice(c, F.lit(1), F.size(c) - (CUT - 1)), lambda x, i: F.xxhash64(x, *[c[i + k] for k in range(1, CUT)]))

    def least(h, m, i):  # m: the least of CUT_REACH hashes from each place on
        inside = (i >= CUT_REACH) & (i < F.size(h) - CUT_REACH)
        return F.when(inside, (h[i] < m[i + 1]) & (h[i] < m[i - CUT_REACH])).otherwise(False)

    def gapped(c, h, m):
        return F.array_join(F.transform(c, lambda x, i: F.when(least(h, m, i), F.concat(F.lit(" "), x)).otherwise(x)), "")

    return let(F.split(run, ""), lambda c: let(hashed(c), lambda h: let(minima(h, CUT_REACH), lambda m: gapped(c, h, m))))


def grams(found: Column, gram: int) -> Column:
    """Hash of each run of ``gram`` units, above its position counted down from the top, so that
    the lesser of two equal hashes is the one further right."""

    def packed(value, i):
        short = F.shiftleft(F.shiftrightunsigned(value, 64 - HASH_BITS), PLACE_BITS)
        return short.bitwiseOR((F.lit(_PLACES) - i % (_PLACES + 1)).cast("long"))

    def runs(h):
        whole = F.transform(
            F.slice(h, F.lit(1), F.size(h) - (gram - 1)),
            lambda x, i: packed(F.xxhash64(x, *[h[i + k] for k in range(1, gram)]), i),
        )
        few = F.transform(F.slice(h, 1, 1), lambda x, i: packed(F.xxhash64(h), i))
        return F.when(F.size(h) < gram, few).otherwise(whole)

    return let(F.transform(found, lambda u: F.xxhash64(u)), runs)


def minima(hashes: Column, window: int) -> Column:
    """The least value of each ``window`` neighbours (a power of two); of all if there are fewer."""

    def doubled(values, step):
        if step == window:
            return values
        return let(values, lambda v: doubled(_lesser(v, step), 2 * step))

    return let(
        hashes,
        lambda h: F.when(F.size(h) == 0, h).when(F.size(h) < window, F.array(F.array_min(h))).otherwise(doubled(h, 1)),
    )


def _lesser(values: Column, step: int) -> Column:
    n = F.size(values) - step
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(1 + step), n), lambda a, b: F.least(a, b))


def marks(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Marks of a text, by position."""
    chosen = F.array_distinct(minima(grams(units(text), gram), window))
    return F.transform(
        chosen,
        lambda v: F.shiftleft(F.lit(_PLACES) - v.bitwiseAND(F.lit(_PLACES)), HASH_BITS).bitwiseOR(F.shiftright(v, PLACE_BITS)),
    )


def places(found: Column) -> Column:
    """(position, hash) of each mark."""
    return F.transform(
        found, lambda m: F.struct(F.shiftright(m, HASH_BITS).alias("position"), m.bitwiseAND(F.lit(_HASHES)).alias("hash"))
    )


def hashes(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda m: m.bitwiseAND(F.lit(_HASHES))))


def spelled(found: Column) -> Column:
    """The hashes of the marks in order, as hexadecimal numbers with blanks between."""
    return F.array_join(F.transform(found, lambda m: F.hex(m.bitwiseAND(F.lit(_HASHES)))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes."""
    both = F.size(F.array_intersect(a, b))
    return let(both, lambda n: F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(n / (F.size(a) + F.size(b) - n)))


def fingerprints(docs: DataFrame, text: str = "text", gram: int = GRAM, window: int = WINDOW, name: str = "marks") -> DataFrame:
    """Add the marks of each text under ``name``."""
    return docs.withColumn(name, marks(F.coalesce(F.col(text), F.lit("")), gram, window))


def with_next(docs: DataFrame, key: str, text: str, derive: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """``derive(docs)`` with ``next_<column>``: the value in the row that follows by key, nulls last
    and equal keys by a hash of the text; the last row is followed by the first.

    Rows are dealt to ranges of the key, a few for each shuffle partition, and each range looks
    ahead by itself in the one shuffle of texts there is. Only the last row of a range needs the
    first row of the next: those few are looked up by their keys, of which there are as many as
    ranges, and derived anew.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    splits = [-float("inf"), *sorted({*cuts} or {0.0}), float("inf")]
    keyed = docs.withColumn("range_key", F.col(key).cast("double")).withColumn("tie", F.xxhash64(text))
    dealt = Bucketizer(splits=splits, inputCol="range_key", outputCol="range", handleInvalid="keep").transform(keyed)
    dealt = dealt.drop("range_key").withColumn("range", F.coalesce("range", F.lit(float(len(splits)))))  # null keys come last

    within = W.partitionBy("range").orderBy(F.col(key).asc_nulls_last(), "tie")
    ahead = derive(dealt).withColumns({"more": F.lead(F.lit(1)).over(within)} | {f"next_{c}": F.lead(c).over(within) for c in columns})

    place = F.struct(F.col(key).alias("k"), F.col("tie").alias("t"))
    bounds = durable(dealt.groupBy("range").agg(F.min(place).alias("low"), F.max(place).alias("high")))
    least = F.min("range").over(W.partitionBy())
    turns = bounds.select("range", F.coalesce(F.lead("range").over(W.orderBy("range")), least).alias("then"))

    def rows_at(end: str) -> DataFrame:
        spots = F.broadcast(bounds.select(F.col("range").alias("at"), f"{end}.k", f"{end}.t"))
        found = dealt.join(spots, (F.col("range") == F.col("at")) & (F.col("tie") == F.col("t")) & F.col(key).eqNullSafe(F.col("k")))
        return derive(found.drop("at", "k", "t").dropDuplicates(["range"]))  # repeated rows are alike

    firsts = rows_at("low").select(F.col("range").alias("then"), *[F.col(c).alias(f"next_{c}") for c in columns])
    ends = rows_at("high").join(turns, "range").join(firsts, "then").drop("then")
    out = [c for c in ahead.columns if c not in ("more", "tie", "range")]
    return ahead.where("more IS NOT NULL").select(*out).unionByName(ends.select(*out))


def compare_edited(docs: DataFrame, text: str = "text", key: str = "doc_id", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_chars, edited, marks, edited_marks, near_edited, near_next): each text against
    itself with its last quarter replaced by the start of the next one, and against the next one."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", "text", lambda df: fingerprints(df, "text", gram, window), ["text", "marks"])
    n = F.length("text")
    gone = F.floor(n / 4).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - gone), F.substring("next_text", F.lit(1), gone))
    )
    rows = fingerprints(rows, "edited", gram, window, "edited_marks")
    rows = rows.withColumn("own", hashes(F.col("marks")))
    return rows.select(
        "doc_id", "n_chars", "edited", "marks", "edited_marks",
        likeness(F.col("own"), hashes(F.col("edited_marks"))).alias("near_edited"),
        likeness(F.col("own"), hashes(F.col("next_marks"))).alias("near_next"),
    )
