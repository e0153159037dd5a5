"""Line dedup: keep bitmaps that drop lines repeated across documents, in built-in expressions only.

A line's key is the line stripped of white space at both ends with A-Z in lower case, known by two
64-bit hashes. Keys of at least ``least_chars`` code points found in at least ``least_docs``
documents lose all their lines except those in the document of the greatest id.

Lines travel as (hash, document, position), never as text. They are partitioned by ranges of the
hash and sorted by document, greatest first, and position behind it, so one pass over a key meets
its kept document first and numbers the documents that follow; the last number says in how many
the key is found. A key that alone holds more than ``1 / HOT_SHARE`` of
all lines would make one range too long: such keys, at most ``HOT_SHARE`` of them, are found
by a count of all keys; their documents are counted by aggregates that fold each key within the
tasks that read it. Both ways give the same rows.

The result is one bitmap for each document that loses a line, as run lengths: (start, length) of
each run of kept lines, the last run open to the end. ``apply`` takes the runs out of the text's line array, a pass linear in the
text. Texts are shuffled once, to meet their bitmaps.

Defined results: a null or empty text is one empty line. Rows that share an id count as one
document when documents are counted and when the greatest id is found; each row keeps its own
bitmap, known by id and two hashes of its text, so equal rows get equal bitmaps. A null id counts
as an id less than all others, and such rows get bitmaps too. A text of any length is one row; its
lines are exploded and its runs are at most its lines. An empty table gives an empty table. Extra columns
stay; one that bears the name of an output is replaced by it. White space is U+0020 and
U+0009 to U+000D; a carriage return before the line feed belongs to the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from titlelab.llm.winnow import let
from titlelab.session import durable

#: White space around a key, and the letters whose case is folded.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LEAST_CHARS, LEAST_DOCS = 20, 3
#: A key with more than one in so many lines is folded before the shuffle; at most so many keys are.
HOT_SHARE = 1000
#: Lines of one range.
RANGE_LINES = 1_000_000

_RUNS = "array<struct<start:int,length:int>>"
_TO_END = (1 << 31) - 1


def text_lines(text: Column | str) -> Column:
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _digest(value: Column, name: str) -> list[Column]:
    return [F.xxhash64(value).alias(f"{name}_a"), F.xxhash64(F.lit(name), value).alias(f"{name}_b")]


def _row(key: str, text: str) -> list[Column]:
    """What tells rows apart: the id and a digest of the text."""
    return [F.col(key).alias("_id"), *_digest(F.coalesce(F.col(text), F.lit("")), "_t")]


def line_keys(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(_id, _t_a, _t_b, pos, _k_a, _k_b) for each line whose key is long enough."""
    each = docs.select(*_row(key, text), F.posexplode(text_lines(text)).alias("pos", "_line"))
    keyed = each.withColumn("_line", line_key(F.col("_line"))).where(F.length("_line") >= least_chars)
    return keyed.select("_id", "_t_a", "_t_b", "pos", *_digest(F.col("_line"), "_k"))


def dropped_lines(lines: DataFrame, ranges: int, hot: list[int], least_docs: int) -> DataFrame:
    """(_id, _t_a, _t_b, pos) of the lines that go."""
    is_hot = F.col("_k_a").isin(hot) if hot else F.lit(False)
    # A null id sorts below all others and is one document.
    lines = lines.withColumn("_doc", F.struct(F.col("_id").isNotNull().alias("set"), F.col("_id").alias("id")))
    by_doc = W.partitionBy("_k_a", "_k_b").orderBy(F.desc("_doc"))
    stream = lines.where(~is_hot).repartitionByRange(ranges, "_k_a").sortWithinPartitions("_k_a", "_k_b", F.desc("_doc"), "pos")
    ranked = stream.withColumn("_rank", F.dense_rank().over(by_doc))
    whole = by_doc.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    counted = ranked.withColumn("_docs", F.last("_rank").over(whole))
    found = counted.where((F.col("_rank") > 1) & (F.col("_docs") >= least_docs)).select("_id", "_t_a", "_t_b", "pos")
    if not hot:
        return found
    often = lines.where(is_hot)
    # Documents of a hot key, each once: folded within the tasks that read them, spread by document.
    docs_of = often.groupBy("_k_a", "_k_b", "_doc").agg(F.lit(1).alias("_one"))
    kept = durable(docs_of.groupBy("_k_a", "_k_b").agg(F.max("_doc").alias("_first"), F.sum("_one").alias("_docs")))
    more = often.join(kept.where(F.col("_docs") >= least_docs), ["_k_a", "_k_b"]).where(F.col("_doc") < F.col("_first"))
    return found.unionByName(more.select("_id", "_t_a", "_t_b", "pos"))


def kept_runs(gone: Column) -> Column:
    """Runs of lines that stay, from the sorted positions of those that go; the last run is open."""

    def runs(edges):
        n = F.size(edges) - 1
        between = F.zip_with(
            F.slice(edges, F.lit(1), n), F.slice(edges, F.lit(2), n),
            lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")),
        )
        return F.filter(between, lambda r: r["length"] > 0).cast(_RUNS)

    return let(F.concat(F.array(F.lit(-1)), gone, F.array(F.lit(_TO_END))), runs)


def keep_bitmaps(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """(_id, _t_a, _t_b, n_dropped, keep) of each row that loses lines; all others keep all of theirs."""
    lines = durable(line_keys(docs, key, text, least_chars))
    total = lines.count()
    # Counts fold a key within each task; at most HOT_SHARE keys come to the driver.
    least = max(total // HOT_SHARE, RANGE_LINES // HOT_SHARE)
    often = lines.groupBy("_k_a").agg(F.count("*").alias("n")).where(F.col("n") > least)
    hot = [r["_k_a"] for r in often.collect()]
    gone = dropped_lines(lines, max(1, -(-total // RANGE_LINES), _partitions(docs)), hot, least_docs)
    of_row = gone.groupBy("_id", "_t_a", "_t_b").agg(F.array_sort(F.collect_set("pos")).alias("_gone"))
    return of_row.select("_id", "_t_a", "_t_b", F.size("_gone").alias("n_dropped"), kept_runs(F.col("_gone")).alias("keep"))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def apply(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_lines (before dropping), n_dropped, keep (null: all lines) and the kept text."""
    made = ["n_lines", "n_dropped", "keep", "kept"]
    wanted = docs.select(*[c for c in docs.columns if c not in made])
    marked = wanted.select("*", *[c.alias(f"_d{i}") for i, c in enumerate(_row(key, text))])
    found = bitmaps.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(("_id", "_t_a", "_t_b"))], "n_dropped", "keep")
    same = F.col("_d0").eqNullSafe(F.col("_b0")) & (F.col("_d1") == F.col("_b1")) & (F.col("_d2") == F.col("_b2"))
    met = marked.join(found, same, "left").drop(*[f"_{side}{i}" for side in "db" for i in range(3)])
    rest = let(text_lines(text), lambda all_: F.flatten(F.transform("keep", lambda r: F.slice(all_, r["start"] + 1, r["length"]))))
    kept = F.when(F.col("keep").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(rest, "\n"))
    return (
        met.withColumn("kept", kept)
        .withColumn("n_lines", F.size(text_lines(text)).cast("long"))
        .withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0)).cast("long"))
    )


def dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """``docs`` with n_lines, n_dropped, keep and kept; the bitmaps are a written table."""
    return apply(docs, durable(keep_bitmaps(docs, key, text, least_chars, least_docs)), key, text)
