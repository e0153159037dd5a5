"""Spelling variants: words one edit apart, found with k-d trees over letter counts.

A word is the vector of its letter counts, and words are kept apart by length. One replaced letter
moves a vector by one down and one up, one inserted letter by one up. So the words near a word of
length L lie, among those of length L, in the ball of one step up and one down, and among those
of length L + 1 in the ball of one step up. K-d trees cut the vectors of each length into boxes
with a median split on the widest dimension; a range search skips every box its ball can't reach.

The upper part of each tree is fitted on a bounded sample of the words (``SAMPLE``, by hash) and
deals all words to cells of about ``CELL_WORDS``; a word is sent to the cells its balls reach. In a
task the words of a cell are cut further by a tree of their own down to leaves of ``LEAF`` words, and
what reaches a leaf is compared with it by one matrix product: letter counts at squared distance 2
(same length) or 1 (one letter more) are exactly one replaced or inserted letter, up to order.
Order is then verified letter by letter. Words with equal counts, which no tree can part, are dealt to
blocks of bounded size, and so are the words sent to a cell: every block meets every block of its
cell, so no task holds a cell of any size.

Each pair is found once and counted for both words. A word's form is its near word of the
greatest count (ties: the least in code-point order) if that is at least ``ratio`` times its own
count. Counts grow from a word to its form, so forms make no circle; roots are found by doubling
the links, a number of joins that grows with the logarithm of the longest chain.

Defined results: null texts and texts without letters have no words; a null id counts as an empty
one in the hash. Repeated rows count as often as they are there. A run of letters of any length is one word;
its vector has one entry for each letter of the alphabet, however long it is. Letters are code
points; those from U+0100 on share entries of the vector, which only lets more words through
to verification. An empty table gives an empty table. Columns other than those named are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelab.llm.lines import LOWER, UPPER
from titlelab.session import durable

#: Letters of a word, which occurrences are misspelt, and which words count.
LETTERS = "[A-Za-zÀ-ÿ]+"
MISSPELT = 97
LEAST_CHARS, LEAST_COUNT, RATIO = 5, 3, 2

DIMS = 256
#: Words of a cell, of a block within it, of a block of words sent to it, and of a leaf.
CELL_WORDS, BLOCK_WORDS, SENT_WORDS, LEAF = 32_768, 65_536, 524_288, 48
#: Words the cells are fitted on, at most; and words of the sample in one cell, at least.
SAMPLE, SAMPLE_LEAF = 65_536, 16


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word) for every run of letters; every ``MISSPELT``-th by hash lacks a letter."""
    doc = F.coalesce(F.col(key).cast("string"), F.lit(""))
    runs = docs.select(F.concat(doc, F.lit(":")).alias("_doc"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("_run"))
    lowered = runs.select("_doc", F.translate("_run", UPPER, LOWER).alias("_run"))
    hashed = lowered.select("_run", F.crc32(F.concat("_doc", "_run")).alias("_h"))
    at = (F.col("_h") % F.length("_run")).cast("int")
    cut = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.length("_run")))
    return hashed.select(F.when(F.col("_h") % MISSPELT == 0, cut).otherwise(F.col("_run")).alias("word"))


def vocabulary(words: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    long_enough = words.where(F.length("word") >= least_chars)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def letter_counts(words: list[str], places: np.ndarray | None = None) -> np.ndarray:
    """Letter counts, one row a word. ``places`` are the letters counted apart, the last one together
    with all that are not among them."""
    places = np.arange(DIMS) if places is None else places
    column = np.full(DIMS, len(places) - 1)
    column[places] = np.arange(len(places))
    out = np.empty((len(words), len(places)), np.float32)
    for first in range(0, len(words), 16_384):
        codes = [_codes(w) for w in words[first : first + 16_384]]
        row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        at = row * len(places) + column[np.concatenate(codes) % DIMS]
        out[first : first + 16_384] = np.bincount(at, minlength=len(codes) * len(places)).reshape(len(codes), -1)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grow(vectors: np.ndarray, most: int):
    """K-d tree of the vectors: (dimension, last value on the left, left, right), or a leaf (rows)."""

    def cut(rows):
        if len(rows) <= most:
            return rows
        part = vectors[rows]
        spread = part.max(0) - part.min(0)
        if not spread.any():
            return rows
        at = int(part.var(0).argmax())
        column = part[:, at]
        split = min(int(np.median(column)), int(column.max()) - 1)
        left = column <= split
        return at, split, cut(rows[left]), cut(rows[~left])

    return cut(np.arange(len(vectors)))


def reach(tree, vectors: np.ndarray, up: int, down: int, visit) -> None:
    """``visit(leaf, rows)`` for the rows whose ball of ``up`` steps up and ``down`` down reaches a leaf."""

    def walk(node, rows, needs_up, needs_down, low, high):
        if not len(rows):
            return
        if not isinstance(node, tuple):
            visit(node, rows)
            return
        at, split, left, right = node
        x = vectors[rows, at]
        # steps down that the left side asks for, beyond those its box asked for before
        more = np.maximum(x - split, 0) - (np.maximum(x - high[at], 0) if at in high else 0)
        stay = needs_down + more <= down
        walk(left, rows[stay], needs_up[stay], (needs_down + more)[stay], low, {**high, at: split})
        more = np.maximum(split + 1 - x, 0) - (np.maximum(low[at] - x, 0) if at in low else 0)
        stay = needs_up + more <= up
        walk(right, rows[stay], (needs_up + more)[stay], needs_down[stay], {**low, at: split + 1}, high)

    none = np.zeros(len(vectors), np.int64)
    walk(tree, np.arange(len(vectors)), none, none, {}, {})


def numbered_leaves(tree, first: int = 0):
    """The tree with a number for each leaf, and the next free number."""
    if not isinstance(tree, tuple):
        return first, first + 1
    left, after = numbered_leaves(tree[2], first)
    right, after = numbered_leaves(tree[3], after)
    return (tree[0], tree[1], left, right), after


def cells(words: DataFrame, total: int) -> dict[int, tuple]:
    """For each length met in a bounded sample: a tree whose leaves are numbered cells.

    The sample and so the trees have at most about ``SAMPLE`` words, however many words there are.
    """
    share = min(1.0, SAMPLE / max(total, 1))
    picked = F.pmod(F.xxhash64(F.lit("cell"), "word"), F.lit(1 << 30)) < int(share * (1 << 30))
    # only words of ordinary length: a word that is very long is in the one cell of its length
    sample = words.where(picked & (F.length("word") <= DIMS)).select("word").toPandas()["word"]
    of_length: dict[int, list[str]] = {}
    for word in sorted(sample):
        of_length.setdefault(len(word), []).append(word)
    most = max(SAMPLE_LEAF, int(CELL_WORDS * share))
    return {n: numbered_leaves(grow(letter_counts(group), most))[0] for n, group in of_length.items()}


def dealt(words: DataFrame, trees: dict[int, tuple]) -> DataFrame:
    """(length, cell, step, word, n): each word in its own cell (step null) and as sent to others.

    Step 0 asks a cell for words of the same length, step 1 for those with one letter more.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("word").to_pylist()
            counts = batch.column("n")
            by_length: dict[int, list[int]] = {}
            for i, text in enumerate(texts):
                by_length.setdefault(len(text), []).append(i)
            for length, members in by_length.items():
                members = np.array(members)
                vectors = letter_counts([texts[i] for i in members]) if length <= DIMS else np.zeros((len(members), DIMS), np.float32)
                for step, target, up, down in ((None, length, 0, 0), (0, length, 1, 1), (1, length + 1, 1, 0)):
                    found = []
                    reach(trees.get(target, 0), vectors, up, down, lambda leaf, rows: found.append((leaf, rows)))
                    leaf = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                    rows = pa.array(members[np.concatenate([f[1] for f in found])])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), target), pa.int32()), pa.array(leaf, pa.int32()),
                         pa.array([step] * len(rows), pa.int32()), batch.column("word").take(rows), counts.take(rows)],
                        names=["length", "cell", "step", "word", "n"],
                    )

    return words.select("word", "n").mapInArrow(run, "length int, cell int, step int, word string, n long")


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replaced letter, or ``b`` by one inserted one."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(1) == 1
    head = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= n


def pairs_in_block(table):
    """(a, a_n, b, b_n) of the near words among one block of a cell and one of the words sent to it."""
    import pyarrow as pa

    steps = table.column("step").to_pylist()
    texts, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
    own = [i for i, s in enumerate(steps) if s is None]
    schema = pa.schema([("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())])
    if not own:
        return schema.empty_table()
    words = [texts[i] for i in own]
    length = len(words[0])
    codes = _codes("".join(words)).reshape(len(words), length)
    letters = np.unique(codes % DIMS)
    # letters that only sent words have share one entry: such a letter can only be the replaced one
    places = np.append(letters, np.setdiff1d(np.arange(DIMS), letters)[:1])
    kind = np.float32 if length < 2048 else np.float64  # whole numbers are exact below these
    here = letter_counts(words, places)
    tree = grow(here, LEAF)
    squares = (here.astype(kind) ** 2).sum(1)
    same = (0, 2) if codes.max() >= DIMS else (2,)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    own, names = np.array(own), np.array(texts, object)
    for step in (0, 1):
        asked = np.array([i for i, s in enumerate(steps) if s == step], np.int64)
        if not len(asked):
            continue
        sent = names[asked].tolist()
        vectors = letter_counts(sent, places)
        sent_codes = _codes("".join(sent)).reshape(len(sent), length - step)
        sent_squares = (vectors.astype(kind) ** 2).sum(1)
        wanted = (1,) if step else same

        def visit(leaf, rows):
            for first in range(0, len(rows), 8192):
                q = rows[first : first + 8192]
                for at in range(0, len(leaf), 2048):
                    c = leaf[at : at + 2048]
                    far = sent_squares[q][:, None] + squares[c] - 2 * (vectors[q].astype(kind) @ here[c].T.astype(kind))
                    close = far == wanted[0]
                    for other in wanted[1:]:
                        close |= far == other
                    x, y = np.nonzero(close)
                    near = one_edit(sent_codes[q[x]], codes[c[y]])
                    a, b = asked[q[x[near]]], own[c[y[near]]]
                    if not step:  # a pair of one length is met from both sides, and kept from one
                        once = np.array(names[a] < names[b], bool)
                        a, b = a[once], b[once]
                    left.append(a)
                    right.append(b)

        reach(tree, vectors, 1, 1 - step, visit)
    a, b = np.concatenate(left), np.concatenate(right)
    return pa.table([pa.array(names[a], pa.string()), pa.array(counts[a]), pa.array(names[b], pa.string()), pa.array(counts[b])], schema=schema)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every two words that one edit parts, once."""
    total = words.count()
    sent = durable(dealt(words, cells(words, total)))
    sizes = sent.groupBy("length", "cell").agg(F.count("step").alias("_sent"), (F.count("*") - F.count("step")).alias("_own"))
    blocks = sizes.where(F.col("_own") > 0).select(
        "length", "cell", F.ceil(F.col("_own") / BLOCK_WORDS).cast("int").alias("_blocks"),
        F.greatest(F.lit(1), F.ceil(F.col("_sent") / SENT_WORDS)).cast("int").alias("_parts"),
    )
    placed = sent.join(durable(blocks), ["length", "cell"])
    place = F.xxhash64(F.lit("block"), "word")
    is_own = F.col("step").isNull()
    copies = F.sequence(F.lit(0), F.when(is_own, F.col("_parts")).otherwise(F.col("_blocks")) - 1)
    copied = placed.withColumn("_copy", F.explode(copies))
    met = copied.select(
        "length", "cell", "step", "word", "n",
        F.when(is_own, F.pmod(place, F.col("_blocks")).cast("int")).otherwise(F.col("_copy")).alias("block"),
        F.when(is_own, F.col("_copy")).otherwise(F.pmod(place, F.col("_parts")).cast("int")).alias("part"),
    )
    return met.groupBy("length", "cell", "block", "part").applyInArrow(pairs_in_block, "a string, a_n long, b string, b_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word that following forms leads to."""
    links = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        joined = durable(joined)
        links = joined.drop("_moved")
        if joined.where("_moved").isEmpty():
            return links


def variants(words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words with counts."""
    words = durable(words.select("word", "n"))
    pairs = durable(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("_near"), F.col("b_n").alias("_n")).union(pairs.select("b", "a", "a_n"))
    best = F.min(F.struct((-F.col("_n")).alias("less"), F.col("_near").alias("form"))).alias("_best")
    near = durable(both.groupBy("word").agg(F.count("*").alias("n_near"), best))
    every = words.join(near, "word", "left")
    takes = -F.col("_best.less") >= F.lit(ratio) * F.col("n")
    formed = durable(every.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("_best.form")).alias("form"), F.when(takes, -F.col("_best.less")).alias("form_n"),
    ))
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
