"""Similarity join on word n-grams: a MinHash LSH forest finds pairs, exact Jaccard decides.

Texts are folded to classes of equal word sequences first. Every class has ``trees`` signatures
of ``depth`` min-hashes, each a path in a prefix trie. The prefix length that must match is
shortened level by level until a pair at exactly the threshold is found with the target recall.
Classes that share such a prefix in some tree are candidates of each other. Connected candidates
are brought together once, in blocks of bounded size, and all candidate pairs of a block are
verified on the full shingle sets in numpy; only counts and group edges leave a task, never
pairs. A component larger than a block is dealt to block pairs, so every pair still meets.

Defined results: a text without words (null, empty, blank) is linked to nothing and is a class
of its own, except that rows of equal id share it. A text of fewer than ``words`` words is one
shingle. Word case and white space don't count. Equal word sequences are links of similarity 1.
Rows repeated under one id are one document with one result row. Null ids keep a row of their
own and link to nothing. Ties go to the lower id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelab.llm.common import map_columns, slices
from titlelab.llm.graph import components
from titlelab.session import durable

WORDS, LEAST = 5, 0.8
TREES, DEPTH = 24, 8
RECALL = 0.9999
#: Classes that one verification task holds of a component.
BLOCK = 1024
SEED = 20_231


def prefix_length(least: float, trees: int, depth: int, recall: float) -> int:
    """Longest matched prefix that still finds a pair at the threshold with the target recall."""
    length = depth
    while length > 1 and 1 - (1 - least**length) ** trees < recall:
        length -= 1
    return length


def word_sequence(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def digest(text: str) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def shingles(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each word sequence's n-grams; none for the empty one."""
    import xxhash

    known: dict[str, int] = {}
    out = []
    for text in texts:
        words = text.split()
        if not words:
            out.append(np.zeros(0, np.uint64))
            continue
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(n, len(h))
        total = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            total = (total ^ h[j : len(h) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        out.append(np.unique(total))
        if len(known) > 500_000:
            known.clear()
    return out


def signatures(sets: list[np.ndarray], trees: int, length: int) -> np.ndarray:
    """One prefix hash for each set and tree. Sets are not empty."""
    pick = np.random.default_rng(SEED)
    odd = pick.integers(1, 1 << 32, trees * length, np.uint32) | np.uint32(1)
    plus = pick.integers(0, 1 << 32, trees * length, np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    every = np.concatenate(sets)
    low, high = every.astype(np.uint32), (every >> np.uint64(32)).astype(np.uint32)
    keys = np.zeros((len(sets), trees), np.uint64)
    for i in range(trees * length):
        mixed = (low * odd[i] + plus[i]) ^ high
        mixed *= odd[-1 - i]
        least = np.minimum.reduceat(mixed, starts)
        keys[:, i // length] = (keys[:, i // length] ^ least.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        keys[:, i // length] ^= keys[:, i // length] >> np.uint64(31)
    return keys


def classes(docs: DataFrame, text: str, words: int, trees: int, length: int) -> DataFrame:
    """Adds ``word_hash`` (128 bits of the word sequence; null without words) and ``keys``."""

    def start():
        import pyarrow as pa

        def compute(column):
            texts = [t or "" for t in column.to_pylist()]
            digests, keys = [], []
            for part in slices(texts, 1_000_000):
                group = texts[part]
                joined = [word_sequence(t) for t in group]
                digests += [digest(t) if t else None for t in joined]
                sets = shingles(joined, words)
                some = [s for s in sets if len(s)]
                found = iter(signatures(some, trees, length).view(np.int64) if some else [])
                keys += [next(found) if len(s) else None for s in sets]
            return [pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]

        return compute

    return map_columns(docs, [text], "word_hash binary, keys array<long>", start, ["doc_id"])


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, least: float = LEAST,
         trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id (least id of its connected documents), copy_of (least
    id with the same words) and n_links (other documents of similarity ``least`` or more)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    length = prefix_length(least, trees, depth, recall)
    hashed = durable(classes(rows, "text", words, trees, length))
    named = hashed.where("doc_id IS NOT NULL AND word_hash IS NOT NULL")
    members = named.select("word_hash", "doc_id").distinct()
    reps = named.groupBy("word_hash").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    copies = members.groupBy("word_hash").agg(F.count(F.lit(1)).alias("copies"))
    reps = durable(reps.join(copies, "word_hash"))

    # candidates: every class of a bucket with the least one of it
    paths = reps.select("rep", "word_hash", F.posexplode("keys").alias("tree", "prefix"))
    buckets = paths.groupBy("tree", "prefix").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).where("most > b")
    met = paths.join(durable(buckets), ["tree", "prefix"]).select(F.col("rep").alias("a"), "b")
    groups = durable(components(met))

    verified = durable(verify(rows, reps, groups, words, least, block))
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(verified.select(F.col("rep").alias("a"), F.col("hook").alias("b")))

    result = reps.select("word_hash", "rep", "copies")
    result = result.join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    result = durable(result.select(
        "word_hash", "rep", F.coalesce("root", "rep").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    ))
    with_words = members.join(result, "word_hash").groupBy("doc_id").agg(
        # an id that comes with several texts takes the least class and all links
        F.min("class_id").alias("class_id"), F.min("rep").alias("copy_of"), F.sum("n_links").alias("n_links")
    )
    alone = hashed.where("doc_id IS NULL").select("doc_id").unionByName(
        hashed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("word_hash").alias("n")).where("n = 0").select("doc_id")
    )
    return with_words.unionByName(
        alone.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"))
    )


def verify(rows: DataFrame, reps: DataFrame, groups: DataFrame, words: int, least: float, block: int) -> DataFrame:
    """(rep, links, hook) from each block: verified links to other documents, and the least
    class it is connected to within the block."""
    sizes = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    placed = groups.join(durable(sizes), "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    wanted = durable(placed.join(reps, F.col("node") == F.col("rep")).select("rep", "word_hash", "root", "part", "parts", "keys", "copies"))
    found = rows.join(wanted, F.col("doc_id") == F.col("rep")).drop("doc_id")
    # block (i, j), i <= j, holds parts i and j; each part goes to all blocks it has a share in
    other = F.explode(F.expr("sequence(0, parts - 1)"))
    dealt = found.withColumn("other", other).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))

    def check(table):
        import pyarrow as pa

        texts = [word_sequence(t) for t in table.column("text").to_pylist()]
        first = {}
        for at, (r, h) in enumerate(zip(table.column("rep").to_pylist(), table.column("word_hash").to_pylist())):
            if digest(texts[at]) == h:  # an id may come with several texts and repeated rows
                first.setdefault((r, h), at)
        at = [first[k] for k in sorted(first)]
        table, texts = table.take(at), [texts[x] for x in at]
        reps = table.column("rep").to_numpy()
        part = table.column("part").to_numpy()
        across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        sets = shingles(texts, words)
        keys = np.array(table.column("keys").to_pylist(), np.int64)
        copies = table.column("copies").to_numpy()
        size = np.array([len(s) for s in sets])
        links, root = np.zeros(len(reps), np.int64), list(range(len(reps)))

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for tree in range(keys.shape[1]):
            order = np.argsort(keys[:, tree], kind="stable")
            edges = np.flatnonzero(np.diff(keys[order, tree])) + 1
            for group in np.split(order, edges):
                for n, x in enumerate(group[:-1].tolist()):
                    others = group[n + 1 :]
                    if across:
                        others = others[part[others] != part[x]]
                    if tree:  # a pair counts in the first tree where it meets
                        others = others[~(keys[others, :tree] == keys[x, :tree]).any(1)]
                    others = others[reps[others] != reps[x]]
                    low, high = np.minimum(size[others], size[x]), np.maximum(size[others], size[x])
                    others = others[low >= least * high - 1e-9]
                    for y in others.tolist():
                        both = shared(sets[x], sets[y])
                        if both >= least * (size[x] + size[y] - both) - 1e-9:
                            links[x] += copies[y]
                            links[y] += copies[x]
                            a, b = top(x), top(y)
                            root[max(a, b)] = min(a, b)
        hook = reps[[top(x) for x in range(len(reps))]]
        keep = links > 0
        return pa.table({"rep": reps[keep], "links": links[keep], "hook": hook[keep]})

    kind = reps.schema["rep"].dataType.simpleString()
    return dealt.groupBy("root", "i", "j").applyInArrow(check, f"rep {kind}, links long, hook {kind}")


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Values that two sorted arrays of distinct values have in common."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())
