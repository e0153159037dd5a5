"""Word vectors, document vectors and fixed-length token sequences."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelab.functions.arrays import pad_to
from titlelab.functions.text import tokens
from titlelab.operators.text_vectors import clean_text
from titlelab.session import durable

# Vector size, context window, token-sequence length, reserved token ids.
VECTOR_SIZE = 100
WINDOW = 5
SEQUENCE_LENGTH = 64
PAD_ID = 0
UNKNOWN_ID = 1
# Noise words for each pair of neighbours, and the first step's length.
NEGATIVES, RATE = 5, 0.025
# Words of a block, and words that take their steps together.
BLOCK_WORDS, BATCH_WORDS = 3_000_000, 1024


@dataclass
class WordVectors:
    """``vectors``: word, times, vec, context; a row for each word. ``vec`` is what training added to the word's start
    vector, ``context`` its vector as a neighbour (null after the last round), both as bytes of halves."""

    vectors: DataFrame
    dim: int


def _start(dim: int):
    """Function from words to their start vectors, self-contained for use in tasks."""

    def start(words):
        raw = [w.encode() for w in words]
        x = np.array([zlib.crc32(w) | zlib.crc32(w, 1) << 32 for w in raw], np.uint64)[:, None] + np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 - 0.5) / dim).astype(np.float32)

    return start


def _blocks(most: int):
    """Texts of a task as blocks of about ``most`` words, each with the list of its distinct words."""

    def packed(first, lists):
        words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        ends = np.cumsum(np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]))
        return pa.RecordBatch.from_arrays(
            [pa.array([first], pa.int64()), pa.array([words.dictionary.to_pylist()], pa.list_(pa.string())),
             pa.array([words.indices.to_numpy().astype("<i4").tobytes()]), pa.array([ends.astype("<i8").tobytes()])],
            names=["block", "words", "at", "ends"],
        )

    def run(batches):
        held, size, first = [], 0, None
        for batch in batches:
            ids, lists = batch.column("id").to_numpy(), batch.column("words")
            ends = lists.offsets.to_numpy()
            ends, start = ends - ends[0], 0
            while start < len(ids):
                # the texts up to the one that fills the block
                stop = max(start + 1, min(len(ids), int(np.searchsorted(ends, ends[start] + most - size))))
                first = int(ids[start]) if first is None else first
                held.append(lists.slice(start, stop - start))
                size += int(ends[stop] - ends[start])
                start = stop
                if size >= most:
                    yield packed(first, held)
                    held, size, first = [], 0, None
        if held:
            yield packed(first, held)

    return run


def _skip_gram(dim: int, window: int, seed: int, round_no: int, rounds: int, negatives: int, batch_words: int, rate: float):
    """Function from a block, and the vectors sent to it by place, to the occurrences and new vectors of its words."""
    start = _start(dim)

    def add(table, at, steps):
        """Add the steps of each word, together no longer than one."""
        order = np.argsort(at, kind="stable")
        at = at[order]
        heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        sums = np.add.reduceat(steps[order], heads, axis=0)
        table[at[heads]] += sums / np.maximum(1, np.sqrt((sums * sums).sum(1, keepdims=True)))

    def chance(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def run(block, words, at, ends, sent):
        first_vec = start(words)
        vec, context = first_vec.copy(), np.zeros((len(words), dim), np.float32)
        if sent is not None:
            place, of_words, of_contexts = sent
            vec[place] += of_words
            context[place] = of_contexts
        text = np.searchsorted(ends, np.arange(len(at)), "right")
        pick = np.random.default_rng([seed, round_no, block % (1 << 63)])
        counts = np.bincount(at, minlength=len(words))
        noise = np.cumsum(counts**0.75)
        for first in range(0, len(at), batch_words):
            done = ((round_no - 1) + first / len(at)) / rounds
            step = np.float32(rate * max(1 - done, 1e-4))
            here = slice(first, first + batch_words)
            w, t = at[here], text[here]
            reach = pick.integers(1, window + 1, len(w))
            v, c = vec[w], context[w]
            to_v, to_c, pairs = np.zeros_like(v), np.zeros_like(c), np.zeros(len(w), np.float32)
            for d in range(1, min(window, len(w) - 1) + 1):
                together = t[d:] == t[:-d]
                for a, b in ((slice(None, -d), slice(d, None)), (slice(d, None), slice(None, -d))):
                    use = together & (reach[a] >= d)
                    g = (step * use * (1 - chance(np.einsum("ij,ij->i", v[a], c[b])))).astype(np.float32)[:, None]
                    to_v[a] += g * c[b]
                    to_c[b] += g * v[a]
                    pairs[a] += use
            # a batch shares its noise words; each pair is told from as many as ``negatives`` of them
            lots = 16 * negatives
            other = np.searchsorted(noise, pick.random(lots) * noise[-1], "right")
            o = context[other]
            g = -step * chance(v @ o.T) * (pairs[:, None] * (negatives / lots)) * (w[:, None] != other)
            g = g.astype(np.float32)
            to_v += g @ o
            add(vec, w, to_v)
            add(context, np.concatenate([w, other]), np.concatenate([to_c, g.T @ v]))
        return counts, vec - first_vec, context

    return run


def _round(learn, dim: int, last: bool):
    """One round of a block: the vectors sent to it by place, then a row for each of its words."""

    def run(block, sent):
        names = ["word", "times", "vec", "context"]
        if not block.num_rows:
            return pa.table([pa.array([], k) for k in (pa.string(), pa.int64(), pa.binary(), pa.binary())], names=names)
        words = block.column("words")[0].values
        at, ends = (np.frombuffer(block.column(c)[0].as_py(), k) for c, k in (("at", "<i4"), ("ends", "<i8")))
        known = None
        if sent is not None and sent.num_rows:
            read = lambda c: np.frombuffer(b"".join(sent.column(c).to_pylist()), "<f2").reshape(-1, dim)
            known = sent.column("place").to_numpy(), read("vec"), read("context")
        times, vec, context = learn(block.column("block")[0].as_py(), words.to_pylist(), at, ends, known)
        raw = lambda t: pa.array([x.tobytes() for x in t.astype("<f2")], pa.binary())
        return pa.table([words, pa.array(times.astype(np.int64)), raw(vec), pa.nulls(len(words), pa.binary()) if last else raw(context)], names=names)

    return run


def _only_round(pack, train):
    """Blocks trained as they are packed."""

    def run(batches):
        for block in pack(batches):
            yield from train(block, None).combine_chunks().to_batches()

    return run


def _merged(dim: int):
    """Rows sorted by word to one for each word: the mean over its blocks, each counted by the word's occurrences there."""

    def run(batches):
        held = None  # the sums of a word that may go on in the next batch

        def rows(words, times, sums):
            raw = [pa.array([x.tobytes() for x in (s / times[:, None]).astype("<f2")], pa.binary()) if s is not None else pa.nulls(len(words), pa.binary()) for s in sums]
            return pa.RecordBatch.from_arrays([words, pa.array(times), *raw], names=["word", "times", "vec", "context"])

        for batch in batches:
            if not batch.num_rows:
                continue
            words, each = batch.column("word"), batch.column("times").to_numpy()
            columns = [batch.column(c) for c in ("vec", "context")]
            if held is not None:
                words, each = pa.concat_arrays([held[0], words]), np.concatenate([held[1], each])
            coded = words.dictionary_encode()
            heads = np.flatnonzero(np.diff(coded.indices.to_numpy(), prepend=-1))
            times, sums = np.add.reduceat(each, heads), []
            for i, c in enumerate(columns):
                if c.null_count:
                    sums.append(None)
                    continue
                x = np.frombuffer(b"".join(c.to_pylist()), "<f2").reshape(-1, dim).astype(np.float64) * batch.column("times").to_numpy()[:, None]
                sums.append(np.add.reduceat(np.concatenate([held[2][i], x]) if held is not None else x, heads, axis=0))
            if len(heads) > 1:
                yield rows(coded.dictionary[:-1], times[:-1], [s if s is None else s[:-1] for s in sums])
            held = coded.dictionary[-1:], times[-1:], [s if s is None else s[-1:] for s in sums]
        if held is not None:
            yield rows(*held)

    return run


def word2vec(
    df: DataFrame, text: str = "text", dim: int = VECTOR_SIZE, window: int = WINDOW,
    iterations: int = 1, partitions: int | None = None, seed: int = 42,
) -> WordVectors:
    """Train word vectors on cleaned tokens by skip-gram with negative samples; every word is kept.

    Texts are dealt to ``partitions`` parts (by default as many as the session has parallel tasks) and there
    packed into blocks of about ``BLOCK_WORDS`` words. A block starts from the vectors of its own words, trains
    on its texts, and sends a row for each of its words; a word's vectors are the mean over its blocks, counted by
    occurrences. Start vectors follow from a hash of the word. So the vocabulary is a table, and neither driver nor
    a task holds more of it than the words of a block. The last round is not written: it is run when the vectors
    are read, so write them if they are read often.
    """
    spark = df.sparkSession
    partitions = partitions or spark.sparkContext.defaultParallelism
    # dealt by a number: dealing in turn would sort the texts first
    dealt = df.select(F.monotonically_increasing_id().alias("id"), text).repartition(partitions, "id")
    texts = dealt.select("id", tokens(clean_text(text)).alias("words"))
    texts, pack = texts.where(F.size("words") > 0), _blocks(BLOCK_WORDS)
    kind = "word string, times long, vec binary, context binary"
    blocks, vectors = None, spark.createDataFrame([], kind)
    for done in range(1, iterations + 1):
        train = _round(_skip_gram(dim, window, seed, done, iterations, NEGATIVES, BATCH_WORDS, RATE), dim, done == iterations)
        if iterations == 1:
            moved = texts.mapInArrow(_only_round(pack, train), kind)
        else:
            blocks = blocks or durable(texts.mapInArrow(pack, "block long, words array<string>, at binary, ends binary"))
            needs = blocks.select(F.col("block").alias("of_block"), F.posexplode("words").alias("place", "word"))
            sent = needs.join(vectors, "word").select("of_block", "place", "vec", "context")
            moved = blocks.groupBy("block").cogroup(sent.groupBy("of_block")).applyInArrow(train, kind)
        vectors = moved.repartition("word").sortWithinPartitions("word", "times", "vec").mapInArrow(_merged(dim), kind)
        vectors = vectors if done == iterations else durable(vectors)
    return WordVectors(vectors, dim)


def word_table(model: WordVectors) -> DataFrame:
    """``(word, vec)`` with plain arrays."""
    dim, start = model.dim, _start(model.dim)

    def run(batches):
        for batch in batches:
            added = np.frombuffer(b"".join(batch.column("vec").to_pylist()), "<f2").reshape(-1, dim)
            flat = (start(batch.column("word").to_pylist()) + added.astype(np.float64)).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * dim, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("word"), lists], names=["word", "vec"])

    return model.vectors.select("word", "vec").mapInArrow(run, "word string, vec array<double>")


def mean_vector(
    df: DataFrame, word_vectors: DataFrame, id_col: str, words: str, dim: int = VECTOR_SIZE
) -> DataFrame:
    """Mean vector over the known words of each row, zeros when none is known.

    Repeated words are counted first; vectors are averaged inside the aggregate, so one
    row per (document, word) is moved rather than one per vector entry.
    """
    counts = df.select(id_col, F.explode(words).alias("word")).groupBy(id_col, "word").agg(
        F.count("*").cast("double").alias("times")
    )
    known = counts.join(word_vectors.select("word", "vec"), "word")
    entries = array_to_vector(F.col("vec").cast("array<double>"))
    means = known.select(id_col, "times", entries.alias("_v")).groupBy(id_col).agg(
        Summarizer.mean(F.col("_v"), F.col("times")).alias("_m")
    )
    arrays = means.select(id_col, vector_to_array("_m").alias("vec"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return df.select(id_col).join(arrays, id_col, "left").withColumn("vec", F.coalesce("vec", zeros))


def encode_sequence(
    df: DataFrame, vocab: DataFrame, id_col: str, text: str = "text",
    max_len: int = SEQUENCE_LENGTH,
) -> DataFrame:
    """``(id, input_ids, attention_mask)`` of exactly ``max_len`` entries.

    ``vocab`` is ``(term, term_id)``; unknown words share one id. Cutting at ``max_len``
    is the operator's definition, so only that many words per row are looked up.
    """
    head = F.slice(tokens(clean_text(text)), 1, max_len)
    words = df.select(id_col, F.posexplode(head).alias("pos", "term"))
    coded = words.join(vocab, "term", "left").select(
        id_col, "pos", F.coalesce("term_id", F.lit(UNKNOWN_ID)).alias("term_id")
    )
    listed = coded.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "term_id"))).alias("s"))
    ids = listed.select(id_col, F.transform("s", lambda e: e["term_id"]).alias("ids"))
    joined = df.select(id_col).join(ids, id_col, "left")
    ids_or_none = F.coalesce(F.col("ids"), F.array().cast("array<int>"))
    mask = F.transform(ids_or_none, lambda _: F.lit(1))
    return joined.select(
        id_col,
        pad_to(ids_or_none, max_len, F.lit(PAD_ID)).alias("input_ids"),
        pad_to(mask, max_len, F.lit(0)).alias("attention_mask"),
    )


def top_classes(df: DataFrame, id_col: str, probability: str, k: int = 3) -> DataFrame:
    """The ``k`` most probable classes of each row: ``(id, rank, class, probability)``.

    Each row's own array is sorted in place, so nothing is shuffled.
    """
    pairs = F.transform(
        F.col(probability), lambda p, i: F.struct((-p).alias("less"), i.cast("int").alias("class"))
    )
    best = F.slice(F.array_sort(pairs), 1, k)
    listed = df.select(id_col, F.posexplode(best).alias("at", "entry"))
    return listed.select(
        id_col, (F.col("at") + 1).alias("rank"), F.col("entry.class").alias("class"),
        (-F.col("entry.less")).alias("probability"),
    )
