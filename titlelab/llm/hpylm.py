"""Language-model scoring with a hierarchical Pitman-Yor model of words after words.

Every word is the context of a restaurant for the words that follow it; the end token is the
context of a text's first word. These restaurants share one parent, the word restaurant, which
gets one customer for each table opened in them. Its base distribution is a spelling model:
restaurants for contexts of the 0 to 3 bytes before, each sharing the restaurant of the shorter
context as its parent, down to a uniform choice of bytes. A table opened for a word sends the
word's spelling to the byte restaurants as one customer a byte, and a table opened there sends
one to its parent. Gibbs sweeps unseat a dish and seat its customers anew by the
Chinese-restaurant process, given all others; probabilities are averaged over the sweeps. The contexts of words share a
strength, chosen by leaving out each training token, so text without order falls back on words.

How it is spread: texts are cut into blocks of bounded size where they lie, each with its own
dictionaries of words and of pairs (previous word, word), so Spark shuffles (block, word) rows
and the pairs of each block as packed arrays, and never (text, word) rows. A pair is known by
64-bit hashes of its words. Ranges of the pairs' hashes, merged in a task each, give their
training tokens. A pair with one token has one table in
every sweep, so only pairs with more are seated, in a table of their own: with the word
probability and the tables of the context of the sweep before. A word has as many tokens after
it as it has itself, so a context's customers are the word's count, and what pairs with one
token add to words and contexts is that count less the other pairs.

A sweep seats the words in the tasks that hold them and sums the bytes of their tables with
Spark. Byte contexts are classed (``CONTEXT_BITS``), so these sums are of bounded size; the byte
restaurants are seated on the driver and sent back. Seating draws from a hash of dish and sweep,
so a task that is run again seats alike. Words return to the blocks with their probability and
tables, and pairs with their count and tables, unless their only token is in the block itself;
a text's score is the sum over its block's pairs.

All words without training tokens are one event, "a new word", as they are in the base score:
its probability is what the word restaurant sends to its base, less the spellings it knows.

Defined results: null text counts as empty; the empty text is one end token. With nothing to
learn from, counts are 0, the base share is 0.5/0.5 and any token is a new word of probability
1, so that both scores are 0. Equal texts have equal scores. Repeated rows are each scored, and each counted if
they are training rows. Case is folded for A-Z only.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlelab.session import durable, release

#: Bits a byte adds to the class of a context, the nearest byte first.
CONTEXT_BITS = (8, 5, 3)
SYMBOLS = 257  # bytes and the end of a word
#: Characters of text that one block holds, and so its dictionary at most.
BLOCK_CHARS = 24_000_000
SWEEPS = 3
STRENGTH = 0.5
#: Strengths that the contexts of words choose from.
STRENGTHS = [STRENGTH * 2 ** (k / 2) for k in range(41)]
END = b"\n"  # the end token; no word holds white space
#: Pairs of a range of hashes, merged in one task.
RANGE_PAIRS = 2_000_000
#: Words that a task seats at a time.
GATHERED = 200_000
#: Customers seated one by one; from there the gaps between new tables come from the continuous law.
ONE_BY_ONE = 64


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, lower-cased for A-Z only, then the end token."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


class Block:
    """Texts as counts of indices into a dictionary of pairs of words, which are indices into one of words."""

    def __init__(self):
        self.index: dict[bytes, int] = {END: 0}
        self.trained, self.texts, self.codes, self.times, self.chars = [], [], [], [], 0

    def add(self, place: int, text: str | None, train: bool) -> None:
        words = tokens(text)
        index = self.index
        ids = np.fromiter([index.setdefault(w, len(index)) for w in words], np.int64, len(words))
        codes, n = np.unique(np.roll(ids, 1) << 32 | ids, return_counts=True)  # the last word is the end token
        self.texts.append((place, len(words), len(codes), train))
        self.codes.append(codes)
        self.times.append(n.astype("<i4"))
        if train:
            self.trained.append((codes & 0xFFFFFFFF, n))
        self.chars += len(text or "") + 1

    def counts(self) -> np.ndarray:
        """Training tokens of each word of the dictionary."""
        total = np.zeros(len(self.index), np.int64)
        if self.trained:
            ids, n = (np.concatenate(x) for x in zip(*self.trained))
            total += np.bincount(ids, n, minlength=len(total)).astype(np.int64)
        return total

    def packed(self) -> list[bytes]:
        """Pairs of each text and how often each, the pairs' words, and the words' hashes."""
        import xxhash

        codes, at = np.unique(np.concatenate(self.codes), return_inverse=True)
        starts = np.cumsum([0, *map(len, self.codes)])[:-1]
        steps = np.diff(at, prepend=0)
        steps[starts] = at[starts]  # steps restart in each text
        before = np.diff(codes >> 32, prepend=0)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in self.index), np.uint64, len(self.index))
        parts = (steps.astype("<i4"), np.concatenate(self.times), before.astype("<i4"), (codes & 0xFFFFFFFF).astype("<i4"), hashes.astype("<u8"))
        return [zlib.compress(x.tobytes(), 1) for x in parts]


PACKED = ("steps", "times", "befores", "afters", "hashes")


class Unpacked:
    """A block's row in arrays."""

    def __init__(self, row: dict):
        steps, self.times, before, after, hashes = (np.frombuffer(zlib.decompress(row[c]), "<u8" if c == "hashes" else "<i4") for c in PACKED)
        self.times, self.before, self.after = self.times.astype(np.int64), np.cumsum(before, dtype=np.int64), after.astype(np.int64)
        self.hashes = hashes.astype(np.uint64).view(np.int64)
        self.distinct = np.array(row["kinds"])
        self.starts = np.concatenate([[0], np.cumsum(self.distinct)[:-1]])
        run = np.cumsum(steps, dtype=np.int64)
        # steps restart in each text: take off what the texts before added up to
        self.ids = run - np.repeat(np.concatenate([[0], run[self.starts[1:] - 1]]), self.distinct)
        learnt = np.repeat(np.array(row["trained"], bool), self.distinct)
        #: Training tokens of each pair in this block.
        self.trained = np.bincount(self.ids[learnt], self.times[learnt], minlength=len(self.after)).astype(np.int64)


def blocks(docs: DataFrame, train: Column, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each block and word (``word``, ``at``, ``train``), and one for each block's texts."""
    key = docs.schema["doc_id"].dataType
    schema = (
        f"block long, word binary, at int, train long, keys array<{key.simpleString()}>, sizes array<long>, "
        "kinds array<long>, trained array<boolean>, " + ", ".join(f"{c} binary" for c in PACKED)
    )

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number, block = TaskContext.get().partitionId() << 32, 0, Block()
        keys: list = []
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = (pa.list_(key_kind), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * len(PACKED))

        def done():
            n, at = len(block.index), part | number
            yield pa.RecordBatch.from_arrays(
                [pa.array([at] * n, pa.int64()), pa.array(list(block.index), pa.binary()), pa.array(np.arange(n, dtype=np.int32)),
                 pa.array(block.counts()), *[pa.nulls(n, k) for k in kinds]], names=names)
            _, size, distinct, trained = zip(*block.texts)
            held = [[keys], [list(size)], [list(distinct)], [list(trained)], *[[x] for x in block.packed()]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([at]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()),
                 *[pa.array(h, k) for h, k in zip(held, kinds)]], names=names)

        for batch in batches:
            ids, texts, trains = (batch.column(i).to_pylist() for i in range(3))
            for i, text in enumerate(texts):
                block.add(i, text, trains[i])
                keys.append(ids[i])
                if block.chars >= block_chars:
                    yield from done()
                    number, block, keys = number + 1, Block(), []
        if block.texts:
            yield from done()

    from pyspark.sql.pandas.types import to_arrow_type

    key_kind = to_arrow_type(key)
    return docs.select("doc_id", "text", train.alias("train")).mapInArrow(run, schema)


def met_pairs(texts: DataFrame, range_pairs: int = RANGE_PAIRS) -> DataFrame:
    """The pairs of all blocks, met in ranges of their hashes.

    A row (range, u, w, count) for each pair with more than one training token, as hashes of the word
    before and the word, and a row (range, block, steps, places) for the pairs of a block: their
    steps in the block's dictionary, and their places among the rows of the range in the order of
    ``pair_order``, -1 for a pair whose only token is in another block. Left out are pairs whose only
    token is in the block itself, and those without tokens.
    """
    most = texts.agg(F.sum(F.aggregate("kinds", F.lit(0).cast("long"), lambda n, k: n + k))).first()[0] or 0
    ranges = most // range_pairs + 1

    def send(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                held = Unpacked(row)
                u, w = held.hashes[held.before], held.hashes[held.after]
                of = (pair_hash(u, w) >> np.uint64(33)) % np.uint64(ranges)
                order = np.argsort(of, kind="stable")
                ends = np.searchsorted(of[order], np.arange(ranges + 1, dtype=np.uint64))
                for k in range(ranges):
                    at = order[ends[k] : ends[k + 1]]
                    if len(at):
                        steps, train = packed(np.diff(at, prepend=0)), packed(held.trained[at])
                        yield pa.RecordBatch.from_pylist([{"range": k, "block": row["block"], "steps": steps, "train": train, "u": u[at].tobytes(), "w": w[at].tobytes()}], schema=kinds)

    def merge(table):
        import pyarrow as pa

        rows = table.to_pylist()
        u, w = (np.frombuffer(b"".join([r[c] for r in rows]), "<i8") for c in ("u", "w"))
        steps = [unpacked(r["steps"]) for r in rows]
        at, train = np.concatenate([np.cumsum(x) for x in steps]), np.concatenate([unpacked(r["train"]) for r in rows])
        block = np.repeat(np.array([r["block"] for r in rows], np.int64), [len(x) for x in steps])
        order = pair_order(u, w)
        u, w, at, train, block = (x[order] for x in (u, w, at, train, block))
        heads = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])))
        sizes = np.diff(np.append(heads, len(u)))
        total = np.add.reduceat(train, heads)
        many = total > 1
        count, place = np.repeat(total, sizes), np.repeat(np.where(many, np.cumsum(many) - 1, -1), sizes)
        kept = np.flatnonzero((count > 1) | (count > train))
        kept = kept[np.lexsort((at[kept], block[kept]))]
        starts = np.flatnonzero(np.diff(block[kept], prepend=-1))
        parts = [kept[a:b] for a, b in zip(starts, np.append(starts[1:], len(kept)))]
        n, m = len(parts), int(many.sum())
        return pa.table({
            "range": pa.array(np.full(n + m, rows[0]["range"], np.int64)), "block": pa.array([*block[kept[starts]].tolist(), *[None] * m], pa.int64()),
            "steps": pa.array([*[packed(np.diff(at[x], prepend=0)) for x in parts], *[None] * m], pa.binary()),
            "places": pa.array([*[packed(place[x]) for x in parts], *[None] * m], pa.binary()),
            **{c: pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(x[heads][many])]) for c, x in (("u", u), ("w", w), ("count", count))},
        })

    import pyarrow as pa

    kinds = pa.schema([("range", pa.int64()), ("block", pa.int64()), *[(c, pa.binary()) for c in ("steps", "train", "u", "w")]])
    sent = texts.select("block", "kinds", "trained", *PACKED).mapInArrow(send, "range long, block long, steps binary, train binary, u binary, w binary")
    return sent.groupBy("range").applyInArrow(merge, "range long, block long, steps binary, places binary, u long, w long, count long")


def seats_of_blocks(met: DataFrame, seats: DataFrame, judged: list[int]) -> DataFrame:
    """(block, steps, n, t<s>): the training tokens and tables of the pairs of ``met``, packed."""

    def run(left, right):
        import pyarrow as pa

        order = pair_order(right.column("u").to_numpy(), right.column("w").to_numpy())
        values = [np.append(right.column(c).to_numpy()[order], 1) for c in ("count", *[f"o{s}" for s in judged])]  # a pair with one token has one table
        places = [unpacked(x) for x in left.column("places").to_pylist()]
        made = [pa.array([packed(v[x]) for x in places], pa.binary()) for v in values]
        return pa.Table.from_arrays([left.column("block"), left.column("steps"), *made], ["block", "steps", "n", *[f"t{s}" for s in judged]])

    schema = "block long, steps binary, n binary, " + ", ".join(f"t{s} binary" for s in judged)
    of_range = seats.withColumnRenamed("range", "of_range")
    return met.groupBy("range").cogroup(of_range.groupBy("of_range")).applyInArrow(run, schema)


def packed(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype("<i4").tobytes(), 1)


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), "<i4").astype(np.int64)


def pair_order(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the pairs in an order that depends on the pairs only; equal ones stand together."""
    key = pair_hash(u, w)
    order = np.argsort(key, kind="stable")
    key, a, b = key[order], u[order], w[order]
    if ((key[1:] == key[:-1]) & ((a[1:] != a[:-1]) | (b[1:] != b[:-1]))).any():
        return np.lexsort((w, u, pair_hash(u, w)))
    return order


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (u.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (w.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x2545F4914F6CDD1D)


@dataclass
class Spelling:
    """Probability of each byte after each class of context, and the tables of the word level.

    Only contexts with customers have a row; others share the row of the longest shorter one.
    """

    row_of: np.ndarray  # row of each context
    logp: np.ndarray  # rows x symbols, natural logarithm
    tables: int  # of all words
    discount: float
    customers: int

    def of(self, words: list[bytes]) -> np.ndarray:
        """Logarithm of each word's spelling probability, its end included."""
        if not words:
            return np.zeros(0)
        cells, starts = byte_cells(words)
        found = self.logp[self.row_of[cells // SYMBOLS], cells % SYMBOLS]
        return np.add.reduceat(found, starts, dtype=np.float64)


def received(sent) -> Spelling | None:
    """The model of a broadcast, which holds plain fields: executors have no class to read it by."""
    return sent and Spelling(**sent.value)


def compact(state: list, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``row_of`` and ``logp`` of the probabilities of all lengths, for the cells of the longest."""
    total = sum(CONTEXT_BITS)
    row_of, rows, n = np.zeros(1, np.int32), [state[0]], 1
    for length in range(1, len(CONTEXT_BITS) + 1):
        bits = sum(CONTEXT_BITS[:length])
        row_of = np.repeat(row_of, 1 << CONTEXT_BITS[length - 1])
        used = np.unique((cells // SYMBOLS) >> (total - bits))
        row_of[used] = n + np.arange(len(used), dtype=np.int32)
        rows.append(state[length][used])
        n += len(used)
    return row_of, np.log(np.concatenate(rows))


def byte_cells(words: list[bytes]):
    """context class * SYMBOLS + symbol for each byte and end, and the start of each word."""
    size = np.array([len(w) + 1 for w in words])
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    raw = np.frombuffer(b"\x00".join([*words, b""]), np.uint8).astype(np.int64)
    place = np.arange(len(raw)) - np.repeat(starts, size)
    symbol = raw.copy()
    symbol[starts + size - 1] = SYMBOLS - 1
    context = np.zeros(len(raw), np.int64)
    for back, bits in enumerate(CONTEXT_BITS, 1):
        # before the start of a word stands the zero byte
        before = np.where(place >= back, np.roll(raw, back), 0)
        context = context << bits | before & ((1 << bits) - 1)
    return context * SYMBOLS + symbol, starts


def discount_of(once: int, twice: int) -> float:
    return float(min(0.95, max(0.05, once / (once + 2 * twice)))) if once else 0.5


def uniforms(seed: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on seed and step only."""
    x = seed + np.uint64((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def seat(customers: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, seed: np.ndarray, strength: float = STRENGTH) -> np.ndarray:
    """Tables of each dish after its customers sat down one after another.

    With n customers at t tables the next opens a table with weight (strength + discount *
    (others + t)) * base against n - discount * t, where others are the tables of other dishes.
    """
    tables = np.minimum(customers, 1)
    at = np.flatnonzero(customers > 1)
    for n in range(1, ONE_BY_ONE):
        at = at[customers[at] > n]
        if not len(at):
            return tables
        t = tables[at]
        new = (strength + discount * (others[at] + t)) * base[at]
        tables[at] += uniforms(seed[at], n) * (new + n - discount * t) < new
    at, n, step = at[customers[at] > ONE_BY_ONE], np.full(len(customers), float(ONE_BY_ONE)), ONE_BY_ONE
    while len(at):
        t = tables[at]
        new = (strength + discount * (others[at] + t)) * base[at]
        # nobody opens a table from n to n + m with chance ((n - dt) / (n + m - dt)) ** new
        seated = n[at] - discount * t
        jump = seated * np.expm1(np.minimum(-np.log(uniforms(seed[at], step)) / np.maximum(new, 1e-300), 600.0))
        n[at] += np.floor(jump) + 1
        at = at[n[at] <= customers[at]]
        tables[at] += 1
        step += 1
    return tables


def seat_bytes(cells: np.ndarray, customers: np.ndarray, before: list | None, sweep: int):
    """Re-seat the byte restaurants from the longest context down.

    ``before`` is the state of the sweep before: for each length of context the probabilities
    (contexts x symbols). Returns the new state.
    """
    lengths = len(CONTEXT_BITS)
    levels = []
    for length in range(lengths, -1, -1):
        contexts = 1 << sum(CONTEXT_BITS[:length])
        context, symbol = cells // SYMBOLS, cells % SYMBOLS
        discount = discount_of(int((customers == 1).sum()), int((customers == 2).sum()))
        drop = CONTEXT_BITS[length - 1] if length else 0
        if before is None:
            tables = np.minimum(customers, 1)
        else:
            parent = before[length - 1][context >> drop, symbol] if length else np.full(len(cells), 1 / SYMBOLS)
            tables = before[lengths + 1 + length].get_many(cells)
            others = np.bincount(context, tables, minlength=contexts)[context] - tables
            seed = cells.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(sweep << 8 | length)
            tables = seat(customers, others, parent, discount, seed)
        levels.append((contexts, context, symbol, customers, tables, discount, cells))
        if length:
            cells, place = np.unique((context >> drop) * SYMBOLS + symbol, return_inverse=True)
            customers = np.bincount(place, tables, minlength=len(cells)).astype(np.int64)
    levels.reverse()
    state, seats, parent = [], [], np.full((1, SYMBOLS), 1 / SYMBOLS, np.float32)
    for length, (contexts, context, symbol, customers, tables, discount, cells) in enumerate(levels):
        c = np.bincount(context, customers, minlength=contexts)
        t = np.bincount(context, tables, minlength=contexts)
        p = np.repeat(parent, contexts // len(parent), axis=0)
        p *= ((STRENGTH + discount * t) / (STRENGTH + c)).astype(np.float32)[:, None]
        p[context, symbol] += ((customers - discount * tables) / (STRENGTH + c[context])).astype(np.float32)
        state.append(p)
        seats.append(Seats(cells, tables))
        parent = p
    return state + seats


@dataclass
class Seats:
    cells: np.ndarray
    tables: np.ndarray

    def get_many(self, wanted: np.ndarray) -> np.ndarray:
        """Tables of cells, 1 for a cell not seen before."""
        if not len(self.cells):
            return np.ones(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(self.cells, wanted), len(self.cells) - 1)
        return np.where(self.cells[at] == wanted, self.tables[at], 1)


def seat_words(words: list[bytes], counts: np.ndarray, model: Spelling | None, sweep: int) -> np.ndarray:
    """Tables of the words in a sweep, given the model of the sweep before; one each in the first.

    The tables of other words are those of all words then; a single word's own few among the
    tables of the whole vocabulary are not taken off.
    """
    import xxhash

    tables = np.minimum(counts, 1)
    many = np.flatnonzero(counts > 1)
    if model is not None and len(many):
        chosen = [words[i] for i in many.tolist()]
        seed = np.fromiter(map(xxhash.xxh3_64_intdigest, chosen), np.uint64, len(chosen)) + np.uint64(sweep)
        spelt = np.exp(np.maximum(model.of(chosen), -700.0))
        tables[many] = seat(counts[many], np.full(len(many), model.tables), spelt, model.discount, seed)
    return tables


def gathered(batches):
    """Arrow batches joined to about ``GATHERED`` rows: seating takes many steps, each over all
    rows at hand."""
    import pyarrow as pa

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= GATHERED:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def fit(words: DataFrame, sweeps: int = SWEEPS) -> list:
    """Gibbs sweeps over the (word, count) table; returns a broadcast model for each."""
    state, sent = None, []
    for sweep in range(sweeps):
        state, model = sweep_words(words, sent[-1] if sent else None, state, sweep)
        sent.append(model)
    return sent


def sweep_words(words: DataFrame, last, state: list | None, sweep: int) -> tuple:
    """One sweep over the customers of the word restaurant, (word, count), and over the byte
    restaurants; ``last`` and ``state`` are of the sweep before. Returns state and broadcast model."""
    counted = words.where("count > 0")
    sums = counted.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("all"), F.count_if(F.col("count") == 1).alias("once"), F.count_if(F.col("count") == 2).alias("twice")
    ).first()
    discount = discount_of(sums["once"], sums["twice"])

    def run(batches):
        import pyarrow as pa

        total, every = np.zeros(0, np.int64), 0
        for batch in gathered(batches):
            names, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            tables = seat_words(names, n, received(last), sweep)
            cells, starts = byte_cells(names)
            sizes = np.diff(np.append(starts, len(cells)))
            if not len(total):
                total = np.zeros((1 << sum(CONTEXT_BITS)) * SYMBOLS, np.int64)
            at, place = np.unique(cells, return_inverse=True)
            total[at] += np.bincount(place, np.repeat(tables, sizes), minlength=len(at)).astype(np.int64)
            every += int(tables.sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], every))], names=["cell", "n"])

    summed = counted.select("word", "count").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    got = summed.toArrow()  # at most contexts x symbols rows
    cell, n = got.column("cell").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(cell)
    cell, n = cell[order], n[order]
    tables = int(n[cell < 0].sum())
    state = seat_bytes(cell[cell >= 0], n[cell >= 0], state, sweep)
    model = Spelling(*compact(state, cell[cell >= 0]), tables, discount, int(sums["all"]))
    return state, words.sparkSession.sparkContext.broadcast(vars(model))


def known_mass(words: DataFrame, models: list) -> list[float]:
    """For each model the share of all spellings that belongs to words with training tokens."""

    def run(batches):
        import pyarrow as pa

        total, known = np.zeros(len(models)), [received(m) for m in models]
        for batch in gathered(batches):
            names = batch.column(0).to_pylist()
            total += [np.exp(m.of(names)).sum() for m in known]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(models))), pa.array(total)], names=["model", "mass"])

    summed = words.where("count > 0").select("word").mapInArrow(run, "model long, mass double").groupBy("model").agg(F.sum("mass").alias("mass"))
    found = {row["model"]: row["mass"] for row in summed.collect()}  # one row for each sweep
    return [min(found.get(i, 0.0), 1 - 1e-9) for i in range(len(models))]


def strength_of(contexts: DataFrame, seats: DataFrame, discount: float) -> float:
    """The strength in ``STRENGTHS`` under which training tokens are likeliest when each in turn is
    left out.

    ``contexts`` has (count, tables, once): the tokens after a word, their tables, and the tokens
    that are the only one of their pair. What is left of such a token is its probability without
    context, which is the same under any strength. ``seats`` has the other pairs (count, tables,
    others: the tables of their context, base).
    """
    grid = np.array(STRENGTHS)

    def summed(value, tables: DataFrame):
        def run(batches):
            import pyarrow as pa

            total = np.zeros(len(grid))
            for table in gathered(batches):
                columns = [c.to_numpy().astype(float) for c in table.columns]
                total += [value(a, *columns).sum() for a in grid]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(grid))), pa.array(total)], names=["at", "total"])

        return tables.mapInArrow(run, "at long, total double")

    def of_contexts(a, count, tables, once):
        return once * np.log(a + discount * np.maximum(tables - 1, 0)) - count * np.log(a + count - 1)

    def of_pairs(a, count, tables, others, base):
        gone = tables == count  # a token left out takes its table with it
        return count * np.log(count - 1 - discount * (tables - gone) + (a + discount * (others - gone)) * np.exp(base))

    both = summed(of_contexts, contexts.where("count > 0")).union(summed(of_pairs, seats.select("count", "tables", "others", "base")))
    total = np.zeros(len(grid))
    for row in both.groupBy("at").agg(F.sum("total").alias("total")).collect():  # a row for each strength
        total[row["at"]] = row["total"]
    return float(grid[total.argmax()])


def after(n, tables, customers, opened, plain, discount: float, strength: float):
    """Probability of a word after another: ``n`` customers at ``tables`` of a context that has
    ``customers`` at ``opened``, and its probability without context."""
    return (n - discount * tables + (strength + discount * opened) * plain) / (strength + customers)


def log_words(names: list[bytes], n: np.ndarray, model: Spelling, last: Spelling | None, covered: float, sweep: int) -> np.ndarray:
    """Natural logarithm of each word's probability in the word restaurant after a sweep."""
    tables = seat_words(names, n, last, sweep)
    spelt = np.exp(np.maximum(model.of(names), -700.0))
    base = (STRENGTH + model.discount * model.tables) * np.where(n > 0, spelt, 1 - covered)
    return np.log((n - model.discount * tables + base) / (STRENGTH + model.customers))


def probabilities(words: DataFrame, models: list) -> DataFrame:
    """Add ``logp``: log10 of each word's probability, averaged over the sweeps after the first;
    for a word without training tokens that of any new word."""
    mass = known_mass(words, models)

    def run(batches):
        import pyarrow as pa

        known = [received(m) for m in models]
        first = min(1, len(known) - 1)
        for batch in gathered(batches):
            names, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            logs = []
            for sweep in range(first, len(known)):
                logs.append(log_words(names, n, known[sweep], known[sweep - 1] if sweep else None, mass[sweep], sweep))
            mean = np.logaddexp.reduce(np.array(logs), 0) - np.log(len(logs))
            yield from pa.table({"word": batch["word"], "count": batch["count"], "logp": mean / np.log(10)}).to_batches()

    return words.select("word", "count").mapInArrow(run, "word binary, count long, logp double")


def learn(words: DataFrame, pairs: DataFrame, sweeps: int = SWEEPS) -> tuple[DataFrame, DataFrame, float, dict[int, float]]:
    """Gibbs sweeps over words and contexts.

    ``words`` has (word, id, count) and ``pairs`` (u, w, count) of the pairs with more than one
    training token. For each sweep s that counts, all after the first, words get ``p<s>``, the
    logarithm of their probability without context, and ``o<s>``, the tables of the restaurant
    that follows them, and pairs get ``o<s>``, their tables. Also returns the discount of the
    contexts and their strength in each sweep that counts, chosen after the sweep before.
    """
    sums = pairs.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("all"), F.count_if(F.col("count") == 2).alias("twice")).first()
    every = words.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()["n"]
    discount = discount_of(int(every) - int(sums["all"]), int(sums["twice"]))
    judged = list(range(min(1, sweeps - 1), sweeps))
    seats, last, state, strengths = pairs.withColumn("tables", F.lit(1).cast("long")), None, None, [STRENGTH]
    for sweep in range(sweeps):
        # customers without a table of their own, of each word and of each context
        n = F.col("count") - F.col("tables")
        sides = F.array(F.struct(F.col("w").alias("id"), n.alias("less"), F.lit(0).cast("long").alias("fewer"), F.lit(0).cast("long").alias("many")),
                        F.struct(F.col("u").alias("id"), F.lit(0).cast("long").alias("less"), n.alias("fewer"), F.col("count").alias("many")))
        spared = seats.select(F.inline(sides)).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("less", "fewer", "many")])
        kept = [c for c in words.columns if c[0] in "po" and int(c[1:]) in judged]
        now = durable(words.join(spared, "id", "left").select(
            "word", "id", "count", *kept, (F.col("count") - F.coalesce("less", F.lit(0))).alias("customers"),
            (F.col("count") - F.coalesce("fewer", F.lit(0))).alias(f"o{sweep}"),
            (F.col("count") - F.coalesce("many", F.lit(0))).alias("once"),
        ))
        customers = now.select("word", F.col("customers").alias("count"))
        state, model = sweep_words(customers, last, state, sweep)
        covered = known_mass(customers, [model])[0]

        def price(batches, model=model, last=last, covered=covered, sweep=sweep):
            import pyarrow as pa

            for table in gathered(batches):
                names, n = table["word"].to_pylist(), table["customers"].to_numpy()
                logp = log_words(names, n, received(model), received(last), covered, sweep)
                yield from table.drop_columns(["customers", "once"]).append_column(f"p{sweep}", pa.array(logp)).to_batches()

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in now.schema if f.name not in ("customers", "once"))
        dead = [now, words] if sweep else [now]  # the first words are the caller's
        words = durable(now.mapInArrow(price, f"{kinds}, p{sweep} double"))
        last = model
        if sweep + 1 < sweeps:
            prior = words.select(F.col("id").alias("w"), F.col(f"p{sweep}").alias("base"))
            context = words.select(F.col("id").alias("u"), F.col(f"o{sweep}").alias("others"))

            done = [c for c in seats.columns if c != "tables"]
            joined = durable(seats.join(prior, "w").join(context, "u").select(*done, "tables", "others", "base"))
            strengths.append(strength_of(now.select("count", f"o{sweep}", "once"), joined, discount))

            def reseat(batches, sweep=sweep + 1, strength=strengths[-1]):
                import pyarrow as pa

                for table in gathered(batches):
                    u, w, n, others, tables = (table[c].to_numpy() for c in ("u", "w", "count", "others", "tables"))
                    seed = u.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ w.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                    found = seat(n, others - tables, np.exp(table["base"].to_numpy()), discount, seed + np.uint64(sweep), strength)
                    held = table.drop_columns(["others", "base", "tables"]).append_column("tables", pa.array(found.astype(np.int64)))
                    if sweep in judged:
                        held = held.append_column(f"o{sweep}", pa.array(found.astype(np.int64)))
                    yield from held.to_batches()

            made = ["tables", *[f"o{s}" for s in judged if s == sweep + 1]]
            dead += [joined, seats] if sweep else [joined]
            seats = durable(joined.mapInArrow(reseat, ", ".join(f"{c} long" for c in [*done, *made])))
        release(*dead)
    for s in judged:
        if f"o{s}" not in seats.columns:  # the first sweep is the only one
            seats = seats.withColumn(f"o{s}", F.col("tables"))
    return words, seats.drop("tables"), discount, {s: strengths[s] for s in judged}


def score(docs: DataFrame, train: Column, text: str = "text", key: str = "doc_id", block_chars: int = BLOCK_CHARS, sweeps: int = SWEEPS) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score) for each text, learning
    from the rows where ``train`` holds. Scores are log10 probabilities; perplexity is
    10 ** (-score / n_tokens)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    cut = durable(blocks(rows, F.col("train"), block_chars))
    entries = cut.where("word IS NOT NULL").select("block", "word", "at", "train")
    texts = cut.where("word IS NULL").select(F.col("block"), "keys", "sizes", "kinds", "trained", *PACKED)
    words = durable(entries.groupBy("word").agg(F.sum("train").alias("count")).withColumn("id", F.xxhash64("word")))
    sums = words.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count_if(F.col("count") > 0).alias("v")).first()
    total, kinds = int(sums["n"]), int(sums["v"])

    # a block knows of itself the pairs that it has the only token of
    met = durable(met_pairs(texts))
    words, seats, discount, strengths = learn(words, met.where("block IS NULL").select("u", "w", "count", "range"), sweeps)
    judged = list(strengths)
    priced = entries.select("block", "word", "at").join(words, "word").select(
        "block", "at", "count", *[f"o{s}" for s in judged], *[f"p{s}" for s in judged]
    )
    of_blocks = met.where("block IS NOT NULL").select("range", "block", "steps", "places")
    priced = priced.unionByName(durable(seats_of_blocks(of_blocks, seats, judged)), allowMissingColumns=True)
    texts = texts.withColumnRenamed("block", "of_block")
    key_kind = rows.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_key = to_arrow_type(key_kind)

    def sums_of(left, right):
        import pyarrow as pa
        import pyarrow.compute

        is_pair = right.column("steps").is_valid()
        of_pairs, of_words = right.filter(is_pair).to_pylist(), right.filter(pa.compute.invert(is_pair))
        at = of_words.column("at").to_numpy()
        count = np.zeros(len(at), np.int64)
        count[at] = of_words.column("count").to_numpy()
        base = np.log10((count + 0.5) / (total + 0.5 * (kinds + 1)))
        out = []
        for row in left.to_pylist():  # one row
            held = Unpacked(row)
            n = held.trained.copy()
            places = [np.cumsum(unpacked(x["steps"])) for x in of_pairs]
            for place, x in zip(places, of_pairs):
                n[place] = unpacked(x["n"])
            mean = np.zeros(len(n))
            for s in judged:
                tables, opened, plain = np.minimum(n, 1), np.zeros(len(at), np.int64), np.zeros(len(at))
                for place, x in zip(places, of_pairs):
                    tables[place] = unpacked(x[f"t{s}"])
                opened[at], plain[at] = of_words.column(f"o{s}").to_numpy(), np.exp(of_words.column(f"p{s}").to_numpy())
                mean += after(n, tables, count[held.before], opened[held.before], plain[held.after], discount, strengths[s])
            logp = np.log10(mean / len(judged))
            ids, word, times, starts = held.ids, held.after[held.ids], held.times, held.starts
            out.append(pa.table({
                "doc_id": pa.array(row["keys"], arrow_key), "trained": pa.array(row["trained"], pa.bool_()),
                "n_tokens": pa.array(row["sizes"], pa.int64()),
                "n_known": np.add.reduceat(np.where(count[word] > 0, times, 0), starts),
                "train_tokens": np.full(len(starts), total),
                "base_score": np.add.reduceat(times * base[word], starts), "score": np.add.reduceat(times * logp[ids], starts),
            }))
        return pa.concat_tables(out)

    schema = (
        f"doc_id {key_kind.simpleString()}, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return texts.groupBy("of_block").cogroup(priced.groupBy("block")).applyInArrow(sums_of, schema)
