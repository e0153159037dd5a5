"""Best-fit packing of documents into sequences of a fixed size by pattern packing.

Tasks tokenise whole texts and write one narrow row for each piece. Only the histogram of piece
lengths (at most ``size`` numbers) decides the packing: patterns of up to three length bins that
fill a sequence are enumerated, their repeat counts are fitted to the histogram by non-negative
least squares and rounded, and what they leave over is packed best-fit into the gaps and into
new sequences. This is planned for each of ``SHARES`` of the fitted counts, the last of which uses
no pattern; the plan with the fewest sequences is taken. The resulting plan says which running number of which length goes where; tasks
look their pieces up in it, so no piece passes through the driver.

Defined results: null and empty texts are one end token. A text longer than ``size`` tokens is
cut into full pieces and a shorter last one. Repeated rows are packed separately; an empty
table gives no piece. Which of several pieces of one length goes where is any, but whole.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from titlelab.session import durable

SIZE = 4096
END = 1
#: Length bins that a sequence is divided into for the patterns.
BINS = 64
#: Shares of the patterns' repeat counts that are planned; 0 is best fit alone, so none is worse than it.
SHARES = tuple(n / 10 for n in range(10, -1, -1))
#: Distinct words whose ids a task remembers at a time.
REMEMBERED = 700_000

PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, k long"


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def tokenise(docs: DataFrame, text: str, key: str, path: str, size: int) -> DataFrame:
    """Pieces with a running number ``k`` of their length within the task's ``part``."""
    kind = docs.schema[key].dataType

    def run(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = Encoder(path).texts
        part, seen = TaskContext.get().partitionId(), Counter()
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            keys, rows, n = batch.column(0), [], 0
            out = [[] for _ in range(7)]
            source = []
            for i, ids in enumerate(encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                total = len(ids) // 4
                for piece, start in enumerate(range(0, total, size)):
                    length = min(size, total - start)
                    k = seen[length]
                    seen[length] = k + 1
                    source.append(i)
                    for c, v in zip(out, (piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, k)):
                        c.append(v)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = [keys.take(pa.array(source, pa.int64()))] + [pa.array(c, t) for c, t in zip(out, types)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = PIECES.format(kind=kind.simpleString())
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _latin(text: str) -> bool:
    """Whether all characters are in Latin-1, where lower-casing is one to one and nothing composes."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: Latin-1 characters as a stop or comma, white space, letter or digit, or another mark. The four
#: separators from 0x1C are marks to the vocabulary's pattern, though Python calls them white space.
_KINDS = bytes(
    ord("," if c in ".," else " " if c.isspace() and not "\x1c" <= c <= "\x1f" else "a" if c.isalnum() else "!")
    for c in map(chr, range(256))
)


class Encoder:
    """Texts to little-endian ids.

    The vocabulary never joins across blanks and line ends, so words between them are encoded
    once and remembered. New words of Latin-1 characters are cut by the vocabulary's own pattern
    first; the distinct pieces are encoded many to a call. Other words are encoded one by one. Texts
    that hold a special token of the vocabulary, such as ``<|endoftext|>``, are encoded whole.
    """

    #: The vocabulary's pattern after lower-casing (a fixed value).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    JOINED = 64

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile(self.PATTERN).findall
        self.whole: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def texts(self, texts: list[str]):
        """The ids of each text."""
        for first in range(0, len(texts), 512):
            group = texts[first : first + 512]
            marked = [any(x in t for x in self.special) for t in group]
            words = [[] if m else self._spread(t).replace("\n", " ").split(" ") for t, m in zip(group, marked)]
            self.learn(set().union(*words).difference(self.whole))
            for text, m, row in zip(group, marked, words):
                yield self._each([text])[0] if m else b"".join(map(self.whole.__getitem__, row))
            if len(self.whole) > REMEMBERED:
                self.whole.clear()
                self.pieces.clear()

    def learn(self, words: set[str]) -> None:
        plain = list(filter(_latin, words))
        rare = list(words.difference(plain)) if len(plain) < len(words) else []
        self.whole.update(zip(rare, self._each(rare)))
        cut = [[w] if w.isalpha() else self.cut(w) for w in map(str.lower, plain)]
        self._learn_pieces(list(set().union(*cut).difference(self.pieces)))
        known = self.pieces
        for word, pieces in zip(plain, cut):
            self.whole[word] = known[pieces[0]] if len(pieces) == 1 else b"".join([known[p] for p in pieces])

    @staticmethod
    def _spread(text: str) -> str:
        """The same pre-tokens in a form that has fewer distinct words: lower case, and stops and
        commas apart from their words, unless they stand in a run of marks."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        text, kinds = text.lower(), raw.translate(_KINDS)
        if b",," in kinds or b",!" in kinds or b"!," in kinds:
            return text
        return text.replace(",", " , ").replace(".", " . ")

    def _each(self, words: list[str]):
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn_pieces(self, pieces: list[str]) -> None:
        groups = [pieces[i : i + self.JOINED] for i in range(0, len(pieces), self.JOINED)]
        for group, found in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            cuts = np.flatnonzero(np.diff(np.array(found.word_ids))) + 1
            if len(cuts) + 1 != len(group):  # a piece that the vocabulary cuts further
                self.pieces.update(zip(group, self._each(group)))
                continue
            raw, ends = np.array(found.ids, "<u4").tobytes(), [0, *(4 * cuts).tolist(), 4 * len(found.ids)]
            self.pieces.update(zip(group, [raw[x:y] for x, y in zip(ends, ends[1:])]))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative least squares by an active set of columns."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = 1e-8 * max(1.0, float(np.abs(a.T @ b).max()))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= slack:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if len(s) == 0 or s.min() > 1e-12:
                x[:] = 0
                x[at] = s
                break
            low = s <= 1e-12
            old = x[at]
            step = np.min(old[low] / np.maximum(old[low] - s[low], 1e-300))
            x[at] = np.maximum(old + step * (s - old), 0)
            drop = at[(x[at] <= 1e-12) & low]
            active[drop if len(drop) else at[low]] = False
            x[~active] = 0
    return x


def patterns(bins: int) -> np.ndarray:
    """All multisets of one to three bins that add up to ``bins``."""
    found = [(bins, 0, 0)]
    for a in range(1, bins):
        for b in range(1, a + 1):
            c = bins - a - b
            if 0 <= c <= b:
                found.append((a, b, c))
    return np.array(found)


def plan(counts: np.ndarray, size: int) -> np.ndarray:
    """Rows (length, first number, pieces, first sequence, offset) that place ``counts[length]`` pieces,
    in as few sequences as any of ``SHARES`` needs.

    A row places one length into one run of sequences with equal gaps, so the number of rows follows
    from the distinct lengths and gaps, at most ``size`` each, and not from the pieces.
    """
    times = fit(counts, size)
    return min((place_all(counts, size, times, share) for share in SHARES), key=n_sequences)


def n_sequences(rows: np.ndarray) -> int:
    return int((rows[:, 3] + rows[:, 2]).max()) if len(rows) else 0


def fit(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], float]]:
    """Patterns, as tuples of bins, with their fitted repeat counts, the greatest first."""
    width = max(1, size // BINS)
    bins = size // width
    if size % width or bins <= 2 or not counts.sum():
        return []
    by_bin = np.zeros(bins + 1)
    np.add.at(by_bin, -(-np.arange(size + 1) // width), counts)
    by_bin[0] = 0
    kinds = patterns(bins)
    kinds = kinds[((by_bin[kinds] > 0) | (kinds == 0)).all(1)]
    if not len(kinds):
        return []
    a = np.zeros((bins + 1, len(kinds)))
    for j in range(3):
        np.add.at(a, (kinds[:, j], np.arange(len(kinds))), 1)
    a[0] = 0
    x = nnls(a, by_bin)
    return [(tuple(b for b in kinds[p].tolist() if b), float(x[p])) for p in np.argsort(-x, kind="stable") if x[p] > 0]


def place_all(counts: np.ndarray, size: int, fitted: list, share: float) -> np.ndarray:
    """The plan that repeats each pattern ``share`` of its fitted count, the rest best-fit."""
    width = max(1, size // BINS)
    left, used = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64)
    rows, gaps, sequences = [], {}, 0  # gaps: free space -> [(first sequence, sequences)]

    def place(length, n, first, offset):
        rows.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    by_bin = np.zeros(size // width + 2, np.int64)
    np.add.at(by_bin, -(-np.arange(len(left)) // width), left)
    for kind, repeats in fitted:
        wanted = Counter(kind)
        times = min([int(share * repeats + 0.5), *(int(by_bin[b] // m) for b, m in wanted.items())])
        if times <= 0:
            continue
        runs = []
        for b, m in wanted.items():
            by_bin[b] -= m * times
            longest = _runs(left, b * width, max(1, (b - 1) * width + 1), m * times)
            runs += [_cut(longest, j * times, times, j % 2) for j in range(m)]
        # the last and shortest piece is left to best fit, which finds the one that fills the gap
        for n, lengths in _segments(runs[:-1] or runs):
            offset = 0
            for length in lengths:
                place(length, n, sequences, offset)
                offset += length
            if offset < size:
                gaps.setdefault(size - offset, []).append((sequences, n))
            sequences += n
    spaces = sorted(gaps)
    for length in range(size, 0, -1):
        while left[length]:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                fresh = int(-(-left[length] // (size // length)))
                gaps[size] = [(sequences, fresh)]
                sequences += fresh
                insort(spaces, size)
                continue
            space = spaces[at]
            first, n = gaps[space].pop()
            take = int(min(n, left[length]))
            if take < n:
                gaps[space].append((first + take, n - take))
            elif not gaps[space]:
                del gaps[space], spaces[at]
            place(length, take, first, size - space)
            rest = space - length
            if rest:
                if rest not in gaps:
                    insort(spaces, rest)
                gaps.setdefault(rest, []).append((first, take))
    return np.array(rows, np.int64).reshape(-1, 5)


def _runs(left, high, low, n):
    """(length, pieces) of the longest ``n`` pieces between two lengths."""
    out = []
    for length in range(high, low - 1, -1):
        take = int(min(n, left[length]))
        if take:
            out.append((length, take))
            n -= take
    return out


def _cut(runs, skip, n, turned):
    """Pieces number ``skip`` to ``skip + n`` of the runs, in the order given or turned round."""
    out = []
    for length, count in runs:
        gone = min(skip, count)
        skip, count = skip - gone, count - gone
        take = min(n, count)
        if take:
            out.append((length, take))
            n -= take
    return out[::-1] if turned else out


def _segments(runs):
    """Stretches over which every slot has one length: (sequences, lengths)."""
    runs = [list(r) for r in runs]
    while runs[0]:
        n = min(r[0][1] for r in runs)
        yield n, [r[0][0] for r in runs]
        for r in runs:
            length, count = r[0]
            r[0] = (length, count - n)
            if count == n:
                del r[0]


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece."""
    pieces = durable(tokenise(docs, text, key, path or vocabulary(), size))
    parts = durable(pieces.groupBy("length", "part").count())
    counts = np.zeros(size + 1, np.int64)
    for row in parts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most ``size`` rows
        counts[row["length"]] = row["n"]
    rows = plan(counts, size)
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = parts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(base, ["length", "part"]).withColumn("number", F.col("base") + F.col("k"))
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    shared = docs.sparkSession.sparkContext.broadcast(rows)  # grows with distinct lengths, not with pieces

    def run(batches):
        import pyarrow as pa

        rows = shared.value
        far = int(rows[:, 1].max()) + 1 if len(rows) else 1  # above every first number
        places = rows[:, 0] * far + rows[:, 1]
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            at = np.searchsorted(places, length * far + np.minimum(number, far - 1), "right") - 1
            sequence = rows[at, 3] + number - rows[at, 1]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(rows[at, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kept = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
