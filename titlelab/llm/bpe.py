"""Byte-level BPE through a sentencepiece model that is serialised from a rank file.

Every byte maps to one printable character, every token of the rank file becomes a piece whose
score is its negative rank, and normalisation is the identity, so the piece with the lowest rank
merges first, as in the rank file's own encoder. Matches of the split pattern are encoded one by
one and remembered; decoding maps ids back to their bytes.

Defined results: null text counts as empty: no ids, the digest of the empty string. Repeated
rows give repeated results; an input column with an output's name is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import public_tokenizers
from pyspark.sql import DataFrame

from titlelab.llm.common import map_columns, slices

#: Distinct stretches of text whose ids a task remembers at a time.
REMEMBERED = 400_000
#: Cuts texts into stretches; a text that holds it is cut by the pattern alone.
CUT = "\x00"


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if it is one, else the next code point from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float | str) -> bytes:
    """One field of a serialised message: a length-delimited, float or integer value."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece 0 is the unknown one, piece r + 1 is the token of rank r."""
    shown = byte_characters()
    unknown = _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)
    pieces = [unknown]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(_field(1, "".join(shown[b] for b in token)) + _field(2, -float(rank)) + _field(3, 1))
    # model type 2 is BPE; there are no begin, end and padding pieces (-1 as a 64-bit varint)
    none = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, none) + _field(42, none) + _field(43, none)
    identity = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, identity)


class Codec:
    """Ids of texts, and bytes of ids."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.rank_of = sorted(self.ranks.values())
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.shown = dict(enumerate(byte_characters()))
        self.split = regex.compile(pattern).findall
        self.lettered = pattern == public_tokenizers.PATTERN
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, list[int]] = {}  # of a match of the pattern
        self.listed: dict[str, str] = {}  # ids as decimal text, of a stretch
        self.raw: dict[str, bytes] = {}  # decoded bytes, of a stretch

    def learn(self, words: set[str]) -> None:
        """Encode matches of the pattern that are not known yet."""
        model = []
        for word in words.difference(self.ids):
            raw = word.encode("utf-8", "replace")
            whole = self.ranks.get(raw)
            if whole is None:
                model.append((word, raw.decode("latin-1").translate(self.shown)))
            else:
                self.ids[word] = [whole]
        for (word, _), got in zip(model, self.model.encode([m[1] for m in model], num_threads=1)):
            self.ids[word] = [self.rank_of[i - 1] for i in got]

    def encode(self, texts: list[str]) -> list[list[int]]:
        words = [self.split(t) for t in texts]
        self.learn(set().union(*words))
        found = [[i for w in row for i in self.ids[w]] for row in words]
        if len(self.ids) > REMEMBERED:
            self.forget()
        return found

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def summaries(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        """Number of ids, the ids as decimal text, and the decoded bytes, of each text."""
        rows = [self.stretches(t) for t in texts]
        fresh = list(set().union(*rows).difference(self.listed))
        # a blank (or none) and letters are one match, whatever the rest of the pattern
        spelled = [[s] if self.lettered and s.lstrip(" ").isalpha() and s[:2] != "  " else self.split(s) for s in fresh]
        self.learn(set().union(*spelled))
        for stretch, words in zip(fresh, spelled):
            ids = [i for w in words for i in self.ids[w]]
            self.listed[stretch] = " ".join(map(str, ids))
            self.raw[stretch] = self.decode(ids)
        found = []
        for row in rows:
            listed = " ".join(map(self.listed.__getitem__, row))
            found.append((listed.count(" ") + 1 if listed else 0, listed, b"".join(map(self.raw.__getitem__, row))))
        if len(self.listed) > REMEMBERED:
            self.forget()
        return found

    def stretches(self, text: str) -> list[str]:
        """The text cut where matches of the pattern end. If all its white space is single blanks
        and line ends, each of them starts a stretch; otherwise the matches are the stretches."""
        if CUT in text or text.split() != text.replace("\n", " ").split(" "):
            return self.split(text)
        return text.replace(" ", CUT + " ").replace("\n", CUT + "\n").split(CUT)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None,
           keep: list[str] | None = None) -> DataFrame:
    """Add ``ids``."""
    path, pattern = path or vocabulary(), pattern or public_tokenizers.PATTERN

    def start():
        codec = Codec(path, pattern)
        return lambda column: [codec.encode([t or "" for t in column.to_pylist()])]

    return map_columns(docs, [text], "ids array<int>", start, keep)


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add ``decoded``, the bytes of the ids; null ids give null."""
    path = path or vocabulary()

    def start():
        bytes_of = {rank: token for token, rank in read_ranks(path).items()}
        return lambda column: [[None if x is None else b"".join(map(bytes_of.__getitem__, x)) for x in column.to_pylist()]]

    return map_columns(rows, [ids], "decoded binary", start, keep)


def round_trip(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None,
               keep: list[str] | None = None) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` without carrying the ids themselves."""
    path, pattern = path or vocabulary(), pattern or public_tokenizers.PATTERN

    def start():
        codec = Codec(path, pattern)

        def compute(column):
            texts = [t or "" for t in column.to_pylist()]
            counts, ids, decoded = [], [], []
            for part in slices(texts):
                for n, listed, raw in codec.summaries(texts[part]):
                    counts.append(n)
                    ids.append(hashlib.sha256(listed.encode()).hexdigest())
                    decoded.append(hashlib.sha256(raw).hexdigest())
            return [counts, ids, decoded]

        return compute

    return map_columns(docs, [text], "n_tokens long, ids_sha256 string, decoded_sha256 string", start, keep)
