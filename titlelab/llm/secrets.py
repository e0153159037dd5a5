"""Secret scan with linking of multipart credentials.

Tasks read whole texts once and note every part with its place: the base kinds (assigned
secrets, access identifiers, hex runs) and weak parts that mean little alone: bare identifiers
(``id``), bare high-variety strings (``key``) and endpoints (``host``). Weak parts are joined
with complementary parts of the same scope (a paragraph) by an interval join: a part's
neighbourhood of ``reach`` characters is met through bins of that width, and for each bin and
kind only the least and greatest place are kept, so a part meets three rows a kind however many
parts a scope holds. A weak key is reported only if an access identifier (or weak identifier
plus endpoint) is near; a weak identifier only if a reported key and an endpoint are near.

Defined results: null text counts as empty and has no span. Overlapping spans of different
kinds are all kept; a weak part that overlaps a base span is dropped. Repeated rows give
repeated results. An input column with an output's name is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelab.llm.common import map_columns
from titlelab.session import durable

# Fixed values of the scan.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "key", "id", "host")
LEAST = {"assign": 6, "access": 20, "hex": 24}

# Weak parts: a host or URL; a bare identifier such as "client_id=..."; a string of 32 to 64 mixed characters.
HOST = r"https?://[A-Za-z0-9.-]+\.[A-Za-z]{2,}[^\s\"'<>]*"
IDENT = r"""(?i:client_?id|user(?:name)?|account|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
LOOSE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{32,64}={0,2}(?![A-Za-z0-9+/=_-])"
REACH = 400
MASK = "[SECRET]"

PARTS = "array<struct<kind:string,start:int,end:int,scope:int>>"


def _scanner():
    assign, access = re.compile(ASSIGN, re.A), re.compile(ACCESS)
    runs = re.compile(f"{HEX[:-1]}{{{LEAST['hex']},}}")  # a run short of it fails as a whole
    host, ident, loose = re.compile(HOST, re.A), re.compile(IDENT, re.A), re.compile(LOOSE, re.A)

    def scan(text: str):
        base = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[1]) >= LEAST["assign"]]
        base += [("access", m.start(), m.end()) for m in access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
        base += [("hex", m.start(), m.end()) for m in runs.finditer(text)]
        weak = [("host", m.start(), m.end()) for m in host.finditer(text)]
        weak += [("id", m.start(), m.end()) for m in ident.finditer(text)]
        weak += [("key", m.start(), m.end()) for m in loose.finditer(text) if _varied(m[0])]
        base.sort(key=lambda s: (s[1], KINDS.index(s[0])))
        if weak and base:
            starts, reached = [b[1] for b in base], list(accumulate((b[2] for b in base), max))
            weak = [w for w in weak if w[0] == "host" or not _overlaps(w, starts, reached)]
        return base, weak

    return scan


def _varied(word: str) -> bool:
    """Upper case, lower case and digits together: no word of a language."""
    return any(c.isdigit() for c in word) and any(c.isupper() for c in word) and any(c.islower() for c in word)


def _overlaps(span, starts: list[int], reached: list[int]) -> bool:
    """Whether a base span that starts before the span's end reaches beyond its start."""
    before = bisect_left(starts, span[2])
    return before > 0 and reached[before - 1] > span[1]


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``base`` (the base spans in order) and ``parts`` (all parts with their scope).

    Scopes are numbered only in texts that have a weak part, as others have nothing to link.
    """

    def start():
        find = _scanner()

        def compute(column):
            bases, parts = [], []
            for text in column.to_pylist():
                base, weak = find(text or "")
                bases.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                found = []
                if weak:
                    breaks = [m.start() for m in re.finditer(r"\n\s*\n", text)]
                    found = [{"kind": k, "start": a, "end": b, "scope": bisect_right(breaks, a)} for k, a, b in base + weak]
                parts.append(found)
            return [bases, parts]

        return compute

    return map_columns(docs, [text], f"base array<struct<kind:string,start:int,end:int>>, parts {PARTS}", start, keep)


def near(parts: DataFrame, others: DataFrame, reach: int) -> DataFrame:
    """Rows of ``parts`` that have a part of ``others`` in their scope within ``reach``.

    Places are starts. ``others`` is folded to the least and greatest start of each bin.
    """
    spots = others.select("row", "scope", F.floor(F.col("start") / reach).alias("bin"), "start")
    spots = spots.groupBy("row", "scope", "bin").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    here = F.floor(F.col("start") / reach)
    asked = parts.withColumn("bin", F.explode(F.array(here - 1, here, here + 1)))
    met = (F.col("low") <= F.col("start") + reach) & (F.col("high") >= F.col("start") - reach)
    return asked.join(spots, ["row", "scope", "bin"]).where(met).select(*parts.columns).distinct()


def link(scanned: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak spans that are reported: (row, kind, start, end)."""
    parts = scanned.where(F.size("parts") > 0).select("row", F.inline("parts"))
    access, host = parts.where("kind = 'access'"), parts.where("kind = 'host'")
    keys, idents = parts.where("kind = 'key'"), parts.where("kind = 'id'")
    strong = parts.where("kind IN ('assign', 'hex')")
    # a key beside an access identifier, or beside an identifier that has an endpoint
    placed = near(idents, host, reach)
    found_keys = near(keys, access.unionByName(placed), reach)
    # an identifier counts once the key of its pair is there too
    found_idents = near(placed, found_keys.unionByName(strong), reach)
    return found_keys.unionByName(found_idents).select("row", "kind", "start", "end")


def secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, reach: int = REACH) -> DataFrame:
    """Add ``base`` and ``spans`` (base plus linked spans, in order of start, then kind)."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "spans")]
    held = {c: f"in_{i}" for i, c in enumerate(names)}
    scanned = scan(docs.select(*[F.col(c).alias(held[c]) for c in names], F.col(text).alias("whole")), "whole", list(held.values()))
    scanned = durable(scanned.withColumn("row", F.monotonically_increasing_id()))
    linked = link(scanned, reach).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    joined = scanned.join(linked, "row", "left")
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    every = F.concat("base", F.coalesce("more", F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")))
    keyed = F.transform(every, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("r"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select(*[F.col(h).alias(c) for c, h in held.items()], "base", spans.alias("spans"))


def spelled(spans: str):
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by a mask; overlapping spans become one."""
    held = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    found = secrets(docs.select(*[F.col(c).alias(h) for c, h in held.items()]), held[text])

    def start():
        def compute(column, spans):
            return [[_masked(t, s) for t, s in zip(column.to_pylist(), spans.to_pylist())]]

        return compute

    masked = map_columns(found, [held[text], "spans"], "masked string", start, list(held.values()))
    return masked.select(*[F.col("masked" if c == text else h).alias(c) for c, h in held.items()])


def _masked(text: str | None, spans: list[dict]) -> str | None:
    if not text or not spans:
        return text
    pieces, at = [], 0
    for s in spans:
        if s["start"] >= at:
            pieces += [text[at : s["start"]], MASK]
        at = max(at, s["end"])
    return "".join(pieces) + text[at:]
