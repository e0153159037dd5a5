"""Main text of web pages: a suffix array of each host's pages, held against what the markup names.

A page becomes blocks of text. Regions that the markup names as something else (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, comments) give no blocks. A class or id names
such a region only as a whole: ``sidebar`` and ``site-footer`` do, ``with-sidebar`` does not. If the
page marks its article, the blocks inside and the paragraphs beside it in the main part are its
stream; if it marks a main part only, the blocks inside that are; else all blocks are. Each marked
article, main part or paragraph beside is a unit.

The streams of all pages of a host, block ends included, are concatenated and sorted as suffixes;
suffixes that agree on ``RUN`` tokens are neighbours, and where such neighbours come from enough
distinct pages, the tokens they share are covered. Unmarked pages are counted among themselves, two
are enough, and covered tokens go. Marked pages are counted among themselves too, ``SHARED`` says
how many are enough, and of these whole units go: those all of whose words are covered, teasers and
notices that different articles carry. The longest unit always stays, and if it is covered itself
the page is a copy and all its units stay: a repeated article is no boilerplate. Nothing goes from
inside a unit.

A host is one task up to a bounded size. A larger one is sorted in shards, so that a hot host is no
single task. Where it has pages that other shards could change (unmarked ones, or of several units),
each shard sends one row for each class of neighbours (a hash of its tokens, and its number of
pages), and runs repeated across shards are found by the sum of the rows. Pages of one host with
equal streams count as one page; they lie in one shard if shards exchange rows.

Defined results: null and empty html give the empty text. Malformed markup never fails: open
elements end with their parents, the article or the page, a quote that is never closed ends with
its tag. Very long pages are read whole, in one pass. White space, no-break spaces included,
becomes one space. Rows repeated give repeated results; a null or odd url has its own host, ''.
Extra columns play no part.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titlelab.llm.common import map_columns
from titlelab.session import durable

#: Tokens on which neighbours in the suffix order must agree; a power of two.
RUN = 8
#: Tokens of one host that a task sorts at a time, and the characters of html that count as one.
SHARD_TOKENS = 1_000_000
TOKEN_CHARS = 8
#: Unmarked and marked pages that make a run of theirs a repeated one.
SHARED = (2, 3)

# Elements and names that mark what is not the article.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp")
DROPPED = {
    "nav", "footer", "aside", "form", "head", "header", "menu", "dialog", "button", "select", "option", "label",
    "fieldset", "canvas", "audio", "video", "map", "datalist", "legend", "svg", "math", "object",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark",
    "q", "ruby", "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo",
    "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter",
    "subscribe", "subscription", "comment", "comments", "commentlist", "respond", "disqus", "reply", "replies", "sidebar", "menu", "nav", "navbar",
    "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "share", "sharing", "social", "related", "recommended",
    "footer", "masthead", "topbar", "toolbar", "widget", "widgets", "login", "signup", "search", "skip", "disclaimer", "copyright",
}
#: Words that, joined to one of the names, leave it what it is (``site-footer``, ``comment-list``).
BESIDE = {
    "area", "article", "bar", "block", "bottom", "box", "btn", "button", "buttons", "container", "content", "entry", "fixed", "floating", "form",
    "global", "group", "header", "icons", "inline", "inner", "item", "items", "left", "link", "links", "list", "main", "media", "message", "page",
    "panel", "post", "posts", "primary", "reader", "right", "secondary", "section", "site", "slot", "sticky", "thread", "top", "unit", "user",
    "wrap", "wrapper",
}
#: Names that make even an article element something else.
ASIDES = {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "sponsored", "promo", "related", "recommended"}
#: Blocks that are text also beside an article, in the main part.
PARAGRAPHS = {"p", "h1", "blockquote"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}

#: The rest of a tag: a quote means something only after an equals sign.
INSIDE = r"""(?:=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)|[^>])*+"""
MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>]){INSIDE}>(?:.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z))"
    rf"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>{INSIDE})>"
    r"|</?[a-z!?][^>]*(?:>|\Z)",
    re.I | re.S,
)
ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")


def names_region(word: str, names: set[str]) -> bool:
    """Whether a whole class or id is one of the names, alone or with words that leave it so."""
    parts = re.findall("[a-z]+", word)
    return not names.isdisjoint(parts) and all(x in names or x in NAMES or x in BESIDE for x in parts)


def unwanted(name: str, attrs: str) -> bool:
    """Whether an element's attributes name it as something other than the article."""
    names = ASIDES if name in ("article", "main") else NAMES
    for key, value in ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            if any(names_region(word, names) for word in value.split()):
                return True
        elif key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks(page: str) -> list[tuple[bool, bool, str, bool, int]]:
    """(in an article, in the main part, text, a paragraph of no list, number of the article or main
    part) of each block outside dropped regions, in order."""
    out: list[tuple[bool, bool, str, bool, int]] = []
    parts: list[str] = []
    article = main = lists = depth = at = unit = 0
    dropped = ""  # the element whose end closes the dropped region
    element = outer = ""  # the block opened last, and the one before it

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((article > 0, main > 0, text, element in PARAGRAPHS and not lists, unit))
            parts.clear()

    for tag in MARKUP.finditer(page):
        if not dropped and tag.start() > at:
            parts.append(page[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            if tag["raw"]:
                flush()
            continue
        closing, attrs = bool(tag["close"]), tag["attrs"]
        if dropped:
            ends = name in ("article", "main") and not closing and not article or closing and name in ("body", "html")
            if dropped in ("p", "li") and not closing and name not in INLINE and name not in VOID:
                ends = True
            if name == dropped and not ends:
                depth += -1 if closing else 1
                if depth == 0:
                    dropped = ""
                continue
            if not ends and not (closing and name == "article" and article):
                continue
            dropped, depth = "", 0
        if name in ("br", "hr"):
            parts.append(" ")
        elif name not in INLINE:
            flush()
            outer, element = element, "" if closing else name
        if closing:
            if name in ("ul", "ol", "dl"):
                lists = max(0, lists - 1)
            if name == "article":
                article = max(0, article - 1)
            elif name == "main":
                main = max(0, main - 1)
            continue
        if name in VOID:
            continue
        inside = name == "header" and article  # an article's own heading
        if name in DROPPED and not inside or attrs and name not in ("body", "html") and unwanted(name, attrs):
            flush()
            if name not in INLINE:
                element = outer
            if not attrs.endswith("/"):
                dropped, depth = name, 1
        elif name == "article":
            unit += not article
            article += 1
        elif name == "main":
            unit += not article and not main
            main += 1
        elif name in ("ul", "ol", "dl"):
            lists += 1
    if not dropped and at < len(page):
        parts.append(page[at:])
    flush()
    return out


def decide(found: list[tuple[bool, bool, str, bool, int]]) -> tuple[str | None, list[list[str]]]:
    """The text that the page marks, null if it marks none, and its units for the host's array."""
    article = any(b[0] for b in found)
    chosen = [b for b in found if (b[0] or b[1] and b[3] if article else b[1])]
    if found and not chosen:
        return None, [[b[2] for b in found]]
    units: list[list[str]] = []
    last = None
    for b in chosen:
        beside = article and not b[0]
        if beside or b[4] != last:
            units.append([])
        units[-1].append(b[2])
        last = None if beside else b[4]
    return " ".join([b[2] for b in chosen]), units


def parsed(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """Add ``marked`` (whether the page marks its text), ``units`` and their ``digest``."""

    def start():
        def compute(column):
            found = [decide(blocks(page or "")) for page in column.to_pylist()]
            return [[text is not None for text, _ in found], [units for _, units in found]]

        return compute

    made = map_columns(pages, [html], "marked boolean, units array<array<string>>", start, keep)
    return made.withColumn("digest", F.xxhash64("units"))


def ranks(tokens: np.ndarray, run: int) -> np.ndarray:
    """Rank of the suffix at each place by its first ``run`` tokens, by doubling; equal ranks are
    neighbours of the suffix array that agree on them all."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < run:
        after = np.concatenate([rank[step:], np.full(min(step, len(rank)), -1)])
        rank = np.unique(rank * (len(rank) + 2) + after + 1, return_inverse=True)[1]
        step *= 2
    return rank


END = "\x00"  # the end of a block, as a token; blocks hold no such word
_SEED = np.uint64(0x9E3779B97F4A7C15)


def stream(pages: list[list[list[str]]], run: int):
    """Token hashes of all pages, each followed by ``run`` tokens of its own, and the page of each."""
    import xxhash

    known: dict[str, int] = {}
    tokens, sizes = [], []
    for p, found in enumerate(pages):
        words = [w for unit in found for b in unit for w in (*b.split(" "), END)]
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        tokens.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        # no run crosses into the next page: the gap's tokens occur once
        tokens.append(page_gap(p, run))
        sizes += [len(words), run]
    owner = np.repeat(np.column_stack([np.arange(len(pages)), np.full(len(pages), -1)]).ravel(), sizes)
    return np.concatenate(tokens) if tokens else np.zeros(0, np.uint64), owner


def page_gap(page: int, run: int) -> np.ndarray:
    return (np.arange(1, run + 1, dtype=np.uint64) + np.uint64(page * run)) * _SEED


def run_keys(tokens: np.ndarray, run: int) -> np.ndarray:
    """A hash of the ``run`` tokens from each place, alike in every shard."""
    key = np.zeros(len(tokens), np.uint64)
    for back in range(run):
        key = (key ^ np.roll(tokens, -back)) * _SEED
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def classes(tokens: np.ndarray, owner: np.ndarray, digests: np.ndarray, marked: np.ndarray, run: int):
    """Places where a run lies within a page, their classes of neighbours, and the distinct pages of
    each class: (unmarked, marked) by class."""
    whole = np.flatnonzero((owner >= 0) & (np.append(owner, np.full(run, -1))[run - 1 : len(owner) + run - 1] == owner))
    if not len(whole):
        return whole, whole, np.zeros((2, 0), np.int64)
    of = np.unique(ranks(tokens, run)[whole], return_inverse=True)[1]
    page = np.unique(digests, return_inverse=True)[1][owner[whole]] * 2 + marked[owner[whole]]
    met = np.unique(of * (2 * len(digests)) + page)
    n = int(of.max()) + 1
    counts = np.array([np.bincount(met[met % 2 == kind] // (2 * len(digests)), minlength=n) for kind in (0, 1)])
    return whole, of, counts


def texts_of(found: list[list[list[str]]], marked: np.ndarray, hit: np.ndarray, run: int) -> list[str]:
    """The text of each page, given the places of the stream from which a repeated run goes."""
    covered = np.zeros(len(hit) + run, bool)
    for ahead in range(run):
        covered[ahead : ahead + len(hit)] |= hit
    texts, at = [], 0
    for p, units in enumerate(found):
        size = sum([b.count(" ") + 2 for unit in units for b in unit])
        gone = covered[at : at + size]
        at += size + run
        if marked[p] and len(units) < 2 or not gone.any():
            texts.append(" ".join([b for unit in units for b in unit]))
            continue
        words, gone = [[w for b in unit for w in (*b.split(" "), END)] for unit in units], gone.tolist()
        if not marked[p]:
            texts.append(" ".join([w for w, g in zip(words[0], gone) if not g and w != END]))
            continue
        free, lengths, of = [], [], iter(gone)
        for unit in words:
            kept = [g for w, g in zip(unit, of) if w != END]
            free.append(not all(kept))
            lengths.append(len(kept))
        copy = not free[lengths.index(max(lengths))]
        texts.append(" ".join([b for unit, f in zip(units, free) if f or copy for b in unit]))
    return texts


def columns_of(table):
    return table.column("units").to_pylist(), table.column("digest").to_numpy(), table.column("marked").to_numpy().astype(np.int64)


def whole_hosts(pages: DataFrame, run: int, schema: T.StructType, names: list[str]) -> DataFrame:
    """The text of the pages of hosts whose shards need nothing of each other."""

    def shard(table):
        import pyarrow as pa

        found, digests, marked = columns_of(table)
        tokens, owner = stream(found, run)
        whole, of, counts = classes(tokens, owner, digests, marked, run)
        kind = marked[owner[whole]]
        hit = np.zeros(len(tokens), bool)
        hit[whole] = counts[kind, of] >= np.array(SHARED)[kind]
        return pa.Table.from_arrays([*map(table.column, names), pa.array(texts_of(found, marked, hit, run), pa.string())], [*names, "text"])

    return pages.groupBy("host", "shard").applyInArrow(shard, schema)


def host_runs(pages: DataFrame, run: int) -> DataFrame:
    """(host, shard, key, unmarked, marked): runs of a shard, and whether enough pages of either kind
    of the host share them."""

    def shard(table):
        import pyarrow as pa

        found, digests, marked = columns_of(table)
        tokens, owner = stream(found, run)
        whole, of, counts = classes(tokens, owner, digests, marked, run)
        n = counts.shape[1]
        key = np.zeros(n, np.int64)
        key[of] = run_keys(tokens, run)[whole]
        return pa.table({
            "host": pa.array([table.column("host")[0].as_py()] * n, pa.string()), "shard": pa.array([table.column("shard")[0].as_py()] * n, pa.int32()),
            "key": pa.array(key), "unmarked": pa.array(counts[0]), "marked": pa.array(counts[1]),
        })

    sent = pages.select("host", "shard", "digest", "marked", "units").groupBy("host", "shard")
    rows = durable(sent.applyInArrow(shard, "host string, shard int, key long, unmarked long, marked long"))
    enough = [(F.sum(kind) >= least).alias(kind) for kind, least in zip(("unmarked", "marked"), SHARED)]
    shared = durable(rows.groupBy("host", "key").agg(*enough).where("unmarked OR marked"))
    return rows.select("host", "shard", "key").join(shared, ["host", "key"])


def sharded_hosts(pages: DataFrame, run: int, schema: T.StructType, names: list[str]) -> DataFrame:
    """The text of the pages of hosts that are several shards."""

    def keep(table, repeated):
        import pyarrow as pa

        found, _, marked = columns_of(table)
        tokens, owner = stream(found, run)
        keys, kind = run_keys(tokens, run), np.append(marked, -1)[owner]
        hit = np.zeros(len(tokens), bool)
        for k, flag in enumerate(("unmarked", "marked")):
            some = repeated.filter(repeated.column(flag)).column("key").to_numpy()
            hit |= (kind == k) & np.isin(keys, some)
        return pa.Table.from_arrays([*map(table.column, names), pa.array(texts_of(found, marked, hit, run), pa.string())], [*names, "text"])

    runs = host_runs(pages, run).withColumnsRenamed({"host": "of_host", "shard": "of_shard"})
    return pages.groupBy("host", "shard").cogroup(runs.groupBy("of_host", "of_shard")).applyInArrow(keep, schema)


def extract(pages: DataFrame, html: str = "html", url: str = "url", keep: list[str] | None = None, run: int = RUN,
            shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``pages`` (the columns ``keep``, by default all but the html) with the ``text`` of each."""
    names = [c for c in (pages.columns if keep is None else keep) if c != html and c != "text"]
    held = {c: f"in_{i}" for i, c in enumerate(names)}
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(*[F.col(c).alias(h) for c, h in held.items()], host.alias("host"), F.col(html).alias("html_"))
    shards = F.ceil(F.sum(F.length("html_")) / (TOKEN_CHARS * shard_tokens)).cast("int")
    # a row for each TOKEN_CHARS * shard_tokens characters of the input at most
    large = durable(rows.groupBy("host").agg(shards.alias("shards")).where("shards > 1"))
    several = parsed(rows.join(F.broadcast(large), "host"), "html_", ["host", "shards"]).where("NOT marked OR size(units) > 1")
    joint = durable(several.select("host", "shards").distinct())  # hosts whose shards need each other

    kept = list(held.values())
    schema = T.StructType([rows.schema[h] for h in kept] + [T.StructField("text", T.StringType())])

    def dealt(of_hosts, by):
        made = parsed(of_hosts, "html_", [*kept, "host", "shards"])
        return made.withColumn("shard", F.pmod(by, F.coalesce("shards", F.lit(1))).cast("int")).drop("shards")

    # where no page can change, any dealing will do, and copies need not lie together
    apart = rows.join(F.broadcast(joint), "host", "left_anti").join(F.broadcast(large), "host", "left")
    found = whole_hosts(dealt(apart, F.monotonically_increasing_id()), run, schema, kept)
    if not joint.isEmpty():
        sent = durable(dealt(rows.join(F.broadcast(joint), "host"), F.col("digest")))
        found = found.unionByName(sharded_hosts(sent, run, schema, kept))
    return found.select(*[F.col(h).alias(c) for c, h in held.items()], "text")
