"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from conftest import SMALL
from titlelab.llm import queries, spelling
from titlelab.llm.common import table

FOLD = str.maketrans(spelling.UPPER, spelling.LOWER)


def words_of(rows):
    """Counts of the words of (doc_id, text) rows."""
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return found


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def deletions(word):
    return {(i, word[:i] + word[i + 1 :]) for i in range(len(word))}


def brute_force(counts):
    """All near pairs through equal deletions, checked letter by letter."""
    meets = {}
    for w in counts:
        for d in {w, *(d for _, d in deletions(w))}:
            meets.setdefault(d, set()).add(w)
    of = {w: set() for w in counts}
    for group in meets.values():
        for a in group:
            of[a] |= {b for b in group if b != a and b not in of[a] and near(a, b)}
    form = {}
    for w, others in of.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(of[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def vocabulary(seed, n, letters="abcd", sizes=(5, 8)):
    pick = random.Random(seed)
    words = {"".join(pick.choices(letters, k=pick.randint(*sizes))) for _ in range(n)}
    return {w: pick.choice([3, 4, 6, 9, 12, 30]) for w in words}


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    counts = vocabulary(1, 700) | vocabulary(2, 200, "aéîÿz") | {"x" * 400: 3, "x" * 401: 7, "y" + "x" * 399: 3}
    if small:  # several cells, blocks and leaves
        for name, value in (("CELL_WORDS", 40), ("BLOCK_WORDS", 16), ("SENT_WORDS", 30), ("LEAF", 3), ("SAMPLE_LEAF", 4)):
            monkeypatch.setattr(spelling, name, value)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert got(spelling.variants(words)) == brute_force(counts)


def test_letters_beyond_the_alphabet_and_anagrams(spark):
    counts = vocabulary(3, 150, "aāšŝ\U00010330b") | {"".join(random.Random(i).sample("abcdefg", 7)): 3 + i % 9 for i in range(300)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(spelling.variants(words)) == brute_force(counts)


def test_words_of_texts(spark):
    rows = [(1, None), (2, ""), (3, "Été été ÉTÉ don't naïve-NAÏVE x"), (None, "Letters letters"), (3, "Été été ÉTÉ don't naïve-NAÏVE x")]
    rows += [(i, "Running runnng RUNNING words \n of 3 documents") for i in range(400)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int")
    found = {r["word"]: r["n"] for r in spelling.vocabulary(spelling.occurrences(docs), 1, 1).collect()}
    assert found == {w: n for w, n in words_of(rows).items() if w}
    assert spelling.variants(spelling.vocabulary(spelling.occurrences(docs.limit(0)))).count() == 0


def test_very_long_texts_and_runs(spark):
    rows = [(i, "q" * 3000 + (" " if i % 2 else "r ") + "plain plane " * 100_000) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {w: n for w, n in words_of(rows).items() if len(w) >= 5 and n >= 3}
    assert got(spelling.variants(spelling.vocabulary(spelling.occurrences(docs)))) == brute_force(counts)


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    counts = {w: n for w, n in words_of(rows).items() if len(w) >= 5 and n >= 3}
    assert len(counts) > 1000
    assert got(queries.op11_spelling_variants(spark, SMALL)) == brute_force(counts)
