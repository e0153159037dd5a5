"""Language ID, quality ranking, language model: held-out behaviour and defined cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from titlelab.llm import hpylm, langid, quality

WORDS = {"aa": "the of and house water".split(), "bb": "der und das haus wasser zug".split()}


def prose(lang, n, seed):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, prose("aa" if i % 2 else "bb", 20, i), "aa" if i % 2 else "bb") for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_of_held_out_texts(spark, labelled):
    model = langid.fit(labelled.where("doc_id < 100"))
    got = langid.predict(labelled, model).where("doc_id >= 100")
    assert got.where("lang = lang_pred").count() == 100
    assert got.where("score < 0.5 OR score > 1").count() == 0


def test_language_of_odd_texts(spark, labelled):
    model = langid.fit(labelled)
    long = prose("bb", 200_000, 1)
    odd = spark.createDataFrame(
        [(1, None, "x"), (1, None, "x"), (2, "", "x"), (3, "12 !?", "x"), (4, "DAS HAUS", None), (5, long, "x")],
        "doc_id long, text string, score string",
    )
    got = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(odd, model).collect())
    assert [g[:2] for g in got] == [(1, "und"), (1, "und"), (2, "und"), (3, "und"), (4, "bb"), (5, "bb")]
    assert [g[2] for g in got[:4]] == [0.0] * 4


def test_language_without_training_rows(spark, labelled):
    model = langid.fit(labelled.limit(0))
    assert {r["lang_pred"] for r in langid.predict(labelled.limit(5), model).collect()} == {"und"}
    assert langid.predict(labelled.limit(0), model).count() == 0


def test_pieces_of_long_texts_score_alike(spark, labelled, monkeypatch):
    """Brute force: the sum over all grams of each text, one at a time."""
    model = langid.fit(labelled)
    texts = [prose("aa", 300, 1) + " 12 " + prose("bb", 900, 2), "x", "1 2", "", prose("bb", 40, 3)]
    letters, buckets = langid._letters(), len(model.logp) - 1
    mask, wanted = (1 << 64) - 1, []
    for t in texts:
        codes = [int(letters[ord(c)]) for c in f" {t} "]
        total = model.prior.copy()
        for order in range(1, langid.ORDERS + 1):
            for end in range(order, len(codes) + 1):
                gram = codes[end - order : end]
                if any(c != 32 for c in gram):
                    h = 0
                    for c in reversed(gram):
                        h = (h * 0x100000001B3 + c + 1) & mask
                    total += model.logp[((h * 0x9E3779B97F4A7C15) & mask) >> (64 - buckets.bit_length() + 1)]
        wanted.append((model.langs[int(total.argmax())], float(1 / np.exp(total - total.max()).sum())) if any(map(str.isalpha, t)) else ("und", 0.0))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(1)
    for most in (langid.PIECE, 100, 7):
        monkeypatch.setattr(langid, "PIECE", most)
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
        for i, (lang, score) in enumerate(wanted):
            assert got[i][0] == lang and abs(got[i][1] - score) < 1e-6


def test_language_sample_is_bounded(spark, labelled):
    assert langid.fit(labelled, max_train=40).langs == ["aa", "bb"]


@pytest.fixture(scope="module")
def graded(spark):
    rows = []
    for i in range(240):
        good = i % 3 > 0
        text = prose("aa", 40 + i % 7, i) + "." if good else ("BUY!! NOW!! " * (10 + i % 5))
        rows.append((i, text, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_quality_of_held_out_texts(spark, graded):
    labels = graded.select("doc_id", "quality").where("doc_id < 120")
    got = quality.score(graded, quality.fit(graded, labels)).where("doc_id >= 120")
    assert got.where("predicted <> quality").count() == 0
    assert got.where("(score >= 0.3) <> (predicted = 1)").count() == 0


def test_quality_of_odd_texts(spark, graded):
    labels = graded.select("doc_id", "quality")
    labels = labels.unionByName(labels.limit(30)).unionByName(spark.createDataFrame([(None, 1), (1, None)], labels.schema))
    model = quality.fit(graded, labels)
    odd = spark.createDataFrame([(1, None), (1, ""), (2, "x" * 300_000), (2, "\n\n"), (None, "a b")], "doc_id long, text string")
    got = [r for r in quality.score(odd, model).collect()]
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert got[0]["score"] == got[1]["score"]


def test_quality_moves_features_to_the_labels_and_no_texts(spark, graded, monkeypatch):
    plans, write = [], quality.durable
    monkeypatch.setattr(quality, "durable", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    quality.fit(graded, graded.select("doc_id", "quality"))
    assert "text" in plans[0] and 0 <= plans[0].find("Join") < plans[0].find("MapInArrow")


def test_quality_with_one_label_or_none(spark, graded):
    for labels in (graded.select("doc_id", F.lit(1).alias("quality")), graded.select("doc_id", "quality").limit(0)):
        got = quality.score(graded, quality.fit(graded, labels)).select("score").distinct().collect()
        assert [r["score"] for r in got] == [0.5]


def test_every_labelled_row_counts(spark):
    """More rows than the former sample held; features of a text of the rare kind are in the sums."""
    n = 24_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "BUY!! NOW!!").otherwise("the water and the house.").alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("quality"))
    model = quality.fit(docs, labels)
    both = quality.features(["BUY!! NOW!!", "the water and the house."], quality._classes())
    assert np.allclose(model.mean, (both[0] + 2 * both[1]) / 3, rtol=1e-12, atol=1e-12)
    got = {r["text"]: r["predicted"] for r in quality.score(docs, model).select("text", "predicted").distinct().collect()}
    assert got == {"BUY!! NOW!!": 0, "the water and the house.": 1}
    langs = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "bb").otherwise("aa"))
    assert np.allclose(np.exp(langid.fit(langs).prior), [2 / 3, 1 / 3], atol=1e-12)


@pytest.mark.parametrize("n_good, n_bad", [(7, 3), (3, 7), (5, 1), (4, 4)])
def test_each_row_is_in_two_pairs_at_least(spark, n_good, n_bad):
    rows = [(i, i < n_good, [float(i + 1)]) for i in range(n_good + n_bad)]
    z = spark.createDataFrame(rows, "key int, good boolean, z array<double>")
    got = [r["d"][0] for r in quality._pairs(z, n_good, n_bad, 1, 7).collect()]
    assert len(got) == 2 * max(n_good, n_bad)
    goods, bads = [float(i + 1) for i in range(n_good)], [float(i + 1) for i in range(n_good, n_good + n_bad)]
    assert set(got) <= {g - b for g in goods for b in bads}


def test_quantile_of_a_table_equals_sorting(spark):
    pick = np.random.default_rng(1)
    for u in (pick.normal(size=5000), np.repeat([1.0, 2.0, 5.0], [10, 30, 60]), np.arange(4.0), np.array([3.0])):
        table = spark.createDataFrame([(float(x),) for x in u], "u double")
        for share in (0.0, 0.14, 0.5, 0.999):
            assert abs(quality._quantile(table, share) - np.quantile(u, share)) < 1e-6


def test_pairs_order_by_the_feature_that_matters():
    import numpy as np

    pick = np.random.default_rng(3)
    differences = pick.normal(size=(4000, 3)) + [2.0, 0.0, -1.0]
    weights = quality.bradley_terry(differences)
    assert weights[0] > abs(weights[1]) and weights[2] < 0


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", folded) + ["\n"]


def corpus(n):
    pick = random.Random(5)
    kinds = ["".join(pick.choice("aeiourstln") for _ in range(pick.randint(2, 6))) for _ in range(400)]
    return [" ".join(kinds[min(399, int(pick.expovariate(0.02)))] for _ in range(pick.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return [None, "", "É É é A a\x0bb c\x1cd", "same text", "same text", *corpus(300)]


@pytest.fixture(scope="module")
def scored(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r for r in hpylm.score(docs, F.col("doc_id") % 4 != 1, block_chars=3000).collect()}


def test_base_score_equals_brute_force(texts, scored):
    seen = Counter(w for i, t in enumerate(texts) if i % 4 != 1 for w in words(t))
    total, kinds = sum(seen.values()), len(seen)
    assert len(scored) == len(texts)
    for i, text in enumerate(texts):
        row, tokens = scored[i], words(text)
        base = sum(math.log10((seen[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(tokens), sum(seen[w] > 0 for w in tokens), total)
        assert row["trained"] == (i % 4 != 1)


def test_model_beats_the_base_on_held_out_texts(texts, scored):
    held = [r for r in scored.values() if not r["trained"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] <= 0 for r in scored.values())
    assert scored[3]["score"] == pytest.approx(scored[4]["score"])


def test_model_probabilities_add_up(spark):
    counts = [(b"a", 5), (b"bb", 2), (b"c", 1), (b"zz", 0)]
    table = spark.createDataFrame(counts, "word binary, count long")
    got = {bytes(r["word"]): 10 ** r["logp"] for r in hpylm.probabilities(table, hpylm.fit(table)).collect()}
    assert sum(got.values()) == pytest.approx(1.0, abs=1e-6)
    assert got[b"a"] > got[b"bb"] > got[b"c"]


def test_model_with_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    got = hpylm.score(docs, F.lit(False)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(0, 0, 0.0, 0.0)] * 2
    assert hpylm.score(docs.limit(0), F.lit(True)).count() == 0


def test_seating_matches_its_expectation():
    import numpy as np

    n, discount, others, base = 40, 0.5, 20, 0.3
    seeds = np.arange(1, 4001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = hpylm.seat(np.full(4000, n), np.full(4000, others), np.full(4000, base), discount, seeds).mean()
    pick, total = random.Random(1), 0
    for _ in range(4000):
        t = 1
        for k in range(1, n):
            new = (hpylm.STRENGTH + discount * (others + t)) * base
            t += pick.random() * (new + k - discount * t) < new
        total += t
    assert got == pytest.approx(total / 4000, rel=0.05)
    far = hpylm.seat(np.full(4000, 5000), np.full(4000, others), np.full(4000, base), discount, seeds)
    assert (far >= 1).all() and (far <= 5000).all() and far.mean() > got


def test_word_order_counts(spark):
    pick, follow = random.Random(5), {"the": "old", "old": "house", "house": "by", "by": "the"}
    texts = []
    for i in range(60):
        row = [pick.choice(list(follow))]
        for _ in range(30):
            row.append(follow[row[-1]])
        texts.append(" ".join(row))
    salad = texts[0].split()
    pick.shuffle(salad)
    docs = spark.createDataFrame(list(enumerate([texts[0], " ".join(salad), *texts])), "doc_id long, text string")
    fluent, mixed = hpylm.score(docs, F.col("doc_id") > 1).where("doc_id < 2").orderBy("doc_id").collect()
    assert fluent["base_score"] == pytest.approx(mixed["base_score"])
    assert fluent["score"] > mixed["score"] + 5


def test_scores_do_not_depend_on_blocks(spark, texts, scored):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    for row in hpylm.score(docs, F.col("doc_id") % 4 != 1).collect():
        assert row["score"] == pytest.approx(scored[row["doc_id"]]["score"])


def test_probabilities_after_each_word_add_up(spark):
    seen = {("a", "b"): 4, ("a", "a"): 1, ("b", "a"): 3, ("b", "\n"): 2, ("\n", "a"): 2, ("a", "\n"): 1, ("\n", "b"): 1}
    counts = Counter()
    for (_, w), n in seen.items():
        counts[w] += n
    ids = {w: i for i, w in enumerate([*counts, "new"])}
    words = spark.createDataFrame([(w.encode(), i, counts[w]) for w, i in ids.items()], "word binary, id long, count long")
    many = [(ids[u], ids[w], n) for (u, w), n in seen.items() if n > 1]
    words, seats, discount, strengths = hpylm.learn(words, spark.createDataFrame(many, "u long, w long, count long"))
    by_id, at = {r["id"]: r for r in words.collect()}, {(r["u"], r["w"]): r for r in seats.collect()}
    assert list(strengths) == list(range(1, hpylm.SWEEPS))
    for s, strength in strengths.items():
        for u in counts:
            tables = {w: at[ids[u], ids[w]][f"o{s}"] if (ids[u], ids[w]) in at else min(1, seen.get((u, w), 0)) for w in ids}
            row = by_id[ids[u]]
            assert sum(tables.values()) == row[f"o{s}"]
            total = sum(
                hpylm.after(seen.get((u, w), 0), tables[w], row["count"], row[f"o{s}"], math.exp(by_id[i][f"p{s}"]), discount, strength)
                for w, i in ids.items()
            )
            assert total == pytest.approx(1, abs=1e-6)


def test_blocks_and_tables_hash_words_alike(spark):
    import xxhash

    names = [b"\n", b"a", "é".encode(), b"x" * 40, bytes(range(200, 256))]
    table = spark.createDataFrame([(w,) for w in names], "word binary").withColumn("id", F.xxhash64("word"))
    for row in table.collect():
        assert row["id"] % 2**64 == xxhash.xxh64_intdigest(bytes(row["word"]), 42)


def test_met_pairs_equal_counting(spark):
    pick = random.Random(6)
    texts = [" ".join(pick.choice("abcdefghij") * pick.randint(1, 2) for _ in range(pick.randint(0, 12))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t, i % 4 != 1) for i, t in enumerate(texts)], "doc_id long, text string, train boolean").repartition(1)
    cut = hpylm.blocks(rows, F.col("train"), 100).where("word IS NULL").collect()
    assert len(cut) > 3
    table = spark.createDataFrame(cut, hpylm.blocks(rows, F.col("train"), 100).schema)
    met = hpylm.met_pairs(table, range_pairs=40).collect()
    assert len({r["range"] for r in met}) > 2
    held = {r["block"]: hpylm.Unpacked(r.asDict()) for r in cut}
    counts = Counter()
    for h in held.values():
        for u, w, n in zip(h.hashes[h.before].tolist(), h.hashes[h.after].tolist(), h.trained.tolist()):
            counts[u, w] += n
    many = {(r["u"], r["w"]): r["count"] for r in met if r["block"] is None}
    assert many == {p: n for p, n in counts.items() if n > 1}
    order = {}
    for k in {r["range"] for r in met}:
        pairs = np.array([(r["u"], r["w"]) for r in met if r["range"] == k and r["block"] is None], np.int64).reshape(-1, 2)
        order[k] = pairs[hpylm.pair_order(pairs[:, 0].copy(), pairs[:, 1].copy())].tolist()
    got, want = {}, {}
    for r in met:
        if r["block"] is not None:
            for at, place in zip(np.cumsum(hpylm.unpacked(r["steps"])).tolist(), hpylm.unpacked(r["places"]).tolist()):
                assert (r["block"], at) not in got
                got[r["block"], at] = tuple(order[r["range"]][place]) if place >= 0 else None
    for block, h in held.items():
        for at, (u, w, n) in enumerate(zip(h.hashes[h.before].tolist(), h.hashes[h.after].tolist(), h.trained.tolist())):
            if counts[u, w] > 1:
                want[block, at] = (u, w)
            elif counts[u, w] > n:
                want[block, at] = None
    assert got == want


def test_learning_keeps_only_the_tables_that_are_read_later(spark, monkeypatch):
    import titlelab.session as session

    written = []
    monkeypatch.setattr(hpylm, "durable", lambda df: written.append(session.durable(df)) or written[-1])
    words = session.durable(spark.createDataFrame([(w.encode(), i, 4) for i, w in enumerate("abc")], "word binary, id long, count long"))
    words_after, seats, _, _ = hpylm.learn(words, spark.createDataFrame([(0, 1, 3), (1, 2, 2)], "u long, w long, count long"))
    assert words_after.count() == 3 and seats.count() == 2 and words.count() == 3
    assert sum(_exists(spark, t) for t in written) == 2


def _exists(spark, table):
    import os

    return all(os.path.exists(f.removeprefix("file:").replace("///", "/")) for f in table.inputFiles())
