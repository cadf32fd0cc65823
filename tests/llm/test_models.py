import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from cadaspark.llm import boosting, hyperdimensional_language, plans, quality_trees, weak_rules

SF = "/root/testdata/sf0.01"


def crc(i):
    return zlib.crc32(str(i).encode())


def test_op2_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = plans.op2_language(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if crc(i) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_by_definition():
    """The batched bundle equals the sum over trigrams written out."""
    encoder = hyperdimensional_language.Encoder(64)
    text = "Ab, ça va?"
    letters = [0, *map(ord, "ab"), 0, *map(ord, "ça"), 0, *map(ord, "va"), 0]
    want = sum(
        np.roll(encoder.letter(a), 2).astype(int) * np.roll(encoder.letter(b), 1) * encoder.letter(c)
        for a, b, c in zip(letters, letters[1:], letters[2:])
    )
    assert (encoder.texts([None, text, ""])[1] == want).all()


def test_language_of_odd_rows(odd):
    learn = F.col("doc_id") != 4
    model = hyperdimensional_language.fit(odd, learn)
    got = {(r.doc_id, r.lang_pred, r.score) for r in hyperdimensional_language.predict(odd, model, ["doc_id"]).collect()}
    by = {i: (la, s) for i, la, s in got}
    assert model[0] == ["de", "en"]  # the only French text has no letter
    for i in (2, 3, 5, 9):
        assert by[i] == ("und", 0.0)
    assert by[1][0] == by[4][0] == "en" and by[8][0] == "de"
    nothing = hyperdimensional_language.fit(odd, F.lit(False))
    assert {r.lang_pred for r in hyperdimensional_language.predict(odd, nothing, ["doc_id"]).collect()} == {"und"}


def test_boosting_learns_and_flattens():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = (x[:, 0] > 0) ^ (x[:, 3] > 0.5)
    forest = boosting.train(x[:2000], y[:2000], depth=3)
    assert ((forest.probability(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    row, total = x[2500], forest.base
    for t in range(len(forest.feature)):  # a walk down each tree
        node = 0
        for _ in range(forest.depth):
            node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.threshold[t, node])
        total += forest.value[t, node - (2**forest.depth - 1)]
    assert abs(total - forest.margin(x[2500:2501])[0]) < 1e-9
    assert boosting.train(np.zeros((0, 2)), np.zeros(0)).probability(np.zeros((1, 2))) == 0.5


def test_op5_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = plans.op5_quality(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) for r in got)
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, 0), (2, None), (None, 1)], "doc_id long, quality int")
    forest = quality_trees.fit(odd, labels, F.col("doc_id") != 7)
    got = quality_trees.score(odd, forest, odd.columns, out="_score")
    assert got.count() == odd.count() and got.drop("_score").columns == odd.columns
    by = defaultdict(set)
    for r in got.collect():
        by[r.doc_id].add(r["_score"])
    assert by[1] == by[4] and by[2] == by[3] and all(len(v) == 1 for v in by.values())
    none = quality_trees.fit(odd, labels.limit(0), F.lit(True))
    assert {r["_score"] for r in quality_trees.score(odd, none, ["doc_id"], out="_score").collect()} == {0.5}


def figures(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = list(zip(words, words[1:], words[2:]))
    seen, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            inside |= {i, i + 1, i + 2}
    n = len(words)
    return (
        n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside),
        n < 50 or 100 * len(inside) > 50 * n,
    )


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def em(patterns, rounds=weak_rules.ROUNDS):
    """Expectation-maximisation over counted vote patterns, written out."""
    size = len(next(iter(patterns)))
    accuracy = [weak_rules.START_ACCURACY] * size

    def good(votes):
        g = b = 0.5
        for v, a in zip(votes, accuracy):
            if v >= 0:
                g, b = g * (a if v == 1 else 1 - a), b * (a if v == 0 else 1 - a)
        return g / (g + b)

    for _ in range(rounds):
        q = {p: good(p) for p in patterns}
        accuracy = [
            (sum(n * (q[p] if p[j] == 1 else 1 - q[p]) for p, n in patterns.items() if p[j] >= 0) + weak_rules.PRIOR * weak_rules.START_ACCURACY)
            / (sum(n for p, n in patterns.items() if p[j] >= 0) + weak_rules.PRIOR)
            for j in range(size)
        ]
    return {p: good(p) for p in patterns}


def test_op3_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = plans.op3_weak_rules(spark, SF).collect()
    assert {r.doc_id: tuple(r[n] for n in NAMES) for r in got} == {i: figures(t) for i, t in texts.items()}
    full = weak_rules.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    votes = list(weak_rules.rules())
    want = em(Counter(tuple(r[v] for v in votes) for r in full))
    for r in full:
        p = want[tuple(r[v] for v in votes)]
        assert abs(r.posterior - p) < 1e-9 and r.kept == (not r.base_failed and p >= 0.5)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.kept or r.base_failed for r in got if quality.get(r.doc_id) == 1)
    assert not any(r.kept for r in got if quality.get(r.doc_id) == 0)


def test_rules_on_odd_rows(odd):
    got = weak_rules.judge(odd).collect()
    want = Counter((r.doc_id, *figures(r.text)) for r in odd.collect())
    assert Counter((r.doc_id, *[r[n] for n in NAMES]) for r in got) == want
    assert weak_rules.judge(odd.limit(0)).count() == 0


def test_repeated_windows_by_hand(spark):
    texts = ["a b c a b c", "a a a", "a a a a", "a a a a a", "x a b c y a b c z", "a b c d b c d", "a b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in weak_rules.figures(rows).collect()}
    assert got == {i: figures(t)[4] for i, t in enumerate(texts)}


def test_few_words_over_and_over_at_any_length(spark):
    """Texts drawn from 200 words are told apart from texts of many words, with no switch at any length."""
    rng = np.random.default_rng(5)
    few = [(n, " ".join(f"word{k}" for k in rng.integers(0, 200, n))) for n in (2000, 4999, 5000, 20_000)]
    many = [(-n, " ".join(f"word{k}" for k in rng.zipf(1.3, n) % 100_000)) for n in (100, 1000, 20_000)]
    got = {r.doc_id: r.few_words_over_and_over for r in weak_rules.judge(spark.createDataFrame(few + many, "doc_id long, text string")).collect()}
    assert all((v == 0) == (i > 0) for i, v in got.items())
