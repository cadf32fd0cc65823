"""Resampling, spelling variants and decontamination against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from cadaspark.llm import importance_resampling, plans, spelling_variants, winnowed_leaks
from cadaspark.llm.words import wide_words

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    return docs, items


def resampled(docs, items, percent=10, least=20, longest=1, buckets=10_000):
    def features(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    held = [features(t) for _, t in docs]
    s, t = Counter(b for f in held for b in f), Counter(b for _, text in items for b in features(text))
    total, aim = sum(s.values()), sum(t.values())
    rows = []
    for (i, text), f in zip(docs, held):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (aim + buckets)))) for b in f)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None, len(words_of(text))])
    fit = sorted((r for r in rows if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in rows)


def test_op11_on_a_whole_table(spark):
    assert Counter(tuple(r) for r in plans.op11_resampling(spark, SF).collect()) == resampled(*tables(spark))


@pytest.mark.parametrize("longest,size", [(1, 3), (2, 50), (3, 7)])
def test_longer_features_with_a_small_head(spark, longest, size):
    docs, items = tables(spark)
    docs = docs[:60]
    frames = [spark.createDataFrame(rows, "doc_id long, text string") for rows in (docs, items)]
    weighed = importance_resampling.weigh(*frames, longest=longest, buckets=777, size=size).drop("text")
    done = importance_resampling.draw(weighed, 50, 20, 2024).drop("n_words")
    assert Counter(tuple(r) for r in done.collect()) == resampled(docs, items, 50, 20, longest, 777)


def test_resampling_of_odd_rows(odd):
    spark = odd.sparkSession
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    target = spark.createDataFrame([(1, "the lazy dog"), (2, None)], "item_id long, text string")
    weighed = importance_resampling.weigh(odd.withColumnRenamed("score", "weight"), target)
    assert {"n_words", "n_features", "_weight"} <= set(weighed.columns)
    weighed = weighed.select("doc_id", "n_words", "n_features", weighed["_weight"].alias("weight"))
    done = importance_resampling.draw(weighed, 100, 1, 2024).drop("n_words")
    assert Counter(tuple(r) for r in done.collect()) == resampled(rows, [(1, "the lazy dog"), (2, None)], 100, 1)
    empty = importance_resampling.weigh(odd.limit(0).select("doc_id", "text"), target.limit(0)).drop("text")
    assert importance_resampling.draw(empty, 10, 20, 1).count() == 0


def test_wide_words_are_those_of_the_pattern():
    text = "".join(map(chr, range(0x250))) + "Ünï-cödé 梦x9 A_b c\x85d"
    assert [w.decode() for w in wide_words(text)] == words_of(text)


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    short, long = sorted((u, v), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def grouped(counts, factor=5):
    """Near words from the words with one letter left out, independent of signatures."""
    by_gap, known = defaultdict(set), dict(counts)
    for w in known:
        for i in range(len(w)):
            by_gap[i, w[:i] + w[i + 1 :]].add(w)
    around = defaultdict(set)
    for same in by_gap.values():
        for w in same:
            around[w] |= same - {w}
    for w in known:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in known:
                around[w].add(shorter)
                around[shorter].add(w)
    form = {}
    for w, n in known.items():
        best = min(around[w], key=lambda v: (-known[v], v), default=None)
        if best is not None and known[best] >= factor * n:
            form[w] = best
    out = set()
    for w, n in known.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(around[w]), known[form[w]] if w in form else None))
    return out


def counted(docs, drop_every=199):
    seen = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % drop_every == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            if len(w) >= 6:
                seen[w] += 1
    return {w: n for w, n in seen.items() if n >= 5}


def test_op12_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in plans.op12_spelling(spark, sf).collect()]
    want = grouped(counted(docs))
    assert len(got) == len(set(got)) and set(got) == want and any(r[1] for r in want)


def test_near_words_of_random_words(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abç") for _ in range(rng.randint(6, 9))) for _ in range(700)}
    counts = {w: rng.choice([5, 5, 30, 200, 2000, 50_000]) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(r) for r in spelling_variants.groups(frame).collect()}
    assert got == grouped(counts)
    some = sorted(words)[:80]
    pairs = {(r.word, r.other) for r in spelling_variants.near_pairs(frame.where(frame.word.isin(some))).collect()}
    assert pairs == {(u, v) for u in some for v in some if near(u, v)}


def test_spelling_of_odd_rows(odd):
    spark = odd.sparkSession
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = {r.word: r.n for r in spelling_variants.word_counts(odd, 3, drop_every=2).collect()}
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{w}".encode())
            if len(w) >= 3 and i is not None and h % 2 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            seen[w] += len(w) >= 3
    assert got == {w: n for w, n in seen.items() if n}
    assert spelling_variants.groups(spark.createDataFrame([], "word string, n long")).count() == 0
    assert spelling_variants.word_counts(odd.limit(0), 3).count() == 0


def leaked(docs, items, span=10):
    """Every window of every item looked up at every place of every document."""
    windows = defaultdict(set)
    for i, text in items:
        w = words_of(text)
        for k in range(max(len(w) - span + 1, min(len(w), 1))):
            windows[tuple(w[k : k + span])].add(str(i))
    sizes = {len(w) for w in windows}
    out = Counter()
    for d, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                names = windows.get(tuple(w[k : k + n]))
                if names:
                    hit |= set(range(k, k + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[d, len(w), len(hit), len(found), digest, bool(hit)] += 1
    return out


def test_op13_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = (
        [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()]
        for t, k in (("documents", "doc_id"), ("benchmark", "item_id"))
    )
    want = leaked(docs, items)
    assert Counter(tuple(r) for r in plans.op13_decontamination(spark, sf).collect()) == want
    assert sum(n for k, n in want.items() if k[5]) > 5


def judged(docs, items):
    done = winnowed_leaks.judge(docs, items).collect()
    digest = [hashlib.sha256(",".join(r["items"]).encode()).hexdigest() for r in done]
    return Counter((r.doc_id, r.n_words, r.n_hit, len(r["items"]), d, r.n_hit > 0) for r, d in zip(done, digest))


def test_leaks_of_a_tiny_vocabulary(spark):
    """Few different words make repeated and overlapping windows, and items of every length."""
    rng = random.Random(8)
    items = [(k, " ".join(rng.choice("abc") for _ in range(rng.choice([0, 4, 7, 9, 10, 11, 14, 30])))) for k in range(60)]
    items += [(3, "a b c A,B;c a b c a b"), (None, "a a a a a a a a a a"), (70, None)]
    docs = [(k, " ".join(rng.choice("abc" if k % 3 else "abcdefgh") for _ in range(rng.randint(0, 300)))) for k in range(80)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert judged(*frames) == leaked(docs, [x for x in items if x[0] is not None])


def test_leaks_of_odd_rows(odd):
    spark = odd.sparkSession
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(5, "quick brown fox jumps over the lazy dog and then it goes"), (6, "word " * 40), (7, "x" * 50_000), (8, ""), (9, "12")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert judged(odd, frame) == leaked(rows, items)
    assert judged(odd, frame.limit(0)) == leaked(rows, [])
    assert winnowed_leaks.judge(odd.limit(0), frame).count() == 0


@pytest.mark.parametrize(
    "name,columns,plain",
    [
        ("op11_resampling", "doc_id, n_features, weight, score, rank", lambda docs, items: resampled(docs, items)),
        ("op12_spelling", "word, form, root, n, n_near, form_n", lambda docs, items: Counter(grouped(counted(docs)))),
        ("op13_decontamination", "doc_id, n_words, n_hit, n_items, items_sha256, contaminated", leaked),
    ],
)
def test_sql_equals_the_plain_version(name, columns, plain):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    docs, items = (duck.execute(f"SELECT {k}, text FROM {t}").fetchall() for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert Counter(duck.execute(f"SELECT {columns} FROM ({plans.CHECKS[name]})").fetchall()) == plain(docs, items)
