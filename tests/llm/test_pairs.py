import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadaspark.llm import components, hilbert_neighbours, jaccard_regions, plans

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingle_set(text, width=3):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    runs = zip(*[words[i:] for i in range(width)])
    return frozenset(runs) if len(words) >= width else frozenset([tuple(words)] if words else [])


def brute(rows, percent=90, width=3):
    """(n_shingles, smallest reachable id) by comparing every two sets."""
    sets = defaultdict(list)
    for i, text in rows:
        sets[i].append(shingle_set(text, width))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for a, (i, x) in enumerate(flat):
        for j, y in flat[:a]:
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return Counter((i, len(shingle_set(t, width)), find(i)) for i, t in rows)


def answers(df, plan=None):
    return Counter(tuple(r) for r in jaccard_regions.classes(df, plan).collect())


def family(rng, size, words, changes):
    """Near copies of one text, with copies of copies."""
    made = [[f"w{rng.randrange(5000)}" for _ in range(words)]]
    while len(made) < size:
        text = list(rng.choice(made))
        for _ in range(rng.randint(0, changes)):
            text[rng.randrange(len(text))] = f"w{rng.randrange(5000)}"
        made.append(text)
    return [" ".join(t) for t in made]


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(5)
    texts = family(rng, 60, 80, 2) + family(rng, 40, 30, 1) + family(rng, 30, 300, 6) + family(rng, 20, 12, 1)
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += ["same text here again"] * 15 + ["one two", "one two", "One TWO", "one", "two one"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_op4_on_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in plans.op4_jaccard(spark, "/root/testdata/sf0.001").collect())
    assert got == brute(rows)


def test_families_of_near_copies(spark, mixed):
    assert answers(spark.createDataFrame(mixed, "doc_id long, text string")) == brute(mixed)


def test_families_at_five_words_and_80_percent(spark, mixed):
    plan = jaccard_regions.Plan(percent=80, width=5)
    assert answers(spark.createDataFrame(mixed, "doc_id long, text string"), plan) == brute(mixed, 80, 5)


def test_heavy_parts_and_many_packs(spark, mixed, monkeypatch):
    """Parts that many sets hold send one of them from each pack."""
    monkeypatch.setattr(jaccard_regions, "HEAVY", 2)
    monkeypatch.setattr(jaccard_regions, "PACKED", 300)
    monkeypatch.setattr(jaccard_regions, "SALTS", 3)
    assert answers(spark.createDataFrame(mixed, "doc_id long, text string")) == brute(mixed)


def test_sets_survive_packing():
    h = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64))
    assert (jaccard_regions.unpack_set(jaccard_regions.pack_set(h)) == np.sort(h & np.uint64((1 << 48) - 1))).all()


def test_one_row_stays_of_an_id_with_two_texts(spark):
    rows = [(1, "b c d"), (1, "a b c"), (2, "x y z"), (3, "b c d")]
    kept = jaccard_regions.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c"), (2, "x y z")]


def test_copies_send_no_parts(spark, monkeypatch):
    """Copies in other packs make no part a shared one, and what was kept on the way is deleted once it is used."""
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(120)) for _ in range(40)]
    rows = [(1000 * copy + i, t) for copy in range(6) for i, t in enumerate(texts)]
    made, keep = {}, jaccard_regions.keep

    def kept(df, name):
        made[name] = keep(df, name)
        counts[name] = made[name].count()
        return made[name]

    counts = {}
    monkeypatch.setattr(jaccard_regions, "PACKED", 300)
    monkeypatch.setattr(jaccard_regions, "keep", kept)
    assert answers(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == Counter((i, 118, i % 1000) for i, _ in rows)
    assert counts["shared-parts"] == 0 and counts["set-rows"] == len(rows)
    left = os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    assert not [x for x in left if x.startswith("shingle-sets") or x.startswith("shared-parts")]


def test_ids_on_the_same_bits_as_gone_ones_stay(spark, monkeypatch):
    """A filter of 64 bits: nearly every id that stays shares a bit with one that goes, and two rows share an id."""
    monkeypatch.setattr(jaccard_regions, "FILTER_BITS", 64)
    rows = [(i, f"text number {i % 50} of fifty") for i in range(200)] + [(300 + i, f"alone {i} a b") for i in range(100)]
    rows += [(300, "alone 0"), (None, "text number 1 of fifty"), (None, None), (500, None)]
    kept = jaccard_regions.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    want = [(i, t) for i, t in rows if i is None or i < 50 or i > 300] + [(300, "alone 0")]
    assert Counter(map(tuple, kept.collect())) == Counter(want)


def test_large_regions_are_divided(spark, mixed, monkeypatch):
    monkeypatch.setattr(jaccard_regions, "LEAF_SETS", 6)
    assert answers(spark.createDataFrame(mixed, "doc_id long, text string")) == brute(mixed)


def test_blocks_join_what_does_not_shrink(spark, mixed, monkeypatch):
    monkeypatch.setattr(jaccard_regions, "LEAF_SETS", 6)
    monkeypatch.setattr(jaccard_regions, "ROUNDS", 1)
    assert answers(spark.createDataFrame(mixed, "doc_id long, text string")) == brute(mixed)


@pytest.mark.parametrize("more", [8, 1])
def test_empty_parts_are_made_up_for(spark, mixed, monkeypatch, more):
    """With hardly more parts than can differ, many sets are unsure of meeting and further parts are needed."""
    monkeypatch.setattr(jaccard_regions, "MORE", more)
    monkeypatch.setattr(jaccard_regions.Plan, "parts_of", lambda self, c: self.differ(int((10 / 9) ** (4 * c + 5)) + 1) + 1)
    assert answers(spark.createDataFrame(mixed, "doc_id long, text string")) == brute(mixed)


def test_leaves_against_brute_force():
    rng = np.random.default_rng(2)
    plan = jaccard_regions.Plan()
    base = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
    sets = []
    for _ in range(80):
        s = base.copy()
        s[rng.integers(0, 60, rng.integers(0, 5))] = rng.integers(0, 1 << 60)
        sets.append(np.unique(s))
    ids = np.arange(80)
    label = list(range(80))
    for a, b in jaccard_regions.leaf_links(ids, sets, plan):
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both)
        label = [label[a] if x == label[b] else x for x in label]
    for i in range(80):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                assert label[i] == label[j]


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.where("doc_id is not null").collect()]
    want = brute(rows)
    got = Counter(tuple(r) for r in jaccard_regions.classes(odd).collect())
    assert got - Counter({k: v for k, v in got.items() if k[0] is None}) == want
    assert [k for k in got if k[0] is None] == [(None, 9, None)]
    kept = jaccard_regions.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 5, 6, 7, 8, 9]
    assert kept.where("doc_id is null").count() == 1
    assert jaccard_regions.classes(odd.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(3, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 100 for i in range(100, 161)} | {7: 7} | {k: 7 for k in range(8, 40)}


def test_hilbert_curve_visits_neighbours():
    side = 8
    grid = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_neighbours.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(side**3))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def exact(rows, k=10):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], dtype=np.float64)
    out = {}
    for q in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        far[ids == ids[q]] = np.inf
        order = np.lexsort((ids, far))
        out[ids[q]] = [(int(ids[i]), far[i]) for i in order if np.isfinite(far[i])][:k]
    return out


def recall(got, want):
    found = sum(len({i for i, _ in want[q]} & {r.vec_id for r in got.get(q, [])}) for q in want)
    return found / sum(map(len, want.values()))


def by_query(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append(r)
    return out


def test_op8_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = exact(rows), by_query(plans.op8_hilbert(spark, sf))
    assert set(got) == set(want) and recall(got, want) >= 0.9
    truth = {q: dict(w) for q, w in exact(rows, len(rows)).items()}
    for q, found in got.items():
        assert [r["rank"] for r in found] == list(range(1, len(want[q]) + 1))
        assert all(abs(r.score - truth[q][r.vec_id]) < 1e-12 for r in found)
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)


def test_neighbours_of_odd_vectors(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4)], "e") for i in range(300)]
    rows[100] = (100, rows[0][1], "e")
    rows += [(300 + i, v, "e") for i, v in enumerate([None, [0.0] * 4, [1.0, nan, 0.0, 0.0], [inf, 0.0, 0.0, 0.0], [1.0, None, 0.0, 0.0], [1.0, 2.0]])]
    rows += [(1000 + i, [1.0, 1.0, 1.0, 1.0], "e") for i in range(400)] + [rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, keys string")
    monkeypatch.setattr(hilbert_neighbours, "BLOCK_ROWS", 50)
    got = by_query(hilbert_neighbours.search(df, F.col("id") % 100 == 0))
    fine = {i: v for i, v, _ in rows if not 300 <= i < 306}
    want = exact(sorted(fine.items()))
    assert set(got) == set(want) == {0, 100, 200, 1000, 1100, 1200, 1300}
    assert got[0][0].vec_id == 100 and got[0][0].score == 0
    assert [r.vec_id for r in got[1000]] == list(range(1001, 1011))
    assert recall(got, want) >= 0.9
    few = hilbert_neighbours.search(df.where("vec_id < 4"), F.col("id") % 100 == 0)
    assert [r.vec_id for r in few.orderBy("rank").collect()] == [i for i, _ in exact(rows_small(rows))[0]]
    assert hilbert_neighbours.search(df.limit(0), F.col("id") % 100 == 0).count() == 0


def rows_small(rows):
    return [(i, v) for i, v, _ in rows if i < 4]


def test_neighbours_beside_a_third_of_copies(spark):
    """Queries near a vector that a third of the rows repeat find the copies, which fill many quantiles of every curve."""
    rng = np.random.default_rng(8)
    hot = rng.normal(size=16)
    v = rng.normal(size=(21_000, 16)) * 2
    v[rng.permutation(21_000)[:7_000]] = hot
    v[::100] = hot + rng.normal(size=(210, 16)) * 0.05
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = by_query(hilbert_neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 100 == 0))
    assert len(got) == 210 and recall(got, exact(rows)) >= 0.9
