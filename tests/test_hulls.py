"""Farthest pairs, clipped axes and self-crossings against every pair of a ring."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadaspark.operators import hulls, raster, rings

METRIC = "run_id long, zone int, seq long, e double, n double"


def first_longest(points):
    pairs = [(-math.floor(math.dist(p, q) * 1000 + 0.5), i, j) for (i, p), (j, q) in itertools.combinations(enumerate(points), 2) if p != q]
    return min(pairs)[1:] if pairs else (0, 0)


def ring_of(rng, n, kind):
    if kind == "grid":  # many equal lengths and repeated vertices
        return [(float(rng.randrange(4)), float(rng.randrange(4))) for _ in range(n)]
    if kind == "circle":
        return [(100 * math.cos(2 * math.pi * k / n), 100 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return [(rng.uniform(0, 500), rng.uniform(0, 90)) for _ in range(n)]


@pytest.mark.parametrize("chunk", [3, 4096])
def test_longest_pairs_equal_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(hulls, "CHUNK", chunk)
    rng = random.Random(6)
    outlines = [ring_of(rng, rng.choice([1, 2, 3, 5, 9, 40, 150]), kind) for kind in ("grid", "circle", "any") for _ in range(25)]
    outlines.append([(7.0, 8.0)] * 5)
    rows = [(i, 31, s, *p) for i, ring in enumerate(outlines) for s, p in enumerate(ring)]
    got = {r.run_id: (r.seq, r.seq2, r.e, r.n, r.qe, r.qn) for r in hulls.longest_pairs(spark.createDataFrame(rows, METRIC)).collect()}
    assert set(got) == set(range(len(outlines)))
    for i, ring in enumerate(outlines):
        a, b = first_longest(ring)
        assert got[i] == (a, b, *ring[a], *ring[b]), i


def test_farthest_corners_by_monotony():
    rng = np.random.default_rng(3)
    for n in (65, 100, 257):
        a = np.sort(rng.uniform(0, 2 * math.pi, n))
        x, y = 300 * np.cos(a), 20 * np.sin(a)
        outline = hulls.hull(x, y)
        x, y = x[outline], y[outline]
        want = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2).max(axis=1)
        assert np.array_equal(hulls.farthest(x, y), want)


def test_a_round_outline_of_many_vertices(spark):
    n = 100_000
    turn = F.col("id") * (2 * math.pi / n)
    ring = spark.range(n).select(
        F.lit(1).cast("long").alias("run_id"), F.lit(31).alias("zone"), F.col("id").alias("seq"), (1000 * F.cos(turn)).alias("e"), (1000 * F.sin(turn)).alias("n")
    )
    axis = raster.longest_axis(ring).first()
    assert axis.seq == 0 and math.hypot(axis.qe - axis.e, axis.qn - axis.n) == pytest.approx(2000, abs=1e-3)


def axis_of(spark, ring):
    rows = [(1, 31, s, *map(float, p)) for s, p in enumerate(ring)]
    r = raster.longest_axis(spark.createDataFrame(rows, METRIC)).first()
    return tuple(round(v, 6) for v in (r.e, r.n, r.qe, r.qn))


def test_clipped_axes(spark):
    assert axis_of(spark, [(0, 0), (4, 0), (4, 3), (0, 3)]) == (0, 0, 4, 3)
    # a notch cuts the axis in two unequal pieces
    assert axis_of(spark, [(0, 0), (10, 0), (10, 1), (7, 1), (7, -0.5), (6, -0.5), (6, 1), (0, 1)])[0:2] == (0, 0)
    # the axis runs along an edge
    assert axis_of(spark, [(0, 0), (9, 0), (5, 2)]) == (0, 0, 9, 0)
    # the axis lies outside but for its ends
    assert axis_of(spark, [(0, 0), (5, -4), (10, 0), (5, -5)]) == (0, 0, 10, 0)
    assert axis_of(spark, [(5, 5)] * 4) == (5, 5, 5, 5)


def meets(p, q, r, s):
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    within = lambda a, b, c: min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])
    d = turn(r, s, p), turn(r, s, q), turn(p, q, r), turn(p, q, s)
    if d[0] * d[1] < 0 and d[2] * d[3] < 0:
        return True
    return any(v == 0 and within(*ab, c) for v, ab, c in zip(d, ((r, s), (r, s), (p, q), (p, q)), (p, q, r, s)))


def crosses(ring):
    edges = list(zip(ring, ring[1:] + ring[:1]))
    m = len(edges)
    return any(meets(*edges[i], *edges[j]) for i in range(m) for j in range(i + 2, m) if not (i == 0 and j == m - 1))


def test_self_crossings_equal_all_pairs(spark):
    rng = random.Random(12)
    outlines = []
    for _ in range(60):
        n = rng.randint(4, 9)
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        ring = [(round(math.cos(a) * rng.uniform(1, 40), 3), round(math.sin(a) * rng.uniform(1, 40), 3)) for a in turns]
        outlines.append(ring)
    rows = [(i, s, *p) for i, ring in enumerate(outlines) for s, p in enumerate(ring)]
    frame = spark.createDataFrame(rows, "run_id long, seq long, lng double, lat double")
    got = {r.run_id: r.self_intersecting for r in rings.self_intersection(frame).collect()}
    want = {i: crosses(ring) for i, ring in enumerate(outlines)}
    assert got == want and len(set(want.values())) == 2


def test_one_long_edge_stays_local(spark):
    """A saw of many short edges closed by one long one: few pairs meet, and a crossing of the long edge is found."""
    n = 20_000
    saw = spark.range(n).select(F.lit(1).alias("run_id"), F.col("id").alias("seq"), (F.col("id") * 0.001).alias("lng"), (F.col("id") % 2 * 0.001 + 0.01).alias("lat"))
    dipped = saw.withColumn("run_id", F.lit(2)).withColumn("lat", F.when(F.col("seq") == 7000, -0.5).otherwise(F.col("lat")))
    both = saw.union(dipped.where(F.col("seq") < n))
    # the closing edge runs along the lower tips; lower the ends so that it runs beneath them
    both = both.withColumn("lat", F.when(F.col("seq").isin(0, n - 1), 0.0).otherwise(F.col("lat")))
    got = {r.run_id: r.self_intersecting for r in rings.self_intersection(both).collect()}
    assert got == {1: False, 2: True}
