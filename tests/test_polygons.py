"""The polygon index against a plain even-odd test of every place with every edge."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cadaspark.operators import polygons

EDGES = "plane int, feature_id long, x1 double, y1 double, x2 double, y2 double"


def ring(feature, corners, plane=0):
    return [(plane, feature, *map(float, p + q)) for p, q in zip(corners, corners[1:] + corners[:1])]


def star(rng, x, y, r, n):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + r * rng.uniform(0.3, 1) * math.cos(a), y + r * rng.uniform(0.3, 1) * math.sin(a)) for a in turns]


def gap(x, y, e):
    _, _, x1, y1, x2, y2 = e
    length = (x2 - x1) ** 2 + (y2 - y1) ** 2
    t = 0 if length == 0 else min(max(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / length, 0), 1)
    return math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))


def plain(places, edges, margin):
    out = {}
    for x, y in places:
        for f in {e[1] for e in edges}:
            mine = [e for e in edges if e[1] == f]
            odd = sum((e[3] > y) != (e[5] > y) and x < (e[4] - e[2]) * (y - e[3]) / (e[5] - e[3]) + e[2] for e in mine) % 2
            d = 0.0 if odd else min(gap(x, y, e) for e in mine)
            if odd or (margin and d <= margin):
                out[x, y, f] = d
    return out


@pytest.mark.parametrize("size,margin", [(1.0, 0.0), (0.3, 0.0), (7.0, 0.0), (1.0, 0.8), (0.4, 1.5), (50.0, 0.5)])
def test_places_in_and_near_outlines(spark, size, margin):
    rng = random.Random(4)
    edges = []
    for f in range(12):
        edges += ring(f, star(rng, rng.uniform(-8, 8), rng.uniform(-8, 8), rng.choice([0.1, 2, 9]), rng.choice([3, 5, 40])))
    edges += ring(20, [(-9, -9), (9, -9), (9, 9), (-9, 9)]) + ring(20, [(-3, -3), (3, -3), (3, 3), (-3, 3)])  # a hole
    edges += ring(21, [(0, 0), (4, 0), (4, 1), (0, 1)]) + ring(22, [(5, 5), (5, 5), (5, 5)])  # on cell borders; a point
    places = [(rng.uniform(-11, 11), rng.uniform(-11, 11)) for _ in range(400)] + [(5.0, 5.3), (100.0, 100.0), (2.0, 1.0), (2.0, 0.0), (4.0, 0.5), (0.0, 0.5), (9.0, 1.0), (-9.0, 1.0)]
    spots = spark.createDataFrame([(0, *p) for p in places], "plane int, x double, y double")
    got = polygons.hits(spots, spark.createDataFrame(edges, EDGES), size, margin).collect()
    want = plain(places, edges, margin)
    assert {(r.x, r.y, r.feature_id) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r.distance - want[r.x, r.y, r.feature_id]) < 1e-9 for r in got)


def test_a_detailed_outline_costs_only_the_edges_of_one_cell(spark):
    n = 100_000
    at = lambda k: (F.lit(50_000.0) * F.cos(2 * math.pi * k / n), F.lit(50_000.0) * F.sin(2 * math.pi * k / n))
    (x1, y1), (x2, y2) = at(F.col("id")), at((F.col("id") + 1) % n)
    edges = spark.range(n).select(F.lit(0).alias("plane"), F.lit(1).alias("feature_id"), *[v.alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2))])
    filed, runs = polygons.index(edges, 500.0)
    assert filed.groupBy("cx", "cy").count().agg(F.max("count")).first()[0] < 400
    assert runs.count() < 2_000
    spots = spark.range(2_000).select(
        F.lit(0).alias("plane"), (F.col("id") * 51.7 - 51_000).alias("x"), (F.col("id") * 17.3 % 997).alias("y")
    )
    inside = {r.x for r in polygons.hits(spots, edges, 500.0).collect()}
    # between the circle and its chords lie 25 micrometres
    assert inside == {r.x for r in spots.collect() if math.hypot(r.x, r.y) < 50_000}


def test_no_outlines_and_no_places(spark):
    none = spark.createDataFrame([], EDGES)
    spots = spark.createDataFrame([(0, 1.0, 1.0)], "plane int, x double, y double")
    assert polygons.hits(spots, none, 1.0).count() == 0
    assert polygons.hits(spots.limit(0), spark.createDataFrame(ring(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)]), EDGES), 1.0).count() == 0
