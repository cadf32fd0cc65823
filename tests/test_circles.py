"""Circle counts against every pair, and no pair of places in the plan."""

import numpy as np

from cadaspark.operators import circles
from cadaspark.plans import catalog


def test_counts_equal_all_pairs():
    rng = np.random.default_rng(3)
    for spread, n in ((30_000.0, 2000), (900.0, 1500), (0.5, 50)):
        px, py = rng.uniform(0, spread, (2, 300)) + 5e5
        gx, gy = rng.uniform(-12_000, spread + 12_000, (2, n)) + 5e5
        gx[:20], gy[:20] = px[:20] + 1000.0, py[:20]  # on the circle
        gw = rng.integers(1, 5, n)
        d = np.sqrt((px[:, None] - gx) * (px[:, None] - gx) + (py[:, None] - gy) * (py[:, None] - gy))
        for radius in (1000.0, 5000.0, 10000.0):
            assert (circles.counts_within(px, py, gx, gy, gw, radius) == ((d <= radius) * gw).sum(axis=1)).all()


def test_many_pairs_are_taken_in_pieces(monkeypatch):
    monkeypatch.setattr(circles, "PAIRS", 100)
    test_counts_equal_all_pairs()


def test_no_broadcast_and_no_join_of_pairs(spark):
    df = catalog.queries()["building_rings"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "FlatMapCoGroupsInArrow" in plan
