"""The carried scan against plain lists, with keys that fill many ranges, end at their borders or are null."""

import random

import pytest
from pyspark.sql import functions as F

from cadaspark.operators import carried


def expected(rows):
    by_key = {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        by_key.setdefault(k, []).append((t, v))
    out = set()
    for k, line in by_key.items():
        total = 0
        for i, (t, v) in enumerate(line):
            total += v
            out.add((k, t, v, total, line[i - 1][0] if i else None, line[i + 1] if i + 1 < len(line) else None))
    return out


@pytest.fixture(autouse=True)
def uncoalesced(spark):
    """Small ranges stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("ranges,keys", [(1, 3), (7, 1), (8, 3), (8, 40), (5, 300)])
def test_scan_equals_plain_lists(spark, ranges, keys):
    rng = random.Random(keys)
    rows = [(rng.choice([None, *range(keys)]), t, rng.randrange(9)) for t in rng.sample(range(5000), 300)]
    frame = spark.createDataFrame(rows, "k long, t long, v long").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        done = carried.scan(frame, ["k"], ["t"], {"total": F.col("v")}, {"prev": ["t"]}, {"nxt": ["t", "v"]}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = {(r.k, r.t, r.v, r.total, r.prev and r.prev.t, r.nxt and tuple(r.nxt)) for r in done}
    assert len(done) == 300 and got == expected(rows)


def test_one_key_on_one_day_spreads_over_all_tasks(spark):
    n = 400_000
    rows = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") / n).alias("t"), F.lit(1).cast("long").alias("v"))
    done = carried.scan(rows, ["k"], ["t"], {"place": F.col("v")}, {"prev": ["t"]})
    worst = done.agg(F.max(F.abs(F.col("place") - 1 - F.round(F.col("t") * n))), F.count_if(F.col("prev").isNull()), F.count("*")).first()
    assert tuple(worst) == (0, 1, n)
    ranged = rows.repartitionByRange("k", "t").groupBy(F.spark_partition_id()).count()
    assert ranged.agg(F.max("count")).first()[0] < n / 4


def test_empty_and_without_order(spark):
    none = spark.createDataFrame([], "k long, t long, v long")
    assert carried.scan(none, ["k"], ["t"], {"total": F.col("v")}, {"p": ["t"]}, {"n": ["t"]}).count() == 0
