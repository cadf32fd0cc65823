"""What must not grow with the tables: broadcasts, and the rows that one task makes of a small file."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from cadaspark.plans import catalog
from cadaspark.sources import bridge

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["slope_pct", "sample_elevation", "internal_profile", "profile_range", "outfall_distance", "outfall_profile", "screen_parcels",
             "outfall_asset", "bowditch_adjust", "apply_dialog_answers", "self_intersection", "scan_station_table", "cadastral_summary", "detect_crs", "flip_test"]
)
def test_tables_that_grow_are_not_broadcast(spark, name):
    assert "BroadcastExchange" not in plan_of(QUERIES[name](spark, SF))


def plans_run(spark, name):
    """The plans of all steps that a query runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    made = store.executionsList(before, 1000)
    return [made.apply(k).physicalPlanDescription() for k in range(made.size())]


def test_screening_is_planned_layer_by_layer(spark):
    """The driver keeps the plans of all steps that run: none of them holds all layers at once."""
    plans = plans_run(spark, "screen_parcels")
    assert plans and max(len(x) for x in plans) < 100_000


def test_zone_of_grids_reads_no_text_for_its_datum(spark):
    plans = plans_run(spark, "minna_zone")
    assert plans and not [x for x in plans if "nigerian" in x or "crs_confidence" in x or "detected_crs" in x]


def test_base_rows_are_dealt_out(spark, tmp_path):
    rows = 3 * bridge.TASK_ROWS
    made = spark.range(rows).select(F.col("id").alias("c_custkey"), F.lit("a").alias("c_mktsegment"))
    made.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    base = bridge.parcel_base(spark, str(tmp_path))
    sizes = base.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r[1] for r in sizes) == rows
    assert max(r[1] for r in sizes) < 2 * bridge.TASK_ROWS


def test_area_sums_follow_the_ring(spark):
    """Bow-ties without area: the sign is that of the sum taken in the order of the ring, wherever its vertices lie."""
    from cadaspark.operators import rings

    def sign(points):
        total = 0.0
        for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]]):
            total += (x2 - x1) * (y2 + y1)
        return total < 0

    made, expected = [], {}
    rng = random.Random(5)
    for run in range(2000):
        e, n, dx, dy = rng.uniform(3e5, 7e5), rng.uniform(4e5, 1e6), rng.uniform(20, 90), rng.uniform(20, 90)
        points = [(e - dx, n - dy), (e + dx, n - dy), (e - dx, n + dy), (e + dx, n + dy)]
        expected[run] = sign(points)
        made += [(run, i, *p) for i, p in enumerate(points)]
    table = spark.createDataFrame(made, "run_id long, seq int, e double, n double").repartition(7, "seq")
    # tables of this size would end up in one partition, in order by chance
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r[0]: r[1] for r in rings.metric_shape(table).select("run_id", "ccw").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == expected


def test_stations_are_sorted_few_times_in_a_task(spark):
    """Every sort of a stage holds a page of its own in each task, 64 MB on large executors."""
    assert plan_of(QUERIES["scan_station_table"](spark, SF)).count("Sort [") <= 8


def test_cheap_tests_spare_no_text_that_counts(spark):
    """Whatever a pattern finds in a text or a line, the cheap test of the raw text finds too."""
    from cadaspark.functions import parsing as p

    rng = random.Random(11)
    pieces = ["1", "12", "123", "1234", "123456", "7654321", ",", ", ", ".", " ", "-", "°", "'", '"', "N", "E", "W", "\n", "\t", "m", "x", "utm zone 31 n",
              "UTM Zone 32N", "Clarke 1880", "MINNA", "Nigerian datum", "/LA/", "45 10 ", "6.5244", "3,456", "1,234,567", "12.5N "]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(20000)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", None]], "t string")
    t = F.col("t")
    clean = p.strip_thousands(t)
    some = lambda v, n=1: F.size(v) >= n
    formats = [some(p.matches(clean, pattern)) for pattern in p.FORMATS.values()]
    missed = df.where(
        (some(p.matches(p.mend_line(t), p.UTM_SCALE)) & ~t.rlike(p.MAY_SCALE))
        | (some(p.scale_numbers(p.mend_line(F.regexp_replace(t, "\n", " "))), 2) & (F.size(p.matches(t, p.MAY_SCALE)) < 2))
        | (t.rlike(p.BEARING) & ~t.rlike(p.MAY_LEG))
        | ((formats[0] | formats[1] | formats[2] | formats[3] | formats[4]) & ~t.rlike(p.MAY_FORMAT))
        | (t.rlike(p.MINNA_TEXT) != p.names_minna(t))
        | (F.regexp_extract(t, p.ZONE_LETTER, 1) != p.named_zone(t))
    )
    assert missed.take(5) == []
    assert df.where(some(p.matches(p.mend_line(t), p.UTM_SCALE))).count() > 1000


def test_texts_are_read_once(spark, monkeypatch):
    """Points, datum, zones and marks come from one pass: only it reads the texts, and it keeps none that hold no three points."""
    from cadaspark.operators import crs
    from cadaspark.plans import crs as plans

    seen = []

    def kept(df, name):
        seen.append((name, plan_of(df).count("FileScan parquet")))
        return keep(df, name)

    keep = plans.keep
    monkeypatch.setattr(plans, "keep", kept)
    monkeypatch.setattr(crs, "keep", kept)
    df = plans.QUERIES["extract_parcels"](spark, SF)
    assert "raw_text" not in plan_of(df)
    assert [name for name, _ in seen] == ["read-texts", "points", "detected", "tagged"]
    subs = spark.createDataFrame([(1, "no numbers", None, None), (2, "12 34 and 5.6 only", None, None)], "run_id long, raw_text string, coordinate_hint string, datum_label string")
    from cadaspark.operators import extract

    assert extract.first_format(subs).where("hit IS NOT NULL OR rest IS NOT NULL").count() == 0


def test_one_pass_spares_no_text_with_points(spark):
    """``first_format`` finds what the patterns alone find, and leaves the text wherever three stations stand in it."""
    from cadaspark.functions import parsing as p
    from cadaspark.operators import crs, extract

    rng = random.Random(12)
    pairs = ["6.52,3.37", "6.5244N 3.3792E", "6°31'27.8\"N 3°22'45.1\"E", "543210E 712345N", "543210 712345", "543,210.5 1,712,345", "6.52 3.37", "6 31 27N 3 22 45E",
             "BP1 E: 543210.1 N: 712345.2", "543210-254 712345", "1 2", "1234567 ", "UTM zone 31 N", "cLARKE\t1880", "/BO/", "7"]
    texts = ["".join(rng.choice(pairs) + rng.choice(["; ", "\n", " ", ", "]) for _ in range(rng.randint(1, 8))) for _ in range(4000)]
    subs = spark.createDataFrame(
        [(i, t, None, rng.choice([None, "1880", "Minna"])) for i, t in enumerate([*texts, "", None])], "run_id long, raw_text string, coordinate_hint string, datum_label string"
    )
    clean = p.strip_thousands(F.col("raw_text"))
    plain = F.coalesce(*[F.when(F.size(p.matches(clean, v)) >= 3, F.struct(F.lit(k).alias("fmt"), p.matches(clean, v).alias("found"))) for k, v in p.FORMATS.items()])
    expected = {r.run_id: r.hit for r in subs.select("run_id", plain.alias("hit")).collect()}
    tried = extract.first_format(crs.with_text_facts(subs)).cache()
    rows = tried.collect()
    assert {r.run_id: r.hit for r in rows} == expected
    assert len({r.hit.fmt for r in rows if r.hit}) == 5
    stations = extract.scan_station_table(subs).groupBy("run_id").count().where("count >= 3")
    assert stations.join(tried.where("hit IS NULL AND rest IS NULL"), "run_id").count() == 0
    text = F.concat("raw_text", F.lit(" "), F.coalesce("datum_label", F.lit("")))
    facts = subs.select(
        "run_id", text.rlike(p.MINNA_TEXT).alias("minna_text"), F.coalesce(F.regexp_extract(text, p.ZONE_LETTER, 1), F.lit("")).alias("zone_text"),
        F.coalesce(F.regexp_extract("raw_text", p.ZONE_LETTER, 1), F.lit("")).alias("own_zone"),
    )
    assert facts.exceptAll(tried.select(*facts.columns)).count() == 0


def rows_shuffled(spark, run):
    """Rows that all stages of ``run`` write to shuffles."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark._jvm

    def stages():
        sc.listenerBus().waitUntilEmpty()
        made = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {made.apply(k).stageId(): made.apply(k).shuffleWriteRecords() for k in range(made.size())}

    before = max(stages(), default=-1)
    run()
    return sum(rows for stage, rows in stages().items() if stage > before)


def test_nearest_search_lists_few_cells_for_a_place(spark):
    """Places and lines in every cell: no step lists all coarse cells within the bound for every place."""
    from cadaspark.operators import cells

    every = lambda n, step: spark.range(n * n).select((6.0 + F.floor(F.col("id") / n) * step).alias("lat"), (7.0 + F.col("id") % n * step).alias("lng"))
    spots = every(60, 0.012).select(F.col("lat") + 0.6, F.col("lng") + 0.6).toDF("lat", "lng")
    lines = every(100, 0.02).select(F.xxhash64("lat", "lng").alias("feature_id"), F.col("lat").alias("lat1"), F.col("lng").alias("lng1"), (F.col("lat") + 0.003).alias("lat2"), F.col("lng").alias("lng2"))
    found = []
    rows = rows_shuffled(spark, lambda: found.append(cells.nearest(spots, lines, 80000.0, []).agg(F.count("*"), F.max("distance_m")).first()))
    assert found[0][0] == 3600 and 0 < found[0][1] < 2000
    assert rows < 300 * 3600, rows


def test_shuffles_of_a_kept_table_are_deleted(spark):
    """And so are tables that are not needed any more; the session's own setting stays as it was."""
    from cadaspark.sources import scratch

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = blocks.getAllFiles()
        return {n for n in (files.apply(k).getName() for k in range(files.size())) if n.startswith("shuffle_")}

    def kept_here():
        return [x for x in os.listdir(spark.conf.get("spark.checkpoint.dir")) if x.startswith("freed-")]

    before, setting = shuffles(), spark.conf.get(scratch.FREED, None)
    kept = scratch.keep(spark.range(100000).groupBy((F.col("id") % 1000).alias("k")).count(), "freed")
    for _ in range(50):
        left = shuffles() - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(scratch.FREED, None) == setting
    assert len(kept.collect()) == 1000 and len(kept_here()) == 1
    scratch.forget(kept)
    assert not kept_here()
