"""Properties that must hold whatever the data: round trips, chunk independence, brute force, batch = stream."""

import json

import pytest
from pyspark.sql import functions as F

from cadaspark.functions import geo, parsing, textrules, units
from cadaspark.operators import cells, governance, ordered, rings, spatial
from cadaspark.plans import sources as plan
from cadaspark.sources import bridge, readers
from cadaspark.streaming import streams

SF = "/root/testdata/sf0.001"


def test_utm_round_trip(spark):
    spots = bridge.parcels(spark, SF).select("parcel_id", "lat", "lng", geo.utm_zone(F.col("lng")).alias("zone"))
    there = geo.with_utm(spots, "lat", "lng", "zone")
    back = geo.with_latlng(there, "e", "n", "zone", "lat2", "lng2")
    worst = back.select(F.max(F.greatest(F.abs(F.col("lat") - F.col("lat2")), F.abs(F.col("lng") - F.col("lng2"))))).first()[0]
    assert worst < 1e-8


def test_reversed_ring_keeps_area(spark):
    st = bridge.stations(spark, SF)
    turned = rings.clockwise(st)
    a = rings.metric_shape(st).select("run_id", F.col("area_m2").alias("a"))
    b = rings.metric_shape(turned).select("run_id", F.col("area_m2").alias("b"), "ccw")
    both = a.join(b, "run_id")
    assert both.filter("abs(a - b) > 1e-3 OR ccw").count() == 0


@pytest.mark.parametrize("size", [2, 3, 1000])
def test_chunks_do_not_change_results(spark, size):
    """One run holding all rows, cut into chunks of any size, gives the plain window's answer."""
    rows = spark.range(50).select(F.lit(1).alias("run_id"), F.col("id").alias("seq"), (F.col("id") * 7 % 13).alias("v"))
    chunk = F.floor(F.col("seq") / size)
    sums = ordered.running_sums(rows, ["run_id"], ["seq"], chunk, {"s": F.col("v")})
    nxt = ordered.with_next(rows, ["run_id"], ["seq"], chunk, ["v"])
    prev = ordered.with_previous(rows, ["run_id"], ["seq"], chunk, ["v"])
    values = [i * 7 % 13 for i in range(50)]
    assert [r.s for r in sums.orderBy("seq").collect()] == [sum(values[: i + 1]) for i in range(50)]
    assert [r.nxt and r.nxt.v for r in nxt.orderBy("seq").collect()] == [*values[1:], None]
    assert [r.prev and r.prev.v for r in prev.orderBy("seq").collect()] == [None, *values[:-1]]


@pytest.mark.parametrize("base", [700.0, 1000.0, 2500.0])
def test_nearest_is_exact_for_any_cell(spark, monkeypatch, base):
    monkeypatch.setattr(cells, "BASE_M", base)
    monkeypatch.setattr(cells, "DESCENT", (int(80000 / base) + 1, 10, 1))
    spots = bridge.parcels(spark, SF).select("parcel_id", "lat", "lng")
    roads = bridge.lines(spark, SF).filter("layer = 'road'")
    got = {r.parcel_id: r.road_m for r in spatial.nearest_road(spots, roads).collect()}
    probe = cells.project_points(spots)
    pairs = probe.join(cells.project_lines(roads), "zone").withColumn("d", cells.line_distance())
    want = {r.parcel_id: r.d for r in pairs.groupBy("parcel_id").agg(F.min("d").alias("d")).collect()}
    for key, value in got.items():
        brute = want.get(key)
        if value is None:
            assert brute is None or brute > spatial.ROAD_BOUND_M
        else:
            assert value == pytest.approx(brute, abs=0.051)


def test_nearest_stays_exact_and_flat_in_a_crowded_city(spark, monkeypatch):
    """20,000 short segments in one square kilometre: places there meet few of them, and answers equal those of all pairs."""
    k = F.col("id")
    city = spark.range(20_000).select(
        k.alias("feature_id"), (6.5 + (k * 7919 % 10007) / 10007 * 0.008).alias("lat1"), (3.4 + (k * 104729 % 9973) / 9973 * 0.008).alias("lng1")
    ).withColumns({"lat2": F.col("lat1") + 0.00002, "lng2": F.col("lng1") + 0.00003})
    spots = spark.range(200).select(k.alias("parcel_id"), (6.499 + (k * 37 % 200) / 200 * 0.01).alias("lat"), (3.399 + (k * 91 % 199) / 199 * 0.01).alias("lng"))
    met_rows = []
    whole = cells._split_dense

    def watched(met, filed):
        met, filed = whole(met, filed)
        met_rows.append(met.join(filed, ["zone", "level", "cx", "cy"]).count())
        return met, filed

    monkeypatch.setattr(cells, "_split_dense", watched)
    got = {r.parcel_id: r.road_m for r in spatial.nearest_road(spots, city).collect()}
    pairs = cells.project_points(spots).join(cells.project_lines(city), "zone").withColumn("d", cells.line_distance())
    want = {r.parcel_id: r.d for r in pairs.groupBy("parcel_id").agg(F.min("d").alias("d")).collect()}
    assert len(got) == 200 and all(got[i] == pytest.approx(want[i], abs=0.051) for i in got)
    assert met_rows[0] < 200 * 800  # of 20,000 a place


def test_hot_place_and_copies(spark):
    """Copies of one place and one crowded cell change nothing but the counts."""
    spots = spark.range(300).select((F.col("id")).alias("parcel_id"), F.lit(6.5).alias("lat"), F.lit(3.4).alias("lng"))
    goals = spark.range(500).select((6.5 + (F.col("id") % 50) * 0.0001).alias("lat"), F.lit(3.4).alias("lng"))
    out = spatial.building_rings(spots, goals).select("n1", "n5", "n10").distinct().collect()
    assert [tuple(r) for r in out] == [(500, 500, 500)]


def test_overlap_counts_equal_pairs(spark):
    rows = [(1, "t", "a", None, False), (2, "t", "a", None, False), (3, "t", None, None, False), (4, "s", "x", "y", True),
            (5, "s", "z", "y", True), (6, "s", "q", None, True), (7, "s", "m", "n", True)]
    owners = spark.createDataFrame(rows, "owner int, channel string, hash_1 string, hash_2 string, two_keys boolean")
    got = {r.owner: (r.matching_partners, r.unknown_partners) for r in governance.credential_overlap(owners).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 2), 4: (1, 1), 5: (1, 1), 6: (0, 3), 7: (0, 1)}


def test_call_limit_batch_equals_stream(spark):
    batch = streams.call_limit(plan._events(spark, SF)).select("run_id", "longest", "abort")
    live = streams.run_to_table(streams.call_limit_stream(plan._event_stream(spark, SF).select("run_id", "event_id", "ts", "valid")), "update", ["run_id"])
    want = {tuple(r) for r in batch.collect()}
    got = {tuple(r) for r in live.filter("longest > 0").collect()}
    assert got == want


def test_session_state_batch_equals_stream(spark):
    batch = streams.session_state(plan._events(spark, SF))
    live = streams.run_to_table(streams.session_state(plan._event_stream(spark, SF)), "update", ["run_id"])
    assert {tuple(r) for r in batch.collect()} == {tuple(r) for r in live.select(*batch.columns).collect()}


def test_gate_expires_unconfirmed(spark):
    subs = spark.sql("SELECT 1L AS run_id, TIMESTAMP '2024-01-01 00:00:00' AS ts UNION ALL SELECT 2L, TIMESTAMP '2024-01-01 00:00:00'")
    conf = spark.sql("SELECT 1L AS run_id, TIMESTAMP '2024-01-01 05:00:00' AS ts UNION ALL SELECT 2L, TIMESTAMP '2024-01-03 00:00:00'")
    out = {r.run_id: r.status for r in streams.stream_gate(subs, conf, expired=True).collect()}
    assert out == {1: "running", 2: "cancelled"}


@pytest.mark.parametrize(
    "raw,value",
    [("550,821.575", 550821.575), ("1,440,000", 1440000.0), ("550852-254", 550852.254), ("550 852.25", 550852.25),
     ("550852,254", 550852254.0), ("550852,25", 550852.25), ("abc", None), ("", None), ("12.5.6", None)],
)
def test_cleanse_numeric(spark, raw, value):
    assert spark.range(1).select(parsing.cleanse_numeric(F.lit(raw))).first()[0] == value


@pytest.mark.parametrize(
    "state,sqm,label",
    [("Lagos", 648.0, "Lagos"), ("Rivers State", 465.0, "Rivers"), ("akwa-ibom", 648.0, "Akwa Ibom"), ("fct", 900.0, "FCT"),
     ("KANO", 900.0, "Kano"), ("nowhere", 648.0, "Std."), (None, 648.0, "Std.")],
)
def test_plot_standard(spark, state, sqm, label):
    got = spark.range(1).select(*units.plot_standard(F.lit(state).cast("string"))).first()
    assert tuple(got) == (sqm, label)


@pytest.mark.parametrize(
    "host,private",
    [("localhost", True), ("a.local", True), ("10.1.2.3", True), ("172.32.0.1", False), ("192.0.1.1", False), ("8.8.8.8", False),
     ("[::1]", True), ("::ffff:10.0.0.1", True), ("::ffff:a00:1", True), ("2001:db8::1", True), ("2606:4700::1", False),
     ("fd00::1", True), ("example.com", False), ("256.1.1.1", False), ("notlocal", False)],
)
def test_private_host(spark, host, private):
    assert spark.range(1).select(textrules.private_host(F.lit(host))).first()[0] is private


def test_redact_partial_masks(spark):
    got = spark.range(1).select(textrules.redact_partial(F.lit("x sk-abcdefghijklmnopqrst y"))).first()[0]
    assert got == "x sk-a" + "*" * 19 + " y"


def test_station_csv_quoted_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Beacon,N,E\nP1,"550,821.5",387804-25\n\n,550900,387900\nP4,bad,1\n')
    rows = readers.read_stations_csv(spark, str(tmp_path)).orderBy("row_index").collect()
    assert [(r.station_id, r.e, r.n) for r in rows] == [("P1", 387804.25, 550821.5), ("S3", 387900.0, 550900.0)]
    assert readers.read_stations_csv(spark, str(tmp_path), errors=True).count() == 1


def test_kml_and_registry_files(spark, tmp_path):
    (tmp_path / "kml").mkdir()
    (tmp_path / "kml" / "p.kml").write_text("<kml><coordinates>3.5,6.6,0 3.6,6.6 3.6,6.7</coordinates></kml>")
    assert [(r.lat, r.lng) for r in readers.read_kml(spark, str(tmp_path / "kml")).orderBy("seq").collect()] == [(6.6, 3.5), (6.6, 3.6), (6.7, 3.6)]
    (tmp_path / "reg").mkdir()
    record = {"id": "A", "centroid": {"lat": 6.5, "lng": 3.5}, "permitted_uses": ["x"]}
    (tmp_path / "reg" / "list.json").write_text(json.dumps([record, {**record, "id": "B"}], indent=1))
    (tmp_path / "reg" / "one.json").write_text(json.dumps({**record, "id": "C"}, indent=1))
    (tmp_path / "reg" / "zbad.json").write_text("{ not json")
    got = readers.read_registry_json(spark, str(tmp_path / "reg")).orderBy("record_order").collect()
    assert [r.id for r in got] == ["A", "B", "C"]


def test_parcels_without_position_keep_their_row(spark):
    spots = spark.createDataFrame([(1, 6.5, 3.4), (2, None, None)], "id int, lat double, lng double")
    goals = spark.range(5).select(F.lit(6.5).alias("lat"), F.lit(3.4).alias("lng"))
    got = {r.id: r.n1 for r in spatial.building_rings(spots, goals).collect()}
    assert got == {1: 5, 2: None}


def test_functions_cut_nothing_unless_told(spark):
    long = "x" * 900
    got = spark.range(1).select(
        textrules.redact_sensitive(F.lit(long)).alias("a"), textrules.redact_sensitive(F.lit(long), width=240).alias("b"),
        textrules.parse_summary(F.lit(long))["summary"].alias("c"), textrules.redact_partial(F.lit("sk-" + "a" * 60)).alias("d"),
        textrules.input_hazard(F.lit("you are now a " + "z" * 100))["hazard_match"].alias("e"),
    ).first()
    assert (got.a, got.b, got.c) == (long, long[:240], long)
    assert got.d == "sk-a" + "*" * 59 and got.e == "you are now a " + "z" * 100


def test_allow_list(spark):
    rows = spark.range(10).withColumnRenamed("id", "user")
    lists = spark.createDataFrame([(" 3, 5,,8 ",), (None,), ("5",)], "ids string")
    allowed = governance.parse_allow_list(lists, "ids")
    assert sorted(r.user for r in governance.allow_list_filter(rows, "user", allowed).collect()) == [3, 5, 8]
    assert governance.allow_list_filter(rows, "user", allowed.limit(0)).count() == 10


def test_csv_fields(spark):
    lines = ['a,b,c', '"x,y",2,"he said ""no, never"""', ',,', '"' + "q," * 50_000 + '",end', ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "line string").select(readers._fields(F.col("line"))).collect()]
    assert got == [["a", "b", "c"], ["x,y", "2", 'he said "no, never"'], ["", "", ""], ["q," * 50_000, "end"], [""]]
