"""Reference cases from raw text: extraction outcome, dialogs and, for four parcels, the screening result."""

import math

import pytest
from pyspark.sql import functions as F

from cadaspark.operators import cadastral, crs, extract, measure, rings
from cadaspark.operators.raster import tile_of

# The inputs of the reference cases.
CASES = {
    1: ("6.6018N 3.5062E; 6.6025N 3.5075E; 6.6010N 3.5080E; 6.6003N 3.5067E; 6.6018N 3.5062E", None, None),
    2: ("6.4355N 3.5912E; 6.4362N 3.5925E; 6.4348N 3.5930E; 6.4341N 3.5917E; 6.4355N 3.5912E", None, None),
    3: ("4.8156N 7.0498E; 4.8163N 7.0511E; 4.8149N 7.0516E; 4.8142N 7.0503E; 4.8156N 7.0498E", None, None),
    4: ("5.1100N 6.7300E; 5.1107N 6.7313E; 5.1093N 6.7318E; 5.1086N 6.7305E; 5.1100N 6.7300E", None, None),
    5: ("727543.0 650182.0; 727556.0 650195.0; 727542.0 650200.0; 727529.0 650187.0; 727543.0 650182.0", "UTM_SWAPPED", None),
    6: ("6.6018N 3.5062E; 6.6025N 3.5075E; 6.6010N 3.5080E; 6.6003N 3.5067E", None, None),
    7: ("6.5912N 3.3501E; 6.5919N 3.3514E; 6.5905N 3.3519E; 6.5898N 3.3506E; 6.5912N 3.3501E", "MINNA_DATUM", "Clarke 1880"),
    8: ("3.8667N 11.5167E; 3.8674N 11.5180E; 3.8660N 11.5185E; 3.8653N 11.5172E; 3.8667N 11.5167E", None, None),
    9: ("450500 650200; 450513 650213; 450499 650218; 450486 650205; 450500 650200", None, None),
    10: (
        "6°36'6.5\"N 3°30'22.3\"E; 6°36'8.9\"N 3°30'27.0\"E; 6°36'3.6\"N 3°30'28.8\"E; 6°36'1.1\"N 3°30'24.1\"E; "
        "6°36'6.5\"N 3°30'22.3\"E", None, None,
    ),
}
TABLE = (
    "SC/AK/K 49700 387804.297 550821.575\nSC/AK/K 49701 387852.254 550891.123\nSC/AK/K 49702 387910.500 550865.400\n"
    "SC/AK/K 49703 387875.100 550795.200\nSC/AK/K 49700 387804.297 550821.575"
)
TRAVERSE = (
    "Tie-Point: E 387500.000 N 550600.000\n\nL1: N 62°15'30\"E 120.50m\nL2: S 27°44'30\"E 95.75m\n"
    "L3: S 62°15'30\"W 120.50m\nL4: N 27°44'30\"W 95.75m"
)


@pytest.fixture(scope="module")
def extracted(spark):
    subs = spark.createDataFrame(
        [(k, *v) for k, v in CASES.items()], "run_id long, raw_text string, coordinate_hint string, datum_label string"
    )
    points = extract.parse_auto(subs)
    return {r.run_id: r for r in crs.extract_parcels(subs, points).collect()}


@pytest.mark.parametrize("case", [1, 2, 3, 4])
def test_plain_cases(extracted, case):
    row = extracted[case]
    assert (row.detected_crs, row.crs_confidence, row.inside_region, row.error_code) == ("WGS84", 95.0, True, None)
    assert "T1" not in row.dialogs and "T2" not in row.dialogs


def test_area_of_first_case(extracted):
    assert extracted[1].area_ha == pytest.approx(2.811, abs=2e-3)


def test_swapped_axes(extracted):
    row = extracted[5]
    assert not row.inside_region and row.flip_tested and "T2" in row.dialogs


def test_open_ring(extracted):
    assert extracted[6].error_code == "POLYGON_OPEN"


def test_old_datum(extracted):
    row = extracted[7]
    assert row.detected_crs == "MINNA" and "T4" in row.dialogs


def test_outside_country(extracted):
    assert not extracted[8].inside_region and "T2" in extracted[8].dialogs


def test_ambiguous_grid(extracted):
    row = extracted[9]
    assert row.detected_crs == "UNKNOWN" and row.crs_confidence <= 59 and "T1" in row.dialogs


def test_dms(extracted):
    row = extracted[10]
    assert row.fmt == "DMS" and row.detected_crs == "WGS84" and "T5" in row.dialogs


def test_station_table(spark):
    subs = spark.createDataFrame([(11, TABLE)], "run_id long, raw_text string")
    stations = extract.scan_station_table(subs)
    assert [r.station_id for r in stations.orderBy("seq").collect()][:2] == ["SC/AK/K 49700", "SC/AK/K 49701"]
    shape = rings.metric_shape(stations).first()
    assert shape.area_m2 == pytest.approx(5594.27, abs=0.01)
    placed = crs._minna_utm(stations.select("seq", F.col("n").alias("p1"), F.col("e").alias("p2"), F.lit(32).alias("zone")), "zone")
    first = placed.filter("seq = 0").first()
    assert (first.lat, first.lng) == (pytest.approx(4.984996, abs=1e-6), pytest.approx(7.987281, abs=1e-6))


def test_traverse(spark):
    subs = spark.createDataFrame([(12, TRAVERSE)], "run_id long, raw_text string")
    legs = extract.scan_traverse_legs(subs)
    assert legs.count() == 4
    anchor = extract.find_anchor(subs).first()
    assert (anchor.anchor_e, anchor.anchor_n) == (387500.0, 550600.0)
    numbered = legs.withColumn("seq", F.col("line_no"))
    assert rings.traverse_misclosure(numbered).first().misclosure_m < 1.0
    track = extract.route_track(subs, extract.scan_station_table(subs), legs).first().track
    assert track == "COGO_TRAVERSE"


def _dem(points, value):
    """Pixels around the points, in the tile layout of the cell table."""
    cells = set()
    for lat, lng in points:
        row, col = math.floor((math.floor(lat) + 1 - lat) * 1200), math.floor((lng - math.floor(lng)) * 1200)
        for i in range(-3, 4):
            for j in range(-3, 4):
                cells.add((lat, lng, row + i, col + j, value(lat, lng, row + i)))
    return cells


def test_screening_of_four_parcels(spark):
    spots = {1: (6.60148, 3.50692), 2: (6.43522, 3.59192), 3: (4.81532, 7.05052), 4: (5.10972, 6.73072)}
    level = {1: lambda row: 35.0 + (7 - row / 1199 - 6.6018) * 3000.0, 2: lambda row: 2.0, 3: lambda row: 12.0, 4: lambda row: 2.5}
    cells = []
    for case, spot in spots.items():
        cells += list(_dem([spot], lambda lat, lng, row, case=case: level[case](row)))
    dem = spark.createDataFrame(cells, "lat double, lng double, px_row long, px_col long, value double").select(
        F.lit("dem").alias("layer"), tile_of(F.col("lat"), F.col("lng")).alias("tile"), "px_row", "px_col", "value"
    ).dropDuplicates(["tile", "px_row", "px_col"])
    rivers = spark.createDataFrame(
        [(1, 5.1100, 6.7302, 5.1110, 6.7310, 5), (2, 4.815, 7.055, 4.820, 7.057, 3), (3, 6.600, 3.520, 6.605, 3.525, 2)],
        "feature_id long, lat1 double, lng1 double, lat2 double, lng2 double, strahler int",
    )
    roads = spark.createDataFrame(
        [(1, 6.6015, 3.5060, 6.6020, 3.5070), (2, 4.8150, 7.0490, 4.8160, 7.0500)],
        "feature_id long, lat1 double, lng1 double, lat2 double, lng2 double",
    )
    wet = {1: -0.15, 2: 0.45, 3: 0.1}
    zone = {1: ("Lagos", 6.35, 6.90, 3.18, 4.02), 2: ("Lagos", 6.35, 6.90, 3.18, 4.02), 3: ("Rivers", 4.65, 4.95, 6.85, 7.20)}
    index = []
    for case, (name, a, b, x, y) in zone.items():
        lat, lng = spots[case]
        at = (name, math.floor((b - lat) / (b - a) * 1200), math.floor((lng - x) / (y - x) * 1200))
        index += [("ndwi", *at, wet[case]), ("ndvi", *at, 0.5)]
    indices = spark.createDataFrame(index, "layer string, tile string, px_row long, px_col long, value double")
    parcels = spark.createDataFrame([(k, *v) for k, v in spots.items()], "parcel_id long, lat double, lng double").selectExpr(
        "*", "false AS acquisition_flag", "CAST(NULL AS STRING) AS title_status", "CAST(NULL AS DOUBLE) AS lowest_m",
        "CAST(NULL AS DOUBLE) AS outfall_m", "false AS outfall_connected",
    )
    out = {r.parcel_id: r for r in measure.screen(parcels, rivers, roads, dem, indices).collect()}
    assert [out[k].river_m for k in (1, 2, 3, 4)] == pytest.approx([1455.2, 19876.3, 498.3, 64.4], abs=0.15)
    assert [out[k].road_m for k in (1, 2, 3, 4)] == pytest.approx([47.5, 20690.5, 94.0, 48056.8], abs=0.15)
    assert (out[1].flood_risk, out[1].terrain, out[1].traffic_light) == ("LOW", "SUITABLE", "GREEN")
    assert out[1].risk_score <= 40
    assert (out[2].flood_risk, out[2].traffic_light) == ("HIGH", "RED") and out[2].risk_score >= 65
    assert (out[3].flood_risk, out[3].terrain, out[3].traffic_light) == ("MEDIUM", "SUITABLE", "AMBER")
    assert (out[4].flood_risk, out[4].terrain, out[4].traffic_light) == ("HIGH", "UNSUITABLE", "RED")
    assert out[4].risk_score >= 75


def test_plans_from_raw_text(spark):
    subs = spark.createDataFrame([(11, TABLE), (12, TRAVERSE), (13, "no numbers at all")], "run_id long, raw_text string")
    ledger, summary = cadastral.cadastral_plan(subs)
    rows = {r.run_id: r for r in summary.collect()}
    assert rows[11].track == "TABULAR" and rows[11].ledger_stations == 5 and rows[11].misclosure_m == 0
    assert rows[12].track == "COGO_TRAVERSE" and rows[12].ledger_stations == 5
    assert rows[12].misclosure_m < 1 and rows[12].closure_status == "CLOSED"
    assert rows[12].area_ha == pytest.approx(120.5 * 95.75 / 10000, abs=1e-3)
    assert rows[13].error_code == "INSUFFICIENT_SPATIAL_DATA" and rows[13].ledger_stations is None
    traverse = ledger.filter("run_id = 12").orderBy("seq").collect()
    assert [r.station_id for r in traverse] == ["TP0 (Tie-Point)", "L1", "L2", "L3", "L4"]
    assert (traverse[0].e, traverse[0].n) == (387500.0, 550600.0)


def test_every_submission_is_a_parcel_or_an_error(spark):
    subs = spark.createDataFrame(
        [(k, *v, 0.5) for k, v in CASES.items()] + [(99, "nothing to read here", None, None, None)],
        "run_id long, raw_text string, coordinate_hint string, datum_label string, stated_area_ha double",
    )
    parcels = crs.extract_parcels(subs, extract.parse_auto(subs))
    errors = {r.run_id: r.error_code for r in extract.extraction_errors(subs, parcels).collect()}
    good = {r.run_id for r in parcels.filter("error_code IS NULL").collect()}
    assert errors[99] == "NO_COORDINATES_DETECTED" and errors[6] == "POLYGON_OPEN"
    assert good | set(errors) == set(CASES) | {99} and not good & set(errors)
    assert any("T3" in r.dialogs for r in parcels.collect())
