"""Queries and checks for coordinate systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaspark.functions import geo
from cadaspark.functions import parsing as p
from cadaspark.functions.numeric import rnd as crnd
from cadaspark.operators import crs, extract
from cadaspark.plans import extract as px
from cadaspark.plans import rings as pr
from cadaspark.plans.checks import inputs, inside, latlng, rnd, shift, utm, with_
from cadaspark.sources import bridge as b
from cadaspark.sources.scratch import keep, large

c = F.col


def _read(spark, sf):
    """Submissions without their texts, and the points in them: both come from one pass over the texts."""
    subs = keep(extract.first_format(crs.with_text_facts(b.submitted(spark, sf))), "read-texts")
    return subs.drop("hit", "rest"), keep(extract.points_of(subs.select("run_id", "hit", "rest")), "points")


def _tagged(spark, sf):
    subs, pts = _read(spark, sf)
    tagged = pts.join(large(crs.detect_crs(subs, pts).select("run_id", "detected_crs")), "run_id")
    return subs, keep(tagged.withColumn("is_utm", c("fmt").isin("UTM_SUFFIX", "UTM", "STATION_TABLE")), "tagged")


def detect(spark, sf, trial=False):
    return crs.detect_crs(*_read(spark, sf), trial).drop("minna_detected")


def _grid(spark, sf):
    """One grid position per parcel."""
    return b.parcel_base(spark, sf).selectExpr(*GRID)


GRID = [
    "parcel_id", "300000e0 + parcel_id * 137 % 400000 AS e", "450000e0 + parcel_id * 911 % 900000 AS n",
    "CAST(31 + parcel_id % 3 AS INT) AS zone",
]


def trial(spark, sf):
    return crs.zone_trial(_grid(spark, sf), "e", "n").select("parcel_id", "trial_crs", "trial_confidence")


def minna_zone(spark, sf):
    """Only what stands on a grid is decoded, and only its texts are read for a zone; no system is detected, as every grid is tried."""
    subs = b.submitted(spark, sf).select("run_id", "raw_text", c("raw_text").alias("own_text"))
    tried = extract.first_format(subs)
    grid = F.coalesce(c("hit.fmt").isin("UTM_SUFFIX", "UTM"), F.lit(False))
    zone = F.when(grid | c("rest").isNotNull(), p.named_zone(c("own_text")))
    # blanked out and filtered after the write: a filter before it would run the patterns a second time
    read = keep(tried.select("run_id", F.when(grid, c("hit")).alias("hit"), "rest", zone.alias("own_zone")), "grid-texts")
    return crs.minna_zone(read.filter("own_zone IS NOT NULL"), extract.points_of(read))


def utm_to_wgs84(spark, sf):
    out = geo.with_latlng(_grid(spark, sf), "e", "n", "zone")
    return out.select("parcel_id", crnd(c("lat"), 7).alias("lat"), crnd(c("lng"), 7).alias("lng"))


def wgs84_to_utm(spark, sf):
    spots = b.parcels(spark, sf).select("parcel_id", "lat", "lng", geo.utm_zone(c("lng")).alias("zone"))
    out = geo.with_utm(spots, "lat", "lng", "zone")
    return out.select("parcel_id", "zone", crnd(c("e"), 3).alias("e"), crnd(c("n"), 3).alias("n"))


def minna_to_wgs84(spark, sf):
    spots = b.parcels(spark, sf).select("parcel_id", c("lat").alias("olat"), c("lng").alias("olng"))
    out = geo.with_datum_shift(spots, "olat", "olng")
    return out.select("parcel_id", crnd(c("lat"), 7).alias("lat"), crnd(c("lng"), 7).alias("lng"))


def transform(spark, sf):
    subs, tagged = _tagged(spark, sf)
    zones = crs.minna_zone(subs, tagged.filter("detected_crs = 'MINNA' AND is_utm"))
    out = crs.transform_to_wgs84(tagged, zones)
    return out.select("run_id", "seq", "detected_crs", crnd(c("lat"), 6).alias("lat"), crnd(c("lng"), 6).alias("lng"))


def flip(spark, sf):
    return crs.flip_test(*_tagged(spark, sf))


ANSWERS = [
    "parcel_id AS run_id",
    "CASE parcel_id % 7 WHEN 0 THEN 'WGS84' WHEN 1 THEN 'UTM_32N' WHEN 2 THEN 'nonsense' END AS t1",
    "CASE parcel_id % 5 WHEN 0 THEN 'swap' WHEN 1 THEN 'proceed' END AS t2",
    "CASE parcel_id % 4 WHEN 0 THEN 'approximate' WHEN 1 THEN 'manual' END AS t6",
]
STORED = [
    "parcel_id AS run_id", "CASE parcel_id % 3 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'MINNA' ELSE 'WGS84' END AS detected_crs",
    "30e0 + parcel_id % 60 AS crs_confidence",
]


def answers(spark, sf):
    base = b.parcel_base(spark, sf)
    asked = base.filter("parcel_id % 6 < 5").selectExpr(*ANSWERS)
    return crs.apply_dialog_answers(b.vertices(spark, sf), base.selectExpr(*STORED), asked)


QUERIES = {
    "detect_crs": detect,
    "detect_crs_trial": lambda spark, sf: detect(spark, sf, True),
    "zone_trial": trial,
    "minna_zone": minna_zone,
    "utm_to_wgs84": utm_to_wgs84,
    "wgs84_to_utm": wgs84_to_utm,
    "minna_to_wgs84": minna_to_wgs84,
    "transform_to_wgs84": transform,
    "flip_test": flip,
    "apply_dialog_answers": answers,
    "extract_parcels": lambda spark, sf: _extracted(spark, sf)[1].filter("error_code IS NULL"),
    "extract_errors": lambda spark, sf: extract.extraction_errors(*_extracted(spark, sf)),
}


def _extracted(spark, sf):
    subs, points = _read(spark, sf)
    out = crs.extract_parcels(subs.withColumn("stated_area_ha", F.expr(STATED)), points)
    return subs, out.withColumn("dialogs", F.array_join("dialogs", ","))


# Area that a submission states, in hectares; every fourth states none.
STATED = "CASE WHEN run_id % 4 > 0 THEN 1e0 * (1 + run_id % 13) END"
_q = px._q
_mk = {z: "/(?:" + "|".join(s) + ")/" for z, s in crs.MARKERS.items()}
_bx = geo.COUNTRY_BOX
_wide = f"a BETWEEN {_bx['lat_min'] - 5!r} AND {_bx['lat_max'] + 5!r} AND b BETWEEN {_bx['lon_min'] - 5!r} AND {_bx['lon_max'] + 5!r}"


def _trial(src: str, e: str, n: str, name: str) -> dict[str, str]:
    parts = {}
    prev = src
    for z in (31, 32, 33):
        parts[f"{name}{z}"] = f"SELECT * EXCLUDE (lat, lng, z{z}), coalesce({inside('lat', 'lng')}, false) AS in{z} FROM ({latlng(f'(SELECT *, {z} AS z{z} FROM {prev})', e, n, f'z{z}')})"
        prev = f"{name}{z}"
    parts[name] = (
        f"SELECT *, CASE WHEN in32 THEN 'UTM_32N' WHEN in31 THEN 'UTM_31N' WHEN in33 THEN 'UTM_33N' ELSE 'UNKNOWN' END AS trial_crs, "
        f"CASE CAST(in31 AS INT)+CAST(in32 AS INT)+CAST(in33 AS INT) WHEN 0 THEN 50e0 WHEN 1 THEN 80e0 ELSE 60e0 END AS trial_confidence FROM {prev}"
    )
    return parts


def _detect(trial: bool) -> dict[str, str]:
    base = {
        **px.SUB, **px.STATIONS, **px.AUTO,
        "ft": f"SELECT run_id, arg_min(p1,seq) AS a, arg_min(p2,seq) AS b, bool_and({inside('p1', 'p2')}) AS allin FROM au GROUP BY run_id",
        "rn": f"""SELECT run_id, coordinate_hint AS h, a, b, allin, regexp_matches(x,{_q(p.MINNA_TEXT)}) AS mt, regexp_extract(x,{_q(p.ZONE_LETTER)},1) AS zt,
          CASE WHEN regexp_matches(upper(x),{_q(_mk[33])}) THEN 'UTM_33N' WHEN regexp_matches(upper(x),{_q(_mk[31])}) THEN 'UTM_31N' WHEN regexp_matches(upper(x),{_q(_mk[32])}) THEN 'UTM_32N' END AS marker,
          least(a,b) AS te, greatest(a,b) AS tn FROM (SELECT *, raw_text || ' ' || coalesce(datum_label,'') AS x FROM sv) LEFT JOIN ft USING (run_id)""",
    }
    if trial:
        # Positions outside the projection's range are not tried.
        base["rg"] = "SELECT * FROM rn"
        base |= _trial("rg", "te", "tn", "tr")
    else:
        base["tr"] = "SELECT *, 'UNKNOWN' AS trial_crs, 50e0 AS trial_confidence FROM rn"
    grid, swp = "a BETWEEN 400000 AND 1600000 AND b BETWEEN 100000 AND 900000", "b BETWEEN 400000 AND 1600000 AND a BETWEEN 100000 AND 900000"
    steps = [
        ("h='MINNA_DATUM'", "'MINNA'", "95e0", "Explicit Hint"), ("h='UTM_SWAPPED'", "'UTM_31N'", "70e0", "Explicit Hint"),
        ("mt", "'MINNA'", "95e0", "Datum Label Match"), ("zt IN ('31','32','33')", "'UTM_' || zt || 'N'", "90e0", "Text Zone Parsing"),
        ("a IS NULL", "'UNKNOWN'", "0e0", "None"), (_wide, "'WGS84'", "CASE WHEN allin THEN 95e0 ELSE 90e0 END", "Lat/Lng Bounds Check"),
        (f"{grid} AND marker IS NOT NULL", "marker", "85e0", "State Prefix Detection"), (grid, "trial_crs", "trial_confidence", "Boundary Trial"),
        (swp, "trial_crs", "60e0", "Boundary Trial (Swapped axes)"),
    ]
    case = lambda i, other: "CASE " + " ".join(f"WHEN {s[0]} THEN {s[i] if i < 3 else _q(s[3])}" for s in steps) + f" ELSE {other} END"
    base["dt"] = f"SELECT run_id, {case(1, chr(39) + 'UNKNOWN' + chr(39))} AS detected_crs, {case(2, '30e0')} AS crs_confidence, {case(3, chr(39) + 'Unknown' + chr(39))} AS method, coalesce(h='MINNA_DATUM',false) OR mt AS minna FROM tr"
    return base


TAG = {**_detect(False), "tg": "SELECT au.*, detected_crs, fmt IN ('UTM_SUFFIX','UTM','STATION_TABLE') AS is_utm FROM au JOIN dt USING (run_id)"}


def _minna_latlng(source: str, tag: str) -> dict[str, str]:
    return {
        f"{tag}a": latlng(source, "p2", "p1", "zone", "olat", "olng", geo.CLARKE_1880),
        tag: shift(f"{tag}a", "olat", "olng", "lat", "lng"),
    }


def _zones(source: str, tag: str) -> dict[str, str]:
    """Zone per run of the grid points in ``source``."""
    return {
        f"{tag}z": f"SELECT run_id, seq, p1, p2, unnest([31,32,33]) AS zone FROM {source}",
        **_minna_latlng(f"{tag}z", f"{tag}m"),
        f"{tag}c": f"SELECT run_id, zone, arg_min(p2,seq) AS fe, {inside(rnd('avg(lat)', 6), rnd('avg(lng)', 6))} AS ok FROM {tag}m GROUP BY run_id, zone",
        f"{tag}g": "SELECT *, CASE WHEN fe BETWEEN 100000 AND 400000 THEN 31 WHEN fe BETWEEN 400000 AND 700000 THEN 32 WHEN fe BETWEEN 700000 AND 900000 THEN 33 ELSE 32 END AS guess FROM " + f"{tag}c",
        tag: f"SELECT run_id, CAST(coalesce(TRY_CAST(nullif(regexp_extract(raw_text,{_q(p.ZONE_LETTER)},1),'') AS INT), z, guess) AS INT) AS zone FROM (SELECT run_id, any_value(guess) AS guess, arg_min(zone, abs(zone-guess)*10+zone-31) FILTER (ok) AS z FROM {tag}g GROUP BY run_id) JOIN sv USING (run_id)",
    }


def _place(source: str, zones: str, tag: str) -> dict[str, str]:
    cols = "run_id, seq, detected_crs, lat, lng"
    return {
        f"{tag}1": f"SELECT {source}.*, zone FROM {source} JOIN {zones} USING (run_id) WHERE detected_crs='MINNA' AND is_utm",
        **_minna_latlng(f"{tag}1", f"{tag}2"),
        f"{tag}3": shift(f"(SELECT * FROM {source} WHERE detected_crs='MINNA' AND NOT is_utm)", "p1", "p2", "lat", "lng"),
        f"{tag}4": latlng(f"(SELECT *, CASE WHEN starts_with(detected_crs,'UTM_') THEN CAST(detected_crs[5:6] AS INT) ELSE 32 END AS zone FROM {source} WHERE detected_crs NOT IN ('MINNA','WGS84') AND is_utm)", "p2", "p1", "zone"),
        tag: f"SELECT {cols} FROM {tag}2 UNION ALL SELECT {cols} FROM {tag}3 UNION ALL SELECT {cols} FROM {tag}4 UNION ALL SELECT run_id, seq, detected_crs, p1, p2 FROM {source} WHERE detected_crs='WGS84' OR (detected_crs<>'MINNA' AND NOT is_utm)",
    }


PLACED = {**TAG, "gm": "SELECT * FROM tg WHERE detected_crs='MINNA' AND is_utm", **_zones("gm", "zn"), **_place("tg", "zn", "pl")}
FLIP = {
    **TAG, "sw": "SELECT * REPLACE (p2 AS p1, p1 AS p2) FROM tg WHERE is_utm OR detected_crs IN ('UTM_31N','UTM_32N','UTM_33N','MINNA')",
    "swg": "SELECT * FROM sw WHERE detected_crs='MINNA' AND is_utm", **_zones("swg", "fz"),
    "swf": "SELECT * REPLACE (CASE WHEN detected_crs='MINNA' THEN is_utm ELSE starts_with(detected_crs,'UTM_') END AS is_utm) FROM sw", **_place("swf", "fz", "fp"),
    "fl": f"SELECT run_id, {inside(rnd('avg(lat)', 6), rnd('avg(lng)', 6))} AS flip_inside FROM fp GROUP BY run_id",
}
_gr = f"SELECT {', '.join(GRID)} FROM ({px._BASE})"


def _facts(source: str) -> dict[str, str]:
    """Ring facts over another vertex table."""
    return {"ed": pr._ring(source, "lng", "lat", "ed")["ed"], "facts": pr.FACTS["facts"]}


_EXTRACT = {**PLACED, **{k: v for k, v in FLIP.items() if k not in TAG}, **_facts("pl"), "kd": "SELECT run_id, min(fmt) AS fmt FROM au GROUP BY run_id",
      "j": "SELECT facts.*, fmt, detected_crs, crs_confidence, method, minna, raw_text, inside_region AND coalesce(coordinate_hint<>'UTM_SWAPPED',true) AS ins, coalesce(flip_inside,false) AS fi FROM facts JOIN dt USING (run_id) JOIN kd USING (run_id) JOIN sv USING (run_id) LEFT JOIN fl USING (run_id)"}
_PARCELS = f"""SELECT run_id, fmt, detected_crs, crs_confidence, method, points, closed, error_code, centroid_lat, centroid_lng, area_ha, ins AS inside_region, NOT ins AND fi AS flip_tested,
       concat_ws(',', CASE WHEN crs_confidence<60 THEN 'T1' END, CASE WHEN NOT ins THEN 'T2' END, CASE WHEN st>0 AND abs(floor(abs((area_ha-st)/st*100e0)*100e0+0.5e0)/100e0)>10 THEN 'T3' END, CASE WHEN minna THEN 'T4' END, CASE WHEN fmt='DMS' THEN 'T5' END, CASE WHEN contains(raw_text,'GRID_REF') THEN 'T6' END) AS dialogs FROM (SELECT *, {STATED} AS st FROM j)"""

CHECKS = {
    "detect_crs": with_(_detect(False), "SELECT run_id, detected_crs, crs_confidence, method FROM dt"),
    "detect_crs_trial": with_(_detect(True), "SELECT run_id, detected_crs, crs_confidence, method FROM dt"),
    "zone_trial": with_({"gr": _gr, **_trial("gr", "e", "n", "tr")}, "SELECT parcel_id, trial_crs, trial_confidence FROM tr"),
    "minna_zone": with_({**TAG, "gu": "SELECT * FROM tg WHERE is_utm", **_zones("gu", "zn")}, "SELECT run_id, zone FROM zn"),
    "utm_to_wgs84": with_({"gr": _gr, "o": latlng("gr", "e", "n", "zone")}, f"SELECT parcel_id, {rnd('lat', 7)} AS lat, {rnd('lng', 7)} AS lng FROM o"),
    "wgs84_to_utm": with_({**inputs("p"), "z": "SELECT parcel_id, lat, lng, CAST(CASE WHEN lng<6 THEN 31 WHEN lng<12 THEN 32 ELSE 33 END AS INT) AS zone FROM p", "o": utm("z", "lat", "lng", "zone")},
      f"SELECT parcel_id, zone, {rnd('e', 3)} AS e, {rnd('n', 3)} AS n FROM o"),
    "minna_to_wgs84": with_({**inputs("p"), "z": "SELECT parcel_id, lat AS olat, lng AS olng FROM p", "o": shift("z", "olat", "olng", "lat", "lng")}, f"SELECT parcel_id, {rnd('lat', 7)} AS lat, {rnd('lng', 7)} AS lng FROM o"),
    "transform_to_wgs84": with_(PLACED, f"SELECT run_id, CAST(seq AS INT) AS seq, detected_crs, {rnd('lat', 6)} AS lat, {rnd('lng', 6)} AS lng FROM pl"),
    "flip_test": with_(FLIP, "SELECT run_id, flip_inside FROM fl"),
    "apply_dialog_answers": with_({**inputs("v"), "an": f"SELECT {', '.join(ANSWERS)} FROM ({px._BASE}) WHERE parcel_id%6<5", "sd": f"SELECT {', '.join(STORED)} FROM ({px._BASE})",
      "tv": "SELECT v.run_id, seq, CASE WHEN t2='swap' THEN lng ELSE lat END AS lat, CASE WHEN t2='swap' THEN lat ELSE lng END AS lng FROM v LEFT JOIN an USING (run_id)", **_facts("tv")},
      """SELECT facts.run_id, CASE WHEN t1 IN ('WGS84','UTM_32N') THEN t1 ELSE detected_crs END AS detected_crs, CASE WHEN t1 IN ('WGS84','UTM_32N') THEN 100e0 ELSE crs_confidence END AS crs_confidence,
       centroid_lat, centroid_lng, area_ha, inside_region, CASE WHEN t6='approximate' THEN 'POS_ACCURACY: APPROXIMATE' END AS warning FROM facts JOIN sd USING (run_id) LEFT JOIN an USING (run_id)"""),
    "extract_parcels": with_(_EXTRACT, f"SELECT * FROM ({_PARCELS}) WHERE error_code IS NULL"),
    "extract_errors": with_(_EXTRACT, f"""SELECT run_id, 'COORD_EXTRACT' AS stage, error_code FROM j WHERE error_code IS NOT NULL UNION ALL
      SELECT run_id, 'COORD_EXTRACT', 'NO_COORDINATES_DETECTED' FROM sv WHERE run_id NOT IN (SELECT run_id FROM j)"""),
}
