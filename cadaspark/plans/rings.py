"""Queries and checks for ordered-vertex geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaspark.functions.geo import WGS84, with_latlng
from cadaspark.functions.numeric import rnd as crnd
from cadaspark.operators import ordered, rings
from cadaspark.plans.checks import haversine, inputs, inside, latlng, rnd, with_
from cadaspark.sources import bridge
from cadaspark.sources.scratch import large


def _facts(*cols):
    return lambda spark, sf: rings.ring_facts(bridge.vertices(spark, sf)).select("run_id", *cols)


def _located_stations(spark, sf):
    st = bridge.stations(spark, sf).withColumn("zone", F.lit(31) + F.col("run_id") % 3)
    return with_latlng(st, "e", "n", "zone")


def _stated(spark, sf):
    return bridge.rectangle_legs(spark, sf).filter("seq = 0").select("run_id", "stated_sqm")


def lineitem_legs(spark, sf):
    """Legs of each order, numbered in line order; the chunk splits an order of any length."""
    raw = bridge.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        (F.col("l_partkey") % 360).cast("double").alias("bearing_dd"),
        F.col("l_quantity").alias("distance_m"),
    )
    order = ["l_linenumber", "l_partkey", "l_suppkey", "distance_m", "l_extendedprice"]
    chunk = F.col("l_linenumber") * F.lit(10**12) + F.floor(F.col("l_partkey") / 64.0)
    numbered = ordered.with_row_number(raw, ["run_id"], order, chunk)
    return numbered.select("run_id", "seq", "bearing_dd", "distance_m")


def shoelace(spark, sf):
    shape = rings.metric_shape(bridge.stations(spark, sf))
    return shape.select("run_id", crnd(F.col("area_m2"), 2).alias("area_m2"), crnd(F.col("diagonal_m"), 3).alias("diagonal_m"))


def misclosure(spark, sf):
    return rings.traverse_misclosure(bridge.rectangle_legs(spark, sf)).select("run_id", "misclosure_m", "closure_status")


def bowditch(spark, sf):
    out = rings.bowditch_adjust(bridge.rectangle_legs(spark, sf))
    return out.select("run_id", "seq", crnd(F.col("e"), 2).alias("e"), crnd(F.col("n"), 2).alias("n"), "adjustment")


def discrepancy(spark, sf):
    cols = rings.area_discrepancy(F.col("area_ha"), F.col("stated_area_ha"))
    return bridge.parcels(spark, sf).select("parcel_id", *[v.alias(k) for k, v in cols.items()])


def match_flag(spark, sf):
    cols = rings.area_match_flag(F.col("area_ha"), F.col("stated_area_ha"))
    return bridge.parcels(spark, sf).select("parcel_id", *[v.alias(k) for k, v in cols.items()])


def triggers(spark, sf):
    c = F.col
    facts = rings.ring_facts(bridge.vertices(spark, sf))
    pct = rings.area_discrepancy(c("area_ha_ring"), c("stated_area_ha"))["discrepancy_pct"]
    joined = facts.withColumnRenamed("area_ha", "area_ha_ring").join(
        large(bridge.parcels(spark, sf).select(c("parcel_id").alias("run_id"), "stated_area_ha", "minna")), "run_id"
    )
    codes = rings.dialog_triggers(
        c("run_id") % 100, c("inside_region"), pct, c("minna"), c("run_id") % 6 == 0, c("run_id") % 8 == 0
    )
    return joined.select("run_id", F.array_join(codes, ",").alias("dialogs"))


QUERIES = {
    "polygon_closed": _facts("points", "closed", "error_code"),
    "auto_close": lambda spark, sf: rings.auto_close(bridge.stations(spark, sf)),
    "centroid": _facts("centroid_lat", "centroid_lng"),
    "bbox": _facts("min_lat", "max_lat", "min_lng", "max_lng"),
    "area_ha": _facts("area_ha", "area_ha_fallback"),
    "shoelace_m2": shoelace,
    "inside_region": _facts("inside_region"),
    "segment_health": _facts("mean_segment_m", "max_segment_m", "std_dev_m"),
    "area_discrepancy": discrepancy,
    "area_match_flag": match_flag,
    "self_intersection": lambda spark, sf: rings.self_intersection(bridge.vertices(spark, sf)),
    "clockwise": lambda spark, sf: rings.clockwise(bridge.stations(spark, sf)),
    "sanity_gate": lambda spark, sf: rings.sanity_gate(_located_stations(spark, sf), _stated(spark, sf)),
    "traverse_forward": lambda spark, sf: rings.traverse_forward(lineitem_legs(spark, sf)).select("run_id", "seq", "e", "n"),
    "traverse_misclosure": misclosure,
    "bowditch_adjust": bowditch,
    "station_ledger": lambda spark, sf: rings.station_ledger(_located_stations(spark, sf)),
    "leg_plausibility": lambda spark, sf: rings.leg_plausibility(bridge.rectangle_legs(spark, sf), _stated(spark, sf)),
    "dialog_triggers": triggers,
}


def _ring(src, x, y, name):
    """Edges with the wrap edge, by plain windows."""
    return {
        name: f"SELECT run_id, seq, {x} AS x1, {y} AS y1, coalesce(lead({x}) OVER w, first_value({x}) OVER w) AS x2, "
        f"coalesce(lead({y}) OVER w, first_value({y}) OVER w) AS y2, lead({x}) OVER w IS NULL AS last, "
        f"count(*) OVER (PARTITION BY run_id) AS n FROM {src} WINDOW w AS (PARTITION BY run_id ORDER BY seq)"
    }


_W = f"(1e0-{WGS84.e2!r}*power(sin(radians(my)),2))"
_KX = f"({WGS84.a!r}*pi()/180*cos(radians(my))/sqrt({_W}))"
_KY = f"({WGS84.a * (1 - WGS84.e2)!r}*pi()/180/power({_W},1.5e0))"
FACTS = {
    **inputs("v"),
    **_ring("v", "lng", "lat", "ed"),
    "facts": f"""SELECT *, CASE WHEN NOT closed THEN 'POLYGON_OPEN' WHEN std_dev_m>5000 THEN 'POLYGON_TOO_LARGE' END AS error_code,
      {inside('centroid_lat', 'centroid_lng')} AS inside_region FROM (
     SELECT run_id, n AS points, n>=4 AND abs(fx-lx)<1e-6 AND abs(fy-ly)<1e-6 AS closed, {rnd('my', 6)} AS centroid_lat, {rnd('mx', 6)} AS centroid_lng,
      min_lat, max_lat, min_lng, max_lng, {rnd(f'a*{_KX}*{_KY}/1e4', 4)} AS area_ha,
      {rnd('a*111320e0*111320e0*abs(cos(radians(my)))/1e4', 4)} AS area_ha_fallback,
      {rnd('ms', 2)} AS mean_segment_m, {rnd('xs', 2)} AS max_segment_m, {rnd('ss', 2)} AS std_dev_m
     FROM (SELECT run_id, count(*) AS n, arg_min(x1,seq) AS fx, arg_min(y1,seq) AS fy, arg_max(x1,seq) AS lx, arg_max(y1,seq) AS ly,
      avg(x1) AS mx, avg(y1) AS my, min(y1) AS min_lat, max(y1) AS max_lat, min(x1) AS min_lng, max(x1) AS max_lng,
      abs(sum((x2-x1)*(y2+y1)))/2 AS a, avg(d) AS ms, max(d) AS xs, stddev_pop(d) AS ss
      FROM (SELECT *, CASE WHEN NOT last THEN {haversine('y1', 'x1', 'y2', 'x2')} END AS d FROM ed) GROUP BY run_id))""",
}
_MET = {**inputs("st"), **_ring("st", "e", "n", "ed")}
_turn = lambda a, b, p: f"(({b}x-{a}x)*({p}y-{a}y)-({b}y-{a}y)*({p}x-{a}x))"
_on = lambda a, b, p: f"({_turn(a, b, p)}=0 AND {p}x BETWEEN least({a}x,{b}x) AND greatest({a}x,{b}x) AND {p}y BETWEEN least({a}y,{b}y) AND greatest({a}y,{b}y))"
_fold = lambda s, p, q: f"({_turn(s, p, q)}=0 AND ({p}x-{s}x)*({q}x-{s}x)+({p}y-{s}y)*({q}y-{s}y)>0)"
_LEGS = {
    "raw": "SELECT *, distance_m*sin(radians(bearing_dd)) AS de, distance_m*cos(radians(bearing_dd)) AS dn FROM legs",
    "tot": "SELECT run_id, sum(de) AS me, sum(dn) AS mn, sum(distance_m) AS len, sqrt(power(sum(de),2)+power(sum(dn),2)) AS gap FROM raw GROUP BY run_id",
}
_LOC = {**inputs("st"), "stz": "SELECT *, 31 + run_id % 3 AS zone FROM st", "loc": latlng("stz", "e", "n", "zone")}
_PCT = rnd("(area_ha-stated_area_ha)/stated_area_ha*100e0", 2)

CHECKS = {
    "polygon_closed": with_(FACTS, "SELECT run_id, points, closed, error_code FROM facts"),
    "auto_close": with_(["st"], """SELECT run_id, seq, station_id, e, n FROM st UNION ALL
      SELECT run_id, CAST(k AS INT), fid || ' (close)', fe, fn FROM (SELECT run_id, count(*) AS k, arg_min(station_id,seq) AS fid, arg_min(e,seq) AS fe, arg_min(n,seq) AS fn,
       arg_max(e,seq) AS le, arg_max(n,seq) AS ln FROM st GROUP BY run_id) WHERE k>=3 AND (abs(fe-le)>0.01e0 OR abs(fn-ln)>0.01e0)"""),
    "centroid": with_(FACTS, "SELECT run_id, centroid_lat, centroid_lng FROM facts"),
    "bbox": with_(FACTS, "SELECT run_id, min_lat, max_lat, min_lng, max_lng FROM facts"),
    "area_ha": with_(FACTS, "SELECT run_id, area_ha, area_ha_fallback FROM facts"),
    "shoelace_m2": with_(_MET, f"""SELECT run_id, {rnd('abs(sum((x2-x1)*(y2+y1)))/2', 2)} AS area_m2,
      {rnd('sqrt(power(max(x1)-min(x1),2)+power(max(y1)-min(y1),2))', 3)} AS diagonal_m FROM ed GROUP BY run_id"""),
    "inside_region": with_(FACTS, "SELECT run_id, inside_region FROM facts"),
    "segment_health": with_(FACTS, "SELECT run_id, mean_segment_m, max_segment_m, std_dev_m FROM facts"),
    "area_discrepancy": with_(["p"], f"SELECT parcel_id, CASE WHEN stated_area_ha>0 THEN {_PCT} END AS discrepancy_pct, CASE WHEN stated_area_ha>0 THEN abs({_PCT}) END AS discrepancy_abs_pct, coalesce(abs({_PCT})>10,false) AS area_flagged FROM p"),
    "area_match_flag": with_(["p"], f"""SELECT parcel_id, CASE WHEN stated_area_ha IS NULL OR stated_area_ha<=0 OR abs(stated_area_ha-area_ha)<=0.005e0 THEN 'GREEN'
      WHEN abs(stated_area_ha-area_ha)<=0.05e0 THEN 'AMBER' ELSE 'RED' END AS area_match,
      CASE WHEN stated_area_ha IS NULL OR stated_area_ha<=0 THEN 0e0 ELSE {rnd('abs(stated_area_ha-area_ha)', 6)} END AS area_delta_ha FROM p"""),
    "self_intersection": with_({**inputs("v"), **_ring("v", "lng", "lat", "e0"),
      "cl": "SELECT run_id, n>=4 AND abs(arg_min(x1,seq)-arg_max(x1,seq))<1e-6 AND abs(arg_min(y1,seq)-arg_max(y1,seq))<1e-6 AS closed FROM e0 GROUP BY run_id, n",
      "ed": "SELECT e0.*, CASE WHEN closed THEN n-1 ELSE n END AS m FROM e0 JOIN cl USING (run_id) WHERE NOT (closed AND last)",
      "pr": "SELECT a.run_id, a.seq AS i, b.seq AS j, a.m, a.x1 AS px, a.y1 AS py, a.x2 AS qx, a.y2 AS qy, b.x1 AS rx, b.y1 AS ry, b.x2 AS sx, b.y2 AS sy FROM ed a JOIN ed b ON a.run_id=b.run_id AND a.seq<b.seq"},
      f"""SELECT run_id, bool_or(CASE WHEN j=i+1 THEN {_fold('q', 'p', 's')} WHEN i=0 AND j=m-1 THEN {_fold('p', 'q', 'r')}
       ELSE ({_turn('r', 's', 'p')}*{_turn('r', 's', 'q')}<0 AND {_turn('p', 'q', 'r')}*{_turn('p', 'q', 's')}<0)
        OR {_on('r', 's', 'p')} OR {_on('r', 's', 'q')} OR {_on('p', 'q', 'r')} OR {_on('p', 'q', 's')} END) AS self_intersecting FROM pr GROUP BY run_id"""),
    "clockwise": with_({**_MET, "sh": f"""SELECT run_id, count(*) AS k, sum((x2-x1)*(y2+y1))<0 AS ccw, count(*)>=4 AND abs(arg_min(x1,seq)-arg_max(x1,seq))<=0.01e0
       AND abs(arg_min(y1,seq)-arg_max(y1,seq))<=0.01e0 AS dup FROM ed GROUP BY run_id"""},
      """SELECT run_id, seq, station_id, e, n FROM st JOIN sh USING (run_id) WHERE NOT ccw UNION ALL
       SELECT run_id, CAST(k - CASE WHEN dup THEN 2 ELSE 1 END - seq AS INT), station_id, e, n FROM st JOIN sh USING (run_id) WHERE ccw AND NOT (dup AND seq=k-1) UNION ALL
       SELECT run_id, CAST(k-1 AS INT), station_id || ' (close)', e, n FROM st JOIN sh USING (run_id) WHERE ccw AND dup AND seq=k-2"""),
    "sanity_gate": with_({**_LOC, **inputs("legs"), **_ring("st", "e", "n", "ed"),
      "sh": "SELECT run_id, abs(sum((x2-x1)*(y2+y1)))/2 AS a, sqrt(power(max(x1)-min(x1),2)+power(max(y1)-min(y1),2)) AS dg FROM ed GROUP BY run_id",
      "ou": "SELECT run_id, bool_or(NOT (lat BETWEEN 4 AND 14 AND lng BETWEEN 2.5e0 AND 15)) AS o FROM loc GROUP BY run_id",
      "rs": """SELECT sh.run_id, CASE WHEN stated_sqm>0 AND (a/stated_sqm>5 OR a/stated_sqm<0.1e0) THEN 'AREA_RATIO' WHEN stated_sqm>0 AND dg>12*sqrt(stated_sqm) THEN 'SPAN_TOO_LARGE'
       WHEN o THEN 'OUTSIDE_BOUNDS' ELSE 'OK' END AS reason FROM sh JOIN ou USING (run_id) LEFT JOIN (SELECT run_id, stated_sqm FROM legs WHERE seq=0) USING (run_id)"""},
      "SELECT run_id, reason, reason='OK' AS passed FROM rs"),
    "traverse_forward": f"""WITH li AS (SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice)-1 AS seq,
      l_quantity*sin(radians(l_partkey%360)) AS de, l_quantity*cos(radians(l_partkey%360)) AS dn FROM lineitem)
      SELECT run_id, seq, {rnd('250000e0+sum(de) OVER w', 3)} AS e, {rnd('1000000e0+sum(dn) OVER w', 3)} AS n FROM li WINDOW w AS (PARTITION BY run_id ORDER BY seq)""",
    "traverse_misclosure": with_({**inputs("legs"), **_LEGS}, f"SELECT run_id, {rnd('gap', 4)} AS misclosure_m, CASE WHEN {rnd('gap', 4)}>2 THEN 'UNCLOSED' ELSE 'CLOSED' END AS closure_status FROM tot"),
    "bowditch_adjust": with_({**inputs("legs"), **_LEGS,
      "fw": f"SELECT run_id, seq, {rnd('anchor_e+sum(de) OVER w', 3)} AS e, {rnd('anchor_n+sum(dn) OVER w', 3)} AS n, sum(distance_m) OVER w AS cd FROM raw WINDOW w AS (PARTITION BY run_id ORDER BY seq)",
      "ad": f"SELECT *, gap>0 AND gap<=2 AS adj, {rnd('e-me*cd/len', 3)} AS e2, {rnd('n-mn*cd/len', 3)} AS n2 FROM fw JOIN tot USING (run_id)"},
      f"SELECT run_id, seq, {rnd('CASE WHEN adj THEN e2 ELSE e END', 2)} AS e, {rnd('CASE WHEN adj THEN n2 ELSE n END', 2)} AS n, CASE WHEN adj THEN 'bowditch' ELSE 'none' END AS adjustment FROM ad"),
    "station_ledger": with_(_LOC, f"SELECT run_id, seq, station_id, e, n, {rnd('lat', 6)} AS lat, {rnd('lng', 6)} AS lng, 'table' AS source, printf('%.3f, %.3f', e, n) AS copy_text FROM loc"),
    "leg_plausibility": with_(["legs"], "SELECT run_id, seq, coalesce(stated_sqm>0 AND distance_m>4*sqrt(stated_sqm),false) AS implausible FROM legs"),
    "dialog_triggers": with_({**FACTS, **inputs("p"), "j": f"SELECT facts.*, minna, CASE WHEN stated_area_ha>0 THEN {rnd('(facts.area_ha-stated_area_ha)/stated_area_ha*100e0', 2)} END AS pct FROM facts JOIN p ON run_id=parcel_id"},
      """SELECT run_id, concat_ws(',', CASE WHEN run_id%100<60 THEN 'T1' END, CASE WHEN NOT inside_region THEN 'T2' END, CASE WHEN abs(pct)>10 THEN 'T3' END,
       CASE WHEN minna THEN 'T4' END, CASE WHEN run_id%6=0 THEN 'T5' END, CASE WHEN run_id%8=0 THEN 'T6' END) AS dialogs FROM j"""),
}
