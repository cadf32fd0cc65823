"""Queries and checks for spatial joins; the checks compare every pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaspark.functions.geo import utm_zone
from cadaspark.functions.numeric import rnd as crnd
from cadaspark.operators import screening, spatial
from cadaspark.plans.checks import haversine, inputs, rnd, state_case, utm, with_, zone
from cadaspark.sources import bridge, config
from cadaspark.sources.scratch import large

c = F.col
_pos = ["parcel_id", "lat", "lng"]


def _spots(spark, sf):
    return bridge.parcels(spark, sf).select(*_pos)


def river(spark, sf):
    out = spatial.nearest_river(_spots(spark, sf), bridge.lines(spark, sf).filter("layer = 'river'"))
    return out.select("parcel_id", "river_m", "strahler")


def road(spark, sf):
    out = spatial.nearest_road(_spots(spark, sf), bridge.lines(spark, sf).filter("layer = 'road'"))
    from cadaspark.functions.rules import road_access

    return out.select("parcel_id", "road_m", road_access(c("road_m")).alias("road_access"))


def facility(spark, sf):
    cols = spatial.nearest_facility(c("lat"), c("lng"))
    return _spots(spark, sf).select("parcel_id", *[v.alias(k) for k, v in cols.items()])


def rings(spark, sf):
    return spatial.building_rings(_spots(spark, sf), bridge.buildings(spark, sf)).select("parcel_id", "n1", "n5", "n10")


def conflicts(spark, sf):
    out = spatial.landuse_conflicts(_spots(spark, sf), bridge.landuse_edges(spark, sf))
    return out.select("parcel_id", F.array_join("conflicts", ",").alias("conflicts"))


def _asset(spark, sf):
    spots = _spots(spark, sf)
    found = spatial.outfall_asset(spots, bridge.lines(spark, sf), bridge.landuse_edges(spark, sf))
    return spots.join(large(found), ["lat", "lng"])


def asset(spark, sf):
    """One row per parcel, unconnected ones included."""
    found = _asset(spark, sf).select("parcel_id", "asset", "feature_id", "distance_m")
    every = _spots(spark, sf).select("parcel_id").join(large(found), "parcel_id", "left")
    return every.select(
        "parcel_id", c("asset").isNotNull().alias("outfall_connected"), "asset", "feature_id", crnd(c("distance_m"), 1).alias("distance_m")
    )


def registry(spark, sf):
    spots = _spots(spark, sf)
    hits = spatial.registry_match(spots, bridge.registry(spark, sf))
    return spots.join(large(hits), ["lat", "lng"], "left").select("parcel_id", "record_id", crnd(c("distance_m"), 1).alias("distance_m"))


def outlines(spark, sf):
    """One 0.4-degree band per nation as polygon edges."""
    n = bridge.table(spark, sf, "nation").withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return n.selectExpr(*OUTLINES)


OUTLINES = [
    "n_nationkey AS feature_id", "n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' State' ELSE '' END AS state",
    "'Area ' || CAST(n_nationkey AS STRING) AS area",
    "4.25e0 + (n_nationkey + CASE WHEN seq IN (0, 3) THEN 0 ELSE 1 END) * 0.36e0 AS lat1",
    "2.51e0 + (CASE WHEN seq IN (0, 1) THEN 0e0 ELSE 11.4e0 END) AS lng1",
    "4.25e0 + (n_nationkey + CASE WHEN seq IN (2, 3) THEN 0 ELSE 1 END) * 0.36e0 AS lat2",
    "2.51e0 + (CASE WHEN seq IN (0, 3) THEN 0e0 ELSE 11.4e0 END) AS lng2",
]


def admin(spark, sf):
    return spatial.admin_lookup(_spots(spark, sf), outlines(spark, sf)).select("parcel_id", "admin_state", "admin_area")


def office(spark, sf):
    reg = bridge.registry(spark, sf)
    parcels = reg.select("id", c("state_confirmed").alias("state"), c("lga_confirmed").alias("lga"))
    return spatial.registry_office(parcels, config.offices(spark), config.DEFAULT_OFFICE).select("id", "office")


def zone_name(spark, sf):
    z = spatial.sentinel_zone(c("lat"), c("lng"))
    return _spots(spark, sf).select("parcel_id", z.alias("zone_name"), z.isNull().alias("out_of_zone"))


def prior(spark, sf):
    return spatial.prior_report(bridge.reports(spark, sf)).select("report_id", "prior_report_id", "prior_generated_at")


QUERIES = {
    "utm_zone_for_lng": lambda spark, sf: _spots(spark, sf).select("parcel_id", utm_zone(c("lng")).alias("zone")),
    "nearest_river": river,
    "nearest_road": road,
    "nearest_facility": facility,
    "building_rings": rings,
    "landuse_conflicts": conflicts,
    "outfall_asset": asset,
    "state_for_point": lambda spark, sf: _spots(spark, sf).select("parcel_id", screening.state_for_point(c("lat"), c("lng")).alias("state")),
    "sentinel_zone": zone_name,
    "admin_lookup": admin,
    "registry_match": registry,
    "prior_report": prior,
    "tile_counts": lambda spark, sf: spatial.tile_counts(bridge.reports(spark, sf), 10),
    "registry_office": office,
}

PZ = f"SELECT parcel_id, lat, lng, {zone('lng')} AS zone FROM p"
PU = {**inputs("p"), "pz": PZ, "pu": utm("pz", "lat", "lng", "zone")}
_zones = "(SELECT unnest([31,32,33]) AS zone)"


def _lines_utm(src: str) -> dict[str, str]:
    return {
        "lz": f"SELECT * FROM {src} CROSS JOIN {_zones}",
        "l1": utm("lz", "lat1", "lng1", "zone", "x1", "y1"),
        "lu2": utm("l1", "lat2", "lng2", "zone", "x2", "y2"),
    }


def _t(px: str, py: str) -> str:
    return (
        f"CASE WHEN x1=x2 AND y1=y2 THEN 0e0 ELSE least(greatest((({px}-x1)*(x2-x1)+({py}-y1)*(y2-y1))/"
        f"nullif((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1),0e0),0e0),1e0) END"
    )


def _d(px: str, py: str) -> str:
    return f"(SELECT sqrt(power({px}-(x1+t*(x2-x1)),2)+power({py}-(y1+t*(y2-y1)),2)) FROM (SELECT {_t(px, py)} AS t))"


def _dist(source: str, px: str = "e", py: str = "n") -> str:
    return (
        f"SELECT *, sqrt(power({px}-(x1+t*(x2-x1)),2)+power({py}-(y1+t*(y2-y1)),2)) AS d "
        f"FROM (SELECT *, {_t(px, py)} AS t FROM ({source}))"
    )


def _nearest(layer: str, bound: int) -> dict[str, str]:
    return {
        **PU, **inputs("lines"), "lay": f"SELECT * FROM lines WHERE layer='{layer}'", **_lines_utm("lay"),
        "dd": _dist("SELECT pu.parcel_id, e, n, lu2.* FROM pu JOIN lu2 USING (zone)"),
        "nn": f"SELECT * FROM dd WHERE d<={bound} QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY floor(d*1000+0.5e0), feature_id)=1",
    }


_POLY = {
    **PU, **inputs("lu"), **_lines_utm("lu"),
    "hit": f"""SELECT parcel_id, feature_id, any_value(tag) AS tag,
       CASE WHEN sum(CASE WHEN (y1>n)<>(y2>n) AND e<(x2-x1)*(n-y1)/nullif(y2-y1,0e0)+x1 THEN 1 ELSE 0 END)%2=1 THEN 0e0 ELSE min(d) END AS d
       FROM ({_dist("SELECT pu.parcel_id, e, n, lu2.* FROM pu JOIN lu2 USING (zone)")}) GROUP BY parcel_id, feature_id""",
}
_conf = ", ".join(f"'{t}'" for t in spatial.CONFLICT_TAGS)
_wet = ", ".join(f"'{t}'" for t in spatial.WATER_TAGS)
_ASSET = {
    **PU, **inputs("lu", "lines"),
    "sg": "SELECT layer, CASE WHEN layer='river' THEN 2 ELSE 3 END AS priority, feature_id, '' AS tag, lat1,lng1,lat2,lng2 FROM lines UNION ALL SELECT 'landuse', 1, feature_id, tag, lat1,lng1,lat2,lng2 FROM lu",
    **_lines_utm("sg"),
    "hit": f"""SELECT parcel_id, priority, feature_id, any_value(lower(tag)) AS tag,
       CASE WHEN priority=1 AND sum(CASE WHEN (y1>n)<>(y2>n) AND e<(x2-x1)*(n-y1)/nullif(y2-y1,0e0)+x1 THEN 1 ELSE 0 END)%2=1 THEN 0e0 ELSE min(d) END AS d
       FROM ({_dist("SELECT pu.parcel_id, e, n, lu2.* FROM pu JOIN lu2 USING (zone)")}) GROUP BY parcel_id, priority, feature_id""",
    "best": f"SELECT * FROM hit WHERE d<=200 AND (priority>1 OR tag IN ({_wet})) QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY priority, floor(d*1000+0.5e0), feature_id)=1",
}
_fac = {
    k: rnd("least(" + ", ".join(haversine("lat", "lng", repr(a), repr(b), 6371.0) for a, b in v) + ")", 2)
    for k, v in spatial.FACILITIES.items()
}
_sent = "CASE " + " ".join(
    f"WHEN lat BETWEEN {a!r} AND {b!r} AND lng BETWEEN {x!r} AND {y!r} THEN '{n}'" for n, a, b, x, y in spatial.SENTINEL_ZONES
) + " END"
_off = ", ".join(
    "(" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in row) + ")" for row in config.OFFICES
)
_def = config.DEFAULT_OFFICE.replace("'", "''")

CHECKS = {
    "utm_zone_for_lng": with_(["p"], f"SELECT parcel_id, CAST({zone('lng')} AS INT) AS zone FROM p"),
    "nearest_river": with_(_nearest("river", 80000), f"SELECT p.parcel_id, {rnd('d', 1)} AS river_m, nn.strahler FROM p LEFT JOIN nn USING (parcel_id)"),
    "nearest_road": with_({**_nearest("road", 50000), "o": f"SELECT p.parcel_id, {rnd('d', 1)} AS road_m FROM p LEFT JOIN nn USING (parcel_id)"},
      "SELECT parcel_id, road_m, CASE WHEN road_m<=200 THEN 'Excellent' WHEN road_m<=600 THEN 'Good' WHEN road_m<=1500 THEN 'Fair' ELSE 'Poor' END AS road_access FROM o"),
    "nearest_facility": with_(["p"], f"SELECT parcel_id, {_fac['airport']} AS airport_km, {_fac['port']} AS port_km, {_fac['rail']} AS rail_km FROM p"),
    "building_rings": with_({**PU, **inputs("bld"), "bz": f"SELECT * FROM bld CROSS JOIN {_zones}", "bu": utm("bz", "lat", "lng", "zone", "be", "bn"),
      "d": "SELECT parcel_id, sqrt(power(e-be,2)+power(n-bn,2)) AS d FROM pu JOIN bu USING (zone)"},
      "SELECT parcel_id, count(*) FILTER (d<=1000) AS n1, count(*) FILTER (d<=5000) AS n5, count(*) FILTER (d<=10000) AS n10 FROM d GROUP BY parcel_id"),
    "landuse_conflicts": with_({**_POLY, "tg": f"SELECT parcel_id, lower(trim(tag)) AS tag FROM hit WHERE d<=200 AND lower(trim(tag)) IN ({_conf})"},
      "SELECT p.parcel_id, coalesce(cs,'') AS conflicts FROM p LEFT JOIN (SELECT parcel_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS cs FROM tg GROUP BY parcel_id) USING (parcel_id)"),
    "outfall_asset": with_(_ASSET, f"SELECT p.parcel_id, priority IS NOT NULL AS outfall_connected, CASE WHEN priority=1 THEN 'Drainage Canal' WHEN priority=2 THEN 'Active River' WHEN priority=3 THEN 'Paved Road' END AS asset, feature_id, {rnd('d', 1)} AS distance_m FROM p LEFT JOIN best USING (parcel_id)"),
    "state_for_point": with_(["p"], f"SELECT parcel_id, {state_case('lat', 'lng')} AS state FROM p"),
    "sentinel_zone": with_(["p"], f"SELECT parcel_id, {_sent} AS zone_name, ({_sent}) IS NULL AS out_of_zone FROM p"),
    "admin_lookup": with_(["p"], """SELECT parcel_id, coalesce(n_name,'Unresolved — confirm State') AS admin_state, coalesce('Area ' || n_nationkey,'Unresolved — confirm LGA') AS admin_area
      FROM p LEFT JOIN nation ON lat>=4.25e0+n_nationkey*0.36e0 AND lat<4.25e0+(n_nationkey+1)*0.36e0 AND lng>=2.51e0 AND lng<13.91e0"""),
    "registry_match": with_({**inputs("p", "reg"), "d": f"SELECT parcel_id, id, record_order, match_radius_m, {haversine('p.lat', 'p.lng', 'reg.lat', 'reg.lng')} AS d FROM p CROSS JOIN reg",
      "b": "SELECT * FROM d WHERE d<=coalesce(match_radius_m,100) QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY record_order)=1"},
      f"SELECT p.parcel_id, b.id AS record_id, {rnd('b.d', 1)} AS distance_m FROM p LEFT JOIN b USING (parcel_id)"),
    "prior_report": with_({**inputs("rep"), "pr": f"""SELECT a.report_id, b.report_id AS prior_report_id, b.generated_at AS prior_generated_at FROM rep a JOIN rep b
       ON abs(a.lat-b.lat)<0.0002e0 AND abs(a.lng-b.lng)<0.0002e0 AND (b.generated_at,b.report_id)<(a.generated_at,a.report_id) AND {haversine('a.lat', 'a.lng', 'b.lat', 'b.lng')}<=10
       QUALIFY row_number() OVER (PARTITION BY a.report_id ORDER BY b.generated_at DESC, b.report_id DESC)=1"""},
      "SELECT report_id, prior_report_id, prior_generated_at FROM rep LEFT JOIN pr USING (report_id)"),
    "tile_counts": with_(["rep"], """SELECT 10 AS z, CAST(floor((lng+180)/360*1024) AS BIGINT) AS x, CAST(floor((1-asinh(tan(radians(lat)))/pi())/2*1024) AS BIGINT) AS y,
      traffic_light, count(*) AS parcels FROM rep GROUP BY ALL"""),
    "registry_office": with_({**inputs("reg"), "o": f"SELECT * FROM (VALUES {_off}) t(s,a,office)"},
      f"SELECT id, coalesce(x.office, y.office, '{_def}') AS office FROM reg LEFT JOIN o x ON x.s=state_confirmed AND x.a=lga_confirmed LEFT JOIN o y ON y.s=state_confirmed AND y.a IS NULL"),
}
