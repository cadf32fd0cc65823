"""Queries and checks for raster sampling and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaspark.functions.numeric import rnd as crnd
from cadaspark.operators import raster, spatial
from cadaspark.plans import spatial as plan
from cadaspark.plans.checks import _sel, inputs, latlng, rnd, utm, with_, zone
from cadaspark.sources import bridge as b
from cadaspark.sources.scratch import large

c = F.col


def _spots(spark, sf):
    return b.parcels(spark, sf).select("parcel_id", "lat", "lng")


def zone_cells(spark, sf):
    """Satellite pixels derived from the parcels inside the zones."""
    pixels = raster.zone_pixels(_spots(spark, sf)).filter("zone_name IS NOT NULL").select("zone_name", "px_row", "px_col").distinct()
    named = pixels.withColumn("index_name", F.explode(F.array(F.lit("ndwi"), F.lit("ndvi"))))
    return named.selectExpr(*b.ZONE_CELLS)


def axis(spark, sf):
    return raster.longest_axis(raster.metric_rings(b.vertices(spark, sf)))


def axis_view(spark, sf):
    return axis(spark, sf).select("run_id", "seq", "seq2", *[crnd(c(k), 2).alias(k) for k in ("e", "n", "qe", "qn")])


def internal(spark, sf):
    return raster.internal_profile(axis(spark, sf), b.dem_cells(spark, sf))


def _paths(spark, sf):
    picked = plan._asset(spark, sf).select(c("parcel_id").alias("run_id"), "priority", "feature_id")
    starts = raster.lowest_vertex(b.vertices(spark, sf), b.dem_cells(spark, sf)).join(large(picked), "run_id")
    return spatial.outfall_path(starts, spatial.asset_segments(b.lines(spark, sf), b.landuse_edges(spark, sf)))


def outfall_distance(spark, sf):
    """From the lowest boundary vertex to the drainage asset; null where there is none."""
    paths = _paths(spark, sf).select("run_id", crnd(c("outfall_m"), 1).alias("outfall_m"))
    return b.vertices(spark, sf).select("run_id").distinct().join(large(paths), "run_id", "left")


def outfall(spark, sf):
    return raster.outfall_profile(_paths(spark, sf), b.dem_cells(spark, sf))


QUERIES = {
    "sample_elevation": lambda spark, sf: raster.sample_elevation(_spots(spark, sf), b.dem_cells(spark, sf)).select("parcel_id", "elevation_m"),
    "slope_pct": lambda spark, sf: raster.slope_pct(_spots(spark, sf), b.dem_cells(spark, sf)).select("parcel_id", "slope_pct"),
    "sample_ndwi_ndvi": lambda spark, sf: raster.sample_ndwi_ndvi(_spots(spark, sf), zone_cells(spark, sf)).select("parcel_id", "ndwi", "ndvi", "out_of_zone"),
    "longest_axis": axis_view,
    "internal_profile": internal,
    "outfall_profile": outfall,
    "outfall_distance": outfall_distance,
    "profile_range": lambda spark, sf: raster.profile_range(internal(spark, sf)),
}

_SEQ = "(SELECT lat, lng, unnest(range(81)) AS seq FROM p)"
DEM = {
    **inputs("p"),
    "dem": _sel(b.DEM_CELLS, f"(SELECT DISTINCT * FROM ({_sel(b.DEM_BLOCK, _SEQ)}) WHERE {b.DEM_FILTER})"),
    "px": "SELECT tile, px_row, px_col, value AS v FROM dem WHERE value > -9999",
}


def _tile(lat: str, lng: str) -> str:
    return f"printf('N%02dE%03d', CAST(floor({lat}) AS INT), CAST(floor({lng}) AS INT))"


def _row(lat: str, base: str) -> str:
    return f"CAST(floor((floor({base})+1-({lat}))*1200e0) AS BIGINT)"


def _col(lng: str, base: str) -> str:
    return f"CAST(floor((({lng})-floor({base}))*1200e0) AS BIGINT)"


_step = repr(raster.STEP_DEG)
_zsql = lambda f: "CASE " + " ".join(
    f"WHEN zone_name='{n}' THEN {f(a, z, x, y)}" for n, a, z, x, y in spatial.SENTINEL_ZONES
) + " END"
_sent = "CASE " + " ".join(
    f"WHEN lat BETWEEN {a!r} AND {z!r} AND lng BETWEEN {x!r} AND {y!r} THEN '{n}'" for n, a, z, x, y in spatial.SENTINEL_ZONES
) + " END"
ZP = {
    **inputs("p"),
    "zn": f"SELECT parcel_id, lat, lng, {_sent} AS zone_name FROM p",
    "zp": "SELECT *, " + _zsql(lambda a, z, x, y: f"CAST(floor(({z!r}e0-lat)/{z-a!r}*1200e0) AS BIGINT)") + " AS px_row, "
    + _zsql(lambda a, z, x, y: f"CAST(floor((lng-{x!r}e0)/{y-x!r}*1200e0) AS BIGINT)") + " AS px_col FROM zn",
    "zc": _sel(b.ZONE_CELLS, "(SELECT DISTINCT zone_name, px_row, px_col, unnest(['ndwi','ndvi']) AS index_name FROM zp WHERE zone_name IS NOT NULL)"),
}
AXIS = {
    **inputs("v"),
    "vz": f"SELECT v.*, {zone('m')} AS zone FROM v JOIN (SELECT run_id, {rnd('avg(lng)', 6)} AS m FROM v GROUP BY run_id) USING (run_id)",
    "vm": utm("vz", "lat", "lng", "zone"),
    "uq": "SELECT run_id, zone, e, n, min(seq) AS seq FROM vm GROUP BY ALL",
    "pr": """SELECT a.run_id, a.zone, a.seq, b.seq AS seq2, a.e, a.n, b.e AS qe, b.n AS qn FROM uq a JOIN uq b ON a.run_id=b.run_id AND a.seq<b.seq
      QUALIFY row_number() OVER (PARTITION BY a.run_id ORDER BY -floor(sqrt(power(a.e-b.e,2)+power(a.n-b.n,2))*1000+0.5e0), a.seq, b.seq)=1""",
    "ax": """SELECT * FROM pr UNION ALL SELECT run_id, zone, seq, seq, e, n, e, n FROM uq WHERE run_id NOT IN (SELECT run_id FROM pr)""",
    "eg": """SELECT run_id, e AS x1, n AS y1, coalesce(lead(e) OVER w, first_value(e) OVER w) AS x2, coalesce(lead(n) OVER w, first_value(n) OVER w) AS y2 FROM vm
      WINDOW w AS (PARTITION BY run_id ORDER BY seq)""",
    "cr": """SELECT run_id, ((x1-e)*(y2-y1)-(y1-n)*(x2-x1))/det AS t, ((x1-e)*(qn-n)-(y1-n)*(qe-e))/det AS u
      FROM (SELECT *, (qe-e)*(y2-y1)-(qn-n)*(x2-x1) AS det FROM ax JOIN eg USING (run_id)) WHERE abs(det)>1e-9""",
    "ct": f"SELECT DISTINCT run_id, {rnd('t', 9)} AS t FROM (SELECT run_id, t FROM cr WHERE t>0 AND t<1 AND u>=0 AND u<=1 UNION ALL SELECT run_id, unnest([0e0,1e0]) FROM ax)",
    "pc": "SELECT * FROM (SELECT run_id, t AS t1, lead(t) OVER (PARTITION BY run_id ORDER BY t) AS t2 FROM ct) WHERE t2 IS NOT NULL",
    "mi": "SELECT pc.*, e+(t1+t2)/2*(qe-e) AS mx, n+(t1+t2)/2*(qn-n) AS my FROM pc JOIN ax USING (run_id)",
    "ins": "SELECT run_id, t1, t2, sum(CASE WHEN (y1>my)<>(y2>my) AND mx<(x2-x1)*(my-y1)/nullif(y2-y1,0e0)+x1 THEN 1 ELSE 0 END)%2=1 OR min(d)<=1e-6 AS inside FROM ("
    + plan._dist("SELECT * FROM mi JOIN eg USING (run_id)", "mx", "my") + ") GROUP BY ALL",
    "isl": "SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY t1) AS island FROM ins",
    "sp": """SELECT run_id, a, b FROM (SELECT run_id, island, min(t1) AS a, max(t2) AS b FROM isl WHERE inside GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY -floor((b-a)*1e6+0.5e0), a)=1""",
    "axis": "SELECT ax.run_id, seq, seq2, zone, e+coalesce(a,0)*(qe-e) AS e, n+coalesce(a,0)*(qn-n) AS n, e+coalesce(b,1)*(qe-e) AS qe, n+coalesce(b,1)*(qn-n) AS qn FROM ax LEFT JOIN sp USING (run_id)",
}


def _profile(source: str, extra: str = "") -> dict[str, str]:
    return {
        "sm": f"SELECT run_id, zone, pos{extra}, e+pos/9e0*(qe-e) AS pe, n+pos/9e0*(qn-n) AS pn, {rnd('pos/9e0*sqrt(power(qe-e,2)+power(qn-n,2))', 2)} AS distance_m FROM (SELECT *, unnest(range(10)) AS pos FROM {source})",
        "sl": latlng("sm", "pe", "pn", "zone", "plat", "plng"),
        "pf": f"SELECT run_id, CAST(pos AS INT) AS pos{extra}, distance_m, {rnd('v+sin((plat+plng)*100000e0)*0.4e0', 2)} AS elevation_m FROM sl LEFT JOIN px ON tile={_tile('plat', 'plng')} AND px_row={_row('plat', 'plat')} AND px_col={_col('plng', 'plng')}",
    }


_INT = {**AXIS, **DEM, **_profile("axis")}
_OUT = {
    **plan._ASSET, **DEM, **inputs("v"),
    "ve": f"SELECT run_id, seq, lat, lng, px.v AS elev FROM v LEFT JOIN px ON tile={_tile('lat', 'lng')} AND px_row={_row('lat', 'lat')} AND px_col={_col('lng', 'lng')}",
    "lowv": f"""SELECT run_id, lat, lng FROM ve WHERE elev IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY elev, seq)=1
      UNION ALL SELECT run_id, {rnd('avg(lat)', 6)}, {rnd('avg(lng)', 6)} FROM ve GROUP BY run_id HAVING count(elev)=0""",
    "st": f"SELECT run_id, priority, feature_id, lat, lng, {zone('lng')} AS zone FROM lowv JOIN best ON run_id=parcel_id",
    "su": utm("st", "lat", "lng", "zone", "se", "sn"),
    "od": plan._dist("SELECT run_id, se, sn, lu2.* FROM su JOIN lu2 USING (zone, priority, feature_id)", "se", "sn"),
    "pa": "SELECT run_id, zone, priority, se AS e, sn AS n, x1+t*(x2-x1) AS qe, y1+t*(y2-y1) AS qn FROM od QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY d)=1",
    **_profile("pa", ", priority"),
}
_OUT_DISTANCE = {k: v for k, v in _OUT.items() if k not in ("sm", "sl", "pf")}
_pairs = ", ".join(
    f"abs(v{i}-v{j})/(90e0*sqrt({(i//3-j//3)**2 + (i%3-j%3)**2}))*100e0" for i in range(9) for j in range(i + 1, 9)
)

CHECKS = {
    "sample_elevation": with_(DEM, f"SELECT parcel_id, v AS elevation_m FROM p LEFT JOIN px ON tile={_tile('lat', 'lng')} AND px_row={_row('lat', 'lat')} AND px_col={_col('lng', 'lng')}"),
    "slope_pct": with_({**DEM, "nb": f"SELECT parcel_id, k, v FROM (SELECT *, unnest(range(9)) AS k FROM p) JOIN px ON tile={_tile('lat', 'lng')} AND px_row={_row(f'lat+(k//3-1)*{_step}', 'lat')} AND px_col={_col(f'lng+(k%3-1)*{_step}', 'lng')}",
      "f": "SELECT parcel_id, count(*) AS found, " + ", ".join(f"max(v) FILTER (k={k}) AS v{k}" for k in range(9)) + " FROM nb GROUP BY parcel_id"},
      f"SELECT parcel_id, CASE WHEN found>=4 THEN {rnd(f'greatest(0e0, {_pairs})', 2)} END AS slope_pct FROM p LEFT JOIN f USING (parcel_id)"),
    "sample_ndwi_ndvi": with_(ZP, "SELECT parcel_id, a.value AS ndwi, b.value AS ndvi, zone_name IS NULL AS out_of_zone FROM zp LEFT JOIN zc a ON a.layer='ndwi' AND a.tile=zone_name AND a.px_row=zp.px_row AND a.px_col=zp.px_col LEFT JOIN zc b ON b.layer='ndvi' AND b.tile=zone_name AND b.px_row=zp.px_row AND b.px_col=zp.px_col"),
    "longest_axis": with_(AXIS, f"SELECT run_id, seq, seq2, {rnd('e', 2)} AS e, {rnd('n', 2)} AS n, {rnd('qe', 2)} AS qe, {rnd('qn', 2)} AS qn FROM axis"),
    "internal_profile": with_(_INT, "SELECT run_id, pos, distance_m, elevation_m, 'Internal Point ' || (pos+1) AS label FROM pf"),
    "outfall_profile": with_(_OUT, "SELECT run_id, pos, distance_m, elevation_m, CASE pos WHEN 0 THEN 'Plot Edge (Lowest)' WHEN 9 THEN CASE priority WHEN 1 THEN 'Canal' WHEN 2 THEN 'River Channel' ELSE 'Gutter' END ELSE 'Outfall Pt ' || pos END AS label FROM pf"),
    "outfall_distance": with_(_OUT_DISTANCE, f"SELECT lowv.run_id, {rnd('min(d)', 1)} AS outfall_m FROM lowv LEFT JOIN od USING (run_id) GROUP BY lowv.run_id"),
    "profile_range": with_({**_INT, "mm": "SELECT run_id, min(elevation_m) AS low, max(elevation_m) AS high FROM pf GROUP BY run_id"},
      f"SELECT run_id, {rnd('low-CASE WHEN high=low THEN 10e0 ELSE high-low END*0.1e0', 3)} AS axis_min, {rnd('high+CASE WHEN high=low THEN 10e0 ELSE high-low END*0.1e0', 3)} AS axis_max FROM mm"),
}
