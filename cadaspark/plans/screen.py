"""The end-to-end screening query and its check."""

from __future__ import annotations

from cadaspark.operators import measure
from cadaspark.plans import raster, rules, spatial
from cadaspark.plans.checks import INPUTS, with_
from cadaspark.sources import bridge as b

COLUMNS = [
    "parcel_id", "river_m", "strahler", "road_m", "elevation_m", "slope_pct", "ndwi", "ndvi", "proximity", "confidence",
    "flood_risk", "terrain", "traffic_light", "risk_score",
]


def screen(spark, sf):
    lines = b.lines(spark, sf)
    out = measure.screen(
        b.parcels(spark, sf), lines.filter("layer = 'river'"), lines.filter("layer = 'road'"),
        b.dem_cells(spark, sf), raster.zone_cells(spark, sf),
    )
    return out.select(*COLUMNS)


QUERIES = {"screen_parcels": screen}

_PARTS = {
    "p0": INPUTS["p"],
    **{
        f"m_{k}": v
        for k, v in {
            "river": spatial.CHECKS["nearest_river"], "road": spatial.CHECKS["nearest_road"],
            "elev": raster.CHECKS["sample_elevation"], "slope": raster.CHECKS["slope_pct"], "index": raster.CHECKS["sample_ndwi_ndvi"],
        }.items()
    },
    "p": """SELECT p0.* REPLACE (m_river.river_m AS river_m, m_river.strahler AS strahler, m_road.road_m AS road_m, m_elev.elevation_m AS elevation_m,
      m_slope.slope_pct AS slope_pct, m_index.ndwi AS ndwi, m_index.ndvi AS ndvi, m_index.out_of_zone AS out_of_zone)
      FROM p0 JOIN m_river USING (parcel_id) JOIN m_road USING (parcel_id) JOIN m_elev USING (parcel_id) JOIN m_slope USING (parcel_id) JOIN m_index USING (parcel_id)""",
    **{k: v for k, v in rules.CHAIN.items() if k != "p"},
}
CHECKS = {"screen_parcels": with_(_PARTS, f"SELECT {', '.join(COLUMNS)} FROM risk")}
