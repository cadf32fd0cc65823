"""Layer measurements and the rule chain over placed parcels, one row per parcel throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cadaspark.operators import raster, screening, spatial
from cadaspark.sources.scratch import forget, keep, large

MEASURED = ["river_m", "strahler", "road_m", "elevation_m", "slope_pct", "ndwi", "ndvi", "out_of_zone"]


def measure(parcels: DataFrame, rivers: DataFrame, roads: DataFrame, dem: DataFrame, indices: DataFrame) -> DataFrame:
    """Attach river, road, elevation, slope and satellite indices to parcels (lat, lng, ...).

    All layers are looked up for the distinct positions, so copies of a parcel cost one lookup. Each layer is a plan of its own: one plan of
    all of them takes the driver more memory than its limit leaves, whatever the size of the tables.
    """
    spots = keep(parcels.select("lat", "lng").distinct(), "spots")
    out = keep(spatial.nearest_river(spots, rivers), "with-river")
    out = keep(spatial.nearest_road(out, roads), "with-road")
    dem = keep(dem, "dem-cells")  # so that the shuffle that made it goes before the next one comes
    out = keep(raster.slope_pct(out, dem, elevation="elevation_m"), "with-slope")
    forget(dem)
    out = keep(raster.sample_ndwi_ndvi(out, indices), "with-indices")
    # a parcel without a position stays, unmeasured
    return parcels.drop(*MEASURED).join(large(out.select("lat", "lng", *MEASURED)), ["lat", "lng"], "left")


def screen(parcels: DataFrame, rivers: DataFrame, roads: DataFrame, dem: DataFrame, indices: DataFrame) -> DataFrame:
    """Measured parcels with flood level, terrain, light and score."""
    return screening.with_risk(screening.with_indicators(measure(parcels, rivers, roads, dem, indices)))
