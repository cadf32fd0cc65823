"""Parcel-to-layer joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaspark.functions import geo
from cadaspark.functions.numeric import rnd
from cadaspark.operators import cells, polygons
from cadaspark.operators.carried import scan
from cadaspark.sources.scratch import large

RIVER_BOUND_M = 80000.0
ROAD_BOUND_M = 50000.0
OUTFALL_M = 200.0
RING_RADII_M = [1000.0, 5000.0, 10000.0]
SAME_PARCEL_M = 10.0
DEFAULT_MATCH_M = 100.0

# Major facilities (lat, lng).
FACILITIES = {
    "airport": [
        (6.5774, 3.3214), (9.0069, 7.2625), (4.9008, 6.9497), (12.0476, 8.5246), (5.0030, 8.3472),
        (6.4736, 7.5618), (6.3170, 5.5995),
    ],
    "port": [(6.4398, 3.3667), (6.4378, 3.3052), (4.7769, 7.0358), (4.7167, 7.1500), (5.5167, 5.7500)],
    "rail": [
        (6.4531, 3.3958), (6.6597, 3.2977), (7.3776, 3.9470), (5.5167, 5.7500), (4.8156, 7.0498),
        (9.0337, 7.2822), (10.5167, 7.4333),
    ],
}
# Satellite zones (name, lat_min, lat_max, lng_min, lng_max).
SENTINEL_ZONES = [("Lagos", 6.35, 6.90, 3.18, 4.02), ("Rivers", 4.65, 4.95, 6.85, 7.20)]
# Land-use tags that conflict with building, and those that are water channels.
CONFLICT_TAGS = [
    "wetland", "marsh", "water", "reservoir", "forest", "wood", "nature_reserve", "protected_area",
    "military", "cemetery", "landfill",
]
WATER_TAGS = ["water", "reservoir", "canal", "wetland", "marsh"]


def nearest_river(parcels: DataFrame, rivers: DataFrame) -> DataFrame:
    near = cells.nearest(parcels, rivers, RIVER_BOUND_M, ["strahler"])
    near = near.withColumn("river_m", rnd(F.col("distance_m"), 1)).drop("distance_m")
    return parcels.join(large(near), ["lat", "lng"], "left")


def nearest_road(parcels: DataFrame, roads: DataFrame) -> DataFrame:
    near = cells.nearest(parcels, roads, ROAD_BOUND_M, [])
    near = near.withColumn("road_m", rnd(F.col("distance_m"), 1)).drop("distance_m")
    return parcels.join(large(near), ["lat", "lng"], "left")


def nearest_facility(lat: Column, lng: Column) -> dict[str, Column]:
    """Kilometres to the closest facility per kind; the fixed lists unroll into one expression."""
    return {
        f"{kind}_km": rnd(F.least(*[geo.haversine(lat, lng, F.lit(a), F.lit(b), 6371.0) for a, b in spots]), 2)
        for kind, spots in FACILITIES.items()
    }


def building_rings(parcels: DataFrame, buildings: DataFrame) -> DataFrame:
    counts = cells.ring_counts(parcels, buildings, RING_RADII_M)
    named = counts.select("lat", "lng", *[F.col(f"within_{i}").alias(n) for i, n in enumerate(("n1", "n5", "n10"))])
    return parcels.join(large(named), ["lat", "lng"], "left")


def landuse_conflicts(parcels: DataFrame, edges: DataFrame, radius: float = OUTFALL_M) -> DataFrame:
    """Sorted conflicting tags per parcel (at most the eleven listed)."""
    tags = edges.select("feature_id", F.lower(F.trim("tag")).alias("tag")).filter(F.col("tag").isin(CONFLICT_TAGS))
    relevant = edges.join(large(tags.select("feature_id").distinct()), "feature_id", "left_semi")
    hits = polygons.in_metres(parcels, relevant, radius).join(large(tags.distinct()), "feature_id")
    found = hits.groupBy("lat", "lng").agg(F.sort_array(F.collect_set("tag")).alias("conflicts"))
    joined = parcels.join(large(found), ["lat", "lng"], "left")
    return joined.withColumn("conflicts", F.coalesce("conflicts", F.array().cast("array<string>")))


def outfall_asset(
    parcels: DataFrame, lines: DataFrame, landuse: DataFrame, any_landuse: bool = False
) -> DataFrame:
    """Drainage asset within 200 m of each place: canal before river before road, then nearest.

    Only water classes count as a canal unless ``any_landuse`` asks for every polygon.
    Returns (lat, lng, asset, feature_id, distance_m) for places that have one.
    """
    c = F.col
    spots = cells.places(parcels)
    boxed = cells.project_lines(lines).withColumnRenamed("zone", "line_zone").withColumns(cells.box_of_lines(OUTFALL_M))
    near = cells.box_join(
        cells.project_points(spots), boxed, ["layer", "feature_id", "line_zone", "x1", "y1", "x2", "y2"]
    ).filter("zone = line_zone")
    linear = near.withColumn("distance_m", cells.line_distance()).filter(c("distance_m") <= OUTFALL_M).select(
        "lat", "lng", F.when(c("layer") == "river", 2).otherwise(3).alias("priority"), "feature_id", "distance_m"
    )
    wet = landuse if any_landuse else landuse.filter(F.lower("tag").isin(WATER_TAGS))
    canals = polygons.in_metres(spots, wet, OUTFALL_M).select(
        "lat", "lng", F.lit(1).alias("priority"), "feature_id", "distance_m"
    )
    best = linear.unionByName(canals).groupBy("lat", "lng").agg(
        F.min(
            F.struct("priority", F.floor(c("distance_m") * 1000 + 0.5).alias("mm"), "feature_id", "distance_m")
        ).alias("b")
    )
    name = F.when(c("b.priority") == 1, "Drainage Canal").when(c("b.priority") == 2, "Active River").otherwise("Paved Road")
    return best.select("lat", "lng", name.alias("asset"), "b.priority", "b.feature_id", "b.distance_m")


def asset_segments(lines: DataFrame, landuse: DataFrame) -> DataFrame:
    """All drainable geometry as segments keyed by (priority, feature_id)."""
    cols = ["feature_id", "lat1", "lng1", "lat2", "lng2"]
    return lines.select(F.when(F.col("layer") == "river", 2).otherwise(3).alias("priority"), *cols).unionByName(
        landuse.select(F.lit(1).alias("priority"), *cols)
    )


def outfall_path(starts: DataFrame, segments: DataFrame) -> DataFrame:
    """From each start (run_id, lat, lng, priority, feature_id) to the closest point of its asset.

    Returns run_id, zone, (e, n) start and (qe, qn) end in metres, and ``outfall_m``.
    """
    c = F.col
    met = cells.project_points(starts).join(
        large(cells.project_lines(segments).drop("lat1", "lng1", "lat2", "lng2")), ["priority", "feature_id", "zone"]
    )
    t = geo.segment_parameter(c("e"), c("n"), c("x1"), c("y1"), c("x2"), c("y2"))
    met = met.withColumns({"qe": c("x1") + t * (c("x2") - c("x1")), "qn": c("y1") + t * (c("y2") - c("y1"))})
    met = met.withColumn("outfall_m", geo.planar(c("e"), c("n"), c("qe"), c("qn")))
    best = met.groupBy("run_id").agg(
        F.min(F.struct("outfall_m", "qe", "qn", "zone", "e", "n", "priority")).alias("b")
    )
    return best.select("run_id", "b.*")


def registry_match(parcels: DataFrame, records: DataFrame) -> DataFrame:
    """First record in file order whose own radius covers the parcel.

    ``records``: id, record_order, lat, lng, match_radius_m. Returns (lat, lng, record_id, distance_m).
    """
    c = F.col
    circle = records.select(
        "id", "record_order", c("lat").alias("rlat"), c("lng").alias("rlng"),
        F.coalesce("match_radius_m", F.lit(DEFAULT_MATCH_M)).alias("radius"),
    )
    boxed = circle.withColumns(cells.box_around(c("rlat"), c("rlng"), c("radius")))
    met = cells.box_join(cells.places(parcels), boxed, ["id", "record_order", "rlat", "rlng", "radius"])
    met = met.withColumn("distance_m", geo.haversine(c("lat"), c("lng"), c("rlat"), c("rlng")))
    first = met.filter(c("distance_m") <= c("radius")).groupBy("lat", "lng").agg(
        F.min(F.struct("record_order", "id", "distance_m")).alias("b")
    )
    return first.select("lat", "lng", c("b.id").alias("record_id"), "b.distance_m")


def near_places(reports: DataFrame, tolerance: float = SAME_PARCEL_M) -> DataFrame:
    """Ordered pairs (lat, lng) -> (qlat, qlng) of distinct places within ``tolerance``, itself included."""
    c = F.col
    spots = cells.places(reports)
    other = spots.select(c("lat").alias("qlat"), c("lng").alias("qlng"))
    boxed = other.withColumns(cells.box_around(c("qlat"), c("qlng"), F.lit(tolerance * 1.01)))
    met = cells.box_join(spots, boxed, ["qlat", "qlng"])
    return met.filter(geo.haversine(c("lat"), c("lng"), c("qlat"), c("qlng")) <= tolerance)


def prior_report(reports: DataFrame, tolerance: float = SAME_PARCEL_M) -> DataFrame:
    """Most recent earlier report within ``tolerance`` metres of each report.

    An as-of join: the reports around one place form one stream in time order, and the predecessor
    of a report there is its answer. No pair of reports is ever formed, and a busy place spreads over many tasks.
    """
    c = F.col
    timeline = reports.select(c("lat").alias("qlat"), c("lng").alias("qlng"), "report_id", "generated_at")
    stream = near_places(reports, tolerance).join(large(timeline), ["qlat", "qlng"])
    linked = scan(stream, ["lat", "lng"], ["generated_at", "report_id"], previous={"prior": ["report_id", "generated_at"]})
    own = linked.filter((c("lat") == c("qlat")) & (c("lng") == c("qlng")))
    return own.select(
        "report_id", "generated_at",
        c("prior.report_id").alias("prior_report_id"), c("prior.generated_at").alias("prior_generated_at"),
    )


def tile_counts(reports: DataFrame, zoom: int) -> DataFrame:
    x, y = geo.mercator_tile(F.col("lat"), F.col("lng"), zoom)
    keyed = reports.select(F.lit(zoom).alias("z"), x.alias("x"), y.alias("y"), "traffic_light")
    return keyed.groupBy("z", "x", "y", "traffic_light").agg(F.count("*").alias("parcels"))


def sentinel_zone(lat: Column, lng: Column, zones=SENTINEL_ZONES) -> Column:
    out = None
    for name, a, b, c, d in zones:
        hit = lat.between(a, b) & lng.between(c, d)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def admin_lookup(parcels: DataFrame, outlines: DataFrame) -> DataFrame:
    """Boundary table lookup; ``outlines`` are polygon edges with state and area names."""
    names = outlines.select("feature_id", "state", "area").distinct()
    hits = polygons.in_degrees(parcels, outlines).groupBy("lat", "lng").agg(F.min("feature_id").alias("feature_id"))
    found = hits.join(names, "feature_id").select("lat", "lng", F.col("state").alias("_s"), F.col("area").alias("_a"))
    joined = parcels.join(large(found), ["lat", "lng"], "left")
    return joined.withColumns(
        {
            "admin_state": F.coalesce(F.replace(F.col("_s"), F.lit(" State"), F.lit("")), F.lit("Unresolved — confirm State")),
            "admin_area": F.coalesce("_a", F.lit("Unresolved — confirm LGA")),
        }
    ).drop("_s", "_a")


def registry_office(parcels: DataFrame, offices: DataFrame, default: str) -> DataFrame:
    """Office by (state, area), then by state (null area), then the global default."""
    c = F.col
    by_area = offices.filter(c("office_area").isNotNull()).withColumnRenamed("office", "area_office")
    by_state = offices.filter(c("office_area").isNull()).select(
        c("office_state").alias("default_state"), c("office").alias("state_office")
    )
    joined = parcels.join(
        by_area, (c("state") == c("office_state")) & (c("lga") == c("office_area")), "left"
    ).join(by_state, c("state") == c("default_state"), "left")
    return joined.withColumn("office", F.coalesce("area_office", "state_office", F.lit(default))).drop(
        "office_state", "office_area", "area_office", "default_state", "state_office"
    )
