"""Raster sampling as equi-joins on a cell table (layer, tile, px_row, px_col, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadaspark.functions import geo
from cadaspark.functions.numeric import rnd
from cadaspark.operators import hulls, rings
from cadaspark.operators.spatial import SENTINEL_ZONES, sentinel_zone
from cadaspark.sources.scratch import keep, large

PIXELS = 1200
NODATA = -9999.0
STEP_DEG = 90.0 / 111320.0
STEP_M = 90.0
SAMPLES = 10
ON_EDGE_M = 1e-6


def tile_of(lat: Column, lng: Column) -> Column:
    """Tile name from the integer part of the position, e.g. N06E003."""
    y, x = lat.cast("int"), lng.cast("int")
    return F.concat(
        F.when(lat >= 0, "N").otherwise("S"), F.lpad(F.abs(y).cast("string"), 2, "0"),
        F.when(lng >= 0, "E").otherwise("W"), F.lpad(F.abs(x).cast("string"), 3, "0"),
    )


def _pixel(lat: Column, lng: Column, lat0: Column, lng0: Column) -> dict[str, Column]:
    """Row and column inside the one-degree tile whose corner is (lat0, lng0)."""
    return {
        "px_row": F.floor((lat0 + 1 - lat) * float(PIXELS)),
        "px_col": F.floor((lng - lng0) * float(PIXELS)),
    }


def _valued(cells: DataFrame, layer: str, out: str) -> DataFrame:
    v = F.col("value")
    return large(cells.filter((F.col("layer") == layer) & (v > NODATA)).select("tile", "px_row", "px_col", v.alias(out)))


def sample_elevation(points: DataFrame, cells: DataFrame, lat: str = "lat", lng: str = "lng", out: str = "elevation_m") -> DataFrame:
    a, b = F.col(lat), F.col(lng)
    keyed = points.withColumns({"tile": tile_of(a, b), **_pixel(a, b, F.floor(a), F.floor(b))})
    return keyed.join(_valued(cells, "dem", out), ["tile", "px_row", "px_col"], "left").drop("tile", "px_row", "px_col")


def lowest_vertex(vertices: DataFrame, cells: DataFrame) -> DataFrame:
    """run_id, lat, lng of the lowest boundary vertex of each ring by sampled elevation, the earliest of equals.

    A ring without any sampled elevation gets its centroid, the mean of all its vertices.
    """
    c = F.col
    sampled = sample_elevation(vertices.select("run_id", "seq", "lat", "lng"), cells)
    found = sampled.groupBy("run_id").agg(
        F.min(F.when(c("elevation_m").isNotNull(), F.struct("elevation_m", "seq", "lat", "lng"))).alias("low"),
        rnd(F.avg("lat"), 6).alias("lat"), rnd(F.avg("lng"), 6).alias("lng"),
    )
    return found.select("run_id", F.coalesce("low.lat", "lat").alias("lat"), F.coalesce("low.lng", "lng").alias("lng"))


def slope_pct(points: DataFrame, cells: DataFrame, elevation: str | None = None) -> DataFrame:
    """Steepest rise over run between any two of 3 x 3 samples 90 m apart.

    Nine lookups per distinct place, folded back into nine columns; the 36 pairs are one expression.
    Samples outside the place's own tile are missing, as there. ``elevation`` names a column for the sample in the middle,
    which is that of ``sample_elevation``, so that both need the cells to travel once.
    """
    c = F.col
    spots = points.select("lat", "lng").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8))))
    la = c("lat") + (F.floor(c("k") / 3) - 1) * F.lit(STEP_DEG)
    ln = c("lng") + (c("k") % 3 - 1) * F.lit(STEP_DEG)
    keyed = spots.withColumns(
        {"tile": tile_of(c("lat"), c("lng")), **_pixel(la, ln, F.floor("lat"), F.floor("lng"))}
    )
    met = keyed.join(_valued(cells, "dem", "v"), ["tile", "px_row", "px_col"])
    folded = met.groupBy("lat", "lng").agg(
        F.count("*").alias("found"), *[F.max(F.when(c("k") == k, c("v"))).alias(f"v{k}") for k in range(9)]
    )
    pairs = [
        F.abs(c(f"v{a}") - c(f"v{b}")) / (STEP_M * math.hypot(a // 3 - b // 3, a % 3 - b % 3)) * 100.0
        for a in range(9)
        for b in range(a + 1, 9)
    ]
    steep = F.when(c("found") >= 4, rnd(F.greatest(F.lit(0.0), *pairs), 2))
    middle = [c("v4").alias(elevation)] if elevation else []
    return points.join(large(folded.select("lat", "lng", *middle, steep.alias("slope_pct"))), ["lat", "lng"], "left")


def zone_pixels(points: DataFrame, zones=SENTINEL_ZONES) -> DataFrame:
    """Zone name and pixel of each point; null outside every zone."""
    c = F.col
    row = col = None
    for name, a, b, x, y in zones:
        r = F.floor((F.lit(b) - c("lat")) / (b - a) * float(PIXELS))
        k = F.floor((c("lng") - F.lit(x)) / (y - x) * float(PIXELS))
        hit = c("zone_name") == name
        row, col = (F.when(hit, r), F.when(hit, k)) if row is None else (row.when(hit, r), col.when(hit, k))
    named = points.withColumn("zone_name", sentinel_zone(c("lat"), c("lng"), zones))
    return named.withColumns({"px_row": row, "px_col": col})


def sample_ndwi_ndvi(points: DataFrame, cells: DataFrame) -> DataFrame:
    keyed = zone_pixels(points).withColumnRenamed("zone_name", "tile")
    at = ["tile", "px_row", "px_col"]
    out = keyed.join(_valued(cells, "ndwi", "ndwi"), at, "left").join(_valued(cells, "ndvi", "ndvi"), at, "left")
    return out.withColumn("out_of_zone", F.col("tile").isNull()).drop(*at)


def metric_rings(vertices: DataFrame) -> DataFrame:
    """Vertices in metres, every vertex of a ring in the zone of the ring's mean longitude."""
    zones = vertices.groupBy("run_id").agg(geo.utm_zone(rnd(F.avg("lng"), 6)).alias("zone"))
    return geo.with_utm(vertices.join(large(zones), "run_id"), "lat", "lng", "zone", solid=True)


def longest_axis(metric: DataFrame) -> DataFrame:
    """Farthest vertex pair of each ring, clipped to the ring (its longest inside piece); of zero length where all vertices coincide."""
    metric = keep(metric, "rings")
    edges = rings.ring_edges(metric, "e", "n", rings.CLOSE_M).select("run_id", "x1", "y1", "x2", "y2")
    return clipped(keep(hulls.longest_pairs(metric), "axis"), edges)


def clipped(axis: DataFrame, edges: DataFrame) -> DataFrame:
    """The longest run of pieces of each axis that lie inside its ring.

    Each edge is compared with the axis of its own ring only: it crosses the axis' line somewhere, or lies along it. Sorted along the line, crossings
    switch between outside and inside; a stretch along an edge belongs to the ring.
    """
    c = F.col
    dx, dy = c("qe") - c("e"), c("qn") - c("n")
    side = lambda k: dx * (c(f"y{k}") - c("n")) - dy * (c(f"x{k}") - c("e"))
    along = lambda k: (c(f"x{k}") - c("e")) * dx + (c(f"y{k}") - c("n")) * dy
    line = axis.select("run_id", "e", "n", "qe", "qn", (dx * dx + dy * dy).alias("square")).where("square > 0")
    met = line.join(large(edges), "run_id").withColumns({"s1": side(1), "s2": side(2), "t1": along(1) / c("square"), "t2": along(2) / c("square")})
    crossing = met.where((c("s1") > 0) != (c("s2") > 0)).select(
        "run_id", (c("t1") + (c("t2") - c("t1")) * c("s1") / (c("s1") - c("s2"))).alias("t"), F.lit(1).alias("flip"), F.lit(0).alias("cover")
    )
    near = F.greatest(F.abs("s1"), F.abs("s2")) <= F.sqrt("square") * ON_EDGE_M
    ends = F.explode(F.array(
        F.struct(F.least("t1", "t2").alias("t"), F.lit(1).alias("cover")), F.struct(F.greatest("t1", "t2").alias("t"), F.lit(-1).alias("cover"))
    )).alias("at")
    lying = met.where(near & (c("t1") != c("t2"))).select("run_id", ends).select("run_id", "at.t", F.lit(0).alias("flip"), "at.cover")
    border = line.select("run_id", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"), F.lit(0).alias("flip"), F.lit(0).alias("cover"))
    events = crossing.unionByName(lying).unionByName(border).groupBy("run_id", rnd(c("t"), 9).alias("t")).agg(
        F.sum("flip").alias("flip"), F.sum("cover").alias("cover")
    )
    order = Window.partitionBy("run_id").orderBy("t")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = events.select(
        "run_id", "t", F.lead("t").over(order).alias("until"), F.sum("flip").over(before).alias("flips"), F.sum("cover").over(before).alias("covers")
    ).where("t >= 0 AND until <= 1")
    # neighbouring inside pieces belong together: outside pieces number the islands
    pieces = pieces.withColumn("inside", (c("flips") % 2 == 1) | (c("covers") > 0))
    islands = pieces.withColumn("island", F.sum(F.when(c("inside"), 0).otherwise(1)).over(before))
    spans = islands.where("inside").groupBy("run_id", "island").agg(F.min("t").alias("a"), F.max("until").alias("b"))
    longest = spans.groupBy("run_id").agg(
        F.min(F.struct((-F.floor((c("b") - c("a")) * 1e6 + 0.5)).alias("rank"), "a", "b")).alias("s")
    )
    joined = axis.join(large(longest), "run_id", "left")
    a, b = F.coalesce(c("s.a"), F.lit(0.0)), F.coalesce(c("s.b"), F.lit(1.0))
    return joined.select(
        "run_id", "seq", "seq2", "zone",
        (c("e") + a * dx).alias("e"), (c("n") + a * dy).alias("n"),
        (c("e") + b * dx).alias("qe"), (c("n") + b * dy).alias("qn"),
    )


def _profile(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """Ten equidistant samples from (e, n) to (qe, qn)."""
    c = F.col
    points = lines.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1))))
    share = c("pos") / float(SAMPLES - 1)
    length = geo.planar(c("e"), c("n"), c("qe"), c("qn"))
    points = points.withColumns(
        {
            "pe": c("e") + share * (c("qe") - c("e")),
            "pn": c("n") + share * (c("qn") - c("n")),
            "distance_m": rnd(share * length, 2),
        }
    )
    located = geo.with_latlng(points, "pe", "pn", "zone", "plat", "plng")
    sampled = sample_elevation(located, cells, "plat", "plng", "raw_m")
    jitter = F.sin((c("plat") + c("plng")) * 100000.0) * 0.4
    return sampled.withColumn("elevation_m", rnd(c("raw_m") + jitter, 2))


def internal_profile(axis: DataFrame, cells: DataFrame) -> DataFrame:
    label = F.concat(F.lit("Internal Point "), (F.col("pos") + 1).cast("string"))
    return _profile(axis, cells).select("run_id", "pos", "distance_m", "elevation_m", label.alias("label"))


def outfall_profile(paths: DataFrame, cells: DataFrame) -> DataFrame:
    c = F.col
    end = F.when(c("priority") == 1, "Canal").when(c("priority") == 2, "River Channel").otherwise("Gutter")
    label = (
        F.when(c("pos") == 0, "Plot Edge (Lowest)")
        .when(c("pos") == SAMPLES - 1, end)
        .otherwise(F.concat(F.lit("Outfall Pt "), c("pos").cast("string")))
    )
    return _profile(paths, cells).select("run_id", "pos", "distance_m", "elevation_m", label.alias("label"))


def profile_range(profiles: DataFrame) -> DataFrame:
    """Elevation axis of a chart: extremes with a tenth of the range as padding; null for a run without any elevation."""
    c = F.col
    seen = profiles.groupBy("run_id").agg(
        F.min("elevation_m").alias("low"), F.max("elevation_m").alias("high")
    )
    pad = F.when(c("high") == c("low"), 10.0).otherwise(c("high") - c("low")) * 0.1
    return seen.select("run_id", rnd(c("low") - pad, 3).alias("axis_min"), rnd(c("high") + pad, 3).alias("axis_max"))
