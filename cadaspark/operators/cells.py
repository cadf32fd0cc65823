"""Grid-cell joins: every spatial match is an equi-join on a cell, refined by an exact test.

Copies never multiply work: callers reduce points to distinct places first and join results back.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadaspark.functions.geo import planar, segment_parameter, utm_zone, with_utm
from cadaspark.operators.circles import tile_counts
from cadaspark.sources.scratch import forget, keep, large

BASE_M = 1000.0
# Cell widths in base cells, coarse to fine, used to narrow the nearest search. Small steps at the end: every kept pair of cells becomes
# the square of a step squared.
DESCENT = (80, 16, 4, 2, 1)
# Cells with more than DENSE segments are split, level by level, into cells of these parts of a base cell.
FINER, DENSE = (4, 16, 64), 64
# Box cells in degrees, and how many salts spread the points of one cell at that level.
BOX_LEVELS = ((0.005, 1), (0.05, 4), (0.5, 16), (5.0, 64), (360.0, 256))
METRES_PER_DEGREE = 110000.0
# Tiles of the circle counts, and about how many places of a tile are counted at once.
TILE_M, TILE_PLACES = 16000.0, 32768


def places(points: DataFrame) -> DataFrame:
    """Distinct positions of ``points`` (lat, lng)."""
    return points.filter("lat IS NOT NULL AND lng IS NOT NULL").select("lat", "lng").distinct()


def project_points(points: DataFrame) -> DataFrame:
    return with_utm(points.withColumn("zone", utm_zone(F.col("lng"))), "lat", "lng", "zone", solid=True)


def _zones(low: Column, high: Column) -> Column:
    """Own zone and any adjacent zone whose parcels could still reach this feature.

    The one-degree margin is wider than the largest search bound (80 km).
    """
    return F.explode(
        F.array_compact(
            F.array(
                F.when(low < 7.0, 31),
                F.when((high >= 5.0) & (low < 13.0), 32),
                F.when(high >= 11.0, 33),
            )
        )
    )


def project_lines(lines: DataFrame) -> DataFrame:
    """Segments (lat1, lng1, lat2, lng2) in metres, once per zone that may look at them."""
    known = lines.dropna(subset=["lat1", "lng1", "lat2", "lng2"])
    spread = known.withColumn("zone", _zones(F.least("lng1", "lng2"), F.greatest("lng1", "lng2")))
    first = with_utm(spread, "lat1", "lng1", "zone", "x1", "y1", solid=True)
    return with_utm(first, "lat2", "lng2", "zone", "x2", "y2", solid=True)


def project_points_all_zones(points: DataFrame) -> DataFrame:
    spread = points.dropna(subset=["lat", "lng"]).withColumn("zone", _zones(F.col("lng"), F.col("lng")))
    return with_utm(spread, "lat", "lng", "zone", solid=True)


def _around(cell_x: Column, cell_y: Column, reach: int) -> tuple[Column, Column, Column]:
    """Explode index and the two coordinates of the (2 * reach + 1)^2 cells around a cell."""
    side = 2 * reach + 1
    k = F.col("_k")
    return (
        F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("_k"),
        cell_x + k % side - reach,
        cell_y + F.floor(k / side) - reach,
    )


def _cell(v: Column, size: float = BASE_M) -> Column:
    return F.floor(v / F.lit(size))


def _line_cells(lines: DataFrame, size: float = BASE_M) -> DataFrame:
    """Cells a segment may touch, with ``sure`` where the segment certainly has a point.

    A long segment is cut into pieces no wider than a cell, so no piece covers more than 2 x 2.
    """
    c = F.col
    longest = F.greatest(F.abs(c("x2") - c("x1")), F.abs(c("y2") - c("y1")))
    pieces = F.greatest(F.ceil(longest / F.lit(size)), F.lit(1))
    cut = lines.withColumn("_k", pieces).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), c("_k") - 1)))
    for axis in ("x", "y"):
        a, b = c(f"{axis}1"), c(f"{axis}2")
        cut = cut.withColumns(
            {
                f"_{axis}a": _cell(a + (b - a) * c("_i") / c("_k"), size),
                f"_{axis}b": _cell(a + (b - a) * (c("_i") + 1) / c("_k"), size),
            }
        )
    span = lambda a, b: F.sequence(F.least(c(a), c(b)), F.greatest(c(a), c(b)))
    out = cut.withColumn("cx", F.explode(span("_xa", "_xb"))).withColumn("cy", F.explode(span("_ya", "_yb")))
    sure = (c("cx") == c("_xa")) & (c("cy") == c("_ya"))
    return out.withColumn("sure", sure).drop("_k", "_i", "_xa", "_xb", "_ya", "_yb")


def _axis_gap(a: Column, b: Column, size: float) -> tuple[Column, Column]:
    """Smallest and largest distance along one axis between cells ``a`` and ``b`` of one size."""
    apart = F.abs(a - b).cast("double")
    return F.greatest(apart - 1.0, F.lit(0.0)) * size, (apart + 1.0) * size


def _candidate_cells(probe_cells: DataFrame, layer_cells: DataFrame, bound: float) -> DataFrame:
    """Layer cells that may hold the nearest feature of each probe cell.

    Works on cell tables only, whose size is bounded by the mapped area. Both sides descend together from 80 km cells to 1 km cells: at each level
    the nearest certainly occupied cell gives an upper bound that prunes the rest, so neither a large neighbourhood of fine cells nor one of
    coarse cells is ever listed for every fine probe cell. Each level is kept, so that its shuffles go before the next one's come.
    """
    c = F.col
    occupied = keep(layer_cells.groupBy("zone", "cx", "cy").agg(F.max("sure").alias("sure")), "occupied")
    top = DESCENT[0]
    start = probe_cells.select("zone", F.floor(c("ax") / top).alias("px"), F.floor(c("ay") / top).alias("py")).distinct()
    index, lx, ly = _around(c("px"), c("py"), 1)
    pairs = start.select("*", index).select("zone", "px", "py", lx.alias("lx"), ly.alias("ly"))
    parent, before = top, []
    under = lambda a, b, *names: [F.floor(c(k) / w).alias(n) for w, of in ((parent, names[:2]), (width, names[2:])) for k, n in zip((a, b), of)]
    for width in DESCENT:
        looking = probe_cells.select("zone", *under("ax", "ay", "px", "py", "wx", "wy")).distinct()
        level = occupied.groupBy("zone", *under("cx", "cy", "lx", "ly", "bx", "by")).agg(F.max("sure").alias("sure"))
        met = pairs.join(large(looking), ["zone", "px", "py"]).join(large(level), ["zone", "lx", "ly"])
        # dealt out before the distances are there: cells are small and compress, distances do not
        met = met.select("zone", "wx", "wy", "bx", "by", "sure").repartition("zone", "wx", "wy")
        size = BASE_M * width
        (x_low, x_high), (y_low, y_high) = _axis_gap(c("wx"), c("bx"), size), _axis_gap(c("wy"), c("by"), size)
        met = met.withColumns(
            {
                "low": F.sqrt(x_low * x_low + y_low * y_low),
                "high": F.when(c("sure"), F.sqrt(x_high * x_high + y_high * y_high)),
            }
        )
        per_probe = Window.partitionBy("zone", "wx", "wy")
        met = met.withColumn("reach", F.coalesce(F.least(F.min("high").over(per_probe), F.lit(bound)), F.lit(bound)))
        pairs = met.filter("low <= reach").select("zone", c("wx").alias("px"), c("wy").alias("py"), c("bx").alias("lx"), c("by").alias("ly"))
        pairs = keep(pairs, "cell-pairs")
        forget(*before)
        parent, before = width, [pairs]
    forget(occupied)
    return pairs.select("zone", c("px").alias("ax"), c("py").alias("ay"), c("lx").alias("cx"), c("ly").alias("cy"))


def nearest(points: DataFrame, lines: DataFrame, bound: float, carry: list[str]) -> DataFrame:
    """Nearest segment within ``bound`` metres of each distinct place of ``points``.

    Candidate cells come from a descent over cell tables; dense ones are split further, and each place keeps only the small cells within reach of it, so a
    place in a crowded city meets about as few segments as one outside. Returns (lat, lng, distance_m, *carry); places with nothing in range are absent. Ties within a
    millimetre go to the lower ``feature_id``.
    """
    c = F.col
    probes = keep(project_points(places(points)).withColumns({"ax": _cell(c("e")), "ay": _cell(c("n"))}), "probes")
    layer = _line_cells(keep(project_lines(lines), "layer-lines"))
    probe_cells = probes.select("zone", "ax", "ay").distinct()
    pairs = _candidate_cells(probe_cells, layer.select("zone", "cx", "cy", "sure"), bound)
    met = probes.join(large(pairs), ["zone", "ax", "ay"]).select("zone", "lat", "lng", "e", "n", F.lit(0).alias("level"), "cx", "cy")
    filed = layer.select("zone", F.lit(0).alias("level"), "cx", "cy", "x1", "y1", "x2", "y2", "feature_id", *carry)
    met, filed = _split_dense(met, filed)
    met = met.join(large(filed), ["zone", "level", "cx", "cy"])
    measured = met.withColumn("distance_m", line_distance())
    best = measured.filter(c("distance_m") <= bound).groupBy("lat", "lng").agg(
        F.min(F.struct(F.floor(c("distance_m") * 1000 + 0.5).alias("mm"), "feature_id", "distance_m", *carry)).alias("b")
    )
    return best.select("lat", "lng", "b.distance_m", *[f"b.{k}" for k in carry])


def _split_dense(met: DataFrame, filed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places with their candidate cells, and segments by cell, after crowded cells have been split where they are crowded.

    Of a split cell a place keeps the parts that are no farther than the nearest part with a certain point of a segment may be.
    """
    c = F.col
    segment = [k for k in filed.columns if k not in ("level", "cx", "cy")]
    ratio_before = 1
    for level, ratio in enumerate(FINER, 1):
        of_cell = ["zone", "level", "cx", "cy"]
        last = filed.where(c("level") == level - 1)
        dense = keep(last.groupBy(*of_cell).agg(F.count("*").alias("held")).where(c("held") > DENSE).select(*of_cell), "dense-cells")
        if dense.limit(1).count() == 0:
            break
        size, step = BASE_M / ratio, ratio // ratio_before
        crowd = last.join(dense, of_cell, "left_semi").select(*segment).distinct()
        parent = [F.floor(c(k) / step).alias(f"p{k}") for k in ("cx", "cy")]
        above = dense.select("zone", c("cx").alias("pcx"), c("cy").alias("pcy"))
        parts = _line_cells(crowd, size).select("*", *parent).join(above, ["zone", "pcx", "pcy"], "left_semi")
        parts = keep(parts, "cell-parts")
        children = parts.groupBy("zone", "pcx", "pcy", "cx", "cy").agg(F.max("sure").alias("sure"))
        near = met.join(dense, of_cell, "left_semi").withColumnsRenamed({"cx": "pcx", "cy": "pcy"}).join(large(children), ["zone", "pcx", "pcy"])
        gaps = {k: (c(v) - c(f"c{x}") * size, (c(f"c{x}") + 1) * size - c(v)) for k, v, x in (("x", "e", "x"), ("y", "n", "y"))}
        (xa, xb), (ya, yb) = gaps["x"], gaps["y"]
        low_x, low_y = F.greatest(-xa, -xb, F.lit(0.0)), F.greatest(-ya, -yb, F.lit(0.0))
        high_x, high_y = F.greatest(F.abs(xa), F.abs(xb)), F.greatest(F.abs(ya), F.abs(yb))
        near = near.withColumns({
            "low": F.sqrt(low_x * low_x + low_y * low_y), "high": F.when(c("sure"), F.sqrt(high_x * high_x + high_y * high_y)),
        })
        reach = F.min("high").over(Window.partitionBy("zone", "lat", "lng"))
        near = near.withColumn("reach", reach).where("reach IS NULL OR low <= reach + 1e-6")
        near = near.select(*met.columns[:-3], F.lit(level).alias("level"), "cx", "cy")
        met = keep(met.join(dense, of_cell, "left_anti").select(*near.columns).union(near), "candidate-cells")
        filed = filed.join(dense, of_cell, "left_anti").select(*filed.columns).union(parts.withColumn("level", F.lit(level)).select(*filed.columns))
        ratio_before = ratio
    return met, filed


def line_distance(px: str = "e", py: str = "n") -> Column:
    c = F.col
    t = segment_parameter(c(px), c(py), c("x1"), c("y1"), c("x2"), c("y2"))
    return planar(c(px), c(py), c("x1") + t * (c("x2") - c("x1")), c("y1") + t * (c("y2") - c("y1")))


def box_join(points: DataFrame, boxes: DataFrame, keep: list[str]) -> DataFrame:
    """Points (lat, lng, ...) inside boxes (min_lat, max_lat, min_lng, max_lng) of any size.

    A box is filed at the first level whose cell is at least as wide as the box, so it covers at
    most 2 x 2 cells there; a point looks up one cell per level. Coarse cells hold most points, so
    points are salted and the (few) coarse boxes repeated per salt.
    """
    c = F.col
    width = F.greatest(c("max_lat") - c("min_lat"), c("max_lng") - c("min_lng"))
    level = F.lit(len(BOX_LEVELS) - 1)
    for i in range(len(BOX_LEVELS) - 2, -1, -1):
        level = F.when(width <= BOX_LEVELS[i][0], i).otherwise(level)
    sizes = F.array(*[F.lit(s) for s, _ in BOX_LEVELS])
    salts = F.array(*[F.lit(k) for _, k in BOX_LEVELS])
    filed = boxes.withColumn("_lv", level).withColumn("_sz", F.element_at(sizes, c("_lv") + 1))
    span = lambda a, b: F.explode(F.sequence(F.floor(c(a) / c("_sz")), F.floor(c(b) / c("_sz"))))
    filed = (
        filed.withColumn("_ci", span("min_lat", "max_lat"))
        .withColumn("_cj", span("min_lng", "max_lng"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.element_at(salts, c("_lv") + 1) - 1)))
        .select("_lv", "_ci", "_cj", "_salt", "min_lat", "max_lat", "min_lng", "max_lng", *keep)
    )
    look = F.array(
        *[
            F.struct(
                F.lit(i).alias("lv"),
                F.floor(c("lat") / s).alias("ci"),
                F.floor(c("lng") / s).alias("cj"),
                F.pmod(F.xxhash64("lat", "lng"), F.lit(k)).cast("int").alias("salt"),
            )
            for i, (s, k) in enumerate(BOX_LEVELS)
        ]
    )
    probes = points.withColumn("_c", F.explode(look)).select(
        *points.columns, c("_c.lv").alias("_lv"), c("_c.ci").alias("_ci"), c("_c.cj").alias("_cj"),
        c("_c.salt").alias("_salt"),
    )
    met = probes.join(large(filed), ["_lv", "_ci", "_cj", "_salt"])
    inside = c("lat").between(c("min_lat"), c("max_lat")) & c("lng").between(c("min_lng"), c("max_lng"))
    return met.filter(inside).select(*points.columns, *keep)


def box_around(lat: Column, lng: Column, radius: Column) -> dict[str, Column]:
    """A box certain to contain the circle of ``radius`` metres."""
    dlat = radius / METRES_PER_DEGREE
    dlng = dlat / F.cos(F.radians(F.least(F.abs(lat) + dlat, F.lit(89.0))))
    return {"min_lat": lat - dlat, "max_lat": lat + dlat, "min_lng": lng - dlng, "max_lng": lng + dlng}


def box_of_lines(margin: float) -> dict[str, Column]:
    """Box of one segment (lat1, lng1, lat2, lng2) grown by ``margin`` metres."""
    c = F.col
    low_lat, high_lat = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    dlat = F.lit(margin / METRES_PER_DEGREE)
    dlng = dlat / F.cos(F.radians(F.least(F.greatest(F.abs(c("lat1")), F.abs(c("lat2"))) + dlat, F.lit(89.0))))
    return {
        "min_lat": low_lat - dlat, "max_lat": high_lat + dlat,
        "min_lng": F.least("lng1", "lng2") - dlng, "max_lng": F.greatest("lng1", "lng2") + dlng,
    }


def ring_counts(points: DataFrame, targets: DataFrame, radii: list[float]) -> DataFrame:
    """Targets within each radius of each distinct place, counted exactly.

    Target copies are collapsed to (place, weight). Places are grouped by tile, crowded tiles in parts; a target goes to the tiles that
    it can be reached from, once per part. No pair of a place and a target travels. Returns (lat, lng, within_0, within_1, ...).
    """
    c = F.col
    tile, part = ["zone", "tx", "ty"], ["zone", "tx", "ty", "part"]
    weighted = targets.groupBy("lat", "lng").agg(F.count("*").alias("w"))
    goal = project_points_all_zones(weighted).where("NOT isnan(e) AND NOT isnan(n)")
    probes = project_points(places(points)).withColumns({"tx": _cell(c("e"), TILE_M), "ty": _cell(c("n"), TILE_M)})
    probes = keep(probes.select(*tile, "lat", "lng", "e", "n"), "ring-places")
    tiles = probes.groupBy(*tile).agg(F.ceil(F.count("*") / F.lit(TILE_PLACES)).alias("parts"))
    dealt = probes.join(large(tiles), tile).withColumn("part", F.pmod(F.xxhash64("lat", "lng"), c("parts")))
    reach = F.lit(float(max(radii)) + 1.0)
    span = lambda v: F.explode(F.sequence(_cell(c(v) - reach, TILE_M), _cell(c(v) + reach, TILE_M)))
    near = goal.withColumn("tx", span("e")).withColumn("ty", span("n")).join(large(tiles), tile)
    near = near.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), c("parts") - 1)))

    def count(mine: pa.Table, around: pa.Table) -> pa.Table:
        return tile_counts(mine, around, radii)

    schema = "lat double, lng double, " + ", ".join(f"within_{i} long" for i in range(len(radii)))
    grouped = dealt.select(*part, "lat", "lng", "e", "n").groupBy(*part)
    return grouped.cogroup(near.select(*part, "e", "n", "w").groupBy(*part)).applyInArrow(count, schema)
