"""Ordered-vertex geometry over long tables ``(run_id, seq, ...)`` with a dense ``seq`` from 0.

Edges meet on (run_id, seq), which bounds the rows of one task even for one giant ring; all per-ring facts are plain aggregates
with map-side combine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadaspark.functions.geo import WGS84, haversine, inside_box
from cadaspark.functions.numeric import rnd
from cadaspark.operators.ordered import CHUNK_ROWS, running_sums, seq_chunk
from cadaspark.sources.scratch import keep, large

KEY = ["run_id"]
CLOSE_DEG = 1e-6
CLOSE_M = 0.01
MAX_SIDE_STD_M = 5000.0
MAX_MISCLOSURE_M = 2.0
DEFAULT_ANCHOR = (250000.0, 1000000.0)


def edges(points: DataFrame, x: str, y: str) -> DataFrame:
    """One row per vertex with the following vertex as (x2, y2); null on the last one.

    A vertex is the start of its own edge and the end of the one before: both meet on (run_id, seq), so that no ring stands in one task.
    """
    c = F.col
    ends = F.array(
        F.struct("seq", F.struct(c(x).alias("x"), c(y).alias("y")).alias("start"), F.lit(None).cast("struct<x:double,y:double>").alias("stop")),
        F.struct((c("seq") - 1).cast(points.schema["seq"].dataType).alias("seq"), F.lit(None).cast("struct<x:double,y:double>").alias("start"),
                 F.struct(c(x).alias("x"), c(y).alias("y")).alias("stop")),
    )
    met = points.select("run_id", F.explode(ends).alias("v")).groupBy("run_id", c("v.seq").alias("seq")).agg(
        F.max("v.start").alias("start"), F.max("v.stop").alias("stop")
    )
    return met.where("start IS NOT NULL").select(
        "run_id", "seq", c("start.x").alias("x1"), c("start.y").alias("y1"), c("stop.x").alias("x2"), c("stop.y").alias("y2")
    )


def _strip(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Trapezoid under one edge; the sum over a ring is minus twice its signed area."""
    return (x2 - x1) * (y2 + y1)


def _strips_in_order(linked: DataFrame) -> DataFrame:
    """Adds ``strip``, the sum of the strips of each chunk on the chunk's last vertex, null elsewhere.

    Terms are added in the order of the ring: where the area is nearly zero, its sign hangs on the order of the sum.
    """
    c = F.col
    order = Window.partitionBy("run_id", seq_chunk()).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.sum(_strip(c("x1"), c("y1"), c("x2"), c("y2"))).over(order)
    last = c("x2").isNull() | (c("seq") % CHUNK_ROWS == CHUNK_ROWS - 1)
    return linked.withColumn("strip", F.when(last, running))


def _shape(linked: DataFrame, *more: Column) -> DataFrame:
    """Counts, extent, ends and the signed shoelace sum (wrap edge included) of each ring; ``strip`` may be given."""
    c = F.col
    strip = c("strip") if "strip" in linked.columns else _strip(c("x1"), c("y1"), c("x2"), c("y2"))
    grouped = linked.groupBy("run_id").agg(
        F.count("*").alias("n"),
        F.avg("x1").alias("mean_x"), F.avg("y1").alias("mean_y"),
        F.min("x1").alias("min_x"), F.max("x1").alias("max_x"),
        F.min("y1").alias("min_y"), F.max("y1").alias("max_y"),
        F.min_by("x1", "seq").alias("x0"), F.min_by("y1", "seq").alias("y0"),
        F.max_by("x1", "seq").alias("xn"), F.max_by("y1", "seq").alias("yn"),
        F.sum(strip).alias("strips"),
        *more,
    )
    return grouped.withColumn(
        "signed2", -(F.coalesce("strips", F.lit(0.0)) + _strip(c("xn"), c("yn"), c("x0"), c("y0")))
    )


def degree_scales(lat: Column) -> tuple[Column, Column]:
    """Metres per degree of longitude and latitude on the ellipsoid at ``lat``."""
    s = F.sin(F.radians(lat))
    w = F.lit(1.0) - F.lit(WGS84.e2) * s * s
    rad = math.pi / 180
    kx = F.lit(WGS84.a * rad) * F.cos(F.radians(lat)) / F.sqrt(w)
    ky = F.lit(WGS84.a * (1 - WGS84.e2) * rad) / (w * F.sqrt(w))
    return kx, ky


def degree_scales_fallback(lat: Column) -> tuple[Column, Column]:
    return F.lit(111320.0) * F.abs(F.cos(F.radians(lat))), F.lit(111320.0)


def ring_facts(vertices: DataFrame) -> DataFrame:
    """Centroid, closure, box, area, country test and side statistics of rings in degrees."""
    c = F.col
    linked = edges(vertices, "lng", "lat")
    side = haversine(c("y1"), c("x1"), c("y2"), c("x2"))
    valid = F.min(c("y1").between(-90, 90) & c("x1").between(-180, 180))
    shape = _shape(
        linked.withColumn("side", side),
        F.avg("side").alias("mean_side"),
        F.max("side").alias("max_side"),
        F.stddev_pop("side").alias("std_side"),
        valid.alias("valid_degrees"),
    )
    kx, ky = degree_scales(c("mean_y"))
    fx, fy = degree_scales_fallback(c("mean_y"))
    twice = F.abs("signed2")
    in_degrees = c("mean_y").between(-90, 90) & c("mean_x").between(-180, 180)
    closed = (
        (c("n") >= 4) & (F.abs(c("x0") - c("xn")) < CLOSE_DEG) & (F.abs(c("y0") - c("yn")) < CLOSE_DEG)
    )
    out = shape.select(
        "run_id",
        c("n").alias("points"),
        closed.alias("closed"),
        rnd(c("mean_y"), 6).alias("centroid_lat"),
        rnd(c("mean_x"), 6).alias("centroid_lng"),
        c("min_y").alias("min_lat"), c("max_y").alias("max_lat"),
        c("min_x").alias("min_lng"), c("max_x").alias("max_lng"),
        F.when(in_degrees, rnd(twice / 2.0 * kx * ky / 10000.0, 4))
        .otherwise(rnd(twice / 2.0 / 10000.0, 4)).alias("area_ha"),
        rnd(twice / 2.0 * fx * fy / 10000.0, 4).alias("area_ha_fallback"),
        F.when(c("valid_degrees"), rnd(c("mean_side"), 2)).alias("mean_segment_m"),
        F.when(c("valid_degrees"), rnd(c("max_side"), 2)).alias("max_segment_m"),
        F.when(c("valid_degrees"), rnd(c("std_side"), 2)).alias("std_dev_m"),
    )
    return out.select(
        "*",
        inside_box(c("centroid_lat"), c("centroid_lng")).alias("inside_region"),
        F.when(~c("closed"), "POLYGON_OPEN")
        .when(c("std_dev_m") > MAX_SIDE_STD_M, "POLYGON_TOO_LARGE").alias("error_code"),
    )


def metric_shape(stations: DataFrame) -> DataFrame:
    """Shoelace area, orientation and box diagonal of rings in metres."""
    c = F.col
    shape = _shape(_strips_in_order(edges(stations, "e", "n")))
    dup = (
        (c("n") >= 4) & (F.abs(c("x0") - c("xn")) <= CLOSE_M) & (F.abs(c("y0") - c("yn")) <= CLOSE_M)
    )
    return shape.select(
        "run_id",
        c("n").alias("points"),
        dup.alias("has_closing"),
        F.when(c("n") >= 3, F.abs("signed2") / 2.0).otherwise(0.0).alias("area_m2"),
        (c("signed2") > 0).alias("ccw"),
        F.sqrt(
            (c("max_x") - c("min_x")) * (c("max_x") - c("min_x"))
            + (c("max_y") - c("min_y")) * (c("max_y") - c("min_y"))
        ).alias("diagonal_m"),
    )


def auto_close(stations: DataFrame) -> DataFrame:
    """Append the first station where the ends differ by more than a centimetre."""
    ends = stations.groupBy("run_id").agg(
        F.count("*").alias("n"),
        F.min_by(F.struct("station_id", "e", "n"), "seq").alias("first"),
        F.max_by(F.struct("e", "n"), "seq").alias("last"),
    )
    gap = (F.abs(F.col("first.e") - F.col("last.e")) > CLOSE_M) | (
        F.abs(F.col("first.n") - F.col("last.n")) > CLOSE_M
    )
    closing = ends.filter((F.col("n") >= 3) & gap).select(
        "run_id",
        F.col("n").cast("int").alias("seq"),
        F.concat(F.col("first.station_id"), F.lit(" (close)")).alias("station_id"),
        F.col("first.e").alias("e"),
        F.col("first.n").alias("n"),
    )
    return stations.select("run_id", "seq", "station_id", "e", "n").unionByName(closing)


def clockwise(stations: DataFrame) -> DataFrame:
    """Reverse counter-clockwise rings; a closing copy is rebuilt from the new first station."""
    c = F.col
    shape = metric_shape(stations).select(
        "run_id", "ccw", "has_closing",
        (c("points") - F.when(c("has_closing"), 1).otherwise(0)).alias("body"),
    )
    rows = stations.join(large(shape), "run_id")
    kept = rows.filter(~c("ccw")).select("run_id", "seq", "station_id", "e", "n")
    turning = rows.filter(c("ccw") & (c("seq") < c("body")))
    # The last body station becomes first, and is emitted again as the closing copy.
    places = F.when(
        c("has_closing") & (c("seq") == c("body") - 1), F.array(F.lit(0).cast("long"), c("body"))
    ).otherwise(F.array(c("body") - 1 - c("seq")))
    turned = turning.withColumn("place", F.explode(places))
    closing = c("place") == c("body")
    turned = turned.select(
        "run_id",
        c("place").cast("int").alias("seq"),
        F.when(closing, F.concat("station_id", F.lit(" (close)"))).otherwise(c("station_id")).alias("station_id"),
        "e", "n",
    )
    return kept.unionByName(turned)


def ring_edges(points: DataFrame, x: str, y: str, tol: float = CLOSE_DEG) -> DataFrame:
    """Numbered edges of each ring, the wrap edge added only when the ring is not closed."""
    c = F.col
    linked = edges(points, x, y)
    ends = linked.groupBy("run_id").agg(
        F.count("*").alias("n"),
        F.min_by("x1", "seq").alias("x2"), F.min_by("y1", "seq").alias("y2"),
        F.max_by("x1", "seq").alias("x1"), F.max_by("y1", "seq").alias("y1"),
    )
    same = (c("n") >= 4) & (F.abs(c("x1") - c("x2")) < tol) & (F.abs(c("y1") - c("y2")) < tol)
    wrap = ends.filter(~same).select(
        "run_id", (c("n") - 1).cast("int").alias("seq"), "x1", "y1", "x2", "y2"
    )
    return linked.filter(c("x2").isNotNull()).unionByName(wrap)


def _turn(ax, ay, bx, by, px, py) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _touch(d, ax, ay, bx, by, px, py) -> Column:
    return (
        (d == 0) & px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))
    )


def self_intersection(points: DataFrame, x: str = "lng", y: str = "lat") -> DataFrame:
    """Whether a ring crosses or touches itself.

    Edges meet only inside a shared cell. Cells are as wide as the mean edge of the ring and long edges are cut into pieces of that
    width (twice as many pieces as edges at most), so one long edge does not bring all others together. Whole edges are compared, so a
    contact where an edge was cut counts like any other.
    """
    c = F.col
    ring = keep(ring_edges(points, x, y), "ring-edges")
    width = F.greatest(F.abs(c("x2") - c("x1")), F.abs(c("y2") - c("y1")))
    size = ring.groupBy("run_id").agg(F.count("*").alias("m"), F.avg(width).alias("size"))
    sized = ring.join(large(size.filter("size > 0")), "run_id").withColumn("k", F.greatest(F.ceil(width / c("size")), F.lit(1)))
    pieces = sized.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), c("k") - 1)))

    def span(axis: str) -> Column:
        p, q = (c(f"{axis}1") + (c(f"{axis}2") - c(f"{axis}1")) * (c("i") + j) / c("k") for j in (0, 1))
        slack = c("size") * 1e-9
        return F.sequence(F.floor((F.least(p, q) - slack) / c("size")), F.floor((F.greatest(p, q) + slack) / c("size")))

    placed = pieces.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y"))).drop("i", "k", "size")
    one, two = placed.alias("a"), large(placed).alias("b")
    pairs = one.join(two, [c(f"a.{k}") == c(f"b.{k}") for k in ("run_id", "cx", "cy")]).filter("a.seq < b.seq").select(
        c("a.run_id").alias("run_id"), c("a.m").alias("m"),
        *[c(f"{s}.{k}").alias(f"{s}_{k}") for s in ("a", "b") for k in ("seq", "x1", "y1", "x2", "y2")],
    )
    a, b = ([c(f"{s}_{k}") for k in ("x1", "y1", "x2", "y2")] for s in ("a", "b"))
    d1, d2 = _turn(*b, a[0], a[1]), _turn(*b, a[2], a[3])
    d3, d4 = _turn(*a, b[0], b[1]), _turn(*a, b[2], b[3])
    crossing = (d1 * d2 < 0) & (d3 * d4 < 0)
    touching = (
        _touch(d1, *b, a[0], a[1]) | _touch(d2, *b, a[2], a[3]) | _touch(d3, *a, b[0], b[1]) | _touch(d4, *a, b[2], b[3])
    )
    follows = c("b_seq") == c("a_seq") + 1
    wraps = (c("a_seq") == 0) & (c("b_seq") == c("m") - 1)

    def folds(sx, sy, px, py, qx, qy) -> Column:
        """Both edges leave the shared vertex in the same direction."""
        return (_turn(sx, sy, px, py, qx, qy) == 0) & ((px - sx) * (qx - sx) + (py - sy) * (qy - sy) > 0)

    hit = (
        F.when(follows, folds(a[2], a[3], a[0], a[1], b[2], b[3]))
        .when(wraps, folds(a[0], a[1], a[2], a[3], b[0], b[1]))
        .otherwise(crossing | touching)
    )
    crossed = pairs.filter(hit).select("run_id").distinct().withColumn("hit", F.lit(True))
    return size.join(large(crossed), "run_id", "left").select(
        "run_id", F.coalesce("hit", F.lit(False)).alias("self_intersecting")
    )


def sanity_gate(stations: DataFrame, stated: DataFrame) -> DataFrame:
    """Reject implausible plans; ``stations`` carry e, n, lat, lng and ``stated`` (run_id, stated_sqm)."""
    c = F.col
    outside = stations.groupBy("run_id").agg(
        F.max(~(c("lat").between(4.0, 14.0) & c("lng").between(2.5, 15.0))).alias("outside")
    )
    joined = metric_shape(stations).join(large(outside), "run_id").join(large(stated), "run_id", "left")
    ratio = c("area_m2") / c("stated_sqm")
    known = c("stated_sqm") > 0
    reason = (
        F.when(known & ((ratio > 5.0) | (ratio < 0.1)), "AREA_RATIO")
        .when(known & (c("diagonal_m") > F.sqrt("stated_sqm") * 12.0), "SPAN_TOO_LARGE")
        .when(c("outside"), "OUTSIDE_BOUNDS")
        .otherwise("OK")
    )
    return joined.select("run_id", reason.alias("reason"), (reason == "OK").alias("passed"))


def _steps(legs: DataFrame) -> DataFrame:
    b = F.radians("bearing_dd")
    return legs.withColumns({"de": F.col("distance_m") * F.sin(b), "dn": F.col("distance_m") * F.cos(b)})


def traverse_forward(legs: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Running position after each leg, from the anchor (or the default one)."""
    c = F.col
    anchored = legs
    for name, value in zip(("anchor_e", "anchor_n"), DEFAULT_ANCHOR, strict=True):
        current = F.coalesce(c(name), F.lit(value)) if name in legs.columns else F.lit(value)
        anchored = anchored.withColumn(name, current)
    summed = running_sums(
        _steps(anchored), KEY, ["seq"], chunk if chunk is not None else seq_chunk(),
        {"cum_e": c("de"), "cum_n": c("dn"), "cum_d": c("distance_m")},
    )
    return summed.withColumns(
        {"e": rnd(c("anchor_e") + c("cum_e"), 3), "n": rnd(c("anchor_n") + c("cum_n"), 3)}
    )


def traverse_misclosure(legs: DataFrame) -> DataFrame:
    """End minus anchor; order does not matter, so this is a plain aggregate."""
    c = F.col
    total = _steps(legs).groupBy("run_id").agg(
        F.sum("de").alias("mis_e"), F.sum("dn").alias("mis_n"), F.sum("distance_m").alias("length_m")
    )
    gap = F.sqrt(c("mis_e") * c("mis_e") + c("mis_n") * c("mis_n"))
    return total.select(
        "run_id", "mis_e", "mis_n", "length_m",
        gap.alias("gap_m"),
        rnd(gap, 4).alias("misclosure_m"),
        F.when(rnd(gap, 4) > MAX_MISCLOSURE_M, "UNCLOSED").otherwise("CLOSED").alias("closure_status"),
    )


def bowditch_adjust(legs: DataFrame) -> DataFrame:
    """Spread a small misclosure along the traverse by cumulative length."""
    c = F.col
    placed = traverse_forward(legs).join(large(traverse_misclosure(legs)), "run_id")
    adjust = (c("gap_m") > 0.0) & (c("gap_m") <= MAX_MISCLOSURE_M) & (c("length_m") > 0)
    share = c("cum_d") / c("length_m")
    return placed.select(
        "run_id", "seq",
        F.when(adjust, rnd(c("e") - c("mis_e") * share, 3)).otherwise(c("e")).alias("e"),
        F.when(adjust, rnd(c("n") - c("mis_n") * share, 3)).otherwise(c("n")).alias("n"),
        F.when(adjust, "bowditch").otherwise("none").alias("adjustment"),
    )


def station_ledger(stations: DataFrame, source: str = "table") -> DataFrame:
    """Per-beacon output without the closing copy."""
    return stations.filter(~F.col("station_id").endswith(" (close)")).select(
        "run_id", "seq", "station_id", "e", "n",
        rnd(F.col("lat"), 6).alias("lat"), rnd(F.col("lng"), 6).alias("lng"),
        F.lit(source).alias("source"),
        F.format_string("%.3f, %.3f", F.col("e"), F.col("n")).alias("copy_text"),
    )


def leg_plausibility(legs: DataFrame, stated: DataFrame) -> DataFrame:
    limit = F.sqrt("stated_sqm") * 4.0
    return legs.select("run_id", "seq", "distance_m").join(large(stated), "run_id", "left").select(
        "run_id", "seq",
        F.coalesce((F.col("stated_sqm") > 0) & (F.col("distance_m") > limit), F.lit(False)).alias("implausible"),
    )


def area_discrepancy(area_ha: Column, stated_ha: Column) -> dict[str, Column]:
    """Signed percentage, its absolute twin, and the review flag."""
    pct = F.when(stated_ha > 0, rnd((area_ha - stated_ha) / stated_ha * 100.0, 2))
    return {
        "discrepancy_pct": pct,
        "discrepancy_abs_pct": F.abs(pct),
        "area_flagged": F.coalesce(F.abs(pct) > 10, F.lit(False)),
    }


def area_match_flag(area_ha: Column, stated_ha: Column) -> dict[str, Column]:
    delta = F.abs(stated_ha - area_ha)
    missing = stated_ha.isNull() | (stated_ha <= 0)
    return {
        "area_match": F.when(missing | (delta <= 0.005), "GREEN").when(delta <= 0.05, "AMBER").otherwise("RED"),
        "area_delta_ha": F.when(missing, 0.0).otherwise(rnd(delta, 6)),
    }


def dialog_triggers(
    confidence: Column, inside: Column, discrepancy: Column, minna: Column, dms: Column, grid_ref: Column
) -> Column:
    rules = [
        ("T1", confidence < 60), ("T2", ~inside), ("T3", F.abs(discrepancy) > 10),
        ("T4", minna), ("T5", dms), ("T6", grid_ref),
    ]
    return F.array_compact(F.array(*[F.when(cond, code) for code, cond in rules]))
