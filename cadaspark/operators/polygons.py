"""Polygon index: boundary cells with their own edges and a parity, interior as runs of whole cells.

An outline is laid over a grid once. Cells that an edge may touch are boundary cells; each keeps the edges around it and whether its
reference point lies inside the outline. Between two boundary cells of a row lie only cells that are wholly inside or wholly outside, so
the inside ones are kept as runs, cut into blocks of ``BLOCK`` cells. A place looks up its cell: in a run it is inside at once; in a
boundary cell its parity is that of the reference point, changed by each edge of the cell that the path from there crosses.
However many edges an outline has, a place meets those of its own cell.

Parities come from the crossings of each row's reference line in order, one window over (outline, row), not from comparing places with
edges. Rings of any number and order count by the even-odd rule, so holes work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadaspark.functions import geo
from cadaspark.operators import cells
from cadaspark.sources.scratch import keep, large

# Where in a cell the reference point lies: nowhere that coordinates or cell borders are likely to be.
REF_X, REF_Y = 0.48710533, 0.51371491
BLOCK = 64


def _floor(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size))


def _pieces(edges: DataFrame, size: float, margin: float) -> DataFrame:
    """Edges with every cell (cx, cy) that they come within ``margin`` of, pieces taken no longer than a cell."""
    c = F.col
    longest = F.greatest(F.abs(c("x2") - c("x1")), F.abs(c("y2") - c("y1")))
    cut = edges.withColumn("_k", F.greatest(F.ceil(longest / F.lit(size)), F.lit(1)))
    cut = cut.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), c("_k") - 1)))
    slack = margin + size * 1e-9
    for axis in ("x", "y"):
        a, b = c(f"{axis}1"), c(f"{axis}2")
        p, q = a + (b - a) * c("_i") / c("_k"), a + (b - a) * (c("_i") + 1) / c("_k")
        span = F.sequence(_floor(F.least(p, q) - slack, size), _floor(F.greatest(p, q) + slack, size))
        cut = cut.withColumn(f"c{axis}", F.explode(span))
    return cut.drop("_k", "_i").distinct()


def _marks(edges: DataFrame, boundary: DataFrame, size: float) -> DataFrame:
    """(plane, feature_id, cx, cy, odd, odd_after): parity at a boundary cell's reference point and at its right border."""
    c = F.col
    line = (c("cy") + REF_Y) * size
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.where("y1 != y2").withColumn("cy", F.explode(F.sequence(_floor(low, size) - 1, _floor(high, size))))
    crossed = rows.where((c("y1") > line) != (c("y2") > line)).select(
        "plane", "feature_id", "cy", (c("x1") + (line - c("y1")) * (c("x2") - c("x1")) / (c("y2") - c("y1"))).alias("x"),
        F.lit(0).alias("kind"), F.lit(None).cast("long").alias("cx"),
    )
    kinds = F.explode(F.array(F.lit(1), F.lit(2))).alias("kind")
    asked = boundary.select("plane", "feature_id", "cy", "cx", kinds).select(
        "plane", "feature_id", "cy", ((c("cx") + F.when(c("kind") == 1, REF_X).otherwise(1.0)) * size).alias("x"), "kind", "cx"
    )
    order = Window.partitionBy("plane", "feature_id", "cy").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = crossed.unionByName(asked).withColumn("before", F.sum(F.when(c("kind") == 0, 1).otherwise(0)).over(order))
    return counted.where("kind > 0").groupBy("plane", "feature_id", "cx", "cy").agg(
        (F.max(F.when(c("kind") == 1, c("before"))) % 2).alias("odd"), (F.max(F.when(c("kind") == 2, c("before"))) % 2).alias("odd_after")
    )


def index(edges: DataFrame, size: float, margin: float = 0.0, seen: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Boundary cells and interior runs of outlines (plane, feature_id, x1, y1, x2, y2).

    Cells: (plane, cx, cy, feature_id, odd, x1, y1, x2, y2), also those within ``margin`` of an edge, with a null ``odd`` where no edge
    touches. Runs: (plane, cy, block, feature_id, first, last). ``seen`` keeps the cells that places can lie in.
    """
    c = F.col
    seen = F.lit(True) if seen is None else seen
    edges = edges.select("plane", "feature_id", "x1", "y1", "x2", "y2")
    around = keep(_pieces(edges, size, margin), "outline-cells")
    own = around if margin == 0 else _pieces(edges, size, 0.0)
    boundary = own.select("plane", "feature_id", "cx", "cy").distinct()
    marks = keep(_marks(edges, boundary, size), "outline-marks")
    filed = around.where(seen).join(large(marks.drop("odd_after")), ["plane", "feature_id", "cx", "cy"], "left")
    after = F.lead("cx").over(Window.partitionBy("plane", "feature_id", "cy").orderBy("cx"))
    runs = marks.withColumn("last", after - 1).where("odd_after = 1 AND last > cx").withColumn("first", c("cx") + 1)
    runs = runs.withColumn("block", F.explode(F.sequence(F.floor(c("first") / BLOCK), F.floor(c("last") / BLOCK))))
    return filed, runs.select("plane", "cy", "block", "feature_id", "first", "last")


def hits(probes: DataFrame, edges: DataFrame, size: float, margin: float = 0.0, seen: Column | None = None) -> DataFrame:
    """(plane, x, y, feature_id, distance): outlines that hold a distinct place (distance 0) or lie within ``margin`` of it."""
    c = F.col
    filed, runs = index(edges, size, margin, seen)
    placed = probes.select("plane", "x", "y").withColumns({"cx": _floor(c("x"), size), "cy": _floor(c("y"), size)})
    inside = placed.withColumn("block", F.floor(c("cx") / BLOCK)).join(large(runs), ["plane", "cy", "block"])
    inside = inside.where(c("cx").between(c("first"), c("last")))
    met = placed.join(large(filed), ["plane", "cx", "cy"])
    rx, ry = (c("cx") + REF_X) * size, (c("cy") + REF_Y) * size
    # the path goes from the reference point up or down its column, then along the place's row
    up_at = c("y1") + (rx - c("x1")) * F.try_divide(c("y2") - c("y1"), c("x2") - c("x1"))
    up = ((c("x1") > rx) != (c("x2") > rx)) & ((up_at <= c("y")) != (up_at <= ry))
    along_at = c("x1") + (c("y") - c("y1")) * F.try_divide(c("x2") - c("x1"), c("y2") - c("y1"))
    along = ((c("y1") > c("y")) != (c("y2") > c("y"))) & ((along_at <= c("x")) != (along_at <= rx))
    crossings = F.when(up, 1).otherwise(0) + F.when(along, 1).otherwise(0)
    t = geo.segment_parameter(c("x"), c("y"), c("x1"), c("y1"), c("x2"), c("y2"))
    far = geo.planar(c("x"), c("y"), c("x1") + t * (c("x2") - c("x1")), c("y1") + t * (c("y2") - c("y1")))
    tested = met.groupBy("plane", "x", "y", "feature_id").agg(
        F.min(far).alias("far"), F.sum(crossings).alias("crossings"), F.max("odd").alias("odd")
    )
    # a place on an edge belongs to one side of it, also where no margin is asked for
    distance = F.when((c("odd") + c("crossings")) % 2 == 1, 0.0).otherwise(F.when(c("far") <= margin, c("far")) if margin else F.lit(None))
    near = tested.select("plane", "x", "y", "feature_id", distance.cast("double").alias("distance")).where("distance IS NOT NULL")
    both = near.unionByName(inside.select("plane", "x", "y", "feature_id", F.lit(0.0).alias("distance")))
    return both.groupBy("plane", "x", "y", "feature_id").agg(F.min("distance").alias("distance"))


def in_metres(points: DataFrame, edges: DataFrame, margin: float, size: float = 500.0) -> DataFrame:
    """(lat, lng, feature_id, distance_m) of outlines (feature_id, lat1, lng1, lat2, lng2) within ``margin`` of each distinct place.

    Outlines are laid out whole in the plane of each zone; only cells that places of the zone can reach are kept.
    """
    c = F.col
    spots = cells.project_points(cells.places(points)).select("lat", "lng", c("zone").alias("plane"), c("e").alias("x"), c("n").alias("y"))
    known = edges.select("feature_id", "lat1", "lng1", "lat2", "lng2").dropna(subset=["lat1", "lng1", "lat2", "lng2"])
    every = known.withColumn("plane", F.explode(F.array(F.lit(31), F.lit(32), F.lit(33))))
    flat = geo.with_utm(every, "lat1", "lng1", "plane", "x1", "y1", solid=True)
    flat = geo.with_utm(flat, "lat2", "lng2", "plane", "x2", "y2", solid=True)
    # a zone is six degrees wide, less than 340 km on either side of its middle
    west, east = 160_000.0 / size, 840_000.0 / size
    seen = ((c("plane") == 31) | (c("cx") >= west - 1)) & ((c("plane") == 33) | (c("cx") <= east + 1))
    found = hits(spots, flat, size, margin, seen)
    return spots.join(large(found), ["plane", "x", "y"]).select("lat", "lng", "feature_id", c("distance").alias("distance_m"))


def in_degrees(points: DataFrame, edges: DataFrame, size: float = 0.05) -> DataFrame:
    """(lat, lng, feature_id) of the outlines that hold each distinct place, edges taken as straight in degrees."""
    c = F.col
    spots = cells.places(points).select(F.lit(0).alias("plane"), c("lng").alias("x"), c("lat").alias("y"))
    flat = edges.dropna(subset=["lat1", "lng1", "lat2", "lng2"]).select(
        F.lit(0).alias("plane"), "feature_id", c("lng1").alias("x1"), c("lat1").alias("y1"), c("lng2").alias("x2"), c("lat2").alias("y2")
    )
    return hits(spots, flat, size).select(c("y").alias("lat"), c("x").alias("lng"), "feature_id")
