"""Coordinate system detection and projection of parsed points.

Points are (run_id, seq, p1, p2) with latitude and longitude, or northing and easting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaspark.functions import parsing as p
from cadaspark.functions.geo import CLARKE_1880, COUNTRY_BOX, inside_box, with_datum_shift, with_latlng
from cadaspark.functions.numeric import rnd
from cadaspark.operators import rings
from cadaspark.sources.scratch import keep, large

ZONES = (31, 32, 33)
# State markers of plan numbers per zone, in the order they are tried.
MARKERS = {
    33: ["BO", "BR", "AD", "TA", "YO", "YB", "GO", "GM"],
    31: ["LA", "OG", "OY", "OS", "EK", "ON", "OD", "ED", "KB", "KE", "KW", "NG", "NI", "SO", "SK"],
    32: [
        "AK", "CR", "AB", "IM", "RI", "RV", "AN", "KA", "KT", "KD", "BA", "BH", "BY", "BS", "BN", "BE", "DT", "DL",
        "EB", "EN", "FCT", "JG", "JI", "KN", "KG", "KO", "NS", "NW", "PL", "ZF", "ZA",
    ],
}
UTM_NAMES = [f"UTM_{z}N" for z in ZONES]
VALID_ANSWERS = ["WGS84", "MINNA", *UTM_NAMES, "UNKNOWN"]


def _marker_zone(text: Column) -> Column:
    """Zone of the first marker found; one pattern per zone over the upper-case text, if it has a slash at all."""
    upper, slash = F.upper(text), F.contains(text, F.lit("/"))
    out = None
    for zone, states in MARKERS.items():
        hit = slash & upper.rlike("/(?:" + "|".join(states) + ")/")
        out = F.when(hit, f"UTM_{zone}N") if out is None else out.when(hit, f"UTM_{zone}N")
    return out


def zone_trial(runs: DataFrame, e: str, n: str) -> DataFrame:
    """Which zones put (e, n) inside the country: trial_crs and trial_confidence."""
    out = runs
    for z in ZONES:
        placed = with_latlng(out.withColumn("_z", F.lit(z)), e, n, "_z", "_lat", "_lng")
        out = placed.withColumn(f"_in{z}", inside_box(F.col("_lat"), F.col("_lng"))).drop("_lat", "_lng", "_z")
    hits = sum((F.when(F.col(f"_in{z}"), 1).otherwise(0) for z in ZONES), F.lit(0))
    single = F.coalesce(*[F.when(F.col(f"_in{z}"), f"UTM_{z}N") for z in (32, 31, 33)])
    return out.withColumns(
        {
            "trial_crs": F.coalesce(single, F.lit("UNKNOWN")),
            "trial_confidence": F.when(hits == 1, 80.0).when(hits > 1, 60.0).otherwise(50.0),
        }
    ).drop(*[f"_in{z}" for z in ZONES])


def with_text_facts(submissions: DataFrame) -> DataFrame:
    """What the steps here need to know of a text, beside the columns given: one pass that puts it in lower case once.

    Submissions with these columns need no ``raw_text`` any more; others are read when a step asks.
    """
    c = F.col
    if "minna_text" in submissions.columns:
        return submissions
    full = submissions.withColumn("_full", F.concat("raw_text", F.lit(" "), F.coalesce("datum_label", F.lit(""))))
    low = full.withColumn("_low", F.lower("_full"))
    return low.withColumns(
        {
            "minna_text": p.names_minna(c("_full"), c("_low")),
            "zone_text": p.named_zone(c("_full"), c("_low")),
            "marker": _marker_zone(c("_full")),
            "own_zone": p.named_zone(c("raw_text"), c("_low")),
            "grid_ref": F.contains("raw_text", F.lit("GRID_REF")),
        }
    ).drop("_full", "_low")


def detect_crs(submissions: DataFrame, points: DataFrame, use_zone_trial: bool = False) -> DataFrame:
    """(detected_crs, crs_confidence, method) per run.

    The zone trial is off by default, which leaves ambiguous grids UNKNOWN for a person to settle.
    """
    c = F.col
    first = points.groupBy("run_id").agg(
        F.min_by("p1", "seq").alias("a"), F.min_by("p2", "seq").alias("b"),
        F.bool_and(inside_box(c("p1"), c("p2"))).alias("all_inside"),
    )
    # read before the join, so that no text is shuffled
    runs = with_text_facts(submissions).select("run_id", "coordinate_hint", "minna_text", "zone_text", "marker").join(large(first), "run_id", "left")
    box = {k: v - 5 if k.endswith("min") else v + 5 for k, v in COUNTRY_BOX.items()}
    north = lambda v: v.between(400000, 1600000)
    east = lambda v: v.between(100000, 900000)
    if use_zone_trial:
        runs = zone_trial(runs.withColumns({"te": F.least("a", "b"), "tn": F.greatest("a", "b")}), "te", "tn")
    else:
        runs = runs.withColumns({"trial_crs": F.lit("UNKNOWN"), "trial_confidence": F.lit(50.0)})
    grid, swapped = north(c("a")) & east(c("b")), north(c("b")) & east(c("a"))
    ladder = [
        (c("coordinate_hint") == "MINNA_DATUM", F.lit("MINNA"), F.lit(95.0), "Explicit Hint"),
        (c("coordinate_hint") == "UTM_SWAPPED", F.lit("UTM_31N"), F.lit(70.0), "Explicit Hint"),
        (c("minna_text"), F.lit("MINNA"), F.lit(95.0), "Datum Label Match"),
        (c("zone_text").isin("31", "32", "33"), F.concat(F.lit("UTM_"), c("zone_text"), F.lit("N")), F.lit(90.0), "Text Zone Parsing"),
        (c("a").isNull(), F.lit("UNKNOWN"), F.lit(0.0), "None"),
        (inside_box(c("a"), c("b"), box), F.lit("WGS84"), F.when(c("all_inside"), 95.0).otherwise(90.0), "Lat/Lng Bounds Check"),
        (grid & c("marker").isNotNull(), c("marker"), F.lit(85.0), "State Prefix Detection"),
        (grid, c("trial_crs"), c("trial_confidence"), "Boundary Trial"),
        (swapped, c("trial_crs"), F.lit(60.0), "Boundary Trial (Swapped axes)"),
        (F.lit(True), F.lit("UNKNOWN"), F.lit(30.0), "Unknown"),
    ]
    pick = lambda i: F.coalesce(*[F.when(step[0], step[i] if i < 3 else F.lit(step[3])) for step in ladder])
    return runs.select(
        "run_id", pick(1).alias("detected_crs"), pick(2).alias("crs_confidence"), pick(3).alias("method"),
        (F.coalesce(c("coordinate_hint") == "MINNA_DATUM", F.lit(False)) | c("minna_text")).alias("minna_detected"),
    )


def _minna_utm(points: DataFrame, zone: str) -> DataFrame:
    """(p1 = northing, p2 = easting) on the old ellipsoid to WGS84 lat, lng."""
    old = with_latlng(points, "p2", "p1", zone, "_olat", "_olng", CLARKE_1880)
    return with_datum_shift(old, "_olat", "_olng").drop("_olat", "_olng")


def minna_zone(submissions: DataFrame, points: DataFrame) -> DataFrame:
    """Zone of old-datum grid points: from the text, else by trial, ties by the easting band."""
    c = F.col
    tried = _minna_utm(points.withColumn("zone", F.explode(F.array(*[F.lit(z) for z in ZONES]))), "zone")
    centres = tried.groupBy("run_id", "zone").agg(
        rnd(F.avg("lat"), 6).alias("lat"), rnd(F.avg("lng"), 6).alias("lng"), F.min_by("p2", "seq").alias("first_e")
    )
    inside = inside_box(c("lat"), c("lng"))
    runs = centres.groupBy("run_id").agg(
        F.max("first_e").alias("first_e"), *[F.bool_or(inside & (c("zone") == z)).alias(f"in{z}") for z in ZONES]
    )
    e = c("first_e")
    guess = (
        F.when(e.between(100000, 400000), 31).when(e.between(400000, 700000), 32).when(e.between(700000, 900000), 33).otherwise(32)
    )
    runs = runs.withColumn("guess", guess)
    ranked = F.array_sort(
        F.array_compact(
            F.array(*[F.when(c(f"in{z}"), F.struct(F.abs(F.lit(z) - c("guess")).alias("gap"), F.lit(z).alias("zone"))) for z in ZONES])
        )
    )
    best = F.coalesce(F.try_element_at(ranked, F.lit(1))["zone"], c("guess"))
    own = c("own_zone") if "own_zone" in submissions.columns else p.named_zone(c("raw_text"))
    texts = submissions.select("run_id", own.try_cast("int").alias("text_zone"))
    return runs.join(large(texts), "run_id").select("run_id", F.coalesce("text_zone", best).alias("zone"))


def transform_to_wgs84(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Points with detected_crs and is_utm to lat, lng; each branch projects only its own rows.

    ``zones`` holds the old-datum zone per run. Geographic points of an unknown system pass through.
    """
    c = F.col
    cols = [k for k in points.columns if k not in ("lat", "lng")]
    minna, utm = c("detected_crs") == "MINNA", c("is_utm")
    grid = _minna_utm(points.filter(minna & utm).join(large(zones), "run_id"), "zone")
    old = with_datum_shift(points.filter(minna & ~utm), "p1", "p2")
    named = F.when(c("detected_crs").isin(UTM_NAMES), F.substring("detected_crs", 5, 2).try_cast("int")).otherwise(32)
    projected = with_latlng(
        points.filter((c("detected_crs") != "MINNA") & (c("detected_crs") != "WGS84") & utm).withColumn("zone", named),
        "p2", "p1", "zone",
    )
    same = points.filter((c("detected_crs") == "WGS84") | ((c("detected_crs") != "MINNA") & ~utm)).withColumns(
        {"lat": c("p1"), "lng": c("p2")}
    )
    out = grid.select(*cols, "lat", "lng")
    for part in (old, projected, same):
        out = out.unionByName(part.select(*cols, "lat", "lng"))
    return out


def flip_test(submissions: DataFrame, points: DataFrame) -> DataFrame:
    """Would swapped axes land inside? Reported for runs outside the country, never applied.

    ``points``: run_id, seq, p1, p2, is_utm, detected_crs.
    """
    c = F.col
    swapped = points.withColumns({"p1": c("p2"), "p2": c("p1")})
    old_grid = swapped.filter((c("detected_crs") == "MINNA") & c("is_utm"))
    zones = minna_zone(submissions, old_grid)
    # Named zones project whatever the text format was; other systems keep the swapped numbers.
    eligible = c("is_utm") | c("detected_crs").isin(*UTM_NAMES, "MINNA")
    forced = swapped.filter(eligible).withColumn(
        "is_utm", F.when(c("detected_crs") == "MINNA", c("is_utm")).otherwise(c("detected_crs").isin(UTM_NAMES))
    )
    placed = transform_to_wgs84(forced, zones)
    centre = placed.groupBy("run_id").agg(rnd(F.avg("lat"), 6).alias("lat"), rnd(F.avg("lng"), 6).alias("lng"))
    return centre.select("run_id", inside_box(c("lat"), c("lng")).alias("flip_inside"))


def extract_parcels(submissions: DataFrame, points: DataFrame, use_zone_trial: bool = False) -> DataFrame:
    """The whole extraction: detect, project, close, measure, and list the dialogs to ask."""
    c = F.col
    if "minna_text" not in submissions.columns:
        submissions = keep(with_text_facts(submissions).drop("raw_text"), "text-facts")
    # both feed several branches: written once, so that no branch reads the texts again for them
    detected = keep(detect_crs(submissions, points, use_zone_trial), "detected")
    tagged = points.join(large(detected), "run_id").withColumn("is_utm", c("fmt").isin("UTM_SUFFIX", "UTM", "STATION_TABLE"))
    tagged = keep(tagged, "tagged")
    zones = minna_zone(submissions, tagged.filter((c("detected_crs") == "MINNA") & c("is_utm")))
    placed = transform_to_wgs84(tagged, zones).select("run_id", "seq", "lat", "lng")
    facts = rings.ring_facts(placed)
    flips = flip_test(submissions, tagged)
    kind = points.groupBy("run_id").agg(F.min("fmt").alias("fmt"))
    stated = c("stated_area_ha") if "stated_area_ha" in submissions.columns else F.lit(None)
    text = submissions.select("run_id", "coordinate_hint", "grid_ref", stated.cast("double").alias("stated_ha"))
    joined = facts.join(large(detected), "run_id").join(large(kind), "run_id").join(large(text), "run_id").join(large(flips), "run_id", "left")
    inside = c("inside_region") & F.coalesce(c("coordinate_hint") != "UTM_SWAPPED", F.lit(True))
    joined = joined.withColumn("inside_region", inside)
    discrepancy = rings.area_discrepancy(c("area_ha"), c("stated_ha"))["discrepancy_pct"]
    return joined.select(
        "run_id", "fmt", "detected_crs", "crs_confidence", "method", "points", "closed", "error_code",
        "centroid_lat", "centroid_lng", "area_ha", "inside_region",
        (~c("inside_region") & F.coalesce(c("flip_inside"), F.lit(False))).alias("flip_tested"),
        rings.dialog_triggers(
            c("crs_confidence"), c("inside_region"), discrepancy, c("minna_detected"), c("fmt") == "DMS", c("grid_ref")
        ).alias("dialogs"),
    )


def apply_dialog_answers(vertices: DataFrame, detected: DataFrame, answers: DataFrame) -> DataFrame:
    """T1 names the system, T2 swaps the axes and measures again, T6 adds an accuracy warning.

    ``answers``: run_id, t1, t2, t6 (null where not asked).
    """
    c = F.col
    asked = vertices.join(large(answers.select("run_id", "t2")), "run_id", "left")
    swap = F.coalesce(c("t2") == "swap", F.lit(False))
    turned = asked.select(
        "run_id", "seq", F.when(swap, c("lng")).otherwise(c("lat")).alias("lat"), F.when(swap, c("lat")).otherwise(c("lng")).alias("lng")
    )
    facts = rings.ring_facts(turned).select("run_id", "centroid_lat", "centroid_lng", "area_ha", "inside_region")
    joined = facts.join(large(detected), "run_id").join(large(answers), "run_id", "left")
    named = F.coalesce(c("t1").isin(VALID_ANSWERS), F.lit(False))
    return joined.select(
        "run_id",
        F.when(named, c("t1")).otherwise(c("detected_crs")).alias("detected_crs"),
        F.when(named, 100.0).otherwise(c("crs_confidence")).alias("crs_confidence"),
        "centroid_lat", "centroid_lng", "area_ha", "inside_region",
        F.when(c("t6") == "approximate", "POS_ACCURACY: APPROXIMATE").alias("warning"),
    )
