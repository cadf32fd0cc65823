"""Screening rules as Column expressions.

Every function takes and returns Columns; nulls mean "layer missing" and never raise. Chains that
need earlier results (level -> suitability -> light) take those results as Columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadaspark.functions.numeric import clamp, fixed, rnd


def terrain_difficulty(slope: Column) -> Column:
    return F.when(slope.isNull() | (slope < 5), "flat").when(slope < 15, "gentle").otherwise("steep")


def road_access(distance: Column) -> Column:
    return (
        F.when(distance <= 200, "Excellent")
        .when(distance <= 600, "Good")
        .when(distance <= 1500, "Fair")
        .otherwise("Poor")
    )


def _band(value: Column, low: float, high: float) -> Column:
    """1 at or below ``low``, 0 at or above ``high``, linear between."""
    return (
        F.when(value <= low, F.lit(1.0))
        .when(value >= high, F.lit(0.0))
        .otherwise(F.lit(1.0) - (value - low) / float(high - low))
    )


def flood_proximity(elevation: Column, river: Column, slope: Column, ndwi: Column) -> Column:
    """Weighted wetness score in [0, 1], renormalised over the inputs that are present."""
    wet = F.when(ndwi >= 0.3, 1.0).when(ndwi <= -0.1, 0.0).otherwise((ndwi + 0.1) / 0.4)
    runoff = F.when(slope < 2, 0.30).when(slope < 8, 0.15).otherwise(0.50)
    parts = [
        (elevation, 0.35, _band(elevation, 5, 50)),
        (river, 0.35, _band(river, 100, 2000)),
        (ndwi, 0.20, wet),
        (slope, 0.10, runoff),
    ]
    score = weight = F.lit(0.0)
    for present, w, value in parts:
        score = score + F.when(present.isNull(), 0.0).otherwise(F.lit(w) * value)
        weight = weight + F.when(present.isNull(), 0.0).otherwise(w)
    return F.when(weight == 0.0, 0.5).otherwise(rnd(clamp(score / weight, 0, 1), 4))


def data_confidence(
    elevation: Column, slope: Column, river: Column, road: Column, ndwi: Column, ndvi: Column, out_of_zone: Column
) -> Column:
    def minus(condition: Column, points: float) -> Column:
        return F.when(condition, points).otherwise(0.0)

    score = (
        F.lit(100.0)
        - minus(elevation.isNull(), 20.0)
        - minus(slope.isNull(), 10.0)
        - minus(river.isNull(), 20.0)
        - minus(road.isNull(), 10.0)
        - minus(ndwi.isNull() | ndvi.isNull(), 15.0)
        - minus(out_of_zone, 5.0)
    )
    return F.greatest(score, F.lit(0.0))


def encroachment(ndvi: Column) -> Column:
    return F.when(ndvi.isNull(), F.lit(None).cast("boolean")).otherwise(ndvi < 0.05)


def _flood_conditions(
    elevation: Column, river: Column, strahler: Column, proximity: Column, ndwi: Column, slope: Column
) -> tuple[list[tuple[Column, Column]], list[tuple[Column, Column]]]:
    m0 = lambda c: fixed(c, 0)
    high = [
        (elevation < 5, F.concat(F.lit("Elevation "), fixed(elevation, 1), F.lit("m is below 5m."))),
        (river < 100, F.concat(F.lit("River at "), m0(river), F.lit("m is within 100m."))),
        (ndwi > 0.3, F.concat(F.lit("Water index "), fixed(ndwi, 2), F.lit(" is above 0.30."))),
        (
            (strahler >= 5) & (river < 500),
            F.concat(F.lit("Major river (order "), strahler.cast("string"), F.lit(") at "), m0(river), F.lit("m.")),
        ),
        (proximity >= 0.75, F.concat(F.lit("Combined flood score "), fixed(proximity, 2), F.lit(" is very high."))),
    ]
    medium = [
        ((elevation >= 5) & (elevation < 15), F.concat(F.lit("Elevation "), fixed(elevation, 1), F.lit("m is moderate."))),
        ((river >= 100) & (river < 500), F.concat(F.lit("River at "), m0(river), F.lit("m is within 500m."))),
        ((ndwi >= 0.0) & (ndwi <= 0.3), F.concat(F.lit("Water index "), fixed(ndwi, 2), F.lit(" shows moist soil."))),
        (
            (proximity >= 0.40) & (proximity < 0.75),
            F.concat(F.lit("Combined flood score "), fixed(proximity, 2), F.lit(" is moderate.")),
        ),
        (slope < 1.5, F.lit("Slope below 1.5% drains poorly.")),
    ]
    return high, medium


def _hits(rules: list[tuple[Column, Column]]) -> Column:
    total = F.lit(0)
    for condition, _ in rules:
        total = total + F.when(condition, 1).otherwise(0)
    return total


def _first(rules: list[tuple[Column, Column]]) -> Column:
    out = F.when(rules[0][0], rules[0][1])
    for condition, text in rules[1:]:
        out = out.when(condition, text)
    return out


def flood_assessment(
    elevation: Column, river: Column, strahler: Column, proximity: Column, ndwi: Column, slope: Column
) -> dict[str, Column]:
    """Level, reason (first rule met plus the count of others) and confidence."""
    high, medium = _flood_conditions(elevation, river, strahler, proximity, ndwi, slope)
    n_high, n_medium = _hits(high), _hits(medium)
    level = F.when(n_high > 0, "HIGH").when(n_medium > 0, "MEDIUM").otherwise("LOW")
    more = lambda n, tag: F.when(
        n > 1, F.concat(F.lit(" ("), (n - 1).cast("string"), F.lit(f" more {tag} factors.)"))
    ).otherwise("")
    nothing = elevation.isNull() & river.isNull() & ndwi.isNull()
    low = F.concat(
        F.lit("Low flood indicators: "),
        F.concat_ws(
            ", ",
            F.concat(F.lit("elevation "), fixed(elevation, 1), F.lit("m")),
            F.concat(F.lit("river "), fixed(river, 0), F.lit("m")),
            F.concat(F.lit("water index "), fixed(ndwi, 2)),
        ),
        F.lit("."),
    )
    reason = (
        F.when(n_high > 0, F.concat(_first(high), more(n_high, "HIGH")))
        .when(n_medium > 0, F.concat(_first(medium), more(n_medium, "MEDIUM")))
        .when(nothing, "Insufficient data, treat as LOW with caution.")
        .otherwise(low)
    )
    sparse = elevation.isNull() | river.isNull()
    confidence = (
        F.when((n_high > 0) & sparse, 65.0)
        .when(n_high > 0, 85.0)
        .when((n_medium > 0) & sparse, 60.0)
        .when(n_medium > 0, 85.0)
        .when(nothing, 50.0)
        .otherwise(85.0)
    )
    return {"flood_risk": level, "flood_reason": reason, "flood_confidence": confidence}


def terrain_suitability(elevation: Column, slope: Column, flood: Column, ndwi: Column) -> Column:
    return (
        F.when((flood == "HIGH") | (elevation < 3) | (slope > 30) | (ndwi > 0.3), "UNSUITABLE")
        .when((elevation < 5) | (slope > 15), "MARGINAL")
        .otherwise("SUITABLE")
    )


def development_matrix(
    flood: Column, terrain: Column, ndwi: Column, encroached: Column, acquisition: Column
) -> dict[str, Column]:
    free = ~F.coalesce(acquisition, F.lit(False))
    untouched = ~F.coalesce(encroached, F.lit(False))
    suitable = terrain == "SUITABLE"
    return {
        "residential": suitable & flood.isin("LOW", "MEDIUM") & free,
        "commercial": suitable & (flood == "LOW") & free,
        "agricultural": untouched & (terrain != "UNSUITABLE") & free & (ndwi.isNull() | (ndwi < 0.4)),
        "industrial": suitable & (flood == "LOW") & free & untouched,
    }


def traffic_light(flood: Column, terrain: Column, acquisition: Column, title_status: Column) -> Column:
    red = (
        (flood == "HIGH")
        | (terrain == "UNSUITABLE")
        | F.coalesce(acquisition, F.lit(False))
        | F.coalesce(F.upper(title_status).isin("REVOKED", "DISPUTED"), F.lit(False))
    )
    return F.when(red, "RED").when((flood == "MEDIUM") | (terrain == "MARGINAL"), "AMBER").otherwise("GREEN")


def risk_score(
    flood: Column, terrain: Column, proximity: Column, acquisition: Column, encroached: Column, confidence: Column
) -> Column:
    base = (
        F.when(flood == "HIGH", 40.0).when(flood == "MEDIUM", 22.0).otherwise(5.0)
        + F.when(terrain == "UNSUITABLE", 25.0).when(terrain == "MARGINAL", 14.0).otherwise(3.0)
        + F.coalesce(proximity * 20.0, F.lit(0.0))
        + F.when(acquisition, 10.0).otherwise(0.0)
        + F.when(encroached, 5.0).otherwise(0.0)
    )
    pull = (F.lit(50.0) - confidence) / 50.0
    adjusted = F.when(confidence < 50, base + pull * (F.lit(50.0) - base) * 0.3).otherwise(base)
    return rnd(clamp(adjusted, 0, 100), 1)


def drainage(lowest_elevation: Column, outfall_elevation: Column, outfall_connected: Column) -> dict[str, Column]:
    """Outfall end above the plot's lowest point blocks gravity drainage."""
    blocked = outfall_elevation > lowest_elevation
    return {
        "drainage_block": blocked,
        "drainage_conflict": F.coalesce(~blocked, F.lit(False)) & ~outfall_connected,
    }


def codes(rules: list[tuple[str, Column]]) -> Column:
    """Ordered array of the codes whose condition holds."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]))


def advisory_rules(c: dict[str, Column]) -> list[tuple[str, Column]]:
    """(code, condition) in report order; ``c`` maps indicator names to Columns."""
    basin = (c["elevation_m"] < 3.0) | (c["ndwi"] > 0.3)
    unsuitable = c["terrain"] == "UNSUITABLE"
    basin_known = F.coalesce(basin, F.lit(False))
    ok = F.coalesce(~c["drainage_conflict"], F.lit(True))
    return [
        ("FLOOD_HIGH", c["flood_risk"] == "HIGH"),
        ("FLOOD_MODERATE", c["flood_risk"] == "MEDIUM"),
        ("LOW_ELEVATION", c["elevation_m"] < 5),
        ("RIVER_PROXIMITY", c["river_m"] < 200),
        ("WATER_SIGNAL", c["ndwi"] > 0.2),
        ("FLOOD_BASIN", unsuitable & basin_known),
        ("TERRAIN_UNSUITABLE", unsuitable & ~basin_known),
        ("ENCROACHMENT", c["encroached"]),
        ("ACQUISITION", c["acquisition_flag"]),
        ("TITLE_UNVERIFIED", ~c["title_verified"]),
        ("MINNA_DATUM", c["minna"]),
        ("LIMITED_SATELLITE", c["out_of_zone"]),
        ("LOW_CONFIDENCE", c["confidence"] < 50),
        ("LOW_CONFIDENCE_FIELDS", c["confidence"] < 50),
        ("DRAINAGE_CONFLICT", c["drainage_conflict"]),
        ("DRAINAGE_BLOCKED", ok & c["drainage_block"]),
        ("DRAINAGE_NATURAL", ok & ~c["drainage_block"] & c["outfall_connected"]),
        (
            "VERIFY_OUTFALL",
            F.coalesce(c["elevation_m"] < 3.0, F.lit(False)) | F.coalesce(c["drainage_block"], F.lit(False)),
        ),
    ]


# Report wording per advisory code.
ADVISORY_TEXT = {
    "FLOOD_HIGH": "HIGH FLOOD RISK: inspect in the wet season before any commitment.",
    "FLOOD_MODERATE": "MODERATE FLOOD RISK: plan flood mitigation in any design.",
    "LOW_ELEVATION": "LOW ELEVATION: foundations must allow for seasonal high water.",
    "RIVER_PROXIMITY": "RIVER PROXIMITY: confirm the safe set-back distance.",
    "WATER_SIGNAL": "WATER SIGNAL DETECTED: verify dry-season conditions on site.",
    "FLOOD_BASIN": "ENVIRONMENTAL FLOOD BASIN VULNERABILITY: low or persistently wet ground.",
    "TERRAIN_UNSUITABLE": "TERRAIN UNSUITABLE: a geotechnical survey is required.",
    "ENCROACHMENT": "ENCROACHMENT SIGNAL: verify boundaries with a licensed surveyor.",
    "ACQUISITION": "GOVERNMENT ACQUISITION RISK: obtain a clearance letter.",
    "TITLE_UNVERIFIED": "TITLE UNVERIFIED: a lawyer must confirm the title at the registry.",
    "MINNA_DATUM": "MINNA DATUM: positional accuracy is about 5 metres.",
    "LIMITED_SATELLITE": "LIMITED SATELLITE DATA: indices not available for this area.",
    "LOW_CONFIDENCE": "LOW DATA CONFIDENCE: several sources were unavailable.",
    "LOW_CONFIDENCE_FIELDS": "LOW CONFIDENCE FIELDS: overall data quality.",
    "DRAINAGE_CONFLICT": "DRAINAGE DATA CONFLICT: natural fall but no outfall connected.",
    "DRAINAGE_BLOCKED": "DRAINAGE BLOCKED: the public drain sits above the plot.",
    "DRAINAGE_NATURAL": "DRAINAGE NATURAL: the plot falls toward the public drain.",
    "VERIFY_OUTFALL": "VERIFY OUTFALL: level check with a local engineer on site.",
}


def diligence_rules(c: dict[str, Column]) -> list[tuple[str, str, Column]]:
    """(priority, action, condition), already in output order: priority, then rule number."""
    always = F.lit(True)
    return [
        ("CRITICAL", "TITLE_SEARCH", always),
        ("CRITICAL", "ACQUISITION_CLEARANCE", c["acquisition_flag"]),
        ("CRITICAL", "HYDROLOGY_STUDY", c["flood_risk"] == "HIGH"),
        ("HIGH", "SOIL_INVESTIGATION", c["terrain"] == "UNSUITABLE"),
        ("HIGH", "CONFIRM_PEGS", ~c["title_verified"]),
        ("HIGH", "RIVER_SETBACK", c["river_m"] < 500),
        ("HIGH", "FRESH_SURVEY", c["encroached"]),
        ("MEDIUM", "WET_SEASON_VISIT", c["flood_risk"] == "MEDIUM"),
        ("MEDIUM", "PLANNING_APPROVAL", always),
        ("LOW", "COURT_SEARCH", always),
    ]


def null_fields(c: dict[str, Column], threshold: float = 50.0) -> Column:
    names = {
        "elevation_m": "elevation_m", "river_m": "distance_to_river_m", "ndwi": "ndwi", "ndvi": "ndvi",
        "road_m": "distance_to_road_m",
    }
    return codes([(told, (c["confidence"] < threshold) & c[name].isNull()) for name, told in names.items()])


def urban_expansion(n1: Column, n5: Column, n10: Column) -> Column:
    part = lambda n, full: F.least(n / float(full), F.lit(1.0))
    return rnd(F.lit(0.5) * part(n1, 200) + F.lit(0.3) * part(n5, 1000) + F.lit(0.2) * part(n10, 5000), 4)


def growth_potential(expansion: Column, road_km: Column, airport_km: Column, flood: Column, terrain: Column) -> Column:
    near = lambda km, limit: F.coalesce(km < limit, F.lit(False))
    good = near(road_km, 2) & near(airport_km, 50)
    capped = (flood == "HIGH") | (terrain == "UNSUITABLE")
    return (
        F.when(expansion.isNull(), F.when(near(airport_km, 30) & near(road_km, 2), "MEDIUM").otherwise("LOW"))
        .when(capped, F.when(expansion > 0.55, "MEDIUM").otherwise("LOW"))
        .when((expansion > 0.55) & good, "HIGH")
        .when((expansion > 0.25) | good, "MEDIUM")
        .otherwise("LOW")
    )


def benchmark_percentile(value: Column, average: Column) -> Column:
    return F.when(average != 0, rnd(clamp(value / (average * 2.0) * 100.0, 0, 99), 1))
