"""Rule chain over a table of parcels with indicator columns: one narrow stage, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaspark.functions import rules, units
from cadaspark.sources.config import STATE_BOXES


def state_for_point(lat, lng, boxes=STATE_BOXES):
    """First matching box. A short fixed list becomes a CASE, so no join is planned."""
    out = None
    for name, lat_min, lat_max, lng_min, lng_max in boxes:
        hit = lat.between(lat_min, lat_max) & lng.between(lng_min, lng_max)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def with_indicators(parcels: DataFrame) -> DataFrame:
    c = F.col
    return parcels.withColumns(
        {
            "state": state_for_point(c("lat"), c("lng")),
            "proximity": rules.flood_proximity(c("elevation_m"), c("river_m"), c("slope_pct"), c("ndwi")),
            "confidence": rules.data_confidence(
                c("elevation_m"), c("slope_pct"), c("river_m"), c("road_m"), c("ndwi"), c("ndvi"), c("out_of_zone")
            ),
            "encroached": rules.encroachment(c("ndvi")),
            "terrain_difficulty": rules.terrain_difficulty(c("slope_pct")),
            "road_access": rules.road_access(c("road_m")),
        }
    )


def with_flood(indicators: DataFrame) -> DataFrame:
    c = F.col
    return indicators.withColumns(
        rules.flood_assessment(
            c("elevation_m"), c("river_m"), c("strahler"), c("proximity"), c("ndwi"), c("slope_pct")
        )
    )


def with_risk(indicators: DataFrame) -> DataFrame:
    """Flood level, terrain, light (with the drainage override) and score."""
    c = F.col
    flooded = with_flood(indicators).withColumn(
        "terrain", rules.terrain_suitability(c("elevation_m"), c("slope_pct"), c("flood_risk"), c("ndwi"))
    )
    drained = flooded.withColumns(rules.drainage(c("lowest_m"), c("outfall_m"), c("outfall_connected")))
    light = rules.traffic_light(c("flood_risk"), c("terrain"), c("acquisition_flag"), c("title_status"))
    return drained.withColumns(
        {
            "base_light": light,
            "traffic_light": F.when(c("drainage_block"), "RED").otherwise(light),
            "risk_score": rules.risk_score(
                c("flood_risk"), c("terrain"), c("proximity"), c("acquisition_flag"), c("encroached"), c("confidence")
            ),
        }
    )


def rule_columns(risk: DataFrame) -> dict:
    return {name: F.col(name) for name in risk.columns}


def with_advisories(risk: DataFrame) -> DataFrame:
    return risk.withColumn("advisory_codes", rules.codes(rules.advisory_rules(rule_columns(risk))))


def advisory_rows(risk: DataFrame, key: str = "parcel_id") -> DataFrame:
    """One row per advisory in report order, with its wording."""
    text = F.create_map(*[x for k, v in rules.ADVISORY_TEXT.items() for x in (F.lit(k), F.lit(v))])
    exploded = with_advisories(risk).select(key, F.posexplode("advisory_codes").alias("pos", "code"))
    return exploded.withColumn("message", F.try_element_at(text, F.col("code")))


def due_diligence(risk: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Ranked actions. The rule list is already in rank order, so position is the rank."""
    listed = rules.diligence_rules(rule_columns(risk))
    items = F.array_compact(
        F.array(
            *[
                F.when(cond, F.struct(F.lit(p).alias("priority"), F.lit(a).alias("action")))
                for p, a, cond in listed
            ]
        )
    )
    return risk.select(key, F.posexplode(items).alias("pos", "item")).select(
        key, (F.col("pos") + 1).alias("rank"), "item.priority", "item.action"
    )


def plot_units(parcels: DataFrame, area: str = "area_ha", state: str = "state_text") -> DataFrame:
    sqm, label = units.plot_standard(F.col(state))
    sized = parcels.withColumns({"plot_sqm_std": sqm, "plot_label": label})
    return sized.withColumns(units.area_display(F.col(area), F.col("plot_sqm_std"), F.col("plot_label")))


def screening_summary(risk: DataFrame) -> DataFrame:
    return risk.groupBy(F.coalesce("state", F.lit("other")).alias("state"), "traffic_light").agg(
        F.count("*").alias("parcels"),
        F.sum(F.floor(F.col("risk_score") * 10 + 0.5)).alias("score_tenths"),
    )
