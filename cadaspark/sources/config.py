"""Configuration read as data: zones, boxes, offices, personas, lineage fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, lat_min, lat_max, lng_min, lng_max; first match wins.
STATE_BOXES = [
    ("Lagos", 6.35, 6.90, 3.18, 4.02),
    ("Ogun", 6.60, 7.30, 2.90, 3.95),
    ("Rivers", 4.60, 5.10, 6.85, 7.50),
    ("Delta", 5.10, 6.00, 5.50, 6.90),
    ("FCT", 8.40, 9.10, 6.90, 7.90),
    ("Kano", 11.60, 12.50, 7.80, 9.40),
]


# Registry offices; a null area is the state default.
OFFICES = [
    ("Lagos", None, "Lands Bureau, Alausa Secretariat, Ikeja"),
    ("Lagos", "Ikorodu", "Ikorodu Local Government Registry, T.O.S Benson Road"),
    ("Lagos", "Epe", "Epe Local Government Land Registry"),
    ("Lagos", "Badagry", "Badagry Local Government Land Registry"),
]
DEFAULT_OFFICE = "State Ministry of Lands / Surveyor General's Office"

# Persona, label, raw metrics, CRS detail, confidence intervals, development matrix, language.
PERSONAS = [
    ("EVERYDAY_BUYER", "Everyday Buyer Report", False, False, False, False, "conversational"),
    ("SURVEYOR", "Technical Surveyor Report", True, True, True, True, "technical"),
    ("REALTOR", "Real Estate Professional Report", False, False, False, True, "value_forward"),
    ("ARCHITECT", "Architect/Developer Report", True, False, False, True, "technical_consequence"),
    ("INSTITUTIONAL_DEV", "Institutional Developer Report", True, True, True, True, "institutional"),
]

# Field, source label, vintage, confidence.
LINEAGE_FIELDS = [
    ("elevation_m", "SRTM DEM (NASA)", "2000–2024", 88.0),
    ("flood_risk", "HydroSHEDS + SRTM", "2022", 74.0),
    ("distance_to_river_m", "HydroRIVERS", "2022", 74.0),
    ("distance_to_road_m", "OpenStreetMap", "live-cache", 83.0),
    ("ndwi", "Sentinel-2 NDWI", "2023-Q4", 69.0),
    ("ndvi", "Sentinel-2 NDVI", "2023-Q4", 69.0),
    ("growth_potential", "OSM + LGA Benchmarks", "live-cache", 71.0),
    ("title_status", None, None, 0.0),
]


def rows(spark: SparkSession, schema: list[str], values: list[tuple]) -> DataFrame:
    """A small literal table that stays a local relation (no job, no Python rows at runtime)."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(schema, value, strict=True)]) for value in values]
    return spark.range(1).select(F.inline(F.array(*structs)))


def offices(spark: SparkSession) -> DataFrame:
    typed = [tuple(F.lit(v).cast("string") for v in row) for row in OFFICES]
    return rows(spark, ["office_state", "office_area", "office"], typed)


def personas(spark: SparkSession) -> DataFrame:
    names = ["persona", "label", "show_raw", "show_crs", "show_intervals", "show_matrix", "language"]
    return rows(spark, names, PERSONAS)


def boxes(spark: SparkSession, named: list[tuple]) -> DataFrame:
    """Named boxes (name, lat_min, lat_max, lng_min, lng_max) as a table."""
    return rows(spark, ["name", "min_lat", "max_lat", "min_lng", "max_lng"], named)
