"""Parcel-shaped tables derived from the star-schema test tables.

Each table is a list of ``expression AS name`` texts over one parquet table (or over another bridge
table), in SQL both Spark and the checker understand, so the inputs of a check are defined once.
Only the inputs: every operator is written separately on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadaspark.sources.config import STATE_BOXES  # noqa: F401 (the checks read it from here)
from cadaspark.sources.scratch import keep

def _div(expr: str, by: int) -> str:
    return f"CAST(FLOOR(({expr}) / {by}e0) AS BIGINT)"


def dec4(expr: str) -> str:
    """Text of an integer count of 1e-4 units, with four decimals."""
    return f"(CAST({_div(expr, 10000)} AS STRING) || '.' || lpad(CAST(({expr}) % 10000 AS STRING), 4, '0'))"


def _cycle(key: str, names: list[str | None]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(names) if v is not None)
    return f"CASE {key} % {len(names)} {arms} END"


def _place(key: str) -> list[str]:
    return [f"43000 + {key} * 7919 % 95000 AS la4", f"27000 + {key} * 10473 % 119000 AS lo4"]


PARCEL_BASE = ["c_custkey AS parcel_id", "c_mktsegment AS lga", *_place("c_custkey")]

PARCELS = [
    "parcel_id", "lga", "la4", "lo4",
    "la4 / 10000e0 AS lat",
    "lo4 / 10000e0 AS lng",
    "CASE WHEN parcel_id % 11 = 0 THEN NULL ELSE (parcel_id * 37 % 600) / 10e0 END AS elevation_m",
    "CASE WHEN parcel_id % 17 = 0 THEN NULL ELSE (parcel_id * 53 % 400) / 10e0 END AS slope_pct",
    "CASE WHEN parcel_id % 13 = 0 THEN NULL ELSE (parcel_id * 97 % 6000) * 1e0 END AS river_m",
    "CAST(1 + parcel_id % 7 AS INT) AS strahler",
    "CASE WHEN parcel_id % 19 = 0 THEN NULL ELSE (parcel_id * 41 % 4000) * 1e0 END AS road_m",
    "CASE WHEN parcel_id % 7 = 0 THEN NULL ELSE (parcel_id * 29 % 110) / 100e0 - 0.6e0 END AS ndwi",
    "CASE WHEN parcel_id % 7 = 0 THEN NULL ELSE (parcel_id * 31 % 100) / 100e0 - 0.05e0 END AS ndvi",
    "parcel_id % 7 = 0 AS out_of_zone",
    "parcel_id % 23 = 0 AS acquisition_flag",
    f"{_cycle('parcel_id', ['ACTIVE', 'ACTIVE', None, 'Disputed', 'ACTIVE', 'PENDING', 'ACTIVE', 'ACTIVE', 'revoked', None, 'ACTIVE', 'ACTIVE'])} AS title_status",
    "parcel_id % 3 = 0 AS title_verified",
    "parcel_id % 5 = 0 AS minna",
    f"{_cycle('parcel_id', ['EVERYDAY_BUYER', 'SURVEYOR', 'REALTOR', 'ARCHITECT', 'INSTITUTIONAL_DEV'])} AS persona",
    f"{_cycle('parcel_id', ['Lagos', 'Rivers State', 'akwa-ibom', 'FCT', 'Kano', 'CROSS_RIVER', None, 'Unresolved', ' Enugu '])} AS state_text",
    "(500 + parcel_id * 61 % 50000) / 10000e0 AS area_ha",
    "CASE WHEN parcel_id % 4 = 0 THEN NULL ELSE (500 + parcel_id * 61 % 50000 + parcel_id % 400 - 150) / 10000e0 END AS stated_area_ha",
    "CASE WHEN parcel_id % 10 = 0 THEN NULL ELSE (parcel_id * 3 % 80) / 1e0 END AS lowest_m",
    "CASE WHEN parcel_id % 10 = 0 THEN NULL ELSE (parcel_id * 7 % 80) / 1e0 END AS outfall_m",
    "parcel_id % 6 <> 0 AS outfall_connected",
    "parcel_id * 5 % 400 AS n1", "parcel_id * 11 % 1800 AS n5", "parcel_id * 17 % 9000 AS n10",
    "CASE WHEN parcel_id % 14 = 0 THEN NULL ELSE (parcel_id * 13 % 900) / 10e0 END AS airport_km",
]

_WIDE = "CASE WHEN parcel_id % 97 = 0 THEN 600 ELSE 1 END"
CORNERS = [
    "parcel_id", "seq", "la4", "lo4",
    "CASE WHEN seq = 4 THEN 0 WHEN parcel_id % 2 = 1 AND seq IN (1, 3) THEN 4 - seq "
    "WHEN parcel_id % 26 = 18 AND seq IN (2, 3) THEN 5 - seq ELSE seq END AS corner",
    f"(5 + parcel_id % 7) * {_WIDE} AS dx",
    f"(4 + parcel_id % 5) * {_WIDE} AS dy",
]
_SX = "CASE WHEN corner IN (0, 3) THEN -1 ELSE 1 END"
_SY = "CASE WHEN corner < 2 THEN -1 ELSE 1 END"
VERTICES = [
    "parcel_id AS run_id", "CAST(seq AS INT) AS seq",
    f"(la4 + dy * ({_SY})) / 10000e0 AS lat",
    f"(lo4 + dx * ({_SX})) / 10000e0 AS lng",
]
VERTEX_FILTER = "NOT (seq = 4 AND parcel_id % 9 = 4)"

STATIONS = [
    "parcel_id AS run_id", "CAST(seq AS INT) AS seq",
    "'BP' || CAST(10000 + parcel_id AS STRING) || '/' || CAST(seq AS STRING) AS station_id",
    f"300000 + parcel_id * 137 % 400000 + (5 + parcel_id % 7) * 10 * ({_SX}) + parcel_id % 10 / 10e0 AS e",
    f"450000 + parcel_id * 911 % 900000 + (4 + parcel_id % 5) * 10 * ({_SY}) + parcel_id % 8 / 8e0 AS n",
]
STATION_FILTER = "NOT (seq = 4 AND parcel_id % 3 > 0)"

# Four legs round a rectangle; the last one is long by up to 3 m for some runs.
RECTANGLE_LEGS = [
    "parcel_id AS run_id", "CAST(seq AS INT) AS seq",
    "(parcel_id * 7 % 360 + seq * 90) % 360 * 1e0 AS bearing_dd",
    "CASE WHEN seq % 2 = 0 THEN 40 + parcel_id % 60 ELSE 30 + parcel_id % 50 END * 1e0 "
    "+ CASE WHEN seq = 3 THEN (parcel_id % 5) * 0.75e0 ELSE 0e0 END AS distance_m",
    "300000e0 + parcel_id * 137 % 400000 AS anchor_e",
    "450000e0 + parcel_id * 911 % 900000 AS anchor_n",
    "CASE WHEN parcel_id % 4 = 0 THEN NULL ELSE (40e0 + parcel_id % 60) * (30 + parcel_id % 50) * "
    "(CASE WHEN parcel_id % 12 = 5 THEN 0.04e0 ELSE 1e0 END) END AS stated_sqm",
]

# Lines, roads and land-use outlines near the parcel with the same key.
FEATURES = [
    "p_partkey AS feature_id",
    "43000 + p_partkey * 7919 % 95000 + p_partkey % 41 - 20 AS la4",
    "27000 + p_partkey * 10473 % 119000 + p_partkey % 31 - 15 AS lo4",
    "p_size AS size",
]
LINES = [
    "feature_id",
    f"{_cycle('feature_id', ['river', 'road', 'road'])} AS layer",
    f"{_cycle('feature_id', ['Lagos', 'national', 'Rivers', 'national', 'Kano'])} AS state",
    "la4 / 10000e0 AS lat1", "lo4 / 10000e0 AS lng1",
    "(la4 + (size - 25) * (CASE WHEN feature_id % 50 = 0 THEN 90 ELSE 3 END)) / 10000e0 AS lat2",
    "(lo4 + (size * 7 % 50 - 25) * (CASE WHEN feature_id % 50 = 0 THEN 90 ELSE 3 END)) / 10000e0 AS lng2",
    "CAST(1 + feature_id % 7 AS INT) AS strahler",
]
BUILDINGS = ["feature_id", "la4 / 10000e0 AS lat", "lo4 / 10000e0 AS lng"]
LANDUSE_TAGS = [
    "wetland", "marsh", "water", "reservoir", "forest", "wood", "nature_reserve", "protected_area",
    "military", "cemetery", "landfill", "residential", "Canal",
]
# One row per polygon edge; seq 0..3 around a square.
LANDUSE_EDGES = [
    "feature_id", "seq",
    f"{_cycle('feature_id', LANDUSE_TAGS)} AS tag",
    "(la4 + (2 + size % 10) * 2 * (CASE WHEN seq IN (0, 3) THEN -1 ELSE 1 END)) / 10000e0 AS lat1",
    "(lo4 + (2 + size % 10) * 2 * (CASE WHEN seq IN (0, 1) THEN -1 ELSE 1 END)) / 10000e0 AS lng1",
    "(la4 + (2 + size % 10) * 2 * (CASE WHEN seq IN (2, 3) THEN -1 ELSE 1 END)) / 10000e0 AS lat2",
    "(lo4 + (2 + size % 10) * 2 * (CASE WHEN seq IN (0, 3) THEN -1 ELSE 1 END)) / 10000e0 AS lng2",
]

REGISTRY = [
    "'LND/' || CAST(s_suppkey AS STRING) AS id",
    "s_suppkey AS record_order",
    "(43000 + s_suppkey * 7919 % 95000 + s_suppkey % 21 - 10) / 10000e0 AS lat",
    "(27000 + s_suppkey * 10473 % 119000 + s_suppkey % 17 - 8) / 10000e0 AS lng",
    "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 100e0 + s_suppkey % 5 * 5000e0 END AS match_radius_m",
    f"{_cycle('s_suppkey', ['C_OF_O', 'R_OF_O', 'DEED', None, 'c_of_o', 'BOGUS'])} AS title_type",
    f"{_cycle('s_suppkey', ['ACTIVE', 'DISPUTED', 'REVOKED', None, 'PENDING', 'WEIRD', 'ACTIVE'])} AS title_status",
    "CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE s_suppkey % 4 = 1 END AS acquisition_flag",
    f"{_cycle('s_suppkey', ['RESIDENTIAL', 'COMMERCIAL', None])} AS zoning_class",
    f"{_cycle('s_suppkey', ['Ikorodu', 'Epe', None, 'Badagry', 'Eleme'])} AS lga_confirmed",
    f"{_cycle('s_suppkey', ['Lagos', 'Lagos', None, 'Lagos', 'Rivers'])} AS state_confirmed",
]

REPORTS = [
    "o_orderkey AS report_id", "o_custkey AS parcel_id",
    "'u' || CAST(o_custkey % 40 AS STRING) AS user_id",
    "o_orderdate AS generated_at",
    "(430000 + o_custkey * 7919 % 95000 * 10 + o_orderkey % 3) / 100000e0 AS lat",
    "(270000 + o_custkey * 10473 % 119000 * 10 + o_orderkey % 2) / 100000e0 AS lng",
    "CAST(FLOOR(o_totalprice) AS BIGINT) % 1000 / 10e0 AS score",
    f"{_cycle('o_orderkey', ['GREEN', 'AMBER', 'RED', 'GREEN', 'AMBER'])} AS traffic_light",
    f"{_cycle('o_orderkey', ['LOW', 'MEDIUM', 'HIGH', 'LOW'])} AS flood_risk",
    f"{_cycle('o_orderkey', ['SUITABLE', 'SUITABLE', 'MARGINAL', 'UNSUITABLE', 'SUITABLE', 'odd'])} AS terrain",
    f"{_cycle('o_orderkey', ['LOW', 'MEDIUM', 'HIGH'])} AS growth",
    "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey * 37 % 600) / 10e0 END AS elevation_m",
    "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE (o_orderkey * 97 % 6000) * 1e0 END AS river_m",
    f"{_cycle('o_custkey', ['Lagos', 'Rivers', 'Kano', 'Ogun', None])} AS state",
    "o_orderpriority AS lga",
    f"{_cycle('o_orderkey', ['EVERYDAY_BUYER', 'SURVEYOR', 'REALTOR', 'ARCHITECT', 'INSTITUTIONAL_DEV'])} AS persona",
    "'{\"parcel_geometry\":{\"computed_area_ha\":' || "
    f"{dec4('500 + o_orderkey * 61 % 50000')} || "
    "'},\"summary\":{\"traffic_light\":\"' || CASE o_orderkey % 5 WHEN 0 THEN 'GREEN' WHEN 1 THEN 'AMBER' "
    "WHEN 2 THEN 'RED' WHEN 3 THEN 'GREEN' ELSE 'AMBER' END || '\"}}' AS report_json",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows of a base table that one task makes vertices, pixels or edges of, up to 81 a row.
TASK_ROWS = 16384


def spread(base: DataFrame, key: str) -> DataFrame:
    """A base table dealt out by its key: its small files are read by one task or a few, whatever is made of their rows."""
    tasks = -(-base.count() // TASK_ROWS)
    return base.repartition(tasks, key) if tasks > 1 else base


def parcel_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "customer").selectExpr(*PARCEL_BASE), "parcel_id")


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parcel_base(spark, sf_dir).selectExpr(*PARCELS)


def _corners(spark: SparkSession, sf_dir: str, last: int) -> DataFrame:
    base = parcel_base(spark, sf_dir)
    return base.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(last)))).selectExpr(*CORNERS)


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corners(spark, sf_dir, 4).filter(VERTEX_FILTER).selectExpr(*VERTICES)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corners(spark, sf_dir, 4).filter(STATION_FILTER).selectExpr(*STATIONS)


def rectangle_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = parcel_base(spark, sf_dir)
    return base.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(3)))).selectExpr(*RECTANGLE_LEGS)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").selectExpr(*FEATURES), "feature_id")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).selectExpr(*LINES)


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).selectExpr(*BUILDINGS)


def landuse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = features(spark, sf_dir)
    return base.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(3)))).selectExpr(*LANDUSE_EDGES)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*REGISTRY)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*REPORTS)


# Elevation pixels in a 9 x 9 block round each parcel; some missing, some nodata.
DEM_BLOCK = [
    "CAST(FLOOR(lat) AS BIGINT) AS tlat", "CAST(FLOOR(lng) AS BIGINT) AS tlng",
    "CAST(FLOOR((FLOOR(lat) + 1 - lat) * 1200e0) AS BIGINT) + seq % 9 - 4 AS px_row",
    "CAST(FLOOR((lng - FLOOR(lng)) * 1200e0) AS BIGINT) + CAST(FLOOR(seq / 9e0) AS BIGINT) - 4 AS px_col",
]
DEM_CELLS = [
    "'dem' AS layer",
    "'N' || lpad(CAST(tlat AS STRING), 2, '0') || 'E' || lpad(CAST(tlng AS STRING), 3, '0') AS tile",
    "px_row", "px_col",
    "CASE WHEN (px_row * px_col) % 23 = 5 THEN -9999e0 ELSE ((px_row * 7 + px_col * 13) % 400) / 10e0 END AS value",
]
DEM_FILTER = "px_row BETWEEN 0 AND 1199 AND px_col BETWEEN 0 AND 1199 AND (px_row + px_col) % 10 < 9"


def dem_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = parcels(spark, sf_dir).select("lat", "lng").withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(80))))
    return base.selectExpr(*DEM_BLOCK).filter(DEM_FILTER).distinct().selectExpr(*DEM_CELLS)


# Satellite pixels under every parcel; one table row per layer.
ZONE_CELLS = [
    "index_name AS layer", "zone_name AS tile", "px_row", "px_col",
    "CASE WHEN (px_row + px_col) % 11 = 3 THEN NULL "
    "ELSE ((px_row * 3 + px_col * 5 + CASE WHEN index_name = 'ndwi' THEN 0 ELSE 7 END) % 120) / 100e0 - 0.6e0 END AS value",
]


# Four feeds per parcel: offline, local registry, state, national.
FEEDS = [
    "parcel_id AS run_id", "CAST(seq AS INT) AS priority",
    "CASE seq WHEN 0 THEN 'offline_raster' WHEN 1 THEN 'mock_registry' WHEN 2 THEN 'state_lis' ELSE 'nlir' END AS adapter_id",
    "CASE WHEN seq = 0 THEN 'ok' WHEN (parcel_id + seq * 7) % 11 = 0 THEN 'timeout' "
    "WHEN (parcel_id + seq * 5) % 13 = 0 THEN 'http_error' WHEN (parcel_id * 3 + seq) % 5 = 0 THEN 'no_record' ELSE 'ok' END AS status",
    "CASE WHEN seq > 0 THEN CASE (parcel_id + seq) % 6 WHEN 0 THEN 'C_OF_O' WHEN 1 THEN 'DEED' WHEN 2 THEN 'c_of_o' WHEN 3 THEN 'BOGUS' WHEN 4 THEN 'CUSTOMARY' END END AS title_type",
    "CASE WHEN seq > 0 THEN CASE (parcel_id * 3 + seq) % 5 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'DISPUTED' WHEN 2 THEN 'REVOKED' WHEN 3 THEN 'weird' END END AS title_status",
    "CASE WHEN seq > 0 THEN 'T' || CAST(parcel_id * 10 + seq AS STRING) END AS title_number",
    "CASE WHEN seq = 0 OR (parcel_id + seq) % 3 = 0 THEN NULL ELSE (parcel_id + seq) % 7 = 0 END AS acquisition_flag",
    "CASE WHEN seq > 0 AND (parcel_id + seq) % 2 = 0 THEN 'ZONE' || CAST((parcel_id + seq) % 4 AS STRING) END AS zoning_class",
    "CASE WHEN seq = 0 OR (parcel_id + seq) % 4 = 0 THEN NULL WHEN (parcel_id + seq) % 4 = 1 THEN '' ELSE 'residential,use' || CAST(seq AS STRING) END AS permitted_text",
    "CASE WHEN seq > 0 AND (parcel_id + seq) % 5 < 3 THEN 'lga' || CAST((parcel_id * seq) % 9 AS STRING) END AS lga_confirmed",
]


def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = parcel_base(spark, sf_dir).withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return base.selectExpr(*FEEDS)


LINEAGE = [
    "l_orderkey AS report_id", "'field_' || CAST(l_linenumber AS STRING) AS field_name",
    "l_partkey AS source_id", "'src' || CAST(l_suppkey % 10 AS STRING) AS source_label",
    "l_quantity * 2 AS confidence_score",
]
EXPORTS = [
    "l_orderkey AS report_id",
    "CASE l_returnflag WHEN 'A' THEN 'PDF' WHEN 'R' THEN 'JSON' ELSE 'PNG_CARD' END AS export_format",
    "l_shipdate AS exported_at", "CAST(FLOOR(l_extendedprice) AS BIGINT) AS file_size_bytes",
]


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*LINEAGE)


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*EXPORTS)


# Raw survey texts in ten styles (by parcel_id % 10), plus every document as it is.
def _thousands(x: str) -> str:
    low = f"lpad(CAST({x} % 1000 AS STRING), 3, '0')"
    mid = f"{_div(f'{x} % 1000000', 1000)}"
    return (
        f"(CASE WHEN {x} >= 1000000 THEN CAST({_div(x, 1000000)} AS STRING) || ',' || lpad(CAST({mid} AS STRING), 3, '0') "
        f"ELSE CAST({mid} AS STRING) END || ',' || {low})"
    )


def _dms(v: str, letter: str) -> str:
    minutes = _div(f"({v}) % 10000 * 60", 10000)
    tenths = _div(f"({v}) % 10000 * 60 % 10000 * 600", 10000)
    return (
        f"CAST({_div(v, 10000)} AS STRING) || '°' || CAST({minutes} AS STRING) || chr(39) || CAST({_div(tenths, 10)} AS STRING) "
        f"|| '.' || CAST({tenths} % 10 AS STRING) || chr(34) || '{letter}'"
    )


_RING = [("-", "-"), ("-", "+"), ("+", "+"), ("+", "-"), ("-", "-")]


def _join(parts: list[str], sep: str) -> str:
    return f" || {sep} || ".join(f"({p})" for p in parts)


def _survey_text() -> str:
    deg = [(f"(la4 {a} dy)", f"(lo4 {o} dx)") for a, o in _RING]
    met = [(f"(n0 {a} dy * 10)", f"(e0 {o} dx * 10)") for a, o in _RING]
    text = lambda x: f"CAST({x} AS STRING)"
    card = [f"{dec4(a)} || 'N ' || {dec4(o)} || 'E'" for a, o in deg]
    plain = [f"{dec4(a)} || ', ' || {dec4(o)}" for a, o in deg]
    dms = [f"{_dms(a, 'N')} || ' ' || {_dms(o, 'E')}" for a, o in deg]
    comma = [f"{_thousands(e)} || '.125E ' || {_thousands(n)} || '.5N'" for n, e in met]
    bare = [
        f"CASE WHEN parcel_id % 20 < 10 THEN {text(e)} || '.5 ' || {text(n)} || '.25' ELSE {text(n)} || '.25 ' || {text(e)} || '.5' END"
        for n, e in met
    ]
    table = [
        f"'BP1234{i} E: ' || {text(e)} || '.297  N: ' || {text(n)} || '.575'" if i % 2 == 0
        else f"'E: ' || {text(e)} || '-254  N: ' || {text(n)}" for i, (n, e) in enumerate(met)
    ]
    leg = lambda q1, q2, d: (
        f"'{q1} ' || CAST(parcel_id % 89 AS STRING) || '°15' || chr(39) || '30' || chr(34) || '{q2} ' || CAST({d} AS STRING) || '.50m'"
    )
    d1, d2 = "(80 + parcel_id % 60)", "(50 + parcel_id % 40)"
    legs = [
        "'Tie-Point: E ' || CAST(e0 AS STRING) || '.000 N ' || CAST(n0 AS STRING) || '.000'",
        f"'1. A1 to B2: ' || {leg('N', 'E', d1)}", f"'L2: ' || {leg('S', 'E', d2)}",
        f"'B3 TO B4: ' || {leg('S', 'W', d1)}",
        f"'leg 4: ' || CAST(300 + parcel_id % 60 AS STRING) || '° 10' || chr(39) || '  ' || CAST({d2} AS STRING) || '.25'",
    ]
    group = ["'EASTINGS'", *[f"{text(e)} || '.5 m'" for _, e in met[:4]], "'NORTHINGS'", *[f"{text(n)} || '.75 m'" for n, _ in met[:4]]]
    plan = "CASE parcel_id % 4 WHEN 0 THEN 'Plan LS/LA/2020' WHEN 1 THEN 'Plan X/BO/11' WHEN 2 THEN 'UTM Zone 32 N' ELSE 'no mark' END"
    suffix = [f"{text(e)} || '.297E ' || {text(n)} || '.575N'" for n, e in met]
    nl = "chr(10)"
    arms = [
        _join(card, "'; '"), _join(plain, "'; '"), _join(dms, "'; '"), _join(comma, "'; '"), _join(bare, "'; '"),
        f"'MINNA UTM ZONE 32' || {nl} || " + _join(table, nl), _join(legs, nl), _join(card[:4], "'; '"), _join(group, nl),
        f"{plan} || {nl} || " + _join(suffix, "'; '"),
    ]
    return "CASE parcel_id % 10 " + " ".join(f"WHEN {i} THEN {a}" for i, a in enumerate(arms)) + " END"


SURVEY_BASE = [
    "parcel_id", "la4", "lo4", "5 + parcel_id % 7 AS dx", "4 + parcel_id % 5 AS dy",
    "300000 + parcel_id * 137 % 400000 AS e0", "450000 + parcel_id * 911 % 900000 AS n0",
]
SURVEYS = [
    "parcel_id AS run_id", f"{_survey_text()} AS raw_text",
    "CASE WHEN parcel_id % 29 = 0 THEN 'MINNA_DATUM' WHEN parcel_id % 31 = 0 THEN 'UTM_SWAPPED' END AS coordinate_hint",
    "CASE WHEN parcel_id % 13 = 0 THEN 'Clarke 1880' END AS datum_label",
]
DOCUMENT_SURVEYS = [
    "1000000000 + doc_id AS run_id", "text AS raw_text", "CAST(NULL AS STRING) AS coordinate_hint", "CAST(NULL AS STRING) AS datum_label",
]


def submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submissions as they are made, for what reads each text once."""
    made = parcel_base(spark, sf_dir).selectExpr(*SURVEY_BASE).selectExpr(*SURVEYS)
    return made.unionByName(table(spark, sf_dir, "documents").selectExpr(*DOCUMENT_SURVEYS))


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submissions table, written once per session: real submissions arrive as stored text."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _STORED:
        _STORED[at] = keep(submitted(spark, sf_dir), "surveys")
    return _STORED[at]


_STORED: dict[tuple[str, str], DataFrame] = {}
