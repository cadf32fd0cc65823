"""File sources: station CSV, KML, registry JSON, layer segments, raster cells, audit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadaspark.functions.parsing import cleanse_numeric
from cadaspark.operators.extract import kml_vertices
from cadaspark.operators.ordered import with_row_number

# Header aliases.
EASTING = ["easting", "e", "x", "east", "longitude_utm", "utm_e"]
NORTHING = ["northing", "n", "y", "north", "latitude_utm", "utm_n"]
STATION = ["station", "id", "beacon", "pillar", "trig", "name", "station_id", "plot", "corner"]
STATION_PREFIX = r"(?i)^(sc|sg|sk|bp|tp|bm|nr)[/\-\s]"
NATIONAL = "national"

REGISTRY_SCHEMA = (
    "id STRING, label STRING, centroid STRUCT<lat: DOUBLE, lng: DOUBLE>, match_radius_m DOUBLE, title_type STRING, "
    "title_status STRING, acquisition_flag BOOLEAN, acquisition_detail STRING, encumbrance_flag BOOLEAN, "
    "encumbrance_detail STRING, zoning_class STRING, permitted_uses ARRAY<STRING>, restrictions ARRAY<STRING>, "
    "gazette_reference STRING, official_plot_number STRING, survey_plan_ref STRING, lga_confirmed STRING, "
    "state_confirmed STRING, mock_scenario STRING, _bad STRING"
)
AUDIT_SCHEMA = (
    "action STRING, sandbox STRING, timestamp STRING, timeout_seconds DOUBLE, reason STRING, policy_applied STRING, "
    "policy_snapshot STRING, restored_at STRING, restored_by STRING, duration_seconds DOUBLE, error STRING"
)


def _file_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and an order that survives splits: block start, then row order."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("ord"),
        "value",
    )


def _fields(line: Column) -> Column:
    """Fields of a CSV line: commas between quotes do not count. One pass over the line, whatever its length."""
    unquoted = lambda v: F.replace(F.regexp_replace(F.trim(v), r'^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))
    # between quotes are the odd pieces; a doubled quote opens and closes and changes nothing
    cut = lambda piece, i: F.when(i % 2 == 0, F.replace(piece, F.lit(","), F.lit("\x01"))).otherwise(piece)
    return F.transform(F.split(F.array_join(F.transform(F.split(line, '"'), cut), '"'), "\x01"), unquoted)


def read_stations_csv(spark: SparkSession, path: str, errors: bool = False) -> DataFrame:
    """Stations of every CSV under ``path``: file, row_index, station_id, e, n.

    Columns are resolved per file from its first line: header aliases, else by position (three or
    more columns: id, easting, northing; two: easting, northing). ``errors`` returns the rejected
    rows instead.
    """
    c = F.col
    lines = _file_lines(spark, path)
    tops = lines.groupBy("file").agg(F.min_by("value", F.struct("block", "ord")).alias("top"))
    heads = tops.select("file", "top", F.posexplode(_fields(c("top"))).alias("at", "name"))
    name = F.lower(F.trim("name"))
    where = lambda test: F.min(F.when(test, c("at")))
    width = F.size(_fields(c("top")))
    found = heads.groupBy("file", "top").agg(
        where(name.isin(STATION) | F.trim("name").rlike(STATION_PREFIX)).alias("station"),
        where(name.isin(EASTING)).alias("easting"),
        where(name.isin(NORTHING)).alias("northing"),
        F.coalesce(F.bool_or(name.isin(EASTING + NORTHING + STATION)), F.lit(False)).alias("header"),
    )
    layout = found.select(
        "file", "header",
        F.when(c("header"), c("station")).when(width >= 3, 0).alias("s_at"),
        F.when(c("header"), c("easting")).when(width >= 3, 1).when(width == 2, 0).alias("e_at"),
        F.when(c("header"), c("northing")).when(width >= 3, 2).when(width == 2, 1).alias("n_at"),
    )
    numbered = with_row_number(lines, ["file"], ["block", "ord"], c("block"), "line_no")
    rows = numbered.join(layout, "file").filter(~(c("header") & (c("line_no") == 0)))
    index = c("line_no") - F.when(c("header"), 1).otherwise(0)
    rows = rows.filter(F.trim(F.regexp_replace("value", r"[,\s]", "")) != "").select(
        "file", index.alias("row_index"), "s_at", "e_at", "n_at", _fields(c("value")).alias("f"), "value"
    )
    at = lambda i: F.try_element_at("f", (c(i) + 1).cast("int"))
    auto = F.concat(F.lit("S"), (c("row_index") + 1).cast("string"))
    parsed = rows.select(
        "file", "row_index",
        F.coalesce(F.nullif(F.trim(at("s_at")), F.lit("")), auto).alias("station_id"),
        cleanse_numeric(at("e_at")).alias("e"), cleanse_numeric(at("n_at")).alias("n"), "value",
    )
    good = c("e").isNotNull() & c("n").isNotNull()
    if errors:
        return parsed.filter(~good).select("file", "row_index", "value")
    return parsed.filter(good).drop("value")


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of each KML file (one plan per file): run_id is the file path."""
    texts = spark.read.text(path, wholetext=True)
    return kml_vertices(texts.select(F.col("_metadata.file_path").alias("run_id"), F.col("value").alias("kml")))


def read_kml_collection(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of files that hold many KML documents one after another: run_id is the first name in a document.

    Documents are split at their closing tag while they are read, so a large collection is read by many tasks.
    """
    texts = spark.read.option("lineSep", "</kml>").text(path)
    name = F.trim(F.regexp_extract("value", r"(?is)<name>(.*?)</name>", 1))
    return kml_vertices(texts.select(name.alias("run_id"), F.col("value").alias("kml")))


def read_zones_json(spark: SparkSession, path: str) -> DataFrame:
    """Named boxes (name, min_lat, max_lat, min_lng, max_lng) from configuration files {"zones": [{"name", "bbox": [4 numbers]}]}.

    The box is [lat_min, lat_max, lng_min, lng_max]; zones without a name or with another number of bounds are left out.
    """
    read = spark.read.schema("zones ARRAY<STRUCT<name: STRING, bbox: ARRAY<DOUBLE>>>").option("multiLine", True).json(path)
    zones = read.select(F.inline("zones")).where("name IS NOT NULL AND size(bbox) = 4")
    bounds = ["min_lat", "max_lat", "min_lng", "max_lng"]
    return zones.select("name", *[F.col("bbox")[i].alias(k) for i, k in enumerate(bounds)])


def read_registry_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Registry records with ``record_order`` by file name and position; bad records are left out.

    Each file holds a list or one object (``multi_line``), or one record per line.
    """
    read = (
        spark.read.schema(REGISTRY_SCHEMA)
        .option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
        .json(path)
    )
    ordered = read.select(
        "*", F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("record_order")
    )
    return ordered.filter("_bad IS NULL AND id IS NOT NULL AND centroid IS NOT NULL").drop("_bad")


def read_layer_segments(spark: SparkSession, path: str, layer: str, state: str | None = None) -> DataFrame:
    """Segments of a layer: the state's own partition if it has one, else the national one."""
    segments = spark.read.parquet(path).filter(F.col("layer") == layer)
    if state:
        own = segments.filter(F.col("state") == state)
        # the national rows only where the state has none, without a job of its own
        national = segments.filter(F.col("state") == NATIONAL).join(own.select("layer").distinct(), "layer", "left_anti")
        return own.unionByName(national.select(*own.columns))
    return segments.filter(F.col("state") == NATIONAL)


def read_raster_cells(spark: SparkSession, path: str, layer: str, tiles: list[str] | None = None) -> DataFrame:
    """Cells of one layer; ``tiles`` prunes partitions."""
    cells = spark.read.parquet(path).filter(F.col("layer") == layer)
    return cells.filter(F.col("tile").isin(tiles)) if tiles else cells


def read_audit_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path).withColumn("ts", F.to_timestamp("timestamp"))


def layer_contents(spark: SparkSession, path: str) -> DataFrame:
    """What a layer store (partitioned by layer and state) holds: files by state, their names, segments and features of each layer."""
    return spark.read.parquet(path).groupBy("layer").agg(
        F.count_distinct("state").alias("files"), F.array_join(F.sort_array(F.collect_set("state")), ",").alias("names"),
        F.count("*").alias("segments"), F.count_distinct("feature_id").alias("features"),
    )
