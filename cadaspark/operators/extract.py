"""Submissions (run_id, raw_text, ...) to points, stations and legs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaspark.functions import parsing as p
from cadaspark.operators.ordered import running_sums, seq_chunk
from cadaspark.sources.scratch import keep, large

KEY = ["run_id"]


def parse_format(submissions: DataFrame, fmt: str, text: str = "raw_text") -> DataFrame:
    """Every pair written in one format, in text order."""
    found = submissions.select("run_id", F.posexplode(p.matches(F.col(text), p.FORMATS[fmt])).alias("seq", "match"))
    a, b = p.decode(F.col("match"), fmt)
    return found.select("run_id", "seq", a.alias("p1"), b.alias("p2"))


def first_format(submissions: DataFrame) -> DataFrame:
    """``hit``, the first format with enough pairs and its matches, and ``rest``, the text of those without that may hold three stations.

    ``raw_text`` goes and other columns stay; all that follows reads the few texts in ``rest`` only.
    """
    enough = lambda pattern: F.size(p.matches(F.col("raw_text"), pattern)) >= p.MIN_PLACES
    cleaned = submissions.withColumn("text", F.when(enough(p.MAY_FORMAT), p.strip_thousands(F.col("raw_text"))))
    ladder = []
    for name, pattern in p.FORMATS.items():
        found = F.array(F.struct(F.lit(name).alias("fmt"), p.matches(F.col("text"), pattern).alias("found")))
        # a list of one, so that the pattern runs once for its number of matches and for the matches
        ladder.append(F.try_element_at(F.filter(found, lambda x: F.size(x["found"]) >= p.MIN_POINTS), F.lit(1)))
    tried = cleaned.withColumn("hit", F.coalesce(*ladder))
    # every number of the scale is a place of MAY_FORMAT too
    rest = F.when(F.col("hit").isNull() & F.col("text").isNotNull() & enough(p.MAY_SCALE), F.col("raw_text"))
    return tried.withColumn("rest", rest).drop("text", "raw_text")


def parse_auto(submissions: DataFrame) -> DataFrame:
    """Points of the first format with three or more; otherwise a station table in the text.

    Returns run_id, fmt, seq, p1, p2 (latitude and longitude, or northing and easting).
    """
    return points_of(keep(first_format(submissions.select("run_id", "raw_text")), "formats"))


def points_of(tried: DataFrame) -> DataFrame:
    """Points of texts that ``first_format`` has gone through: run_id, hit, rest."""
    c = F.col
    found = tried.filter("hit IS NOT NULL").select("run_id", "hit.fmt", F.posexplode("hit.found").alias("seq", "match"))
    a, b = p.decode_any(c("match"), c("fmt"))
    points = found.select("run_id", "fmt", "seq", a.alias("p1"), b.alias("p2"))
    rest = tried.filter("rest IS NOT NULL").select("run_id", c("rest").alias("raw_text"))
    stations = keep(scan_station_table(rest), "stations")
    enough = stations.groupBy("run_id").agg(F.count("*").alias("n")).filter(c("n") >= p.MIN_POINTS)
    tabled = stations.join(large(enough), "run_id", "left_semi").select(
        "run_id", F.lit("STATION_TABLE").alias("fmt"), "seq", c("n").alias("p1"), c("e").alias("p2")
    )
    return points.unionByName(tabled)


def extraction_errors(submissions: DataFrame, parcels: DataFrame) -> DataFrame:
    """One error row for each submission that gave no usable parcel.

    ``parcels``: run_id, error_code. Submissions without a row there hold no coordinates.
    """
    told = submissions.select("run_id").join(large(parcels.select("run_id", "error_code", F.lit(True).alias("found"))), "run_id", "left")
    code = F.when(F.col("found").isNull(), "NO_COORDINATES_DETECTED").otherwise(F.col("error_code"))
    return told.select("run_id", F.lit("COORD_EXTRACT").alias("stage"), code.alias("error_code")).filter("error_code IS NOT NULL")


def text_lines(submissions: DataFrame, text: str = "raw_text") -> DataFrame:
    lines = submissions.select("run_id", F.posexplode(F.split(text, p.NEW_LINE)).alias("line_no", "line"))
    return lines.withColumn("line", F.btrim("line", F.lit(" \t\f\x0b"))).filter("line <> ''")


def scan_station_table(submissions: DataFrame) -> DataFrame:
    """Stations line by line; a text with fewer than three falls back to column-grouped numbers.

    Returns run_id, seq, station_id, e, n.
    """
    c = F.col
    lines = text_lines(submissions.filter(c("raw_text").rlike(p.MAY_SCALE))).filter(c("line").rlike(p.MAY_SCALE)).withColumn(
        "nums", F.regexp_extract_all(p.mend_line(c("line")), F.lit(p.UTM_SCALE), 1)
    ).filter(F.size("nums") >= 2)
    a, b = (F.element_at("nums", i).try_cast("double") for i in (1, 2))
    valued = lines.select("run_id", "line_no", "line", a.alias("a"), b.alias("b")).filter("a >= 100000 AND b >= 100000")
    valued = keep(valued, "station-lines")  # few lines of all texts, for the stations and for their number
    area = (
        F.when(F.contains("line", F.lit("\t")), F.trim(F.substring_index("line", "\t", 1)))
        .when(F.contains("line", F.lit("  ")), F.trim(F.substring_index("line", "  ", 1)))
        .otherwise(c("line"))
    )
    label = F.regexp_replace(F.trim(F.regexp_extract(area, p.STATION_LABEL, 0)), r"\s+", " ")
    labelled = valued.withColumn("label", label)
    counted = running_sums(
        labelled, KEY, ["line_no"], seq_chunk("line_no"),
        {"place": F.lit(1), "auto": F.when(c("label") == "", 1).otherwise(0)},
    )
    by_line = counted.select(
        "run_id",
        (c("place") - 1).cast("int").alias("seq"),
        F.when(c("label") == "", F.concat(F.lit("S"), c("auto").cast("string"))).otherwise(c("label")).alias("station_id"),
        F.least("a", "b").alias("e"), F.greatest("a", "b").alias("n"),
    )
    enough = valued.groupBy("run_id").agg(F.count("*").alias("found")).filter(c("found") >= p.MIN_POINTS)
    grouped = keep(_column_grouped(submissions, enough), "grouped-stations")  # for its rows and for their runs
    replaced = grouped.select("run_id").distinct()
    return by_line.join(large(replaced), "run_id", "left_anti").unionByName(grouped)


def _column_grouped(submissions: DataFrame, enough: DataFrame) -> DataFrame:
    """All eastings first, then all northings: split the numbers of the text in the middle, for runs not in ``enough``."""
    c = F.col
    flat = p.mend_line(F.regexp_replace("raw_text", r"\n", " "))
    # The cheap test for six numbers spares most texts the array work.
    likely = submissions.filter(c("raw_text").rlike(p.MAY_SCALE)).filter(
        F.size(F.regexp_extract_all("raw_text", F.lit(p.MAY_SCALE), 0)) >= 2 * p.MIN_POINTS
    )
    # written first: the join would move below the projection and sort whole texts
    listed = keep(likely.select("run_id", p.scale_numbers(flat).alias("numbers")), "station-numbers").join(large(enough), "run_id", "left_anti")
    numbers = listed.select("run_id", F.posexplode("numbers").alias("pos", "v"))
    counts = numbers.groupBy("run_id").agg(F.count("*").alias("total")).filter(
        (c("total") >= 2 * p.MIN_POINTS) & (c("total") % 2 == 0)
    )
    half = (c("total") / 2).cast("int")
    rows = numbers.join(large(counts), "run_id").groupBy("run_id", (c("pos") % half).cast("int").alias("seq")).agg(
        F.max(F.when(c("pos") < half, c("v"))).alias("v1"), F.max(F.when(c("pos") >= half, c("v"))).alias("v2")
    )
    means = rows.groupBy("run_id").agg(F.avg("v1").alias("m1"), F.avg("v2").alias("m2")).filter("abs(m1 - m2) > 50000")
    first = c("m1") < c("m2")
    return rows.join(large(means), "run_id").select(
        "run_id", "seq", F.concat(F.lit("S"), (c("seq") + 1).cast("string")).alias("station_id"),
        F.when(first, c("v1")).otherwise(c("v2")).alias("e"), F.when(first, c("v2")).otherwise(c("v1")).alias("n"),
    )


def scan_traverse_legs(submissions: DataFrame) -> DataFrame:
    """Bearing and distance per line; lines with coordinate-scale numbers are not legs."""
    c = F.col
    lines = text_lines(submissions.filter(c("raw_text").rlike(p.MAY_LEG))).filter(c("line").rlike(p.MAY_LEG))
    lines = lines.filter(F.size(p.scale_numbers(p.mend_line(c("line")))) == 0)
    found = lines.withColumn("hit", F.regexp_extract("line", p.BEARING, 0)).filter("hit <> ''")
    g = lambda i: F.regexp_extract("hit", p.BEARING, i)
    parts = found.select(
        "run_id", "line_no", "line", "hit",
        g(1).alias("d1"), g(5).alias("d2"),
        (
            g(2).try_cast("double") + g(3).try_cast("double") / 60.0
            + F.when(g(4) == "", 0.0).otherwise(g(4).try_cast("double")) / 3600.0
        ).alias("angle"),
    )
    marked = c("hit").rlike("[°'″]")
    kept = parts.filter(((c("d1") != "") | (c("d2") != "") | marked) & c("angle").isNotNull())
    rest = F.substring(c("line"), F.instr("line", c("hit")) + F.length("hit"), F.length("line"))
    after = F.regexp_extract(rest, p.DISTANCE, 1)
    distance = F.when(after != "", after).otherwise(F.regexp_extract("line", p.DISTANCE, 1)).try_cast("double")
    header = F.when(F.contains("line", F.lit(":")), F.substring_index("line", ":", 1))
    ends = F.split(F.regexp_replace(header, r"(?i)^(.*?)\bto\b(.*)$", "$1\u0001$2"), "\u0001")
    linked = F.size(ends) == 2
    legs = kept.select(
        "run_id", "line_no",
        p.bearing_to_dd(c("d1"), c("angle"), c("d2")).alias("bearing_dd"),
        distance.alias("distance_m"),
        F.trim(F.regexp_extract("line", p.LEG_LABEL, 0)).alias("label"),
        F.when(linked, F.trim(F.regexp_replace(F.trim(ends[0]), r"^\d+[\s.)\-:]+", ""))).otherwise("").alias("from_station"),
        F.when(linked, F.trim(F.try_element_at(ends, F.lit(2)))).otherwise("").alias("to_station"),
    )
    return legs.filter("distance_m > 0")


def find_anchor(submissions: DataFrame) -> DataFrame:
    """Labelled tie point, else the first two coordinate-scale numbers (smaller is the easting)."""
    c = F.col
    text = c("raw_text")
    e, n = (p.cleanse_numeric(F.regexp_extract(text, p.ANCHOR, i)) for i in (1, 2))
    first_two = p.scale_numbers(p.mend_line(F.regexp_replace(text, r"\n", " ")))
    read = submissions.select("run_id", e.alias("e"), n.alias("n"), first_two.alias("s"))
    labelled = c("e").isNotNull() & c("n").isNotNull()
    pair = F.size("s") >= 2
    a, b = F.try_element_at("s", F.lit(1)), F.try_element_at("s", F.lit(2))
    return read.select(
        "run_id",
        F.when(labelled, c("e")).when(pair, F.least(a, b)).alias("anchor_e"),
        F.when(labelled, c("n")).when(pair, F.greatest(a, b)).alias("anchor_n"),
    )


def route_track(submissions: DataFrame, stations: DataFrame, legs: DataFrame) -> DataFrame:
    """TABULAR, COGO_TRAVERSE or INSUFFICIENT by what the text holds."""
    c = F.col
    count = lambda d, name: d.groupBy("run_id").agg(F.count("*").alias(name))
    joined = (
        submissions.select("run_id").join(large(count(stations, "stations")), "run_id", "left")
        .join(large(count(legs, "legs")), "run_id", "left").fillna(0, ["stations", "legs"])
    )
    track = F.when(c("stations") >= 3, "TABULAR").when(c("legs") >= 3, "COGO_TRAVERSE").otherwise("INSUFFICIENT")
    return joined.withColumns(
        {"track": track, "error_code": F.when(track == "INSUFFICIENT", "INSUFFICIENT_SPATIAL_DATA")}
    )


PLAN_SCHEMA = (
    "selected_processing_track STRING, datum STRING, stated_area_sqm DOUBLE, starting_beacon STRING, "
    "plan_metadata STRUCT<datum: STRING, stated_area_sqm: DOUBLE>, "
    "anchor_point_resolution STRUCT<anchor_station_id: STRING, resolved_intersection_easting: DOUBLE, resolved_intersection_northing: DOUBLE>, "
    "reference_grid STRUCT<easting: DOUBLE, northing: DOUBLE>, origin STRUCT<easting: DOUBLE, northing: DOUBLE>, "
    "parsed_data STRUCT<ledger_stations: ARRAY<STRUCT<station_id: STRING, easting: DOUBLE, northing: DOUBLE>>, "
    "traverse_legs: ARRAY<STRUCT<from_station: STRING, to_station: STRING, bearing_dms: STRING, bearing: STRING, distance_meters: DOUBLE, distance_m: DOUBLE>>>, "
    "raw_coordinates ARRAY<ARRAY<DOUBLE>>, "
    "legs ARRAY<STRUCT<bearing_dms: STRING, bearing: STRING, distance_m: DOUBLE>>, "
    "boundaries ARRAY<STRUCT<bearing: STRING, distance_m: DOUBLE, to_easting: DOUBLE, to_northing: DOUBLE>>"
)


def vision_json_to_lines(plans: DataFrame, json: str = "plan_json") -> DataFrame:
    """Plan records as the line text the scanners read: run_id, line_no, line."""
    read = plans.select("run_id", F.from_json(json, PLAN_SCHEMA).alias("j"))
    j = lambda path: F.col(f"j.{path}")
    m3 = lambda v: F.format_string("%.3f", v)
    filled = lambda v: v.isNotNull() & (v != "")
    nonzero = lambda v: v.isNotNull() & (v != 0)
    either = lambda a, b: F.when(filled(a), a).otherwise(b)
    either_n = lambda a, b: F.when(nonzero(a), a).otherwise(b)

    datum = either(j("plan_metadata.datum"), j("datum"))
    area = either_n(j("plan_metadata.stated_area_sqm"), j("stated_area_sqm"))
    beacon = either(j("anchor_point_resolution.anchor_station_id"), j("starting_beacon"))
    re, rn = (j(f"anchor_point_resolution.resolved_intersection_{k}") for k in ("easting", "northing"))
    given = re.isNotNull() & rn.isNotNull()
    ge, gn = (F.when(given, a).otherwise(j(f"reference_grid.{k}")) for a, k in ((re, "easting"), (rn, "northing")))
    oe, on = j("origin.easting"), j("origin.northing")
    head = F.array(
        F.when(filled(j("selected_processing_track")), F.concat(F.lit("TRACK: "), j("selected_processing_track"))),
        F.when(filled(datum), F.concat(F.lit("DATUM: "), datum)),
        F.when(nonzero(area), F.concat(F.lit("STATED_AREA_SQM: "), m3(area))),
        F.when(filled(beacon), F.concat(F.lit("STARTING_BEACON: "), beacon)),
        F.when(nonzero(ge) & nonzero(gn), F.concat(F.lit("GRID_REF: E "), m3(ge), F.lit(" N "), m3(gn))),
        F.when(nonzero(oe) & nonzero(on), F.concat(m3(oe), F.lit("mE"))),
        F.when(nonzero(oe) & nonzero(on), F.concat(m3(on), F.lit("mN"))),
    )
    point = lambda e, n: F.concat(F.lit("E: "), m3(e), F.lit("  N: "), m3(n))

    def station(s):
        line = F.when(filled(s["station_id"]), F.concat(s["station_id"], F.lit(" "), point(s["easting"], s["northing"])))
        return F.when(s["easting"].isNotNull() & s["northing"].isNotNull(), line.otherwise(point(s["easting"], s["northing"])))

    def leg(x):
        bearing = either(x["bearing_dms"], x["bearing"])
        dist = either_n(x["distance_meters"], x["distance_m"])
        named = filled(x["from_station"]) & filled(x["to_station"])
        full = F.concat(x["from_station"], F.lit(" to "), x["to_station"], F.lit(": "), bearing, F.lit(" "), m3(dist), F.lit("m"))
        short = F.concat(bearing, F.lit("  "), m3(dist), F.lit("m"))
        return F.when(filled(bearing) & dist.isNotNull(), F.when(named, full).otherwise(short))

    def plain_leg(bearing, dist):
        return F.when(filled(bearing) & dist.isNotNull(), F.concat(bearing, F.lit("  "), m3(dist), F.lit("m")))

    none = F.array().cast("array<string>")
    each = lambda path, f: F.coalesce(F.transform(j(path), f), none)
    pair = lambda v: F.when(F.size(v) == 2, point(v[0], v[1]))
    bounds = F.flatten(
        F.coalesce(
            F.transform(
                j("boundaries"),
                lambda x: F.array(
                    plain_leg(x["bearing"], x["distance_m"]),
                    F.when(nonzero(x["to_easting"]) & nonzero(x["to_northing"]), point(x["to_easting"], x["to_northing"])),
                ),
            ),
            F.array().cast("array<array<string>>"),
        )
    )
    lines = F.concat(
        head, each("parsed_data.ledger_stations", station), each("raw_coordinates", pair),
        each("parsed_data.traverse_legs", leg),
        each("legs", lambda x: plain_leg(either(x["bearing_dms"], x["bearing"]), x["distance_m"])), bounds,
    )
    return read.select("run_id", F.posexplode(F.array_compact(lines)).alias("line_no", "line"))


def kml_vertices(documents: DataFrame, text: str = "kml") -> DataFrame:
    """First coordinates block of a KML text: run_id, seq, lat, lng."""
    c = F.col
    block = F.regexp_extract(c(text), r"(?is)<coordinates>(.*?)</coordinates>", 1)
    tokens = F.filter(F.split(block, r"\s+"), lambda t: t != "")
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    parsed = F.transform(
        tokens,
        lambda t: F.transform(
            F.slice(F.split(t, ","), 1, 2), lambda v: F.when(F.trim(v).rlike(number), F.trim(v).try_cast("double"))
        ),
    )
    whole = F.filter(parsed, lambda a: (F.size(a) == 2) & F.try_element_at(a, F.lit(1)).isNotNull() & F.try_element_at(a, F.lit(2)).isNotNull())
    return documents.select("run_id", F.posexplode(whole).alias("seq", "x")).select(
        "run_id", "seq", c("x")[1].alias("lat"), c("x")[0].alias("lng")
    )
