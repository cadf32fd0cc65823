"""Queries and checks for sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaspark.functions import numeric
from cadaspark.operators import cells, history, spatial
from cadaspark.plans.checks import inputs, with_
from cadaspark.plans.raster import DEM
from cadaspark.sources import bridge as b
from cadaspark.sources import config, readers, sinks
from cadaspark.sources.scratch import scratch_path
from cadaspark.streaming import streams

c = F.col

# Four layouts of station file, by customer key.
STATION_LINES = [
    "c_custkey % 4 AS file_id", "c_custkey AS ord",
    "CASE c_custkey % 4 WHEN 0 THEN 'BP' || CAST(c_custkey AS STRING) || ',\"' || CAST(300 + c_custkey % 400 AS STRING) || ',' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '.5\",' || CAST(500000 + c_custkey AS STRING) || '-25' "
    "WHEN 1 THEN CAST(500000 + c_custkey AS STRING) || ',' || CASE WHEN c_custkey % 5 = 0 THEN 'bad' ELSE CAST(300000 + c_custkey AS STRING) END "
    "WHEN 2 THEN 'A ' || CAST(c_custkey AS STRING) || ',' || CAST(300000 + c_custkey AS STRING) || ',' || CAST(500000 + c_custkey AS STRING) || ',q' "
    "ELSE CAST(300000 + c_custkey AS STRING) || ',' || CAST(500000 + c_custkey AS STRING) END AS value",
]
HEADERS = {0: "Station,East,NORTH", 1: "Y,X"}


def stations_csv(spark, sf):
    path = scratch_path(spark, "stations")
    body = b.table(spark, sf, "customer").selectExpr(*STATION_LINES)
    heads = config.rows(spark, ["file_id", "ord", "value"], [(F.lit(k).cast("long"), F.lit(-1).cast("long"), v) for k, v in HEADERS.items()])
    lines = body.unionByName(heads)
    lines.repartition("file_id").sortWithinPartitions("file_id", "ord").select("file_id", "value").write.partitionBy("file_id").text(path)
    out = readers.read_stations_csv(spark, path)
    return out.select(
        F.regexp_extract("file", r"file_id=(\d+)", 1).cast("long").alias("file_id"), "row_index", "station_id", "e", "n"
    )


KML = [
    "parcel_id AS run_id",
    "'<kml><Placemark><Coordinates>' || chr(10) || ' ' || CAST(lo4 / 10000e0 AS STRING) || ',' || CAST(la4 / 10000e0 AS STRING) || ',0 ' || chr(10) || '7.25,6.5 x,y 1 8.5,6.75,12' || '</Coordinates><coordinates>1,2</coordinates></kml>' AS kml",
]


def kml(spark, sf):
    """KML documents of all parcels, written as collections and read back."""
    path = scratch_path(spark, "kml")
    named = F.replace("kml", F.lit("<Placemark>"), F.concat(F.lit("<Placemark><name> "), c("run_id").cast("string"), F.lit("</name>")))
    b.parcel_base(spark, sf).selectExpr(*KML).select(named.alias("value")).write.option("lineSep", "\n").text(path)
    return readers.read_kml_collection(spark, path).withColumn("run_id", c("run_id").cast("long"))


def registry_json(spark, sf):
    path = scratch_path(spark, "registry")
    made = b.registry(spark, sf).withColumn("centroid", F.struct("lat", "lng")).drop("lat", "lng", "record_order")
    made.write.json(path)
    out = readers.read_registry_json(spark, path, multi_line=False)
    return out.select("id", "centroid.lat", "centroid.lng", "match_radius_m", "title_type", "title_status", "acquisition_flag", "lga_confirmed")


def layer_segments(spark, sf):
    path = scratch_path(spark, "layers")
    b.lines(spark, sf).write.partitionBy("layer", "state").parquet(path)
    read = lambda state: readers.read_layer_segments(spark, path, "road", state).select(
        F.lit(state).alias("asked"), "feature_id", "lat1", "strahler"
    )
    return read("Lagos").unionByName(read("Ogun"))


def raster_cells(spark, sf):
    path = scratch_path(spark, "raster")
    b.dem_cells(spark, sf).write.partitionBy("layer", "tile").parquet(path)
    read = readers.read_raster_cells(spark, path, "dem", [f"N06E{i:03d}" for i in range(3, 14)])
    return read.groupBy("tile").agg(F.count("*").alias("cells"), numeric.rnd(F.sum("value"), 1).alias("total"))


def rules_config(spark, sf):
    """Parcels inside each configured box, the boxes read from configuration files."""
    spots = b.parcels(spark, sf).select("parcel_id", "lat", "lng")
    made = config.boxes(spark, spatial.SENTINEL_ZONES + [(n + " state", *v) for n, *v in b.STATE_BOXES])
    path = scratch_path(spark, "zones")
    bbox = F.array("min_lat", "max_lat", "min_lng", "max_lng")
    made.groupBy().agg(F.collect_list(F.struct("name", bbox.alias("bbox"))).alias("zones")).write.json(path)
    zones = readers.read_zones_json(spark, path)
    hits = cells.box_join(spots, zones, ["name"])
    return hits.groupBy("name").agg(F.count("*").alias("parcels"), F.min("parcel_id").alias("first_parcel"))


def write_reports(spark, sf):
    path = scratch_path(spark, "reports")
    base = b.reports(spark, sf).select("report_id", "state", "lga", "score", F.lit(1).alias("version"))
    sinks.write_reports(base, path)
    again = base.filter("report_id % 4 = 0").withColumns({"version": F.lit(2), "score": c("score") + 1000.0, "state": F.lit("Moved")})
    sinks.write_reports(again, path)
    return sinks.read_reports(spark, path).select("report_id", "state", "lga", "score", "version")


def compact_reports(spark, sf):
    """Three writes: all reports, a quarter with new scores of which some move to another state, and one state that moves as a whole."""
    path = scratch_path(spark, "report-store")
    base = b.reports(spark, sf).select("report_id", "state", "lga", "score", F.lit(1).alias("version"))
    sinks.upsert_reports(base, path)
    place = F.when(c("report_id") % 8 == 0, "Moved").otherwise(c("state"))
    sinks.upsert_reports(base.filter("report_id % 4 = 0").withColumns({"version": F.lit(2), "score": c("score") + 1000.0, "state": place}), path)
    sinks.upsert_reports(base.filter("state = 'Kano'").withColumns({"version": F.lit(3), "state": F.lit("Ogun")}), path)
    return sinks.stored_reports(spark, path).select("report_id", "state", "lga", "score", "version")


def export_json(spark, sf):
    root = scratch_path(spark, "export")
    reports = b.reports(spark, sf).select("report_id", "persona", "score", "traffic_light")
    sinks.export_reports_json(reports, f"{root}/json", f"{root}/audit")
    stored = spark.read.schema("report_id LONG, score DOUBLE, traffic_light STRING").json(f"{root}/json")
    return spark.read.parquet(f"{root}/audit").join(stored, "report_id").select("report_id", "export_format", "persona", "score", "traffic_light")


def availability(spark, sf):
    """Contents of a layer store written from the given features."""
    path = scratch_path(spark, "layer-store")
    b.lines(spark, sf).repartition("layer", "state").write.partitionBy("layer", "state").parquet(path)
    return readers.layer_contents(spark, path)


STAGES = "CASE event_type WHEN 'signup' THEN 'INIT' WHEN 'click' THEN 'CONFIRMED' WHEN 'view' THEN 'GIS_ANALYSIS' WHEN 'purchase' THEN 'COMPLETE' ELSE 'ERROR' END"
EVENT_COLUMNS = ["user_id AS run_id", "event_id", f"{STAGES} AS stage", "event_type = 'purchase' AS valid", "value", "event_type", "CAST(FLOOR(event_id / 3e0) AS BIGINT) AS gate_run"]
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"


def _shape(events):
    return events.selectExpr(*EVENT_COLUMNS, f"timestamp_micros({MICROS}) AS ts")


def _events(spark, sf):
    return _shape(b.table(spark, sf, "events"))


def _event_stream(spark, sf):
    schema = b.table(spark, sf, "events").schema
    return _shape(spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet"))


def _replayed(spark, sf, parts=4):
    """The events as a stream of several micro-batches: files in order of time, one a batch."""
    events, path = b.table(spark, sf, "events"), scratch_path(spark, "event-files")
    us = F.expr(MICROS)
    inner = events.select(us.cast("double").alias("us")).approxQuantile("us", [i / parts for i in range(1, parts)], 0.001)
    for low, high in zip([None, *inner], [*inner, None]):
        some = F.lit(True) if low is None else us >= low
        some = some if high is None else some & (us < high)
        events.where(some).coalesce(1).write.mode("append").parquet(path)
    return _shape(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path))


def expired_gate(spark, sf):
    """Both outcomes of the gate: runs that are confirmed within a day, and those whose day has passed without it."""
    events = _replayed(spark, sf)
    side = lambda kind: events.filter(c("event_type") == kind).select(c("gate_run").alias("run_id"), "ts")
    out = streams.run_to_table(streams.stream_gate(side("signup"), side("purchase"), expired=True), "append")
    return out.select("run_id", F.unix_micros("submitted_at").alias("submitted_us"), F.unix_micros("confirmed_at").alias("confirmed_us"), "status")


def closed_windows(spark, sf):
    """Windows of all three kinds as they are closed by the watermark, over several micro-batches."""
    events = _replayed(spark, sf)
    done = [streams.run_to_table(streams.submission_windows(events, kind), "append") for kind in ("tumbling", "sliding", "session")]
    return done[0].unionByName(done[1]).unionByName(done[2])


def call_sessions(spark, sf):
    return streams.run_to_table(streams.call_sessions(_replayed(spark, sf)), "append")


def gate(spark, sf):
    side = lambda kind: _event_stream(spark, sf).filter(c("event_type") == kind).select(c("gate_run").alias("run_id"), "ts")
    out = streams.run_to_table(streams.stream_gate(side("signup"), side("purchase")), "append")
    return out.select("run_id", F.unix_micros("submitted_at").alias("submitted_us"), F.unix_micros("confirmed_at").alias("confirmed_us"), "status")


def sessions(spark, sf):
    out = streams.run_to_table(streams.session_state(_event_stream(spark, sf)), "update", ["run_id"])
    return out.select("run_id", "stage", "status", F.unix_micros("updated_at").alias("updated_us"), "events")


AREA_ROWS = ["'S' || CAST(run_id % 5 AS STRING) AS state", "event_type AS lga", "value AS flood_score", "CASE WHEN event_id % 6 > 0 THEN value * 2 END AS growth_score", "CASE WHEN event_id % 4 > 0 THEN value + 1 END AS elevation_m", "1e0 * (event_id % 100) AS confidence"]


def bench_stream(spark, sf):
    rows = _event_stream(spark, sf).selectExpr(*AREA_ROWS)
    return history.benchmark_means(streams.run_to_table(history.benchmark_state(rows), "update", history.AREA))


def windows(spark, sf):
    batch = _events(spark, sf)
    out = streams.run_to_table(streams.submission_windows(_event_stream(spark, sf), "tumbling"), "update", ["kind", "start_us", "end_us"])
    for kind in ("sliding", "session"):
        out = out.unionByName(streams.submission_windows(batch, kind))
    return out


QUERIES = {
    "read_stations_csv": stations_csv,
    "read_kml": kml,
    "read_registry_json": registry_json,
    "read_layer_segments": layer_segments,
    "read_raster_cells": raster_cells,
    "read_rules_config": rules_config,
    "write_reports": write_reports,
    "compact_reports": compact_reports,
    "export_reports_json": export_json,
    "layer_availability": availability,
    "stream_gate": gate,
    "stream_gate_expired": expired_gate,
    "closed_windows": closed_windows,
    "call_sessions": call_sessions,
    "session_state": sessions,
    "stream_benchmark": bench_stream,
    "submission_windows": windows,
    "call_limit": lambda spark, sf: streams.call_limit(_events(spark, sf)),
}

_EV = f"SELECT {', '.join(EVENT_COLUMNS)}, epoch_us(ts) AS us FROM events"
_zone_rows = ", ".join(f"('{n}',{v[0]!r}e0,{v[1]!r}e0,{v[2]!r}e0,{v[3]!r}e0)" for n, *v in spatial.SENTINEL_ZONES + [(n + " state", *v) for n, *v in b.STATE_BOXES])
_means = ", ".join(f"(floor(sum({m})/count(*)*1e4+0.5e0)/1e4) AS avg_{m}, (floor(avg({m})*1e4+0.5e0)/1e4) AS plain_{m}" for m in history.MEASURES)

_us = "epoch_us(ts)"
_WINDOWS = f"""WITH e AS ({_EV}), t AS (SELECT 'tumbling' AS kind, us//21600000000*21600000000 AS start_us, 21600000000 AS len, stage FROM e UNION ALL
       SELECT 'sliding', (us//21600000000-d)*21600000000, 43200000000, stage FROM e, (SELECT unnest([0,1]) AS d)),
      o AS (SELECT *, CASE WHEN us-lag(us) OVER (PARTITION BY run_id ORDER BY us)<1800000000 THEN 0 ELSE 1 END AS brk FROM e), s AS (SELECT run_id, us, stage, sum(brk) OVER (PARTITION BY run_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM o)
      SELECT kind, CAST(NULL AS BIGINT) AS run_id, start_us, start_us+len AS end_us, count(*) AS runs, count(*) FILTER (stage='ERROR') AS errors FROM t GROUP BY ALL UNION ALL
      SELECT 'session', run_id, min(us), max(us)+1800000000, count(*), count(*) FILTER (stage='ERROR') FROM s GROUP BY run_id, k"""

CHECKS = {
    "read_stations_csv": """WITH r AS (SELECT c_custkey%4 AS file_id, c_custkey AS k, row_number() OVER (PARTITION BY c_custkey%4 ORDER BY c_custkey)-1 AS row_index FROM customer)
      SELECT file_id, row_index, CASE file_id WHEN 0 THEN 'BP' || k WHEN 2 THEN 'A ' || k ELSE 'S' || (row_index+1) END AS station_id,
      CASE WHEN file_id=0 THEN (300+k%400)*1000+k%1000+0.5e0 ELSE 300000e0+k END AS e, CASE WHEN file_id=0 THEN 500000e0+k+0.25e0 ELSE 500000e0+k END AS n FROM r WHERE NOT (file_id=1 AND k%5=0)""",
    "read_kml": with_(["p"], """SELECT parcel_id AS run_id, CAST(0 AS INT) AS seq, lat, lng FROM p UNION ALL SELECT parcel_id, 1, 6.5e0, 7.25e0 FROM p UNION ALL SELECT parcel_id, 2, 6.75e0, 8.5e0 FROM p"""),
    "read_registry_json": with_(["reg"], "SELECT id, lat, lng, match_radius_m, title_type, title_status, acquisition_flag, lga_confirmed FROM reg"),
    "read_layer_segments": with_(["lines"], "SELECT 'Lagos' AS asked, feature_id, lat1, strahler FROM lines WHERE layer='road' AND state='Lagos' UNION ALL SELECT 'Ogun', feature_id, lat1, strahler FROM lines WHERE layer='road' AND state='national'"),
    "read_raster_cells": with_({k: v for k, v in DEM.items() if k != "px"}, "SELECT tile, count(*) AS cells, floor(sum(value)*10+0.5e0)/10 AS total FROM dem WHERE tile BETWEEN 'N06E003' AND 'N06E013' GROUP BY tile"),
    "read_rules_config": with_({**inputs("p"), "z": f"SELECT * FROM (VALUES {_zone_rows}) t(name,a,b,x,y)"}, "SELECT name, count(*) AS parcels, min(parcel_id) AS first_parcel FROM p JOIN z ON lat BETWEEN a AND b AND lng BETWEEN x AND y GROUP BY name"),
    "write_reports": with_(["rep"], "SELECT report_id, CASE WHEN report_id%4=0 THEN 'Moved' ELSE state END AS state, lga, CASE WHEN report_id%4=0 THEN score+1000 ELSE score END AS score, CAST(CASE WHEN report_id%4=0 THEN 2 ELSE 1 END AS INT) AS version FROM rep"),
    "compact_reports": with_(["rep"], """SELECT report_id, CASE WHEN state='Kano' THEN 'Ogun' WHEN report_id%8=0 THEN 'Moved' ELSE state END AS state, lga,
      CASE WHEN report_id%4=0 AND state IS DISTINCT FROM 'Kano' THEN score+1000 ELSE score END AS score,
      CAST(CASE WHEN state='Kano' THEN 3 WHEN report_id%4=0 THEN 2 ELSE 1 END AS INT) AS version FROM rep"""),
    "export_reports_json": with_(["rep"], "SELECT report_id, 'JSON' AS export_format, persona, score, traffic_light FROM rep"),
    "layer_availability": with_(["lines"], "SELECT layer, count(DISTINCT state) AS files, string_agg(DISTINCT state, ',' ORDER BY state) AS names, count(*) AS segments, count(DISTINCT feature_id) AS features FROM lines GROUP BY layer"),
    "stream_gate": f"WITH e AS ({_EV}) SELECT s.gate_run AS run_id, s.us AS submitted_us, k.us AS confirmed_us, 'running' AS status FROM e s JOIN e k ON s.gate_run=k.gate_run AND s.event_type='signup' AND k.event_type='purchase' AND k.us BETWEEN s.us AND s.us+86400000000",
    "stream_gate_expired": f"""WITH e AS ({_EV}), s AS (SELECT gate_run, us FROM e WHERE event_type='signup'), k AS (SELECT gate_run, us FROM e WHERE event_type='purchase'),
      w AS (SELECT least((SELECT max(us) FROM s), (SELECT max(us) FROM k)) - 3600000000 AS w), j AS (SELECT s.gate_run, s.us, k.us AS kus FROM s LEFT JOIN k ON s.gate_run=k.gate_run AND k.us BETWEEN s.us AND s.us+86400000000)
      SELECT gate_run AS run_id, us AS submitted_us, kus AS confirmed_us, CASE WHEN kus IS NULL THEN 'cancelled' ELSE 'running' END AS status FROM j, w WHERE kus IS NOT NULL OR us+86400000000 < w""",
    "closed_windows": f"SELECT o.* FROM ({_WINDOWS}) o WHERE end_us <= (SELECT max({_us}) - 3600000000 FROM events)",
    "call_sessions": f"""WITH e AS ({_EV}), g AS (SELECT *, CASE WHEN us-lag(us) OVER w<=21600000000 THEN 0 ELSE 1 END AS brk FROM e WINDOW w AS (PARTITION BY run_id ORDER BY us, event_id)),
      s AS (SELECT *, sum(brk) OVER (PARTITION BY run_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS ses FROM g),
      i AS (SELECT *, sum(CASE WHEN valid THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, ses ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM s),
      k AS (SELECT run_id, ses, isl, min(us) AS a, max(us) AS z, count(*) AS n, count(*) FILTER (NOT valid) AS bad FROM i GROUP BY ALL),
      r AS (SELECT run_id, min(a) AS started_us, max(z) AS ended_us, CAST(sum(n) AS BIGINT) AS calls, CAST(max(bad) AS BIGINT) AS longest FROM k GROUP BY run_id, ses)
      SELECT *, longest>3 AS abort FROM r WHERE ended_us+21600000000 < (SELECT max(us) FROM e)-3600000000""",
    "session_state": f"""WITH e AS ({_EV}), g AS (SELECT run_id, arg_max(stage, {{'u': us, 'i': event_id}}) AS stage, max(us) AS updated_us, count(*) AS events, bool_or(stage='CONFIRMED') AS ok FROM e GROUP BY run_id)
      SELECT run_id, stage, CASE stage WHEN 'ERROR' THEN 'error' WHEN 'COMPLETE' THEN 'completed' ELSE CASE WHEN ok THEN 'running' ELSE 'pending' END END AS status, updated_us, events FROM g""",
    "stream_benchmark": f"WITH e AS ({_EV}), r AS (SELECT {', '.join(AREA_ROWS)} FROM e) SELECT state, lga, count(*) AS report_count, {_means} FROM r GROUP BY state, lga",
    "submission_windows": _WINDOWS,
    "call_limit": f"WITH e AS ({_EV}), i AS (SELECT *, sum(CASE WHEN valid THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM e), s AS (SELECT run_id, k, count(*) AS n FROM i WHERE NOT valid GROUP BY ALL) SELECT r.run_id, coalesce(max(n),0) AS longest, coalesce(max(n),0)>3 AS abort FROM (SELECT DISTINCT run_id FROM e) r LEFT JOIN s ON r.run_id=s.run_id GROUP BY r.run_id",
}
