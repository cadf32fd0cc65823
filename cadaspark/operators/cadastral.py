"""Survey plans as one computation: raw text to a closed station ledger and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaspark.functions.numeric import rnd
from cadaspark.operators import extract, rings
from cadaspark.operators.ordered import seq_chunk, with_row_number
from cadaspark.sources.scratch import keep, large

KEY = ["run_id"]
ANCHOR_NAME = "TP0 (Tie-Point)"


def traverse_stations(legs: DataFrame) -> DataFrame:
    """Stations of traverses, the anchor first, with a small misclosure spread along the legs.

    ``legs``: run_id, seq (dense from 0), bearing_dd, distance_m, label, from_station, to_station, anchor_e, anchor_n.
    A station is named by the leg's end, else its label, else its number. Returns run_id, seq, station_id, e, n, adjustment.
    """
    c = F.col
    filled = lambda v: F.when(v != "", v)
    named = legs.select(
        "run_id", "seq",
        F.coalesce(filled(c("to_station")), filled(c("label")), F.concat(F.lit("S"), (c("seq") + 1).cast("string"))).alias("station_id"),
    )
    adjusted = rings.bowditch_adjust(legs)
    reached = adjusted.join(large(named), ["run_id", "seq"]).select(
        "run_id", (c("seq") + 1).cast("int").alias("seq"), "station_id", "e", "n", "adjustment"
    )
    first_e, first_n = (F.coalesce(c(n), F.lit(v)) for n, v in zip(("anchor_e", "anchor_n"), rings.DEFAULT_ANCHOR, strict=True))
    start = legs.filter("seq = 0").select(
        "run_id", F.coalesce(filled(c("from_station")), F.lit(ANCHOR_NAME)).alias("station_id"),
        first_e.alias("e"), first_n.alias("n"),
    )
    kind = adjusted.filter("seq = 0").select("run_id", "adjustment")
    anchors = start.join(large(kind), "run_id").select("run_id", F.lit(0).alias("seq"), "station_id", "e", "n", "adjustment")
    return reached.unionByName(anchors)


def cadastral_plan(submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger, summary) of submissions (run_id, raw_text).

    The ledger holds every station of every run that could be computed: a station table is closed, a traverse is run from its
    anchor (or the default one) and adjusted. The summary has one row per submission, with an error code where there was nothing
    to compute.
    """
    c = F.col
    stations = keep(extract.scan_station_table(submissions), "plan-stations")
    legs = keep(extract.scan_traverse_legs(submissions), "plan-legs")
    route = keep(extract.route_track(submissions, stations, legs), "plan-routes")
    of = lambda rows, track: rows.join(large(route.filter(c("track") == track).select("run_id")), "run_id", "left_semi")
    table = rings.auto_close(of(stations, "TABULAR")).withColumn("adjustment", F.lit("none"))
    steps = with_row_number(of(legs, "COGO_TRAVERSE"), KEY, ["line_no"], seq_chunk("line_no"))
    anchors = extract.find_anchor(of(submissions, "COGO_TRAVERSE"))
    steps = keep(steps.join(large(anchors), "run_id", "left"), "plan-steps")
    ledger = keep(table.unionByName(traverse_stations(steps)), "plan-ledger")
    closure = rings.traverse_misclosure(steps).select("run_id", "misclosure_m", "closure_status")
    shape = rings.metric_shape(ledger).select("run_id", rnd(c("area_m2") / 10000.0, 4).alias("area_ha"))
    counts = ledger.groupBy("run_id").agg(F.count("*").alias("ledger_stations"), F.max("adjustment").alias("adjustment"))
    summary = (
        route.select("run_id", "track", "error_code").join(large(counts), "run_id", "left").join(large(closure), "run_id", "left")
        .join(large(shape), "run_id", "left")
    )
    # a table has no misclosure
    tabular = c("track") == "TABULAR"
    return ledger, summary.withColumns(
        {
            "misclosure_m": F.when(tabular, 0.0).otherwise(c("misclosure_m")),
            "closure_status": F.when(tabular, "CLOSED").otherwise(c("closure_status")),
        }
    )
