"""Report history, comparisons, area benchmarks and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadaspark.functions.geo import haversine
from cadaspark.functions.numeric import rnd
from cadaspark.functions.rules import benchmark_percentile
from cadaspark.operators.ordered import running_sums
from cadaspark.operators.spatial import SAME_PARCEL_M
from cadaspark.sources.config import LINEAGE_FIELDS

AREA = ["state", "lga"]
MEASURES = ["flood_score", "growth_score", "elevation_m", "confidence"]
REPORT_JSON = "parcel_geometry STRUCT<computed_area_ha: DOUBLE>, summary STRUCT<traffic_light: STRING>"

# Rank of ordered levels.
RANKS = {
    "GREEN": 1, "AMBER": 2, "RED": 3, "LOW": 1, "MEDIUM": 2, "HIGH": 3,
    "SUITABLE": 1, "MARGINAL": 2, "UNSUITABLE": 3,
}


def benchmark_state(rows: DataFrame) -> DataFrame:
    """Additive benchmark state per area: counts and sums, mergeable in any order."""
    return rows.groupBy(*AREA).agg(
        F.count("*").alias("report_count"),
        *[F.sum(m).alias(f"sum_{m}") for m in MEASURES],
        *[F.count(m).alias(f"n_{m}") for m in MEASURES],
    )


def merge_states(*states: DataFrame) -> DataFrame:
    """Combine benchmark states; this is the incremental update."""
    merged = states[0]
    for other in states[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy(*AREA).agg(*[F.sum(c).alias(c) for c in merged.columns if c not in AREA])


def benchmark_means(state: DataFrame, *more: str) -> DataFrame:
    """Two means per measure: nulls as zero (the stored running mean) and over known values only."""
    c = F.col
    return state.select(
        *AREA, *more, "report_count",
        *[rnd(c(f"sum_{m}") / c("report_count"), 4).alias(f"avg_{m}") for m in MEASURES],
        *[rnd(F.try_divide(c(f"sum_{m}"), c(f"n_{m}")), 4).alias(f"plain_{m}") for m in MEASURES],
    )


def benchmark_rollup(rows: DataFrame) -> DataFrame:
    """Means per area, per state and over all: the additive area state rolled up, so that rows are read and shuffled once.

    ``level`` is 0 for an area, 1 for a state and 3 for all, which tells a total from a missing name.
    """
    state = benchmark_state(rows)
    totals = state.rollup(*AREA).agg(*[F.sum(k).alias(k) for k in state.columns if k not in AREA], F.grouping_id().alias("level"))
    return benchmark_means(totals, "level")


def lga_benchmark(rows: DataFrame) -> DataFrame:
    return benchmark_means(benchmark_state(rows))


def percentile(rows: DataFrame, key: str) -> DataFrame:
    """Estimate from the area mean, and the true percent rank beside it.

    The rank comes from a running count over the distinct scores of an area, so the shuffled rows
    are a histogram and not the reports.
    """
    c = F.col
    means = rows.groupBy(*AREA).agg((F.sum("flood_score") / F.count("*")).alias("mean"), F.count("flood_score").alias("known"))
    counts = rows.filter("flood_score IS NOT NULL").groupBy(*AREA, "flood_score").agg(F.count("*").alias("same"))
    below = running_sums(counts, AREA, ["flood_score"], F.floor(c("flood_score") * 64), {"upto": c("same")})
    ranks = below.select(*AREA, "flood_score", (c("upto") - c("same")).alias("smaller"))
    joined = rows.join(means, AREA).join(ranks, [*AREA, "flood_score"], "left")
    return joined.select(
        key,
        benchmark_percentile(c("flood_score"), c("mean")).alias("flood_percentile"),
        rnd(F.when(c("known") > 1, c("smaller") / (c("known") - 1)).otherwise(F.when(c("smaller") == 0, 0.0)), 4)
        .alias("percent_rank"),
    )


def history_page(
    reports: DataFrame, user: str, limit: int, state: str | None = None, light: str | None = None, offset: int = 0
) -> DataFrame:
    """One user's reports, newest first; the area is read from the stored JSON of the page only."""
    c = F.col
    chosen = reports.filter(c("user_id") == user)
    if state:
        chosen = chosen.filter(c("state") == state)
    if light:
        chosen = chosen.filter(c("traffic_light") == light.upper())
    page = chosen.orderBy(c("generated_at").desc(), c("report_id").desc()).offset(offset).limit(limit)
    area = F.get_json_object("report_json", "$.parcel_geometry.computed_area_ha").try_cast("double")
    return page.select(
        "report_id", "generated_at", "state", "lga", "traffic_light", "score", "persona", area.alias("computed_area_ha")
    )


def report_by_id(reports: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored reports of the wanted ids, parsed."""
    parsed = F.from_json("report_json", REPORT_JSON)
    return reports.join(wanted, "report_id", "left_semi").select(
        "report_id",
        parsed["parcel_geometry"]["computed_area_ha"].alias("computed_area_ha"),
        parsed["summary"]["traffic_light"].alias("traffic_light"),
    )


def latest_by_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Replace semantics: the newest version per key, by aggregation (no per-key sort)."""
    rest = [c for c in rows.columns if c not in key]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v"))
    return newest.select(*key, "v.*")


def data_sources(lineage: DataFrame) -> DataFrame:
    """One lineage row per report and field: the one with the smallest source id."""
    best = lineage.groupBy("report_id", "field_name").agg(
        F.min(F.struct("source_id", "source_label", "confidence_score")).alias("v")
    )
    return best.select("report_id", "field_name", "v.*")


def lineage_rows(reports: DataFrame) -> DataFrame:
    """Eight lineage rows per report; the title row takes its source from the feed."""
    c = F.col
    fields = F.array(
        *[
            F.struct(
                F.lit(name).alias("field_name"),
                F.lit(label).cast("string").alias("label"),
                F.lit(vintage).cast("string").alias("vintage"),
                F.lit(conf).alias("confidence_score"),
            )
            for name, label, vintage, conf in LINEAGE_FIELDS
        ]
    )
    rows = reports.withColumn("f", F.explode(fields))
    return rows.select(
        "report_id", "f.field_name", c("adapter_id").alias("source_adapter"),
        F.coalesce("f.label", "source_name").alias("source_label"),
        F.coalesce("f.vintage", "feed_vintage").alias("data_vintage"),
        "f.confidence_score", F.lit(False).alias("live_feed_used"), "fallback_used",
    )


def _direction(a: Column, b: Column, better: str) -> Column:
    improved = (b < a) if better == "lower" else (b > a)
    return F.when(a.isNull() | b.isNull() | (a == b), "unchanged").when(improved, "improved").otherwise("worsened")


def _level_direction(a: Column, b: Column, better: str) -> Column:
    ranks = F.create_map(*[x for k, v in RANKS.items() for x in (F.lit(k), F.lit(v))])
    ra, rb = F.try_element_at(ranks, F.upper(a)), F.try_element_at(ranks, F.upper(b))
    unknown = (a != b) & (ra.isNull() | rb.isNull())
    return F.when(a.isNull() | b.isNull(), "unchanged").when(unknown, "changed").otherwise(_direction(ra, rb, better))


# Column, the name it is reported under, kind and better direction.
COMPARED = [
    ("traffic_light", "traffic_light", "level", "lower"), ("score", "overall_risk_score", "number", "lower"),
    ("flood_risk", "flood_risk", "level", "lower"), ("terrain", "terrain_suitability", "level", "lower"),
    ("growth", "growth_potential", "level", "higher"), ("elevation_m", "elevation_m", "number", "higher"),
    ("river_m", "distance_to_river_m", "number", "higher"),
]


def compare_reports(pairs: DataFrame, reports: DataFrame) -> DataFrame:
    """Seven field deltas for each (report_id_a, report_id_b)."""
    c = F.col
    names = [n for n, *_ in COMPARED]
    side = lambda s: reports.select(
        c("report_id").alias(f"report_id_{s}"), *[c(n).alias(f"{n}_{s}") for n in [*names, "lat", "lng"]]
    )
    joined = pairs.join(side("a"), "report_id_a").join(side("b"), "report_id_b")
    same = haversine(c("lat_a"), c("lng_a"), c("lat_b"), c("lng_b")) <= SAME_PARCEL_M

    def text(kind: str, v: Column) -> Column:
        return v if kind == "level" else F.format_string("%.1f", v)

    def delta(name: str, told: str, kind: str, better: str) -> Column:
        a, b = c(f"{name}_a"), c(f"{name}_b")
        direction = _level_direction(a, b, better) if kind == "level" else _direction(a, b, better)
        return F.struct(
            F.lit(told).alias("field_name"),
            F.when(a.isNotNull(), text(kind, a)).alias("value_a"),
            F.when(b.isNotNull(), text(kind, b)).alias("value_b"),
            direction.alias("direction"),
        )

    rows = joined.select("report_id_a", "report_id_b", same.alias("parcel_match"), F.explode(F.array(*[delta(*d) for d in COMPARED])).alias("d"))
    missing = lambda v: F.coalesce(v, F.lit("None"))
    plain = F.when(
        c("direction") == "unchanged",
        F.concat("field_name", F.lit(" remained the same ("), missing(c("value_a")), F.lit(").")),
    ).otherwise(
        F.concat(
            "field_name", F.lit(" "), F.when(c("direction") == "improved", "improved").otherwise("worsened"),
            F.lit(": "), missing(c("value_a")), F.lit(" → "), missing(c("value_b")), F.lit("."),
        )
    )
    return rows.select("report_id_a", "report_id_b", "parcel_match", "d.*").withColumn("plain_english", plain)


def export_log(exports: DataFrame) -> DataFrame:
    return exports.groupBy("export_format").agg(
        F.count("*").alias("exports"), F.sum("file_size_bytes").alias("bytes"), F.max("exported_at").alias("last_exported_at")
    )


def persona_view(reports: DataFrame, personas: DataFrame) -> DataFrame:
    """Columns a persona may see; the rest are null."""
    c = F.col
    shown = reports.join(personas, "persona")
    return shown.select(
        "report_id", "label", "language", "traffic_light", "score",
        F.when(c("show_raw"), c("elevation_m")).alias("elevation_m"),
        F.when(c("show_raw"), c("river_m")).alias("river_m"),
        F.when(c("show_crs"), c("lat")).alias("lat"),
        F.when(c("show_crs"), c("lng")).alias("lng"),
        F.when(c("show_matrix"), c("terrain")).alias("terrain"),
    )


def golden_eval(expectations: DataFrame, actuals: DataFrame) -> DataFrame:
    """Check rows (case_id, field, kind, expected) against (case_id, field, actual)."""
    c = F.col
    met = expectations.join(actuals, ["case_id", "field"], "left")
    number = lambda v: c(v).try_cast("double")
    ok = (
        F.when(c("kind") == "equal", c("actual") == c("expected"))
        .when(c("kind") == "min", number("actual") >= number("expected"))
        .when(c("kind") == "max", number("actual") <= number("expected"))
        .when(c("kind") == "contains", F.contains(c("actual"), c("expected")))
    )
    return met.withColumn("passed", F.coalesce(ok, F.lit(False)))


def golden_summary(checked: DataFrame) -> DataFrame:
    per_case = checked.groupBy("case_id", "suite").agg(F.bool_and("passed").alias("passed"))
    return per_case.groupBy("suite").agg(
        F.count("*").alias("cases"), F.count_if("passed").alias("passed_cases"),
        rnd(F.count_if("passed") / F.count("*") * 100.0, 1).alias("pass_rate_pct"),
    )


def assemble_report(coord: DataFrame, risk: DataFrame, feed: DataFrame, growth: DataFrame) -> DataFrame:
    """Nested report per run from the stage tables, all keyed by run_id."""
    c = F.col
    joined = coord.join(risk, "run_id").join(feed, "run_id", "left").join(growth, "run_id", "left")
    return joined.select(
        "run_id",
        F.struct(
            "centroid_lat", "centroid_lng", "computed_area_ha", "state", F.coalesce("lga_confirmed", "lga").alias("lga")
        ).alias("parcel_geometry"),
        F.struct("flood_risk", c("proximity").alias("score"), c("river_m").alias("distance_to_river_m"), "ndwi").alias("flood_risk_metrics"),
        F.struct("elevation_m", "slope_pct", c("terrain").alias("suitability")).alias("terrain_assessment"),
        F.struct(
            F.coalesce("feed_title_status", F.lit("Not verified via live registry.")).alias("title_status"),
            "title_type", F.coalesce("source_verified", F.lit(False)).alias("source_verified"),
        ).alias("title_record"),
        F.struct("growth_potential").alias("growth"),
        "advisory_codes",
        F.struct("traffic_light", "risk_score").alias("summary"),
        "persona",
    )
