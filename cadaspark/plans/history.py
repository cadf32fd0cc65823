"""Queries and checks for feeds, history, benchmarks and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaspark.functions import rules as fr
from cadaspark.operators import feeds, history, rings, screening, spatial
from cadaspark.plans import rings as ring_plan
from cadaspark.plans import rules as rule_plan
from cadaspark.plans import spatial as spatial_plan
from cadaspark.plans.checks import _seqs, _sel, inputs, rnd, with_
from cadaspark.sources import bridge as b
from cadaspark.sources import config

c = F.col


def _feeds(spark, sf):
    return feeds.feed_normalise(b.feed_rows(spark, sf))


def normalise(spark, sf):
    return _feeds(spark, sf).withColumn("permitted_uses", F.array_join("permitted_uses", ","))


def merge(spark, sf):
    return feeds.feed_merge(_feeds(spark, sf)).withColumn("permitted_uses", F.array_join("permitted_uses", ","))


def null_feed(spark, sf):
    spots = b.parcels(spark, sf).select("parcel_id", "lat", "lng")
    return feeds.null_feed(spots, spatial.registry_match(spots, b.registry(spark, sf)))


MEASURED = [
    "parcel_id", "coalesce(state, 'other') AS state", "lga", "proximity AS flood_score",
    "CASE WHEN parcel_id % 6 = 0 THEN NULL ELSE (parcel_id * 13 % 100) / 100e0 END AS growth_score",
    "elevation_m", "confidence",
]


def _measured(spark, sf):
    return screening.with_indicators(b.parcels(spark, sf)).selectExpr(*MEASURED)


def incremental(spark, sf):
    rows = _measured(spark, sf)
    first, second = rows.filter("parcel_id % 3 > 0"), rows.filter("parcel_id % 3 = 0")
    return history.benchmark_means(history.merge_states(history.benchmark_state(first), history.benchmark_state(second)))


def latest(spark, sf):
    rows = b.reports(spark, sf).select("parcel_id", "report_id", "generated_at", "traffic_light", "score")
    return history.latest_by_key(rows, ["parcel_id"], ["generated_at", "report_id"])


def by_id(spark, sf):
    wanted = b.table(spark, sf, "events").select(c("user_id").alias("report_id")).distinct()
    return history.report_by_id(b.reports(spark, sf), wanted)


REPORT_FEED = [
    "report_id", "CASE report_id % 3 WHEN 0 THEN 'offline_raster' WHEN 1 THEN 'mock_registry' ELSE 'nlir' END AS adapter_id",
    "'feed ' || CAST(report_id % 3 AS STRING) AS source_name", "'2024' AS feed_vintage", "report_id % 7 = 0 AS fallback_used",
]


def compare(spark, sf):
    reports = b.reports(spark, sf)
    pairs = spatial.prior_report(reports).filter("prior_report_id IS NOT NULL").select(
        c("prior_report_id").alias("report_id_a"), c("report_id").alias("report_id_b")
    )
    return history.compare_reports(pairs, reports)


EXPECT = [
    "report_id AS case_id", "'suite' || CAST(report_id % 5 AS STRING) AS suite",
    "CASE seq WHEN 0 THEN 'light' WHEN 1 THEN 'score' WHEN 2 THEN 'score' ELSE 'json' END AS field",
    "CASE seq WHEN 0 THEN 'equal' WHEN 1 THEN 'min' WHEN 2 THEN 'max' ELSE 'contains' END AS kind",
    "CASE seq WHEN 0 THEN CASE WHEN report_id % 6 < 5 THEN traffic_light ELSE 'RED' END WHEN 1 THEN CAST(report_id % 20 AS STRING) "
    "WHEN 2 THEN CAST(70 + report_id % 30 AS STRING) ELSE 'computed_area_ha\":' || CAST(report_id % 3 AS STRING) END AS expected",
]


def golden(spark, sf):
    reports = b.reports(spark, sf)
    expected = reports.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(3)))).selectExpr(*EXPECT)
    actual = reports.select(
        c("report_id").alias("case_id"),
        F.explode(
            F.create_map(
                F.lit("light"), c("traffic_light"), F.lit("score"), c("score").cast("string"), F.lit("json"), c("report_json")
            )
        ).alias("field", "actual"),
    )
    return history.golden_summary(history.golden_eval(expected, actual))


def assemble(spark, sf):
    facts = rings.ring_facts(b.vertices(spark, sf)).select(
        "run_id", "centroid_lat", "centroid_lng", c("area_ha").alias("computed_area_ha")
    )
    risk = screening.with_advisories(rule_plan._risk(spark, sf)).withColumnRenamed("parcel_id", "run_id").select(
        "run_id", "state", "lga", "flood_risk", "proximity", "river_m", "ndwi", "elevation_m", "slope_pct", "terrain",
        "advisory_codes", "traffic_light", "risk_score", "persona",
    )
    merged = feeds.feed_merge(_feeds(spark, sf)).select(
        "run_id", "title_type", c("title_status").alias("feed_title_status"), "source_verified", "lga_confirmed"
    )
    growth = rule_plan.growth(spark, sf).withColumnRenamed("parcel_id", "run_id")
    report = history.assemble_report(facts, risk, merged, growth)
    return report.select(
        "run_id", "parcel_geometry.centroid_lat", "parcel_geometry.computed_area_ha", "parcel_geometry.lga",
        c("flood_risk_metrics.score").alias("flood_score"), "terrain_assessment.suitability", "title_record.title_status",
        "title_record.title_type", "title_record.source_verified", "growth.growth_potential",
        F.size("advisory_codes").alias("advisories"), "summary.traffic_light", "summary.risk_score", "persona",
    )


QUERIES = {
    "feed_normalise": normalise,
    "feed_merge": merge,
    "feed_fallback": lambda spark, sf: feeds.feed_fallback(_feeds(spark, sf)),
    "null_feed": null_feed,
    "lga_benchmark": lambda spark, sf: history.lga_benchmark(_measured(spark, sf)),
    "benchmark_rollup": lambda spark, sf: history.benchmark_rollup(_measured(spark, sf)),
    "benchmark_incremental": incremental,
    "benchmark_percentile": lambda spark, sf: history.percentile(_measured(spark, sf), "parcel_id"),
    "history_page": lambda spark, sf: history.history_page(b.reports(spark, sf), "u6", limit=50, light="green", offset=5),
    "report_by_id": by_id,
    "latest_report": latest,
    "data_sources": lambda spark, sf: history.data_sources(b.lineage(spark, sf)),
    "lineage_rows": lambda spark, sf: history.lineage_rows(b.reports(spark, sf).selectExpr(*REPORT_FEED)),
    "compare_reports": compare,
    "assemble_report": assemble,
    "export_log": lambda spark, sf: history.export_log(b.exports(spark, sf)),
    "persona_view": lambda spark, sf: history.persona_view(b.reports(spark, sf), config.personas(spark)),
    "golden_eval": golden,
}

FEED = {
    "f0": _sel(b.FEEDS, _seqs(_sel(b.PARCEL_BASE, "customer"), 4)),
    "fd": """SELECT run_id, adapter_id, status, priority, CASE WHEN live THEN title_type IS NOT NULL END AS title_exists,
      CASE WHEN live AND tt IN ('C_OF_O','DEED','CUSTOMARY','UNKNOWN') THEN tt END AS title_type, CASE WHEN live THEN title_number END AS title_number,
      CASE WHEN live AND ts IN ('ACTIVE','DISPUTED','REVOKED','UNKNOWN') THEN ts END AS title_status, CASE WHEN live THEN acquisition_flag END AS acquisition_flag,
      CASE WHEN live THEN zoning_class END AS zoning_class, CASE WHEN live THEN permitted_text END AS permitted_uses, CASE WHEN live THEN lga_confirmed END AS lga_confirmed,
      live AS source_verified, CASE WHEN status<>'ok' THEN 0e0 WHEN adapter_id='offline_raster' THEN 0.85e0 WHEN adapter_id='mock_registry' THEN 0.7e0 ELSE 0.9e0 END AS feed_confidence
      FROM (SELECT *, status='ok' AND adapter_id<>'offline_raster' AS live, CASE WHEN priority>=2 THEN upper(title_type) ELSE title_type END AS tt,
       CASE WHEN priority>=2 THEN upper(title_status) ELSE title_status END AS ts FROM f0)""",
}
_last = lambda f, extra="": f"arg_max({f}, priority) FILTER (status='ok' AND {f} IS NOT NULL{extra}) AS {f}"
FEED["fm"] = (
    "SELECT run_id, arg_max(adapter_id, priority) FILTER (status='ok') AS adapter_id, arg_max(feed_confidence, priority) FILTER (status='ok') AS feed_confidence, "
    "bool_or(source_verified) AS source_verified, bool_or(status NOT IN ('ok','no_record')) AS fallback_used, "
    + ", ".join(_last(f, " AND permitted_uses<>''" if f == "permitted_uses" else "") for f in feeds.FIELDS)
    + " FROM fd GROUP BY run_id"
)
MEAS = {**rule_plan._ind_sql, "ms": _sel(MEASURED, "ind")}
_bench = "SELECT state, lga, count(*) AS report_count, " + ", ".join(
    f"{rnd(f'sum({m})/count(*)', 4)} AS avg_{m}, {rnd(f'avg({m})', 4)} AS plain_{m}" for m in history.MEASURES
) + " FROM ms GROUP BY state, lga"
_rollup = _bench.replace("SELECT state, lga,", "SELECT state, lga, GROUPING(state, lga) AS level,").replace("GROUP BY state, lga", "GROUP BY ROLLUP (state, lga)")
_prior_sql = spatial_plan.CHECKS["prior_report"]
_rank = lambda v: f"CASE upper({v}) WHEN 'GREEN' THEN 1 WHEN 'AMBER' THEN 2 WHEN 'RED' THEN 3 WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'SUITABLE' THEN 1 WHEN 'MARGINAL' THEN 2 WHEN 'UNSUITABLE' THEN 3 END"


# What the comparison reports, written out here and not taken from the code under test.
_DELTAS = [
    ("traffic_light", "traffic_light", "level", "lower"), ("score", "overall_risk_score", "number", "lower"),
    ("flood_risk", "flood_risk", "level", "lower"), ("terrain", "terrain_suitability", "level", "lower"),
    ("growth", "growth_potential", "level", "higher"), ("elevation_m", "elevation_m", "number", "higher"),
    ("river_m", "distance_to_river_m", "number", "higher"),
]


def _delta(name: str, told: str, kind: str, better: str) -> str:
    a, z = f"a.{name}", f"z.{name}"
    x, y = (a, z) if kind == "number" else (_rank(a), _rank(z))
    op = "<" if better == "lower" else ">"
    changed = f"WHEN {a}<>{z} AND ({x} IS NULL OR {y} IS NULL) THEN 'changed' " if kind == "level" else ""
    d = f"CASE WHEN {a} IS NULL OR {z} IS NULL THEN 'unchanged' {changed}WHEN {x}={y} OR {a}={z} THEN 'unchanged' WHEN {y}{op}{x} THEN 'improved' ELSE 'worsened' END"
    t = lambda v: f"printf('%.1f', {v})" if kind == "number" else v
    return (
        f"SELECT a.report_id AS report_id_a, z.report_id AS report_id_b, parcel_match, '{told}' AS field_name, {t(a)} AS value_a, {t(z)} AS value_b, {d} AS direction "
        "FROM pq JOIN rep a ON a.report_id=pq.a JOIN rep z ON z.report_id=pq.z"
    )


CHECKS = {
    "feed_normalise": with_(FEED, "SELECT * FROM fd"),
    "feed_merge": with_(FEED, "SELECT * FROM fm"),
    "feed_fallback": with_(FEED, "SELECT run_id, bool_or(status NOT IN ('ok','no_record')) AS fallback_used, count(*) FILTER (status NOT IN ('ok','no_record')) AS failed_sources FROM fd GROUP BY run_id"),
    "null_feed": f"WITH m AS ({spatial_plan.CHECKS['registry_match']}) SELECT parcel_id, record_id AS title_number, CASE WHEN record_id IS NULL THEN 'No registry data available' ELSE 'Mock Registry (local JSON)' END AS source_name, record_id IS NOT NULL AS feed_active, CASE WHEN record_id IS NULL THEN 0e0 ELSE 0.7e0 END AS feed_confidence, record_id IS NOT NULL AS source_verified FROM m",
    "lga_benchmark": with_(MEAS, _bench),
    "benchmark_rollup": with_(MEAS, _rollup),
    "benchmark_incremental": with_(MEAS, _bench),
    "benchmark_percentile": with_({**MEAS, "mm": "SELECT state, lga, sum(flood_score)/count(*) AS mean FROM ms GROUP BY ALL"},
      f"SELECT parcel_id, CASE WHEN mean<>0 THEN {rnd('least(greatest(flood_score/(mean*2)*100e0,0e0),99e0)', 1)} END AS flood_percentile, {rnd('percent_rank() OVER (PARTITION BY state, lga ORDER BY flood_score)', 4)} AS percent_rank FROM ms JOIN mm USING (state, lga)"),
    "history_page": with_(["rep"], "SELECT report_id, generated_at, state, lga, traffic_light, score, persona, CAST(json_extract(report_json, '$.parcel_geometry.computed_area_ha') AS DOUBLE) AS computed_area_ha FROM rep WHERE user_id='u6' AND traffic_light='GREEN' ORDER BY generated_at DESC, report_id DESC LIMIT 50 OFFSET 5"),
    "report_by_id": with_(["rep"], "SELECT report_id, CAST(json_extract(report_json, '$.parcel_geometry.computed_area_ha') AS DOUBLE) AS computed_area_ha, json_extract_string(report_json, '$.summary.traffic_light') AS traffic_light FROM rep WHERE report_id IN (SELECT user_id FROM events)"),
    "latest_report": with_(["rep"], "SELECT parcel_id, report_id, generated_at, traffic_light, score FROM rep QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY generated_at DESC, report_id DESC)=1"),
    "data_sources": f"WITH l AS ({_sel(b.LINEAGE, 'lineitem')}) SELECT report_id, field_name, source_id, source_label, confidence_score FROM l QUALIFY row_number() OVER (PARTITION BY report_id, field_name ORDER BY source_id, source_label, confidence_score)=1",
    "lineage_rows": with_({**inputs("rep"), "rf": _sel(REPORT_FEED, "rep"), "d": "SELECT * FROM (VALUES " + ", ".join(
        "(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}e0" for v in row) + ")" for row in config.LINEAGE_FIELDS) + ") t(field_name,label,vintage,confidence_score)"},
      "SELECT report_id, field_name, adapter_id AS source_adapter, coalesce(label, source_name) AS source_label, coalesce(vintage, feed_vintage) AS data_vintage, confidence_score, false AS live_feed_used, fallback_used FROM rf CROSS JOIN d"),
    "compare_reports": with_({**inputs("rep"), "pr": _prior_sql, "pq": "SELECT prior_report_id AS a, report_id AS z, true AS parcel_match FROM pr WHERE prior_report_id IS NOT NULL",
      "dl": " UNION ALL ".join(_delta(*x) for x in _DELTAS)},
      """SELECT *, CASE WHEN direction='unchanged' THEN field_name || ' remained the same (' || coalesce(value_a,'None') || ').'
        ELSE field_name || ' ' || CASE WHEN direction='improved' THEN 'improved' ELSE 'worsened' END || ': ' || coalesce(value_a,'None') || ' → ' || coalesce(value_b,'None') || '.' END AS plain_english FROM dl"""),
    "assemble_report": with_({**ring_plan.FACTS, **rule_plan.CHAIN, **FEED, "ad": rule_plan._adv_union, "gr": f"SELECT * FROM ({rule_plan.CHECKS['growth_potential']})"},
      """SELECT facts.run_id, centroid_lat, facts.area_ha AS computed_area_ha, coalesce(fm.lga_confirmed, risk.lga) AS lga, proximity AS flood_score, terrain AS suitability,
       coalesce(fm.title_status,'Not verified via live registry.') AS title_status, fm.title_type, coalesce(fm.source_verified,false) AS source_verified, growth_potential,
       CAST((SELECT count(*) FROM ad WHERE ad.parcel_id=facts.run_id) AS INT) AS advisories, traffic_light, risk_score, persona
       FROM facts JOIN risk ON risk.parcel_id=facts.run_id LEFT JOIN fm ON fm.run_id=facts.run_id LEFT JOIN gr ON gr.parcel_id=facts.run_id"""),
    "export_log": f"WITH x AS ({_sel(b.EXPORTS, 'lineitem')}) SELECT export_format, count(*) AS exports, CAST(sum(file_size_bytes) AS BIGINT) AS bytes, max(exported_at) AS last_exported_at FROM x GROUP BY 1",
    "persona_view": with_({**inputs("rep"), "pe": "SELECT * FROM (VALUES " + ", ".join(
        "(" + ", ".join(str(v).lower() if isinstance(v, bool) else f"'{v}'" for v in row) + ")" for row in config.PERSONAS) + ") t(persona,label,r,k,i,m,language)"},
      "SELECT report_id, label, language, traffic_light, score, CASE WHEN r THEN elevation_m END AS elevation_m, CASE WHEN r THEN river_m END AS river_m, CASE WHEN k THEN lat END AS lat, CASE WHEN k THEN lng END AS lng, CASE WHEN m THEN terrain END AS terrain FROM rep JOIN pe USING (persona)"),
    "golden_eval": with_({**inputs("rep"), "ex": _sel([*EXPECT, "traffic_light", "score", "report_json"], "(SELECT *, unnest(range(4)) AS seq FROM rep)"),
      "ck": "SELECT case_id, suite, bool_and(CASE kind WHEN 'equal' THEN traffic_light=expected WHEN 'min' THEN score>=CAST(expected AS DOUBLE) WHEN 'max' THEN score<=CAST(expected AS DOUBLE) ELSE contains(report_json, expected) END) AS ok FROM (SELECT *, CASE WHEN kind IN ('min','max') THEN expected END FROM ex) GROUP BY ALL"},
      f"SELECT suite, count(*) AS cases, count(*) FILTER (ok) AS passed_cases, {rnd('count(*) FILTER (ok)/count(*)*100e0', 1)} AS pass_rate_pct FROM ck GROUP BY suite"),
}
