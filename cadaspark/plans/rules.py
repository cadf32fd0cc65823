"""Queries and checks for the rule engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaspark.functions import rules, units
from cadaspark.operators import screening as s
from cadaspark.plans.checks import fixed, inputs, rnd, state_case, with_
from cadaspark.sources import bridge


def _ind(spark, sf):
    return s.with_indicators(bridge.parcels(spark, sf))


def _risk(spark, sf):
    return s.with_risk(_ind(spark, sf))


def _pick(builder, *cols):
    return lambda spark, sf: builder(spark, sf).select("parcel_id", *cols)


def urban_expansion(spark, sf):
    c = F.col
    return bridge.parcels(spark, sf).select(
        "parcel_id", rules.urban_expansion(c("n1"), c("n5"), c("n10")).alias("urban_expansion")
    )


def growth(spark, sf):
    c = F.col
    expansion = F.when(c("parcel_id") % 8 != 0, rules.urban_expansion(c("n1"), c("n5"), c("n10")))
    return _risk(spark, sf).select(
        "parcel_id",
        rules.growth_potential(expansion, c("road_m") / 1000.0, c("airport_km"), c("flood_risk"), c("terrain")).alias(
            "growth_potential"
        ),
    )


def development(spark, sf):
    risk = _risk(spark, sf)
    c = F.col
    matrix = rules.development_matrix(c("flood_risk"), c("terrain"), c("ndwi"), c("encroached"), c("acquisition_flag"))
    return risk.select("parcel_id", *[v.alias(k) for k, v in matrix.items()])


def low_data_fields(spark, sf):
    # The bridge keeps few parcels under 50, so the check runs at 70 as well.
    risk = _risk(spark, sf)
    c = s.rule_columns(risk)
    return risk.select(
        "parcel_id",
        F.array_join(rules.null_fields(c), ",").alias("null_fields"),
        F.array_join(rules.null_fields(c, 70.0), ",").alias("null_fields_70"),
        (F.col("confidence") < 50).alias("low_overall"),
    )


def flood_proximity(spark, sf):
    return _ind(spark, sf).select("parcel_id", "proximity")


QUERIES = {
    "terrain_difficulty": _pick(_ind, "terrain_difficulty"),
    "road_access": _pick(_ind, "road_access"),
    "flood_proximity": flood_proximity,
    "data_confidence": _pick(_ind, "confidence"),
    "encroachment": _pick(_ind, "encroached"),
    "flood_risk": _pick(_risk, "flood_risk", "flood_reason", "flood_confidence"),
    "terrain_suitability": _pick(_risk, "terrain"),
    "development_matrix": development,
    "traffic_light": _pick(_risk, "base_light"),
    "drainage_block": _pick(_risk, "drainage_block", "drainage_conflict", "traffic_light"),
    "risk_score": _pick(_risk, "risk_score"),
    "advisory_flags": lambda spark, sf: s.advisory_rows(_risk(spark, sf)).select("parcel_id", "pos", "code"),
    "due_diligence": lambda spark, sf: s.due_diligence(_risk(spark, sf)),
    "low_data_fields": low_data_fields,
    "urban_expansion": urban_expansion,
    "growth_potential": growth,
    "plot_units": lambda spark, sf: s.plot_units(bridge.parcels(spark, sf)).select(
        "parcel_id", "sqm", "plots", "plot_sqm_std", "plot_label", "ha", "display_simple", "display_expert",
        "display_plots_only",
    ),
    "screening_summary": lambda spark, sf: s.screening_summary(_risk(spark, sf)),
}

_ELEV = "CASE WHEN elevation_m<=5 THEN 1e0 WHEN elevation_m>=50 THEN 0e0 ELSE 1e0-(elevation_m-5e0)/45e0 END"
_RIV = "CASE WHEN river_m<=100 THEN 1e0 WHEN river_m>=2000 THEN 0e0 ELSE 1e0-(river_m-100e0)/1900e0 END"
_WET = "CASE WHEN ndwi>=0.3e0 THEN 1e0 WHEN ndwi<=-0.1e0 THEN 0e0 ELSE (ndwi+0.1e0)/0.4e0 END"
_SLP = "CASE WHEN slope_pct<2 THEN 0.3e0 WHEN slope_pct<8 THEN 0.15e0 ELSE 0.5e0 END"
_PARTS = [("elevation_m", "0.35e0", _ELEV), ("river_m", "0.35e0", _RIV), ("ndwi", "0.2e0", _WET), ("slope_pct", "0.1e0", _SLP)]
_SUM = " + ".join(f"CASE WHEN {n} IS NULL THEN 0e0 ELSE {w}*({x}) END" for n, w, x in _PARTS)
_WT = " + ".join(f"CASE WHEN {n} IS NULL THEN 0e0 ELSE {w} END" for n, w, _ in _PARTS)

IND = f"""
SELECT *, {state_case('lat', 'lng')} AS state,
  CASE WHEN ({_WT})=0 THEN 0.5e0 ELSE {rnd(f'least(greatest(({_SUM})/({_WT}),0e0),1e0)', 4)} END AS proximity,
  greatest(100e0 - CASE WHEN elevation_m IS NULL THEN 20 ELSE 0 END - CASE WHEN slope_pct IS NULL THEN 10 ELSE 0 END
   - CASE WHEN river_m IS NULL THEN 20 ELSE 0 END - CASE WHEN road_m IS NULL THEN 10 ELSE 0 END
   - CASE WHEN ndwi IS NULL OR ndvi IS NULL THEN 15 ELSE 0 END - CASE WHEN out_of_zone THEN 5 ELSE 0 END, 0e0) AS confidence,
  ndvi < 0.05e0 AS encroached
FROM p"""

_H = [
    ("elevation_m<5", f"'Elevation ' || {fixed('elevation_m', 1)} || 'm is below 5m.'"),
    ("river_m<100", f"'River at ' || {fixed('river_m', 0)} || 'm is within 100m.'"),
    ("ndwi>0.3e0", f"'Water index ' || {fixed('ndwi', 2)} || ' is above 0.30.'"),
    ("strahler>=5 AND river_m<500", f"'Major river (order ' || strahler || ') at ' || {fixed('river_m', 0)} || 'm.'"),
    ("proximity>=0.75e0", f"'Combined flood score ' || {fixed('proximity', 2)} || ' is very high.'"),
]
_M = [
    ("elevation_m>=5 AND elevation_m<15", f"'Elevation ' || {fixed('elevation_m', 1)} || 'm is moderate.'"),
    ("river_m>=100 AND river_m<500", f"'River at ' || {fixed('river_m', 0)} || 'm is within 500m.'"),
    ("ndwi>=0 AND ndwi<=0.3e0", f"'Water index ' || {fixed('ndwi', 2)} || ' shows moist soil.'"),
    ("proximity>=0.4e0 AND proximity<0.75e0", f"'Combined flood score ' || {fixed('proximity', 2)} || ' is moderate.'"),
    ("slope_pct<1.5e0", "'Slope below 1.5% drains poorly.'"),
]


def _count(rs):
    return "+".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _ in rs)


def _case(rs):
    return "CASE " + " ".join(f"WHEN {c} THEN {t}" for c, t in rs) + " END"


def _more(n, tag):
    return f"CASE WHEN {n}>1 THEN ' (' || ({n}-1) || ' more {tag} factors.)' ELSE '' END"


FLOOD = f"""
SELECT *, CASE WHEN nh>0 THEN 'HIGH' WHEN nm>0 THEN 'MEDIUM' ELSE 'LOW' END AS flood_risk,
 CASE WHEN nh>0 THEN {_case(_H)} || {_more('nh', 'HIGH')} WHEN nm>0 THEN {_case(_M)} || {_more('nm', 'MEDIUM')}
  WHEN elevation_m IS NULL AND river_m IS NULL AND ndwi IS NULL THEN 'Insufficient data, treat as LOW with caution.'
  ELSE 'Low flood indicators: ' || concat_ws(', ', 'elevation ' || {fixed('elevation_m', 1)} || 'm',
    'river ' || {fixed('river_m', 0)} || 'm', 'water index ' || {fixed('ndwi', 2)}) || '.' END AS flood_reason,
 CASE WHEN nh>0 THEN CASE WHEN elevation_m IS NULL OR river_m IS NULL THEN 65e0 ELSE 85e0 END
  WHEN nm>0 THEN CASE WHEN elevation_m IS NULL OR river_m IS NULL THEN 60e0 ELSE 85e0 END
  WHEN elevation_m IS NULL AND river_m IS NULL AND ndwi IS NULL THEN 50e0 ELSE 85e0 END AS flood_confidence
FROM (SELECT *, {_count(_H)} AS nh, {_count(_M)} AS nm FROM ind)"""

RISK = f"""
SELECT *, CASE WHEN drainage_block THEN 'RED' ELSE base_light END AS traffic_light,
 coalesce(NOT drainage_block, false) AND NOT outfall_connected AS drainage_conflict,
 {rnd("least(greatest(CASE WHEN confidence<50 THEN base + (50e0-confidence)/50e0*(50e0-base)*0.3e0 ELSE base END,0e0),100e0)", 1)} AS risk_score
FROM (SELECT *, outfall_m > lowest_m AS drainage_block,
 CASE WHEN flood_risk='HIGH' OR terrain='UNSUITABLE' OR acquisition_flag OR coalesce(upper(title_status) IN ('REVOKED','DISPUTED'),false) THEN 'RED'
  WHEN flood_risk='MEDIUM' OR terrain='MARGINAL' THEN 'AMBER' ELSE 'GREEN' END AS base_light,
 CASE flood_risk WHEN 'HIGH' THEN 40e0 WHEN 'MEDIUM' THEN 22e0 ELSE 5e0 END
 + CASE terrain WHEN 'UNSUITABLE' THEN 25e0 WHEN 'MARGINAL' THEN 14e0 ELSE 3e0 END + proximity*20e0
 + CASE WHEN acquisition_flag THEN 10e0 ELSE 0e0 END + CASE WHEN encroached THEN 5e0 ELSE 0e0 END AS base
 FROM (SELECT *, CASE WHEN flood_risk='HIGH' OR elevation_m<3 OR slope_pct>30 OR ndwi>0.3e0 THEN 'UNSUITABLE'
   WHEN elevation_m<5 OR slope_pct>15 THEN 'MARGINAL' ELSE 'SUITABLE' END AS terrain FROM fl))"""

CHAIN = {**inputs("p"), "ind": IND, "fl": FLOOD, "risk": RISK}
_ind_sql = {k: CHAIN[k] for k in ("p", "ind")}

_ADV = [
    ("FLOOD_HIGH", "flood_risk='HIGH'"), ("FLOOD_MODERATE", "flood_risk='MEDIUM'"), ("LOW_ELEVATION", "elevation_m<5"),
    ("RIVER_PROXIMITY", "river_m<200"), ("WATER_SIGNAL", "ndwi>0.2e0"),
    ("FLOOD_BASIN", "terrain='UNSUITABLE' AND coalesce(elevation_m<3 OR ndwi>0.3e0,false)"),
    ("TERRAIN_UNSUITABLE", "terrain='UNSUITABLE' AND NOT coalesce(elevation_m<3 OR ndwi>0.3e0,false)"),
    ("ENCROACHMENT", "encroached"), ("ACQUISITION", "acquisition_flag"), ("TITLE_UNVERIFIED", "NOT title_verified"),
    ("MINNA_DATUM", "minna"), ("LIMITED_SATELLITE", "out_of_zone"), ("LOW_CONFIDENCE", "confidence<50"),
    ("LOW_CONFIDENCE_FIELDS", "confidence<50"), ("DRAINAGE_CONFLICT", "drainage_conflict"),
    ("DRAINAGE_BLOCKED", "NOT drainage_conflict AND drainage_block"),
    ("DRAINAGE_NATURAL", "NOT drainage_conflict AND NOT drainage_block AND outfall_connected"),
    ("VERIFY_OUTFALL", "coalesce(elevation_m<3,false) OR coalesce(drainage_block,false)"),
]
_DD = [
    ("CRITICAL", "TITLE_SEARCH", "true"), ("CRITICAL", "ACQUISITION_CLEARANCE", "acquisition_flag"),
    ("CRITICAL", "HYDROLOGY_STUDY", "flood_risk='HIGH'"), ("HIGH", "SOIL_INVESTIGATION", "terrain='UNSUITABLE'"),
    ("HIGH", "CONFIRM_PEGS", "NOT title_verified"), ("HIGH", "RIVER_SETBACK", "river_m<500"),
    ("HIGH", "FRESH_SURVEY", "encroached"), ("MEDIUM", "WET_SEASON_VISIT", "flood_risk='MEDIUM'"),
    ("MEDIUM", "PLANNING_APPROVAL", "true"), ("LOW", "COURT_SEARCH", "true"),
]
_adv_union = " UNION ALL ".join(f"SELECT parcel_id, {i} AS ord, '{c}' AS code FROM risk WHERE {w}" for i, (c, w) in enumerate(_ADV))
_dd_union = " UNION ALL ".join(
    f"SELECT parcel_id, {i} AS ord, '{p}' AS priority, '{a}' AS action FROM risk WHERE {w}" for i, (p, a, w) in enumerate(_DD)
)
_GROW = "coalesce(road_m/1000e0 < 2 AND airport_km < 50, false)"
_UE = rnd("0.5e0*least(n1/200e0,1e0)+0.3e0*least(n5/1000e0,1e0)+0.2e0*least(n10/5000e0,1e0)", 4)
_plots = ", ".join(f"('{k.lower()}','{k}',{v!r}e0)" for k, v in units.PLOT_SQM.items())
_nulls = lambda t: "concat_ws(',', " + ", ".join(
    f"CASE WHEN confidence<{t} AND {n} IS NULL THEN '{told}' END"
    for n, told in (("elevation_m", "elevation_m"), ("river_m", "distance_to_river_m"), ("ndwi", "ndwi"), ("ndvi", "ndvi"), ("road_m", "distance_to_road_m"))
) + ")"
_thousands = "regexp_replace(CAST(CAST(sqm AS BIGINT) AS VARCHAR), '(\\d)(\\d{3})$', '\\1,\\2')"

CHECKS = {
    "terrain_difficulty": with_(["p"], "SELECT parcel_id, CASE WHEN slope_pct IS NULL OR slope_pct<5 THEN 'flat' WHEN slope_pct<15 THEN 'gentle' ELSE 'steep' END AS terrain_difficulty FROM p"),
    "road_access": with_(["p"], "SELECT parcel_id, CASE WHEN road_m<=200 THEN 'Excellent' WHEN road_m<=600 THEN 'Good' WHEN road_m<=1500 THEN 'Fair' ELSE 'Poor' END AS road_access FROM p"),
    "flood_proximity": with_(_ind_sql, "SELECT parcel_id, proximity FROM ind"),
    "data_confidence": with_(_ind_sql, "SELECT parcel_id, confidence FROM ind"),
    "encroachment": with_(_ind_sql, "SELECT parcel_id, encroached FROM ind"),
    "flood_risk": with_(CHAIN, "SELECT parcel_id, flood_risk, flood_reason, flood_confidence FROM risk"),
    "terrain_suitability": with_(CHAIN, "SELECT parcel_id, terrain FROM risk"),
    "development_matrix": with_(CHAIN, """SELECT parcel_id,
      terrain='SUITABLE' AND flood_risk IN ('LOW','MEDIUM') AND NOT coalesce(acquisition_flag,false) AS residential,
      terrain='SUITABLE' AND flood_risk='LOW' AND NOT coalesce(acquisition_flag,false) AS commercial,
      NOT coalesce(encroached,false) AND terrain<>'UNSUITABLE' AND NOT coalesce(acquisition_flag,false) AND (ndwi IS NULL OR ndwi<0.4e0) AS agricultural,
      terrain='SUITABLE' AND flood_risk='LOW' AND NOT coalesce(acquisition_flag,false) AND NOT coalesce(encroached,false) AS industrial FROM risk"""),
    "traffic_light": with_(CHAIN, "SELECT parcel_id, base_light FROM risk"),
    "drainage_block": with_(CHAIN, "SELECT parcel_id, drainage_block, drainage_conflict, traffic_light FROM risk"),
    "risk_score": with_(CHAIN, "SELECT parcel_id, risk_score FROM risk"),
    "advisory_flags": with_({**CHAIN, "adv": _adv_union}, "SELECT parcel_id, CAST(row_number() OVER (PARTITION BY parcel_id ORDER BY ord) - 1 AS INT) AS pos, code FROM adv"),
    "due_diligence": with_({**CHAIN, "dd": _dd_union}, """SELECT parcel_id, CAST(row_number() OVER (PARTITION BY parcel_id ORDER BY
      CASE priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, ord) AS INT) AS rank, priority, action FROM dd"""),
    "low_data_fields": with_(CHAIN, f"SELECT parcel_id, {_nulls(50)} AS null_fields, {_nulls(70)} AS null_fields_70, confidence<50 AS low_overall FROM risk"),
    "urban_expansion": with_(["p"], f"SELECT parcel_id, {_UE} AS urban_expansion FROM p"),
    "growth_potential": with_(CHAIN, f"""SELECT parcel_id, CASE
      WHEN ue IS NULL THEN CASE WHEN coalesce(airport_km<30 AND road_m/1000e0<2,false) THEN 'MEDIUM' ELSE 'LOW' END
      WHEN flood_risk='HIGH' OR terrain='UNSUITABLE' THEN CASE WHEN ue>0.55e0 THEN 'MEDIUM' ELSE 'LOW' END
      WHEN ue>0.55e0 AND {_GROW} THEN 'HIGH' WHEN ue>0.25e0 OR {_GROW} THEN 'MEDIUM' ELSE 'LOW' END AS growth_potential
      FROM (SELECT *, CASE WHEN parcel_id%8<>0 THEN {_UE} END AS ue FROM risk)"""),
    "plot_units": with_({**inputs("p"), "sizes": f"SELECT * FROM (VALUES {_plots}) t(k,label,size)",
      "m": "SELECT parcel_id, area_ha, floor(area_ha*10000e0+0.5e0) AS sqm, area_ha*10000e0/coalesce(size,648e0) AS plots, coalesce(size,648e0) AS size, coalesce(label,'Std.') AS label FROM p LEFT JOIN sizes ON k = lower(replace(replace(replace(trim(state_text),' State',''),'-',' '),'_',' '))"},
      f"""SELECT parcel_id, CAST(sqm AS BIGINT) AS sqm, {rnd('plots', 1)} AS plots, size AS plot_sqm_std, label AS plot_label, {rnd('area_ha', 4)} AS ha,
      {_thousands} || ' sqm  ·  ≈ ' || {fixed('plots', 1)} || ' plots  ·  ' || {fixed('area_ha', 2)} || ' ha' AS display_simple,
      {_thousands} || ' sqm  ·  ≈ ' || {fixed('plots', 1)} || ' plots ' || CASE WHEN label='Std.' THEN '(Std.)' ELSE '(' || label || ' std.)' END || '  ·  ' || {fixed('area_ha', 4)} || ' ha' AS display_expert,
      '≈ ' || {fixed('plots', 1)} || ' plots' AS display_plots_only FROM m"""),
    "screening_summary": with_(CHAIN, "SELECT coalesce(state,'other') AS state, traffic_light, count(*) AS parcels, CAST(sum(floor(risk_score*10+0.5e0)) AS BIGINT) AS score_tenths FROM risk GROUP BY 1,2"),
}
