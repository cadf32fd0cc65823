"""Queries and checks for text extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaspark.functions import parsing as p
from cadaspark.functions.numeric import rnd as crnd
from cadaspark.operators import cadastral
from cadaspark.operators import extract as x
from cadaspark.plans.checks import _sel, rnd, with_
from cadaspark.sources import bridge as b

c = F.col


def _fmt(name):
    return lambda spark, sf: x.parse_format(b.surveys(spark, sf), name).select(
        "run_id", "seq", crnd(c("p1"), 6).alias("p1"), crnd(c("p2"), 6).alias("p2")
    )


NUMERALS = [
    "l_orderkey * 10 + l_linenumber AS id", "l_partkey AS pk",
    "CASE l_partkey % 9 WHEN 0 THEN CAST(100000 + l_partkey AS STRING) || '-' || CAST(100 + l_suppkey AS STRING) "
    "WHEN 1 THEN '1,' || lpad(CAST(l_partkey % 1000 AS STRING), 3, '0') || ',' || lpad(CAST(l_suppkey % 1000 AS STRING), 3, '0') "
    "WHEN 2 THEN CAST(500 + l_partkey % 400 AS STRING) || ' ' || CAST(100 + l_suppkey % 800 AS STRING) || '.25' "
    "WHEN 3 THEN CAST(100000 + l_partkey AS STRING) || ',' || CAST(l_suppkey % 90 + 10 AS STRING) "
    "WHEN 4 THEN CAST(100000 + l_partkey AS STRING) || ',254' WHEN 5 THEN 'n/a' WHEN 6 THEN '' WHEN 7 THEN '12.5.6' "
    "ELSE '  -' || CAST(l_partkey AS STRING) || '.5 ' END AS raw",
]


def numerals(spark, sf):
    rows = b.table(spark, sf, "lineitem").selectExpr(*NUMERALS)
    return rows.groupBy("raw").agg(F.count("*").alias("uses")).select("raw", "uses", p.cleanse_numeric(c("raw")).alias("value"))


def thousands(spark, sf):
    rows = b.surveys(spark, sf).select("run_id", p.strip_thousands(c("raw_text")).alias("t"))
    return rows.select("run_id", F.md5("t").alias("digest"), F.length("t").alias("chars"))


def auto(spark, sf):
    out = x.parse_auto(b.surveys(spark, sf))
    return out.select("run_id", "fmt", "seq", crnd(c("p1"), 6).alias("p1"), crnd(c("p2"), 6).alias("p2"))


def stations(spark, sf):
    return x.scan_station_table(b.surveys(spark, sf))


def legs(spark, sf):
    out = x.scan_traverse_legs(b.surveys(spark, sf))
    return out.withColumn("bearing_dd", crnd(c("bearing_dd"), 6))


def quadrant(spark, sf):
    """Every leg of the order lines as a quadrant bearing."""
    rows = b.table(spark, sf, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), "l_partkey",
        F.element_at(F.array(*[F.lit(v) for v in ("N", "S", "s", "n", "")]), (c("l_suppkey") % 5 + 1).cast("int")).alias("d1"),
        F.element_at(F.array(*[F.lit(v) for v in ("E", "W", "e")]), (c("l_partkey") % 3 + 1).cast("int")).alias("d2"),
    )
    dd = p.bearing_to_dd(c("d1"), (c("l_partkey") % 90).cast("double"), F.when(c("d1") != "", c("d2")).otherwise(""))
    return rows.select("id", "l_partkey", dd.alias("bearing_dd"))


def datum(spark, sf):
    cols = p.detect_datum(c("raw_text"))
    return b.surveys(spark, sf).select("run_id", *[v.alias(k) for k, v in cols.items()])


def track(spark, sf):
    s = b.surveys(spark, sf)
    return x.route_track(s, x.scan_station_table(s), x.scan_traverse_legs(s))


_mm = lambda v: f"CAST({v} AS STRING) || '.5'"
PLANS = [
    "parcel_id AS run_id",
    "CASE WHEN parcel_id % 3 = 0 THEN '{\"selected_processing_track\":\"TRACK_A\",\"plan_metadata\":{\"datum\":\"MINNA\",\"stated_area_sqm\":' || CAST(400 + parcel_id AS STRING) || "
    "'},\"parsed_data\":{\"ledger_stations\":[{\"station_id\":\"BP' || CAST(parcel_id AS STRING) || '\",\"easting\":' || " + _mm("e0") + " || ',\"northing\":' || " + _mm("n0") + " || "
    "'},{\"easting\":' || " + _mm("e0 + 10") + " || ',\"northing\":' || " + _mm("n0") + " || '},{\"station_id\":\"X\"}]},\"raw_coordinates\":[[' || " + _mm("e0") + " || ',' || " + _mm("n0") + " || '],[1]]}' "
    "WHEN parcel_id % 3 = 1 THEN '{\"datum\":\"WGS84\",\"anchor_point_resolution\":{\"anchor_station_id\":\"A' || CAST(parcel_id AS STRING) || '\"},\"reference_grid\":{\"easting\":' || " + _mm("e0") + " || ',\"northing\":' || " + _mm("n0") + " || "
    "'},\"parsed_data\":{\"traverse_legs\":[{\"from_station\":\"A\",\"to_station\":\"B\",\"bearing_dms\":\"45 10\",\"distance_meters\":' || " + _mm("20 + parcel_id % 50") + " || '},{\"bearing\":\"90 00\",\"distance_m\":12}]}}' "
    "ELSE '{\"origin\":{\"easting\":' || " + _mm("e0") + " || ',\"northing\":' || " + _mm("n0") + " || '},\"legs\":[{\"bearing\":\"10 20\",\"distance_m\":' || " + _mm("parcel_id % 70") + " || '}],\"boundaries\":[{\"bearing\":\"\",\"distance_m\":5},{\"bearing\":\"7 8\",\"distance_m\":9,\"to_easting\":' || " + _mm("e0") + " || ',\"to_northing\":' || " + _mm("n0") + " || '}]}' END AS plan_json",
]


def vision(spark, sf):
    return x.vision_json_to_lines(b.parcel_base(spark, sf).selectExpr(*b.SURVEY_BASE).selectExpr(*PLANS))


def plan_ledger(spark, sf):
    ledger, _ = cadastral.cadastral_plan(b.surveys(spark, sf))
    return ledger.select("run_id", "seq", "station_id", crnd(c("e"), 2).alias("e"), crnd(c("n"), 2).alias("n"), "adjustment")


def plan_summary(spark, sf):
    _, summary = cadastral.cadastral_plan(b.surveys(spark, sf))
    return summary.withColumns({"misclosure_m": crnd(c("misclosure_m"), 3), "area_ha": crnd(c("area_ha"), 3)})


QUERIES = {
    "strip_thousands": thousands,
    "cleanse_numeric": numerals,
    "parse_dd_cardinal": _fmt("DD_CARDINAL"),
    "parse_dd_plain": _fmt("DD"),
    "parse_dms": _fmt("DMS"),
    "parse_utm_suffix": _fmt("UTM_SUFFIX"),
    "parse_utm_bare": _fmt("UTM"),
    "parse_auto": auto,
    "scan_station_table": stations,
    "scan_traverse_legs": legs,
    "bearing_to_dd": quadrant,
    "find_anchor": lambda spark, sf: x.find_anchor(b.surveys(spark, sf)),
    "detect_datum": datum,
    "route_track": track,
    "vision_json_to_lines": vision,
    "cadastral_plan": plan_ledger,
    "cadastral_summary": plan_summary,
}

_BASE = _sel(b.SURVEY_BASE, f"({_sel(b.PARCEL_BASE, 'customer')})")
SUB = {"sv": f"{_sel(b.SURVEYS, f'({_BASE})')} UNION ALL {_sel(b.DOCUMENT_SURVEYS, 'documents')}"}
_q = lambda s: "'" + s.replace("'", "''") + "'"


def _ng(text: str) -> str:
    """Thousands commas without look-around: three passes cover numbers under 10^12."""
    out = text
    for _ in range(3):
        out = f"regexp_replace({out}, '(\\d),(\\d{{3}})(\\D|$)', '\\1\\2\\3', 'g')"
    return out


def _rows(name: str, text: str = "raw_text") -> str:
    """run_id, seq, m: matches of one format with position."""
    pat = _q(p.FORMATS[name])
    return f"SELECT run_id, i-1 AS seq, m[i] AS m FROM (SELECT run_id, m, unnest(range(1, len(m)+1)) AS i FROM (SELECT run_id, regexp_extract_all({text}, {pat}) AS m FROM sv))"


def _dec(name: str) -> tuple[str, str]:
    pat = _q(p.FORMATS[name])
    g = lambda i: f"regexp_extract(m, {pat}, {i})"
    d = lambda i: f"TRY_CAST({g(i)} AS DOUBLE)"
    sg = lambda v, i: f"CASE WHEN upper({g(i)}) IN ('S','W') THEN -({v}) ELSE {v} END"
    if name == "DMS":
        return sg(f"{d(1)}+{d(2)}/60e0+{d(3)}/3600e0", 4), sg(f"{d(5)}+{d(6)}/60e0+{d(7)}/3600e0", 8)
    if name == "DD_CARDINAL":
        return sg(d(1), 2), sg(d(3), 4)
    if name == "DD":
        return d(1), d(2)
    if name == "UTM_SUFFIX":
        en = f"upper({g(2)})='E' AND upper({g(4)})='N'"
        return f"CASE WHEN {en} THEN {d(3)} ELSE greatest({d(1)},{d(3)}) END", f"CASE WHEN {en} THEN {d(1)} ELSE least({d(1)},{d(3)}) END"
    return f"greatest({d(1)},{d(2)})", f"least({d(1)},{d(2)})"


def _parsed(name: str) -> str:
    a, z = _dec(name)
    return f"SELECT run_id, CAST(seq AS INT) AS seq, {rnd(a, 6)} AS p1, {rnd(z, 6)} AS p2 FROM ({_rows(name)})"


_mend = lambda t: f"regexp_replace({_ng(t)}, '(\\d{{3,7}})-(\\d{{3}})', '\\1.\\2', 'g')"
_scale = _q(p.UTM_SCALE)
LINES = {"ln": "SELECT run_id, i-1 AS line_no, trim(l[i], ' ' || chr(9) || chr(12) || chr(11)) AS line FROM (SELECT run_id, l, unnest(range(1, len(l)+1)) AS i FROM (SELECT run_id, regexp_split_to_array(raw_text, '\\r\\n|\\r|\\n') AS l FROM sv)) WHERE trim(l[i], ' ' || chr(9) || chr(12) || chr(11))<>''"}
_LABEL = (
    r"(?i)(?:SC|SG|SK|BP|TP|BM|NR|S)[/\-\s]*[A-Z0-9]+(?:[/\-\s]*[A-Z0-9]+)*"
    r"|[A-Z]{1,4}\d{4,7}|(?:STATION|BEACON|PILLAR|CORNER)\s*\d+|[A-Z]\d+"
)
STATIONS = {
    **LINES,
    "s1": f"SELECT run_id, line_no, line, regexp_extract_all({_mend('line')}, {_scale}, 1) AS k FROM ln",
    "s2": "SELECT run_id, line_no, line, CAST(k[1] AS DOUBLE) AS a, CAST(k[2] AS DOUBLE) AS b FROM s1 WHERE len(k)>=2",
    "s3": f"""SELECT *, trim(regexp_replace(regexp_extract(regexp_replace(CASE WHEN contains(line,chr(9)) THEN split_part(line,chr(9),1) WHEN contains(line,'  ') THEN split_part(line,'  ',1) ELSE line END,
       '\\b(\\d{{6,}}|\\d+\\.\\d+)\\b', '|', 'g'), {_q(_LABEL)}), '\\s+', ' ', 'g')) AS label FROM s2 WHERE a>=100000 AND b>=100000""",
    "s4": "SELECT run_id, row_number() OVER w - 1 AS seq, CASE WHEN label='' THEN 'S' || sum(CASE WHEN label='' THEN 1 ELSE 0 END) OVER w ELSE label END AS station_id, least(a,b) AS e, greatest(a,b) AS n, count(*) OVER (PARTITION BY run_id) AS found FROM s3 WINDOW w AS (PARTITION BY run_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "g1": f"SELECT run_id, [CAST(z AS DOUBLE) FOR z IN regexp_extract_all({_mend("replace(raw_text, chr(10), ' ')")}, {_scale}, 1) IF CAST(z AS DOUBLE)>=100000] AS k FROM sv",
    "g2": "SELECT run_id, k[1:len(k)//2] AS h1, k[len(k)//2+1:] AS h2 FROM g1 WHERE len(k)>=6 AND len(k)%2=0 AND run_id NOT IN (SELECT run_id FROM s4 WHERE found>=3)",
    "g3": "SELECT run_id, CASE WHEN list_avg(h1)<list_avg(h2) THEN h1 ELSE h2 END AS es, CASE WHEN list_avg(h1)<list_avg(h2) THEN h2 ELSE h1 END AS ns FROM g2 WHERE abs(list_avg(h1)-list_avg(h2))>50000",
    "stn": "SELECT run_id, CAST(seq AS INT) AS seq, station_id, e, n FROM s4 WHERE run_id NOT IN (SELECT run_id FROM g3) UNION ALL SELECT run_id, CAST(i-1 AS INT), 'S' || i, es[i], ns[i] FROM (SELECT *, unnest(range(1,len(es)+1)) AS i FROM g3)",
}
_bg = lambda i: f"regexp_extract(hit, {_q(p.BEARING)}, {i})"
LEGS = {
    **LINES,
    "l1": f"SELECT *, regexp_extract(line, {_q(p.BEARING)}) AS hit FROM ln WHERE len([1 FOR z IN regexp_extract_all({_mend('line')}, {_scale}, 1) IF CAST(z AS DOUBLE)>=100000])=0",
    "l2": f"SELECT *, upper({_bg(1)}) AS d1, upper({_bg(5)}) AS d2, TRY_CAST({_bg(2)} AS DOUBLE)+TRY_CAST({_bg(3)} AS DOUBLE)/60e0+CASE WHEN {_bg(4)}='' THEN 0e0 ELSE TRY_CAST({_bg(4)} AS DOUBLE) END/3600e0 AS ang FROM l1 WHERE hit<>''",
    "l3": f"""SELECT *, substr(line, instr(line,hit)+length(hit)) AS rest, CASE WHEN contains(line,':') THEN split_part(line,':',1) END AS hd FROM l2
      WHERE ang IS NOT NULL AND (d1<>'' OR d2<>'' OR regexp_matches(hit, '[°''″]'))""",
    "l4": f"""SELECT *, TRY_CAST(CASE WHEN regexp_extract(rest,{_q(p.DISTANCE)},1)<>'' THEN regexp_extract(rest,{_q(p.DISTANCE)},1) ELSE regexp_extract(line,{_q(p.DISTANCE)},1) END AS DOUBLE) AS dist,
      coalesce(regexp_matches(hd,'(?i)\\bto\\b'),false) AS lk FROM l3""",
    "lg": f"""SELECT run_id, CAST(line_no AS INT) AS line_no, {rnd("CASE d1 || d2 WHEN 'SE' THEN 180-ang WHEN 'SW' THEN 180+ang WHEN 'NW' THEN 360-ang ELSE ang END", 6)} AS bearing_dd, dist AS distance_m,
      trim(regexp_extract(line, {_q(p.LEG_LABEL)})) AS label,
      CASE WHEN lk THEN trim(regexp_replace(trim(regexp_extract(hd,'(?i)^(.*?)\\bto\\b(.*)$',1)),'^\\d+[\\s.)\\-:]+','')) ELSE '' END AS from_station,
      CASE WHEN lk THEN trim(regexp_extract(hd,'(?i)^(.*?)\\bto\\b(.*)$',2)) ELSE '' END AS to_station FROM l4 WHERE dist>0""",
}
AUTO = {
    "fm": "SELECT run_id, CASE " + " ".join(f"WHEN len(regexp_extract_all(t, {_q(pat)}))>=3 THEN '{n}'" for n, pat in p.FORMATS.items()) + f" END AS fmt, t FROM (SELECT run_id, {_ng('raw_text')} AS t FROM sv)",
    "au": " UNION ALL ".join(
        f"SELECT run_id, '{n}' AS fmt, i-1 AS seq, {_dec(n)[0]} AS p1, {_dec(n)[1]} AS p2 FROM (SELECT run_id, i, k[i] AS m FROM (SELECT run_id, k, unnest(range(1,len(k)+1)) AS i FROM (SELECT run_id, regexp_extract_all(t, {_q(pat)}) AS k FROM fm WHERE fmt='{n}')))"
        for n, pat in p.FORMATS.items()
    ) + " UNION ALL SELECT run_id, 'STATION_TABLE', seq, n, e FROM stn JOIN fm USING (run_id) WHERE fmt IS NULL AND run_id IN (SELECT run_id FROM stn GROUP BY run_id HAVING count(*)>=3)",
}
_anc = lambda i: f"TRY_CAST(nullif(regexp_extract(raw_text, {_q(p.ANCHOR)}, {i}), '') AS DOUBLE)"

_PLAN = {
    **SUB, **STATIONS, **LEGS,
    "k": "SELECT run_id, coalesce(s,0) AS stations, coalesce(l,0) AS legs FROM sv LEFT JOIN (SELECT run_id, count(*) AS s FROM stn GROUP BY run_id) USING (run_id) LEFT JOIN (SELECT run_id, count(*) AS l FROM lg GROUP BY run_id) USING (run_id)",
    "rt": "SELECT run_id, CASE WHEN stations>=3 THEN 'TABULAR' WHEN legs>=3 THEN 'COGO_TRAVERSE' ELSE 'INSUFFICIENT' END AS track, CASE WHEN stations<3 AND legs<3 THEN 'INSUFFICIENT_SPATIAL_DATA' END AS error_code FROM k",
    "tb": "SELECT stn.* FROM stn JOIN rt USING (run_id) WHERE track='TABULAR'",
    "te": "SELECT run_id, count(*) AS c, arg_min(station_id,seq) AS s0, arg_min(e,seq) AS e0, arg_min(n,seq) AS n0, arg_max(e,seq) AS e9, arg_max(n,seq) AS n9 FROM tb GROUP BY run_id",
    "an": f"SELECT run_id, CASE WHEN e IS NOT NULL AND n IS NOT NULL THEN e WHEN len(k)>=2 THEN least(k[1],k[2]) END AS ae, CASE WHEN e IS NOT NULL AND n IS NOT NULL THEN n WHEN len(k)>=2 THEN greatest(k[1],k[2]) END AS an FROM (SELECT sv.run_id, {_anc(1)} AS e, {_anc(2)} AS n, k FROM sv JOIN g1 USING (run_id))",
    "cg": "SELECT lg.*, coalesce(ae,250000e0) AS ae, coalesce(an,1000000e0) AS an, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS i, distance_m*sin(radians(bearing_dd)) AS de, distance_m*cos(radians(bearing_dd)) AS dn FROM lg JOIN rt USING (run_id) JOIN an USING (run_id) WHERE track='COGO_TRAVERSE'",
    "tt": "SELECT run_id, sum(de) AS me, sum(dn) AS mn, sum(distance_m) AS ln, sqrt(sum(de)*sum(de)+sum(dn)*sum(dn)) AS gap FROM cg GROUP BY run_id",
    "fw": f"SELECT run_id, i, label, to_station, {rnd('ae+sum(de) OVER w', 3)} AS e, {rnd('an+sum(dn) OVER w', 3)} AS n, sum(distance_m) OVER w AS cd FROM cg WINDOW w AS (PARTITION BY run_id ORDER BY i)",
    "pl": f"""SELECT run_id, seq, station_id, e, n, 'none' AS adjustment FROM tb UNION ALL
      SELECT run_id, CAST(c AS INT), s0 || ' (close)', e0, n0, 'none' FROM te WHERE c>=3 AND (abs(e0-e9)>0.01e0 OR abs(n0-n9)>0.01e0) UNION ALL
      SELECT run_id, CAST(i AS INT), CASE WHEN to_station<>'' THEN to_station WHEN label<>'' THEN label ELSE 'S' || i END, CASE WHEN gap>0 AND gap<=2 THEN {rnd('e-me*cd/ln', 3)} ELSE e END, CASE WHEN gap>0 AND gap<=2 THEN {rnd('n-mn*cd/ln', 3)} ELSE n END, CASE WHEN gap>0 AND gap<=2 THEN 'bowditch' ELSE 'none' END FROM fw JOIN tt USING (run_id) UNION ALL
      SELECT run_id, 0, CASE WHEN from_station<>'' THEN from_station ELSE 'TP0 (Tie-Point)' END, ae, an, CASE WHEN gap>0 AND gap<=2 THEN 'bowditch' ELSE 'none' END FROM cg JOIN tt USING (run_id) WHERE i=1""",
    "ar": "SELECT run_id, count(*) AS c, max(adjustment) AS adjustment, abs(sum((e2-e)*(n2+n)))/2 AS a FROM (SELECT *, coalesce(lead(e) OVER w, first(e) OVER w) AS e2, coalesce(lead(n) OVER w, first(n) OVER w) AS n2 FROM pl WINDOW w AS (PARTITION BY run_id ORDER BY seq)) GROUP BY run_id",
}

CHECKS = {
    "cadastral_plan": with_(_PLAN, f"SELECT run_id, seq, station_id, {rnd('e', 2)} AS e, {rnd('n', 2)} AS n, adjustment FROM pl"),
    "cadastral_summary": with_(_PLAN, f"""SELECT run_id, track, error_code, c AS ledger_stations, adjustment, CASE WHEN track='TABULAR' THEN 0e0 ELSE {rnd(rnd('gap', 4), 3)} END AS misclosure_m,
      CASE WHEN track='TABULAR' THEN 'CLOSED' WHEN {rnd('gap', 4)}>2 THEN 'UNCLOSED' WHEN gap IS NOT NULL THEN 'CLOSED' END AS closure_status, {rnd(rnd('a/10000e0', 4), 3)} AS area_ha
      FROM rt LEFT JOIN ar USING (run_id) LEFT JOIN tt USING (run_id)"""),
    "strip_thousands": with_({**SUB, "o": f"SELECT run_id, {_ng('raw_text')} AS t FROM sv"}, "SELECT run_id, md5(t) AS digest, CAST(length(t) AS INT) AS chars FROM o"),
    "cleanse_numeric": f"""WITH k AS ({_sel(NUMERALS, 'lineitem')}) SELECT raw, count(*) AS uses, CASE any_value(pk)%9
      WHEN 0 THEN CAST(replace(raw,'-','.') AS DOUBLE) WHEN 1 THEN CAST(replace(raw,',','') AS DOUBLE) WHEN 2 THEN CAST(replace(raw,' ','') AS DOUBLE) WHEN 3 THEN CAST(replace(raw,',','.') AS DOUBLE)
      WHEN 4 THEN CAST(replace(raw,',','') AS DOUBLE) WHEN 8 THEN CAST(trim(raw) AS DOUBLE) END AS value FROM k GROUP BY raw""",
    **{
        key: with_(SUB, _parsed(name))
        for key, name in {"parse_dd_cardinal": "DD_CARDINAL", "parse_dd_plain": "DD", "parse_dms": "DMS", "parse_utm_suffix": "UTM_SUFFIX", "parse_utm_bare": "UTM"}.items()
    },
    "parse_auto": with_({**SUB, **STATIONS, **AUTO}, f"SELECT run_id, fmt, CAST(seq AS INT) AS seq, {rnd('p1', 6)} AS p1, {rnd('p2', 6)} AS p2 FROM au"),
    "scan_station_table": with_({**SUB, **STATIONS}, "SELECT * FROM stn"),
    "scan_traverse_legs": with_({**SUB, **LEGS}, "SELECT * FROM lg"),
    "bearing_to_dd": """WITH r AS (SELECT l_orderkey*10+l_linenumber AS id, l_partkey, ['N','S','s','n',''][l_suppkey%5+1] AS d1, ['E','W','e'][l_partkey%3+1] AS d2, l_partkey%90*1e0 AS a FROM lineitem)
      SELECT id, l_partkey, CASE WHEN d1='' THEN a WHEN upper(d1)='N' AND upper(d2)='E' THEN a WHEN upper(d1)='S' AND upper(d2)='E' THEN 180-a WHEN upper(d1)='S' THEN 180+a ELSE 360-a END AS bearing_dd FROM r""",
    "find_anchor": with_({**SUB, "g1": STATIONS["g1"], "o": f"SELECT sv.run_id, {_anc(1)} AS e, {_anc(2)} AS n, k FROM sv JOIN g1 USING (run_id)"},
      "SELECT run_id, CASE WHEN e IS NOT NULL AND n IS NOT NULL THEN e WHEN len(k)>=2 THEN least(k[1],k[2]) END AS anchor_e, CASE WHEN e IS NOT NULL AND n IS NOT NULL THEN n WHEN len(k)>=2 THEN greatest(k[1],k[2]) END AS anchor_n FROM o"),
    "detect_datum": with_(SUB, f"SELECT run_id, CASE WHEN regexp_matches(raw_text,{_q(p.MINNA_WORD)}) THEN 'MINNA' WHEN regexp_matches(raw_text,{_q(p.WGS_WORD)}) THEN 'WGS84' ELSE 'MINNA' END AS datum, TRY_CAST(nullif(regexp_extract(raw_text,{_q(p.ZONE_WORD)},1),'') AS INT) AS stated_zone FROM sv"),
    "route_track": with_({**SUB, **STATIONS, **LEGS, "k": "SELECT run_id, coalesce(s,0) AS stations, coalesce(l,0) AS legs FROM sv LEFT JOIN (SELECT run_id, count(*) AS s FROM stn GROUP BY run_id) USING (run_id) LEFT JOIN (SELECT run_id, count(*) AS l FROM lg GROUP BY run_id) USING (run_id)"},
      "SELECT *, CASE WHEN stations>=3 THEN 'TABULAR' WHEN legs>=3 THEN 'COGO_TRAVERSE' ELSE 'INSUFFICIENT' END AS track, CASE WHEN stations<3 AND legs<3 THEN 'INSUFFICIENT_SPATIAL_DATA' END AS error_code FROM k"),
    "vision_json_to_lines": f"""WITH s AS ({_BASE}), k AS (SELECT parcel_id AS run_id, CASE WHEN parcel_id%3=0 THEN
       ['TRACK: TRACK_A','DATUM: MINNA','STATED_AREA_SQM: ' || (400+parcel_id) || '.000','BP' || parcel_id || ' E: ' || e0 || '.500  N: ' || n0 || '.500','E: ' || (e0+10) || '.500  N: ' || n0 || '.500','E: ' || e0 || '.500  N: ' || n0 || '.500']
      WHEN parcel_id%3=1 THEN ['DATUM: WGS84','STARTING_BEACON: A' || parcel_id,'GRID_REF: E ' || e0 || '.500 N ' || n0 || '.500','A to B: 45 10 ' || (20+parcel_id%50) || '.500m','90 00  12.000m']
      ELSE [e0 || '.500mE', n0 || '.500mN','10 20  ' || (parcel_id%70) || '.500m','7 8  9.000m','E: ' || e0 || '.500  N: ' || n0 || '.500'] END AS l FROM s)
      SELECT run_id, CAST(i-1 AS INT) AS line_no, l[i] AS line FROM (SELECT *, unnest(range(1,len(l)+1)) AS i FROM k)""",
}
