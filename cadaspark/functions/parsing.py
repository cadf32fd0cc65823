"""Coordinate text as Column expressions: patterns, numbers and per-match decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text patterns.
NUMBER = r"\d{6,7}(?:\.\d+)?"
DMS = (
    r"""(?i)(\d{1,2})[°\s]+(\d{1,2})['\s]+([\d.]+)["'\s]*([NS])[,;\s]*"""
    r"""(\d{1,3})[°\s]+(\d{1,2})['\s]+([\d.]+)["'\s]*([EW])"""
)
DD_CARDINAL = r"(?i)(\d{1,2}\.\d{2,8})\s*([NS])[,;\s]+(\d{1,3}\.\d{2,8})\s*([EW])"
DD_PLAIN = r"(?i)(-?\d{1,2}\.\d{2,8})[°\s,;]*[NS]?[,;\s]+(-?\d{1,3}\.\d{2,8})[°\s,;]*[EW]?"
UTM_SUFFIX = rf"({NUMBER})\s*([ENen])\s*[,;\s]+({NUMBER})\s*([NSns])"
UTM_BARE = rf"({NUMBER})[,;\s]+({NUMBER})"
UTM_SCALE = rf"\b({NUMBER})\b"
STATION_LABEL = (
    r"(?i)(?:SC|SG|SK|BP|TP|BM|NR|S)[/\-\s]*(?!\b\d{6,}\b)(?!\b\d+\.\d+\b)[A-Z0-9]+"
    r"(?:[/\-\s]*(?!\b\d{6,}\b)(?!\b\d+\.\d+\b)[A-Z0-9]+)*"
    r"|[A-Z]{1,4}\d{4,7}|(?:STATION|BEACON|PILLAR|CORNER)\s*\d+|[A-Z]\d+"
)
BEARING = r"""(?:([NSns])\s*)?(\d{1,3})[°\s]+(\d{1,2})['′\s]*(?:([\d.]+)["″\s]*)?([EWew])?"""
DISTANCE = r"(\d{1,6}(?:\.\d+)?)\s*[mM]?\b"
LEG_LABEL = r"(?i)(?:line|leg|l)\s*\d+|^\d+[.):]"
ANCHOR = (
    r"(?i)(?:tie[\-\s]*point|anchor|origin|start(?:ing)?\s*point|reference)[:\s]*(?:E(?:asting)?[:\s]*)?"
    r"(\d{3,7}(?:\.\d+)?)\s*[mM]?\s*[,;\s]+\s*(?:N(?:orthing)?[:\s]*)?(\d{3,7}(?:\.\d+)?)"
)
MINNA_TEXT = r"(?i)minna|clarke\s*1880|nigerian\s*datum"
MINNA_WORD = r"(?i)\bminna\b|clarke\s*1880|nigerian\s+datum"
WGS_WORD = r"(?i)\bwgs\s*84\b|\bwgs84\b|\bepa:4326\b"
ZONE_LETTER = r"(?i)utm\s*zone\s*(\d+)\s*([NS])"
ZONE_WORD = r"(?i)\butm\s*zone\s*(\d+)\b"
NEW_LINE = r"\r\n|\r|\n"

# Format name -> pattern, in the order they are tried.
FORMATS = {"DMS": DMS, "DD_CARDINAL": DD_CARDINAL, "DD": DD_PLAIN, "UTM_SUFFIX": UTM_SUFFIX, "UTM": UTM_BARE}
MIN_POINTS = 3


def strip_thousands(text: Column) -> Column:
    """Drop commas before exactly three digits; look-around makes one pass enough."""
    return F.regexp_replace(text, r"(?<=\d),(?=\d{3}(?!\d))", "")


def cleanse_numeric(raw: Column) -> Column:
    """Number from damaged text, null if it is none."""
    s = F.regexp_replace(F.trim(raw), r"(?<=\d)\s+(?=\d)", "")
    s = F.regexp_replace(strip_thousands(s), r"^(-?\d+)-(\d+)$", "$1.$2")
    lone = ~F.contains(s, F.lit(".")) & (F.length(s) - F.length(F.replace(s, F.lit(","), F.lit(""))) == 1)
    s = F.when(lone, F.replace(s, F.lit(","), F.lit("."))).otherwise(s)
    # Only plain decimals count: the cast alone would also take words such as NaN or a D suffix.
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


def mend_line(line: Column) -> Column:
    """Thousands commas, then a hyphen standing for a decimal point; column gaps stay."""
    return F.regexp_replace(strip_thousands(line), r"(\d{3,7})-(\d{3})", "$1.$2")


# What every number of UTM_SCALE, every leg and every match of a format holds in the text as it is written; one pass that spares most texts the others.
# Thousands commas may still be there: of a number of six digits, three stand before the last comma and three after it.
MAY_SCALE = r"\d{3},?\d{3}"
MAY_LEG = r"\d[°\s]+\d"
MAY_FORMAT = r"\d(?:[°\s]+\d|\.\d|\d{2},?\d{3})"
# Each of three points holds two numbers with such a place in each. Read from the left, one found place touches two of those six at most.
MIN_PLACES = 3


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def scale_numbers(text: Column) -> Column:
    """All numbers of six or seven whole digits that reach 100000."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(UTM_SCALE), 1), lambda v: v.try_cast("double"))
    return F.filter(numbers, lambda v: v >= 100000)


def _g(match: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(match, pattern, i)


def _d(match: Column, pattern: str, i: int) -> Column:
    return _g(match, pattern, i).try_cast("double")


def _signed(value: Column, letter: Column) -> Column:
    return F.when(F.upper(letter).isin("S", "W"), -value).otherwise(value)


def decode(match: Column, fmt: str) -> tuple[Column, Column]:
    """(latitude, longitude) or (northing, easting) of one match."""
    p = FORMATS[fmt]
    if fmt == "DMS":
        angle = lambda i: _d(match, p, i) + _d(match, p, i + 1) / 60.0 + _d(match, p, i + 2) / 3600.0
        return _signed(angle(1), _g(match, p, 4)), _signed(angle(5), _g(match, p, 8))
    if fmt == "DD_CARDINAL":
        return _signed(_d(match, p, 1), _g(match, p, 2)), _signed(_d(match, p, 3), _g(match, p, 4))
    if fmt == "DD":
        return _d(match, p, 1), _d(match, p, 2)
    if fmt == "UTM_SUFFIX":
        a, b = _d(match, p, 1), _d(match, p, 3)
        plain = (F.upper(_g(match, p, 2)) == "E") & (F.upper(_g(match, p, 4)) == "N")
        return F.when(plain, b).otherwise(F.greatest(a, b)), F.when(plain, a).otherwise(F.least(a, b))
    a, b = _d(match, p, 1), _d(match, p, 2)
    return F.greatest(a, b), F.least(a, b)


def decode_any(match: Column, fmt: Column) -> tuple[Column, Column]:
    first = second = None
    for name in FORMATS:
        a, b = decode(match, name)
        first = F.when(fmt == name, a) if first is None else first.when(fmt == name, a)
        second = F.when(fmt == name, b) if second is None else second.when(fmt == name, b)
    return first, second


def bearing_to_dd(first: Column, degrees: Column, second: Column) -> Column:
    """Quadrant bearing to whole circle; letters other than a full pair leave the angle alone."""
    pair = F.concat(F.upper(first), F.upper(second))
    return (
        F.when(pair == "SE", F.lit(180.0) - degrees)
        .when(pair == "SW", degrees + 180.0)
        .when(pair == "NW", F.lit(360.0) - degrees)
        .otherwise(degrees)
    )


def names_minna(text: Column, low: Column | None = None) -> Column:
    """Whether a text names the old datum; the pattern is tried only where one of its words stands. ``low``: the text in lower case, if at hand."""
    low = F.lower(text) if low is None else low
    word = F.contains(low, F.lit("minna")) | F.contains(low, F.lit("clarke")) | F.contains(low, F.lit("nigerian"))
    return word & text.rlike(MINNA_TEXT)


def named_zone(text: Column, low: Column | None = None) -> Column:
    """Number of the zone that a text names with its hemisphere, empty if none. ``low``: a text in lower case that holds this one, if at hand."""
    return F.when(F.contains(F.lower(text) if low is None else low, F.lit("utm")), F.regexp_extract(text, ZONE_LETTER, 1)).otherwise(F.lit(""))


def detect_datum(text: Column) -> dict[str, Column]:
    zone = F.regexp_extract(text, ZONE_WORD, 1)
    return {
        "datum": F.when(text.rlike(MINNA_WORD), "MINNA").when(text.rlike(WGS_WORD), "WGS84").otherwise("MINNA"),
        "stated_zone": F.when(zone != "", zone.try_cast("int")),
    }
