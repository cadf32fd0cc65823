"""Shared pieces of the checking SQL: input tables as CTEs and formula texts."""

from __future__ import annotations

from cadaspark.functions import geo
from cadaspark.sources import bridge as b


def rnd(expr: str, digits: int) -> str:
    return f"(floor(({expr}) * 1e{digits} + 0.5e0) / 1e{digits})"


def fixed(expr: str, digits: int) -> str:
    return f"printf('%.{digits}f', {rnd(expr, digits)})"


def _sel(cols: list[str], source: str, where: str = "") -> str:
    return f"SELECT {', '.join(cols)} FROM {source}" + (f" WHERE {where}" if where else "")


def _corners(n: int) -> str:
    return _sel(b.CORNERS, f"(SELECT *, unnest(range({n})) AS seq FROM ({_sel(b.PARCEL_BASE, 'customer')}))")


def _seqs(source: str, n: int) -> str:
    return f"(SELECT *, unnest(range({n})) AS seq FROM ({source}))"


FEATURES = _sel(b.FEATURES, "part")
INPUTS = {
    "p": _sel(b.PARCELS, f"({_sel(b.PARCEL_BASE, 'customer')})"),
    "v": _sel(b.VERTICES, f"({_corners(5)})", b.VERTEX_FILTER),
    "st": _sel(b.STATIONS, f"({_corners(5)})", b.STATION_FILTER),
    "legs": _sel(b.RECTANGLE_LEGS, _seqs(_sel(b.PARCEL_BASE, "customer"), 4)),
    "lines": _sel(b.LINES, f"({FEATURES})"),
    "bld": _sel(b.BUILDINGS, f"({FEATURES})"),
    "lu": _sel(b.LANDUSE_EDGES, _seqs(FEATURES, 4)),
    "reg": _sel(b.REGISTRY, "supplier"),
    "rep": _sel(b.REPORTS, "orders"),
}


def with_(ctes: dict[str, str] | list[str], select: str) -> str:
    """``WITH name AS (...), ... select``; names in INPUTS need no text."""
    items = {c: INPUTS[c] for c in ctes} if isinstance(ctes, list) else ctes
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in items.items()) + " " + select


def inputs(*names: str) -> dict[str, str]:
    return {n: INPUTS[n] for n in names}


def haversine(lat1: str, lng1: str, lat2: str, lng2: str, r: float = 6371000.0) -> str:
    a = (
        f"(power(sin(radians({lat2}-{lat1})/2),2) + "
        f"cos(radians({lat1}))*cos(radians({lat2}))*power(sin(radians({lng2}-{lng1})/2),2))"
    )
    return f"(2*{r!r}e0*atan2(sqrt({a}), sqrt(1-{a})))"


def zone(lng: str) -> str:
    return f"CASE WHEN {lng} < 6 THEN 31 WHEN {lng} < 12 THEN 32 ELSE 33 END"


def utm(source: str, lat: str, lng: str, zone_col: str, e: str = "e", n: str = "n", ell=geo.WGS84) -> str:
    """SELECT adding easting and northing; ``source`` is a CTE name or parenthesised query."""
    c = 2 * ell.n**0.5 / (1 + ell.n)
    ka = geo.K0 * ell.rectifying_radius
    al = geo.forward_coefficients(ell)
    s1 = (
        f"SELECT *, sinh(atanh(sin(radians({lat}))) - {c!r}*atanh({c!r}*sin(radians({lat})))) AS _t, "
        f"radians({lng} - ({zone_col}*6-183)) AS _dl FROM {source}"
    )
    s2 = f"SELECT *, atan2(_t, cos(_dl)) AS _xi, atanh(sin(_dl)/sqrt(1+_t*_t)) AS _eta FROM ({s1})"
    east = "_eta" + "".join(f" + {a!r}*cos({2*j}*_xi)*sinh({2*j}*_eta)" for j, a in enumerate(al, 1))
    north = "_xi" + "".join(f" + {a!r}*sin({2*j}*_xi)*cosh({2*j}*_eta)" for j, a in enumerate(al, 1))
    return (
        f"SELECT * EXCLUDE (_t,_dl,_xi,_eta), 500000e0 + {ka!r}*({east}) AS {e}, {ka!r}*({north}) AS {n} FROM ({s2})"
    )


def latlng(source: str, e: str, n: str, zone_col: str, lat: str = "lat", lng: str = "lng", ell=geo.WGS84) -> str:
    ka = geo.K0 * ell.rectifying_radius
    be, de = geo.inverse_coefficients(ell)
    s1 = f"SELECT *, {n}/{ka!r} AS _x, ({e}-500000e0)/{ka!r} AS _y FROM {source}"
    xi = "_x" + "".join(f" - {v!r}*sin({2*j}*_x)*cosh({2*j}*_y)" for j, v in enumerate(be, 1))
    eta = "_y" + "".join(f" - {v!r}*cos({2*j}*_x)*sinh({2*j}*_y)" for j, v in enumerate(be, 1))
    s2 = f"SELECT *, {xi} AS _xi, {eta} AS _eta FROM ({s1})"
    s3 = f"SELECT *, asin(sin(_xi)/cosh(_eta)) AS _chi, atan2(sinh(_eta), cos(_xi)) AS _dl FROM ({s2})"
    phi = "_chi" + "".join(f" + {v!r}*sin({2*j}*_chi)" for j, v in enumerate(de, 1))
    return (
        f"SELECT * EXCLUDE (_x,_y,_xi,_eta,_chi,_dl), degrees({phi}) AS {lat}, "
        f"degrees(_dl) + ({zone_col}*6-183) AS {lng} FROM ({s3})"
    )


def shift(source: str, lat: str, lng: str, out_lat: str, out_lng: str, d=geo.MINNA_SHIFT) -> str:
    s, t = geo.CLARKE_1880, geo.WGS84
    b_ax = t.a * (1 - t.f)
    ep2 = t.e2 / (1 - t.e2)
    s1 = f"SELECT *, {s.a!r}/sqrt(1-{s.e2!r}*power(sin(radians({lat})),2)) AS _nu FROM {source}"
    s2 = (
        f"SELECT *, _nu*cos(radians({lat}))*cos(radians({lng}))+({d[0]!r}) AS _X, "
        f"_nu*cos(radians({lat}))*sin(radians({lng}))+({d[1]!r}) AS _Y, "
        f"_nu*{1-s.e2!r}*sin(radians({lat}))+({d[2]!r}) AS _Z FROM ({s1})"
    )
    s3 = f"SELECT *, sqrt(_X*_X+_Y*_Y) AS _p FROM ({s2})"
    s4 = f"SELECT *, atan2(_Z*{t.a!r}, _p*{b_ax!r}) AS _th FROM ({s3})"
    return (
        f"SELECT * EXCLUDE (_nu,_X,_Y,_Z,_p,_th), "
        f"degrees(atan2(_Z+{ep2*b_ax!r}*power(sin(_th),3), _p-{t.e2*t.a!r}*power(cos(_th),3))) AS {out_lat}, "
        f"degrees(atan2(_Y,_X)) AS {out_lng} FROM ({s4})"
    )


def state_case(lat: str, lng: str) -> str:
    arms = " ".join(
        f"WHEN {lat} BETWEEN {a!r} AND {z!r} AND {lng} BETWEEN {c!r} AND {d!r} THEN '{n}'"
        for n, a, z, c, d in b.STATE_BOXES
    )
    return f"CASE {arms} END"


def inside(lat: str, lng: str) -> str:
    x = geo.COUNTRY_BOX
    return f"({lat} BETWEEN {x['lat_min']!r} AND {x['lat_max']!r} AND {lng} BETWEEN {x['lon_min']!r} AND {x['lon_max']!r})"
