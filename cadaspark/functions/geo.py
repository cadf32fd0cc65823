"""Projections, datum shift and distances as native Column expressions.

Steps that reuse an intermediate many times are DataFrame functions: each stage is its own
``select`` so the expression trees stay small and Catalyst keeps the shared value in one place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    inv_f: float

    @property
    def f(self) -> float:
        return 1.0 / self.inv_f

    @property
    def n(self) -> float:
        return self.f / (2.0 - self.f)

    @property
    def e2(self) -> float:
        return self.f * (2.0 - self.f)

    @property
    def rectifying_radius(self) -> float:
        n = self.n
        return self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)


# Ellipsoids, datum shift and the country box.
WGS84 = Ellipsoid(6378137.0, 298.257223563)
CLARKE_1880 = Ellipsoid(6378249.145, 293.4663)
MINNA_SHIFT = (-92.0, -93.0, 272.0)
COUNTRY_BOX = {"lon_min": 2.676932, "lon_max": 14.680073, "lat_min": 4.240594, "lat_max": 13.885645}
K0 = 0.9996
FALSE_EASTING = 500000.0


def forward_coefficients(ell: Ellipsoid) -> tuple[float, float, float]:
    n = ell.n
    return (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    )


def inverse_coefficients(ell: Ellipsoid) -> tuple[tuple[float, ...], tuple[float, ...]]:
    n = ell.n
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96,
        n**2 / 48 + n**3 / 15,
        17 * n**3 / 480,
    )
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3,
        7 * n**2 / 3 - 8 * n**3 / 5,
        56 * n**3 / 15,
    )
    return beta, delta


def utm_zone(lng: Column) -> Column:
    """Zone used for metric work: 31 west of 6E, 32 west of 12E, else 33."""
    return F.when(lng < 6.0, 31).when(lng < 12.0, 32).otherwise(33)


def inside_box(lat: Column, lng: Column, box: dict | None = None) -> Column:
    b = box or COUNTRY_BOX
    return lat.between(b["lat_min"], b["lat_max"]) & lng.between(b["lon_min"], b["lon_max"])


def with_utm(
    df: DataFrame, lat: str, lng: str, zone: str, e: str = "e", n: str = "n", ell: Ellipsoid = WGS84, solid: bool = False
) -> DataFrame:
    """Add easting and northing of (lat, lng) in the UTM zone held by column ``zone``.

    ``solid`` marks the results non-null (callers drop null positions first). Without it, the
    is-not-null filters Catalyst infers for join keys are pushed below the stages and re-inline the
    whole projection into one huge predicate.
    """
    c = 2 * math.sqrt(ell.n) / (1 + ell.n)
    ka = K0 * ell.rectifying_radius
    alpha = forward_coefficients(ell)
    keep = [x for x in df.columns if x not in (e, n)]
    s1 = df.select(
        *keep,
        F.sin(F.radians(lat)).alias("_s"),
        F.radians(F.col(lng) - (F.col(zone) * 6.0 - 183.0)).alias("_dl"),
    )
    s2 = s1.select(
        *keep, "_dl", F.sinh(F.atanh("_s") - F.lit(c) * F.atanh(F.lit(c) * F.col("_s"))).alias("_t")
    )
    s3 = s2.select(
        *keep,
        F.atan2(F.col("_t"), F.cos("_dl")).alias("_xi"),
        F.atanh(F.sin("_dl") / F.sqrt(F.lit(1.0) + F.col("_t") * F.col("_t"))).alias("_eta"),
    )
    east, north = F.col("_eta"), F.col("_xi")
    for j, aj in enumerate(alpha, start=1):
        east = east + F.lit(aj) * F.cos(F.col("_xi") * (2.0 * j)) * F.sinh(F.col("_eta") * (2.0 * j))
        north = north + F.lit(aj) * F.sin(F.col("_xi") * (2.0 * j)) * F.cosh(F.col("_eta") * (2.0 * j))
    east, north = east * F.lit(ka) + F.lit(FALSE_EASTING), north * F.lit(ka)
    if solid:
        east, north = (F.coalesce(v, F.lit(float("nan"))) for v in (east, north))
    return s3.select(*keep, east.alias(e), north.alias(n))


def with_latlng(
    df: DataFrame, e: str, n: str, zone: str, lat: str = "lat", lng: str = "lng", ell: Ellipsoid = WGS84
) -> DataFrame:
    """Inverse of :func:`with_utm`."""
    ka = K0 * ell.rectifying_radius
    beta, delta = inverse_coefficients(ell)
    keep = [x for x in df.columns if x not in (lat, lng)]
    s1 = df.select(
        *keep,
        (F.col(n) / F.lit(ka)).alias("_x"),
        ((F.col(e) - F.lit(FALSE_EASTING)) / F.lit(ka)).alias("_y"),
    )
    xi, eta = F.col("_x"), F.col("_y")
    for j, bj in enumerate(beta, start=1):
        xi = xi - F.lit(bj) * F.sin(F.col("_x") * (2.0 * j)) * F.cosh(F.col("_y") * (2.0 * j))
        eta = eta - F.lit(bj) * F.cos(F.col("_x") * (2.0 * j)) * F.sinh(F.col("_y") * (2.0 * j))
    s2 = s1.select(*keep, xi.alias("_xi"), eta.alias("_eta"))
    s3 = s2.select(
        *keep,
        F.asin(F.sin("_xi") / F.cosh("_eta")).alias("_chi"),
        F.atan2(F.sinh("_eta"), F.cos("_xi")).alias("_dl"),
    )
    phi = F.col("_chi")
    for j, dj in enumerate(delta, start=1):
        phi = phi + F.lit(dj) * F.sin(F.col("_chi") * (2.0 * j))
    return s3.select(
        *keep,
        F.degrees(phi).alias(lat),
        (F.degrees("_dl") + (F.col(zone) * 6.0 - 183.0)).alias(lng),
    )


def with_datum_shift(
    df: DataFrame,
    lat: str,
    lng: str,
    out_lat: str = "lat",
    out_lng: str = "lng",
    src: Ellipsoid = CLARKE_1880,
    dst: Ellipsoid = WGS84,
    shift: tuple[float, float, float] = MINNA_SHIFT,
) -> DataFrame:
    """Geodetic -> ECEF -> translate -> geodetic (Bowring's closed form), at zero height."""
    dx, dy, dz = shift
    keep = [x for x in df.columns if x not in (out_lat, out_lng)]
    s1 = df.select(
        *keep,
        F.sin(F.radians(lat)).alias("_sp"),
        F.cos(F.radians(lat)).alias("_cp"),
        F.radians(lng).alias("_l"),
    )
    s2 = s1.select(
        *keep, "_sp", "_cp", "_l",
        (F.lit(src.a) / F.sqrt(F.lit(1.0) - F.lit(src.e2) * F.col("_sp") * F.col("_sp"))).alias("_nu"),
    )
    s3 = s2.select(
        *keep,
        (F.col("_nu") * F.col("_cp") * F.cos("_l") + F.lit(dx)).alias("_X"),
        (F.col("_nu") * F.col("_cp") * F.sin("_l") + F.lit(dy)).alias("_Y"),
        (F.col("_nu") * F.lit(1.0 - src.e2) * F.col("_sp") + F.lit(dz)).alias("_Z"),
    )
    b = dst.a * (1 - dst.f)
    ep2 = dst.e2 / (1 - dst.e2)
    s4 = s3.select(
        *keep, "_X", "_Y", "_Z",
        F.sqrt(F.col("_X") * F.col("_X") + F.col("_Y") * F.col("_Y")).alias("_p"),
    )
    s5 = s4.select(
        *keep, "_X", "_Y", "_Z", "_p",
        F.atan2(F.col("_Z") * F.lit(dst.a), F.col("_p") * F.lit(b)).alias("_th"),
    )
    s6 = s5.select(*keep, "_X", "_Y", "_Z", "_p", F.sin("_th").alias("_st"), F.cos("_th").alias("_ct"))
    st3 = F.col("_st") * F.col("_st") * F.col("_st")
    ct3 = F.col("_ct") * F.col("_ct") * F.col("_ct")
    return s6.select(
        *keep,
        F.degrees(
            F.atan2(F.col("_Z") + F.lit(ep2 * b) * st3, F.col("_p") - F.lit(dst.e2 * dst.a) * ct3)
        ).alias(out_lat),
        F.degrees(F.atan2(F.col("_Y"), F.col("_X"))).alias(out_lng),
    )


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = 6371000.0) -> Column:
    sp = F.sin(F.radians(lat2 - lat1) / 2.0)
    sl = F.sin(F.radians(lng2 - lng1) / 2.0)
    a = sp * sp + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * sl * sl
    return F.lit(radius * 2.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def segment_parameter(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Position in [0, 1] of the point of the segment closest to (px, py)."""
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.try_divide((px - x1) * dx + (py - y1) * dy, len2)
    return F.coalesce(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def planar(px: Column, py: Column, qx: Column, qy: Column) -> Column:
    return F.sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy))


def mercator_tile(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    tiles = float(2**zoom)
    x = F.floor((lng + 180.0) / 360.0 * tiles)
    y = F.floor((F.lit(1.0) - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * tiles)
    return x, y
