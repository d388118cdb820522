"""Distances and projection on the WGS84 ellipsoid, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from pingtrail.functions.timeutil import col

# WGS84 semi-major axis (m) and flattening.
AXIS, FLAT = 6378137.0, 1 / 298.257223563
MINOR = AXIS * (1 - FLAT)
EARTH_RADIUS = 6371008.8


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dp, dl = p2 - p1, F.radians(col(lon2)) - F.radians(col(lon1))
    h = F.sin(dp / 2) * F.sin(dp / 2) + F.cos(p1) * F.cos(p2) * F.sin(dl / 2) * F.sin(dl / 2)
    # least() passes over nulls
    return F.when(h.isNotNull(), 2 * EARTH_RADIUS * F.asin(F.least(F.sqrt(h), F.lit(1.0))))


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def geodesic_m(lat1, lon1, lat2, lon2, iters: int = 8) -> Column:
    """Vincenty inverse distance in metres with a fixed number of iterations.

    Coincident points give 0; a missing coordinate gives null. Where the iteration has not settled (near-antipodal points) the
    great-circle distance is returned.
    """
    lat1, lon1, lat2, lon2 = (col(c).cast("double") for c in (lat1, lon1, lat2, lon2))
    big_l = F.radians(lon2) - F.radians(lon1)
    u1 = F.atan((1 - FLAT) * F.tan(F.radians(lat1)))
    u2 = F.atan((1 - FLAT) * F.tan(F.radians(lat2)))
    start = F.struct(
        F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"),
        F.cos(u2).alias("c2"), big_l.alias("l"),
    )

    def arc(p: Column, lam: Column) -> Column:
        a = p["c2"] * F.sin(lam)
        b = p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(lam)
        cos_sigma = p["s1"] * p["s2"] + p["c1"] * p["c2"] * F.cos(lam)
        return F.struct(
            F.sqrt(a * a + b * b).alias("sin"), cos_sigma.alias("cos"),
            (p["c1"] * p["c2"] * F.sin(lam)).alias("num"),
        )

    def angles(p: Column, g: Column) -> Column:
        sin_alpha = F.when(g["sin"] == 0, 0.0).otherwise(g["num"] / g["sin"])
        cos2_alpha = 1 - sin_alpha * sin_alpha
        mid = F.when(cos2_alpha == 0, 0.0).otherwise(
            g["cos"] - 2 * p["s1"] * p["s2"] / cos2_alpha
        )
        return F.struct(
            g["sin"].alias("sin"), g["cos"].alias("cos"), sin_alpha.alias("sa"),
            cos2_alpha.alias("ca"), mid.alias("mid"),
            F.atan2(g["sin"], g["cos"]).alias("sigma"),
        )

    def state(p: Column, lam: Column, then) -> Column:
        return _bind(arc(p, lam), lambda g: _bind(angles(p, g), then))

    def advance(p: Column, lam: Column) -> Column:
        def step(q: Column) -> Column:
            c = FLAT / 16 * q["ca"] * (4 + FLAT * (4 - 3 * q["ca"]))
            bend = q["mid"] + c * q["cos"] * (2 * q["mid"] * q["mid"] - 1)
            return p["l"] + (1 - c) * FLAT * q["sa"] * (q["sigma"] + c * q["sin"] * bend)

        return state(p, lam, step)

    def length(p: Column, lam: Column) -> Column:
        ratio = (AXIS * AXIS - MINOR * MINOR) / (MINOR * MINOR)

        def finish(q: Column) -> Column:
            uu = q["ca"] * ratio
            a = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
            b = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
            mm = q["mid"] * q["mid"]
            ds = b * q["sin"] * (
                q["mid"] + b / 4 * (
                    q["cos"] * (2 * mm - 1)
                    - b / 6 * q["mid"] * (4 * q["sin"] * q["sin"] - 3) * (4 * mm - 3)
                )
            )
            return MINOR * a * (q["sigma"] - ds)

        return state(p, lam, finish)

    def solve(p: Column) -> Column:
        trail = F.aggregate(
            F.sequence(F.lit(1), F.lit(iters)),
            F.struct(p["l"].alias("prev"), p["l"].alias("cur")),
            lambda acc, _: F.struct(acc["cur"].alias("prev"), advance(p, acc["cur"]).alias("cur")),
        )
        return _bind(
            trail,
            lambda t: F.when(F.abs(t["cur"] - t["prev"]) < 1e-9, length(p, t["cur"])),
        )

    return F.coalesce(_bind(start, solve), haversine_m(lat1, lon1, lat2, lon2))


def to_utm(lat, lon, zone: int = 13) -> tuple[Column, Column]:
    """(easting, northing) in metres of the northern UTM ``zone`` by the Krueger series."""
    n = FLAT / (2 - FLAT)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    )
    ecc = 2 * math.sqrt(n) / (1 + n)
    phi = F.radians(col(lat))
    lam = F.radians(col(lon)) - math.radians(6 * zone - 183)
    t = F.sinh(F.atanh(F.sin(phi)) - ecc * F.atanh(ecc * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    scale = 0.9996 * radius
    return 500000.0 + scale * east, scale * north


def local_xy_m(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """East and north metres about a nearby origin."""
    lat, lon, lat0, lon0 = (col(c) for c in (lat, lon, lat0, lon0))
    east = EARTH_RADIUS * F.radians(lon - lon0) * F.cos(F.radians(lat0))
    return east, EARTH_RADIUS * F.radians(lat - lat0)
