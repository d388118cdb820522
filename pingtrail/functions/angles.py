"""Bearings: categories, compass sectors and circular means."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pingtrail.functions.timeutil import col

SECTORS = ["Northeast", "East", "Southeast", "South", "Southwest", "West", "Northwest"]
NO_SECTOR = "Unknown/Omni"


def wrap_degrees(angle: Column | str) -> Column:
    return F.pmod(col(angle), F.lit(360.0))


def compass_sector(angle: Column | str, wrap: bool = True) -> Column:
    """Eight-way sector; bounds are inclusive and the first match in written order wins.

    ``wrap=False`` is the literal form, in which North never matches and negative bearings have
    no sector.
    """
    bearing = wrap_degrees(angle) if wrap else col(angle)
    out = F.when((bearing >= 337.5) | (bearing <= 22.5), "North") if wrap else None
    for i, name in enumerate(SECTORS):
        inside = bearing.between(22.5 + 45.0 * i, 67.5 + 45.0 * i)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise(NO_SECTOR)


def bearing_category(angle: Column | str) -> Column:
    """Category by exact value (not the compass convention); anything else is null."""
    a = col(angle)
    return F.when(a == 90, "N").when(a == 0, "E").when(a == 180, "S").when(a == 270, "W")


def circular_mean(angle: Column | str, weight: Column | str | None = None) -> Column:
    """Aggregate: weighted mean direction in [0, 360); null when the directions cancel out.

    A null angle or weight in the group makes the mean null.
    """
    theta = F.radians(col(angle))
    w = F.lit(1.0) if weight is None else col(weight)
    east, north, n = F.sum(w * F.sin(theta)), F.sum(w * F.cos(theta)), F.count(F.lit(1))
    mean = wrap_degrees(F.degrees(F.atan2(east, north)))
    # a tiny negative angle wraps to exactly 360
    mean = F.when(mean >= 360.0, 0.0).otherwise(mean)
    complete = F.count(w * theta) == n
    return F.when(complete & (F.sqrt(east * east + north * north) / n >= 1e-12), mean)
