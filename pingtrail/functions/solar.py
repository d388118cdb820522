"""Sun times and day length from published low-precision equations, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from pingtrail.functions.timeutil import US, col, micros, solar_date

# Sun altitude in degrees and side of the day (-1 before noon, +1 after) per named time.
SUN_EVENTS = {
    "sunrise": (-0.833, -1),
    "sunset": (-0.833, 1),
    "sunriseEnd": (-0.3, -1),
    "sunsetStart": (-0.3, 1),
    "dawn": (-6.0, -1),
    "dusk": (-6.0, 1),
    "nauticalDawn": (-12.0, -1),
    "nauticalDusk": (-12.0, 1),
}
TWILIGHT = ("nauticalDawn", "sunrise", "sunset", "nauticalDusk")

_RAD = math.pi / 180.0


def _settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Append columns as generated output. A later filter on them then stays above this point; it
    would otherwise be rewritten through every projection below, copying the whole formula."""
    values = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(values)))


def _sun_columns(df, date, lat, lon, keep, prefix="") -> DataFrame:
    """The formulas as one select list; each term is an alias that later ones refer to."""
    terms = {
        "_lw": f"-_at_lon * {_RAD!r}D",
        "_phi": f"_at_lat * {_RAD!r}D",
        "_turn": f"_lw / {2 * math.pi!r}D",
        "_ds": "0.0009D + _turn + floor(_at_day - 0.0009D - _turn + 0.5D)",
        "_m": f"(357.5291D + 0.98560028D * _ds) * {_RAD!r}D",
        "_l": f"""_m + (1.9148D * sin(_m) + 0.02D * sin(2 * _m) + 0.0003D * sin(3 * _m)) * {_RAD!r}D
            + {102.9372 * _RAD + math.pi!r}D""",
        "_dec": f"asin({math.sin(23.4397 * _RAD)!r}D * sin(_l))",
        # days since 2000-01-01 12:00 UTC of solar noon
        "_noon": "_ds + 0.0053D * sin(_m) - 0.0069D * sin(2 * _l)",
    }
    times = {}
    for name in keep:
        altitude, side = SUN_EVENTS[name]
        ratio = f"_r{abs(altitude) * 1000:.0f}"
        terms[ratio] = (
            f"({math.sin(altitude * _RAD)!r}D - sin(_phi) * sin(_dec)) / (cos(_phi) * cos(_dec))"
        )
        half_day = f"acos(CASE WHEN abs({ratio}) <= 1 THEN {ratio} END) / {2 * math.pi!r}D"
        days = f"_noon {'+' if side > 0 else '-'} {half_day} + 10957.5D"
        times[prefix + name] = (
            f"timestamp_micros(CAST(floor(({days}) * {86400.0 * US!r}D + 0.5D) AS BIGINT))"
        )
    day = F.datediff(col(date).cast("date"), F.lit("2000-01-01").cast("date")).cast("double")
    given = df.withColumns({"_at_day": day, "_at_lat": col(lat), "_at_lon": col(lon)})
    listed = [f"{e} AS `{name}`" for name, e in {**terms, **times}.items()]
    return given.selectExpr("*", *listed).drop("_at_day", "_at_lat", "_at_lon", *terms)


def add_sun_times(
    df: DataFrame,
    date: Column | str,
    lat: Column | str,
    lon: Column | str,
    keep: tuple[str, ...] = TWILIGHT,
) -> DataFrame:
    """Append UTC timestamps of the named sun events of each row's (solar date, position).

    Null on days the sun does not cross the altitude. Intermediate terms are separate projections
    so that each is evaluated once.
    """
    hidden = {name: f"_s_{name}" for name in keep}
    out = _sun_columns(df, date, lat, lon, keep, "_s_")
    out = _settled(out, {name: F.col(h) for name, h in hidden.items()})
    return out.drop(*hidden.values())


def sun_calendar(
    sites: DataFrame, first: str, last: str, lat: str = "lat", lon: str = "lon", keep=TWILIGHT
) -> DataFrame:
    """One row per site and date of the closed range, with the named sun times."""
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return add_sun_times(sites.withColumn("date", days), "date", lat, lon, keep)


def _row_date(ts: str, lon: str, date_mode: str) -> Column:
    return solar_date(ts, lon) if date_mode == "solar" else F.to_date(col(ts).cast("timestamp"))


def with_sun(
    df: DataFrame,
    lat: str = "recvDeployLat",
    lon: str = "recvDeployLon",
    ts: str = "ts",
    keep: tuple[str, ...] = ("sunrise", "sunset"),
    date_mode: str = "solar",
) -> DataFrame:
    """Append the sun times of each row's own position and date.

    Evaluated in place: some arithmetic per row inside the scan stage costs far less than joining
    detections to a (date, station) calendar whose size grows with the data.
    """
    dated = df.withColumn("solar_date", _row_date(ts, lon, date_mode))
    return add_sun_times(dated, "solar_date", lat, lon, keep)


def time_to_sun(
    df: DataFrame,
    lat: str = "recvDeployLat",
    lon: str = "recvDeployLon",
    ts: str = "ts",
    units: str = "hours",
) -> DataFrame:
    """Append time since the latest and until the next sunrise and sunset.

    The sun times of the row's solar date and of both neighbouring dates decide.
    """
    per_unit = {"seconds": 1.0, "minutes": 60.0, "hours": 3600.0}[units] * US
    shifts = {"_p_": -1, "_c_": 0, "_n_": 1}
    joined = df.withColumn("solar_date", solar_date(ts, lon))
    for tag, shift in shifts.items():
        joined = _sun_columns(
            joined, F.date_add("solar_date", shift), lat, lon, ("sunrise", "sunset"), tag
        )
    now = micros(ts)
    out = {}
    for event, name in (("sunrise", "rise"), ("sunset", "set")):
        days = [micros(f"{tag}{event}") for tag in shifts]
        before = F.greatest(*[F.when(t <= now, t) for t in days])
        after = F.least(*[F.when(t > now, t) for t in days])
        out[event] = F.col(f"_c_{event}")
        out[f"ts_since_{name}"] = (now - before) / per_unit
        out[f"ts_to_{name}"] = (after - now) / per_unit
    return _settled(joined, out).drop(
        *[f"{tag}{event}" for tag in shifts for event in ("sunrise", "sunset")]
    )


def time_of_day(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Class of a time against the four twilight columns, cases tested in order."""
    t = F.col(ts)
    return df.withColumn(
        "time_of_day",
        F.when((t <= F.col("nauticalDawn")) | (t >= F.col("nauticalDusk")), "Night")
        .when((t > F.col("nauticalDawn")) & (t < F.col("sunrise")),
              "Pre-Sunrise Twilight (Nautical/Civil)")
        .when((t > F.col("sunset")) & (t < F.col("nauticalDusk")),
              "Post-Sunset Twilight (Civil/Nautical)")
        .otherwise("Day"),
    )


def day_length(lat: Column | str, doy: Column | str) -> Column:
    """Hours between sunrise and sunset by latitude and day of year (CBM model)."""
    phi, j = F.radians(col(lat)), F.pmod(col(doy), F.lit(365))
    tilt = F.asin(
        0.39795 * F.cos(0.2163108 + 2 * F.atan(0.9671396 * F.tan(0.0086 * (j - 186))))
    )
    ratio = (math.sin(0.8333 * _RAD) + F.sin(phi) * F.sin(tilt)) / (F.cos(phi) * F.cos(tilt))
    clamped = F.least(F.greatest(ratio, F.lit(-1.0)), F.lit(1.0))
    return 24.0 - (24.0 / math.pi) * F.acos(clamped)
