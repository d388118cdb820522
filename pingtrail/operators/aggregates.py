"""Summaries: tracks, centroids, bearings, profiles and histograms. Partial aggregation does the
heavy part before every shuffle; no operator gathers the rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pingtrail.functions.angles import circular_mean
from pingtrail.functions.timeutil import (
    clock, col, cut, from_micros, micros, round_time, seconds,
)
from pingtrail.operators.filters import has_location, normalised_signal
from pingtrail.session import measured

PATH_KEYS = [
    "motusTagID", "tagDeployID", "recvDeployName", "tagDepLon", "tagDepLat", "recvDeployLat",
    "recvDeployLon",
]
TRACK_KEYS = [
    "motusTagID", "runID", "recvDeployName", "ambigID", "tagDepLon", "tagDepLat", "recvDeployLat",
    "recvDeployLon",
]


def track_summary(
    df: DataFrame, keys: list[str] = TRACK_KEYS, project: int | None = None, strict: bool = False
) -> DataFrame:
    """Longest run and mean time per key of located detections, optionally of one tag project."""
    if project is not None:
        df = df.where(F.col("tagProjID") == project)
    located = df.where(has_location(strict=strict))
    return located.groupBy(*keys).agg(
        F.max("runLen").alias("max_runLen"),
        # mean of whole microseconds: exact sums, so the result does not depend on task order
        from_micros(F.floor(F.avg(micros("ts").cast("decimal(20,0)")))).alias("ts_mean"),
    )


def path_summary(df: DataFrame, project: int) -> DataFrame:
    return track_summary(df, PATH_KEYS, project)


def centroids(
    events: DataFrame,
    min_towers: int = 2,
    weighting: str = "stronger",
    key: str = "motusTagID",
) -> DataFrame:
    """Plain and signal-weighted mean station position of each multi-tower event.

    Weights are ``sig - min(sig) + 1`` over the event (strong pings count most), or with
    ``weighting="as_written"`` the literal ``max(sig) - sig + 1``. A weight is linear in sig, so the
    weighted sums expand into plain sums of combining aggregates; the extreme is not joined back to
    the rows. A null signal makes the weighted mean null.
    """
    event = [key, "event_id"]
    # sums per event and tower, then per event: a long event is combined before it is shuffled
    terms = {
        "n": F.lit(1), "lat": F.col("recvDeployLat"), "lon": F.col("recvDeployLon"),
        "s": F.col("sig"), "slat": F.col("sig") * F.col("recvDeployLat"),
        "slon": F.col("sig") * F.col("recvDeployLon"),
    }
    towers = events.groupBy(*event, "recvDeployName").agg(
        *[F.sum(c).alias(name) for name, c in terms.items()],
        F.count("sig").alias("n_sig"), F.min("sig").alias("lo"), F.max("sig").alias("hi"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    sums = towers.groupBy(*event).agg(
        *[F.sum(name).alias(name) for name in terms],
        F.sum("n_sig").alias("n_sig"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.min("first_ts").alias("ts"), F.max("last_ts").alias("last_ts"),
        F.count(F.lit(1)).alias("w_towers"),
    )
    n = F.col("n")
    if weighting == "stronger":
        sign, origin = 1.0, 1.0 - F.col("lo")
    elif weighting == "as_written":
        sign, origin = -1.0, 1.0 + F.col("hi")
    else:
        raise ValueError(f"unknown weighting {weighting!r}")
    total = sign * F.col("s") + origin * n

    def weighted(c: str) -> Column:
        value = (sign * F.col("s" + c) + origin * F.col(c)) / total
        return F.when(F.col("n_sig") == n, value)

    return sums.where(F.col("w_towers") >= min_towers).select(
        *event,
        (F.col("lat") / n).alias("simple_lat"), (F.col("lon") / n).alias("simple_lon"),
        weighted("lat").alias("weighted_lat"), weighted("lon").alias("weighted_lon"),
        "ts", "last_ts", "w_towers", n.alias("n_pings"),
    )


def bearing_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Signal-weighted circular mean bearing and elapsed seconds per key."""
    return df.groupBy(*keys).agg(
        circular_mean("antBearing", "sig_norm").alias("vanish_bearing"),
        (F.max(seconds("ts")) - F.min(seconds("ts"))).alias("seconds_used"),
        F.count(F.lit(1)).alias("n"),
    )


def vanishing_bearing(
    df: DataFrame,
    departures: DataFrame,
    station: str,
    min_sig: float | None = None,
    max_sig: float | None = None,
    key: str = "motusTagID",
) -> DataFrame:
    """Mean bearing of each departing tag's pings at ``station`` from its departure on."""
    bounds = {k: v for k, v in (("min_sig", min_sig), ("max_sig", max_sig)) if v is not None}
    joined = df.join(departures, key, "right").where(
        (F.col("ts") >= F.col("ts_depart")) & (F.col("recvDeployName") == station)
    )
    used = joined.withColumn("sig_norm", normalised_signal("sig", **bounds))
    return bearing_summary(used, [key, "recvDeployName", "recvDeployLat", "recvDeployLon"])


def last_per_key(df: DataFrame, key: str, ts: str, columns: list[str], ties: list[str]) -> DataFrame:
    """The latest row per key; ties go to the smallest ``ties`` (nulls last). No window needed."""
    order = [-micros(ts)]
    for c in ties:
        order += [F.isnull(c), F.col(c)]
    best = df.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return best.select(key, "_row.*")


def activity_by_clock(df: DataFrame, ts: str = "freq") -> DataFrame:
    """Rows and summed beeps per time of day."""
    return df.groupBy(clock(ts).alias("Time")).agg(
        F.count(F.lit(1)).alias("count"), F.sum("beep_count").alias("beep_count")
    )


def activity_since_sunrise(df: DataFrame, digits: int = 4) -> DataFrame:
    """Rows and summed beeps per hours since sunrise, binned to ``digits`` decimals."""
    return df.groupBy(F.round("ts_since_rise", digits).alias("ts_since_rise")).agg(
        F.count(F.lit(1)).alias("count"), F.sum("beep_count").alias("beep_count")
    )


def histogram(
    df: DataFrame, column: str, width: float | None = None, breaks: list[float] | None = None,
    hi: float | None = None,
) -> DataFrame:
    """Counts of non-null values per fixed-width bin (by its lower edge) or per right-closed break
    interval, whose first one includes its lower edge; values above ``hi`` are left out."""
    value = F.col(column)
    kept = df.where(value.isNotNull() if hi is None else ~(value > hi))
    if breaks is None:
        label = F.floor(value / width) * F.lit(float(width))
    else:
        first = f"({breaks[0]:g},{breaks[1]:g}]"
        label = F.when(value == breaks[0], first).otherwise(cut(value, breaks))
    return kept.groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("n")).where(
        "bin IS NOT NULL"
    )


def extent(df: DataFrame, lat: str, lon: str, pad: float = 2.0) -> DataFrame:
    return df.agg(
        (F.min(lon) - pad).alias("xmin"), (F.max(lon) + pad).alias("xmax"),
        (F.min(lat) - pad).alias("ymin"), (F.max(lat) + pad).alias("ymax"),
    )


def dispersion(df: DataFrame, column: str) -> DataFrame:
    mean, var = F.avg(column), F.var_samp(column)
    return df.agg(mean.alias("mean"), var.alias("var"), F.try_divide(var, mean).alias("ratio"))


def hourly_presence(df: DataFrame) -> DataFrame:
    """Distinct (tag, antenna, hour of day) combinations."""
    return df.where("recvDeployLat IS NOT NULL").select(
        "motusTagID", "port", "tagDeployStart", "tagDepLat", "tagDepLon", "recvDeployLat",
        "recvDeployLon", "recvDeployName", "antBearing", "speciesEN",
        F.year("ts").alias("year"), F.dayofyear("ts").alias("doy"), F.hour("ts").alias("hour"),
    ).distinct()


def rounded_hours(df: DataFrame, columns: list[str], ts: str = "ts") -> DataFrame:
    """Distinct rows with the time rounded to the nearest hour."""
    return df.select(*columns, round_time(ts, 3600).alias("hour")).distinct()


def daily_movement(locations: DataFrame, bin: str = "1 day") -> DataFrame:
    """Mean and standard deviation of each tag's positions per bin, with the mean +- sd box."""
    binned = locations.withColumn("bin", F.window("freq", bin)["start"])
    moved = binned.groupBy("bin", "TagId").agg(
        F.avg("avg_y").alias("Lat"),
        F.avg("avg_x").alias("Lon"),
        F.stddev_samp("avg_y").alias("std_lat"),
        F.stddev_samp("avg_x").alias("std_lon"),
        F.count(F.lit(1)).alias("N"),
    )
    box = {}
    for out, mean, sd in (("lat", "Lat", "std_lat"), ("lon", "Lon", "std_lon")):
        box[f"low{out}"] = col(mean) - col(sd)
        box[f"up{out}"] = col(mean) + col(sd)
    return moved.withColumns(box)


def incidence(
    df: DataFrame,
    keys: list[str] = ["tsCorrected", "recvDeployLat", "recvDeployLon"],
    min_points: int = 5,
    tag: str = "motusTagID",
) -> DataFrame:
    """Sparse tag x point presence: one row per present cell, tags with ``min_points`` or more.

    Zero cells and zero columns are simply absent; nothing is pivoted.
    """
    points = df.select(tag, *keys).distinct().withColumn("presence", F.lit(1))
    enough = points.groupBy(tag).agg(F.count(F.lit(1)).alias("n_points")).where(
        F.col("n_points") >= min_points
    )
    return points.join(measured(enough), tag)


def run_length_split(df: DataFrame, tag: str = "motusTagID") -> DataFrame:
    """Per tag: number of rows with run length other than 2 and equal to 2 (null when none)."""
    flagged = df.where("runLen IS NOT NULL").withColumn("is_two", F.col("runLen") == 2)
    wide = flagged.groupBy(tag).pivot("is_two", [False, True]).count()
    return wide.withColumnsRenamed({"false": "n_other", "true": "n_two"})
