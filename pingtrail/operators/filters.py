"""Row filters and per-row derivations. All stay inside one scan stage; none shuffles except the
equi-joins against metadata tables, which are broadcast only by their known or counted size."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from pingtrail.functions.fixed import MAX_SIG, MIN_SIG, STUDY_BOX
from pingtrail.functions.timeutil import col
from pingtrail.session import measured


def standard_filter(
    df: DataFrame,
    test: int | None = 0,
    named_only: bool = True,
    sites: list[str] | None = None,
    not_sites: list[str] = (),
    not_receivers: list[str] = (),
    receivers: list[str] | None = None,
    mfg: str | None = None,
    species: str | None = None,
) -> DataFrame:
    """Usual detection filter; rows whose tested column is null are dropped."""
    keep = []
    if test is not None:
        keep.append(F.col("tagDeployTest") == test)
    if named_only:
        keep.append(F.col("recvDeployName").isNotNull())
    if sites is not None:
        keep.append(F.col("recvSiteName").isin(list(sites)))
    keep += [F.col("recvSiteName") != s for s in not_sites]
    keep += [F.col("recvDeployName") != r for r in not_receivers]
    if receivers is not None:
        keep.append(F.col("recvDeployName").isin(list(receivers)))
    if mfg is not None:
        keep.append(F.col("mfg") == mfg)
    if species is not None:
        keep.append(F.col("speciesEN") == species)
    return reduce(lambda d, c: d.where(c), keep, df)


def bbox(
    df: DataFrame,
    lat_min: float = STUDY_BOX[0],
    lat_max: float = STUDY_BOX[1],
    lon_min: float = STUDY_BOX[2],
    lon_max: float = STUDY_BOX[3],
    lat: str = "recvDeployLat",
    lon: str = "recvDeployLon",
) -> DataFrame:
    return df.where(F.col(lat).between(lat_min, lat_max) & F.col(lon).between(lon_min, lon_max))


def time_slice(
    df: DataFrame,
    lo: str | None = None,
    hi: str | None = None,
    tag=None,
    station: str | None = None,
    ts: str = "ts",
    tag_col: str = "motusTagID",
) -> DataFrame:
    """Exclusive time window, optionally of one tag and one station.

    Bounds are cast strictly, so a malformed literal such as ``19:18:000`` is an error. Ids of
    text columns are compared as text.
    """
    if lo is not None:
        df = df.where(F.col(ts) > F.lit(lo).cast("timestamp"))
    if hi is not None:
        df = df.where(F.col(ts) < F.lit(hi).cast("timestamp"))
    if tag is not None:
        text = dict(df.dtypes)[tag_col] == "string"
        df = df.where(F.col(tag_col) == F.lit(str(tag) if text else tag))
    if station is not None:
        df = df.where(F.col("recvDeployName") == station)
    return df


def split_runs(
    df: DataFrame, by: str = "motusFilter", min_len: int = 3
) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): good against dubious runs, or long runs against two-ping runs."""
    if by == "motusFilter":
        return df.where("motusFilter = 1"), df.where("motusFilter = 0")
    if by == "runLen":
        kept = df.where(F.col("runLen") >= min_len)
        removed = df.where(F.col("runLen") == min_len - 1)
        return kept, removed.select("motusTagID", "runID").distinct()
    raise ValueError(f"unknown run filter {by!r}")


def short_runs(df: DataFrame, max_len: int = 3) -> DataFrame:
    return df.where(F.col("runLen") <= max_len)


def apply_run_filter(
    df: DataFrame, run_filter: DataFrame, default: float = 1.0, above: float = 0.0
) -> DataFrame:
    """Attach run probabilities (unlisted runs count as ``default``) and keep those above."""
    joined = df.join(run_filter, ["runID", "motusTagID"], "left")
    filled = joined.withColumn("probability", F.coalesce("probability", F.lit(default)))
    return filled.where(F.col("probability") > above)


RECEIVER_COLUMNS = [
    "recvDeployLat", "recvDeployLon", "recvDeployName", "recvDeployID", "recv", "recvProjID",
    "recvProjName",
]


def missing_locations(df: DataFrame, columns: list[str] = RECEIVER_COLUMNS) -> DataFrame:
    """Distinct receivers lacking a latitude or a name."""
    lacking = df.where("recvDeployLat IS NULL OR recvDeployName IS NULL")
    return lacking.select(*columns).distinct()


def has_location(lat: str = "recvDeployLat", strict: bool = False) -> Column:
    """Latitude present; a latitude of 0 passes unless ``strict``."""
    known = F.col(lat).isNotNull()
    return known & (F.col(lat) != 0) if strict else known


def fill_station_name(df: DataFrame) -> DataFrame:
    """Missing name becomes ``lat:lon`` (up to 12 decimals), null without coordinates."""

    def text(c: str) -> Column:
        plain = F.col(c).cast("decimal(20,12)").cast("string")
        return F.regexp_replace(F.regexp_replace(plain, "0+$", ""), "\\.$", "")

    position = F.concat(text("recvDeployLat"), F.lit(":"), text("recvDeployLon"))
    known = F.col("recvDeployLat").isNotNull() & F.col("recvDeployLon").isNotNull()
    return df.withColumn("recvDeployName", F.coalesce("recvDeployName", F.when(known, position)))


def receiver_position(df: DataFrame) -> DataFrame:
    """GPS position with fallback to the deployment: null or 0 for lat/lon, null for altitude."""

    def usable(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(0.0))

    return df.withColumns(
        {
            "recvLat": F.coalesce(usable("gpsLat"), F.col("recvDeployLat")),
            "recvLon": F.coalesce(usable("gpsLon"), F.col("recvDeployLon")),
            "recvAlt": F.coalesce("gpsAlt", "recvDeployAlt"),
        }
    )


def correct_bearing(df: DataFrame, offsets: DataFrame, wrap: bool = False) -> DataFrame:
    """``antBearing_adj`` = bearing plus the station's offset (0 when unlisted), not wrapped."""
    shifted = F.col("antBearing") + F.coalesce("_offset", F.lit(0.0))
    if wrap:
        shifted = F.pmod(shifted, F.lit(360.0))
    table = offsets.select("recvDeployName", F.col("offset").alias("_offset"))
    return (
        df.join(table, "recvDeployName", "left")
        .withColumn("antBearing_adj", shifted)
        .drop("_offset")
    )


def ambiguity(column: str = "ambigID") -> Column:
    return F.when(F.col(column).isNotNull(), "ambiguous tag").otherwise("okay tag")


def normalised_signal(
    sig: Column | str = "sig", min_sig: float = MIN_SIG, max_sig: float = MAX_SIG
) -> Column:
    return (col(sig) - min_sig) / (max_sig - min_sig)


def normalise_by_station(df: DataFrame) -> DataFrame:
    """Normalise against each station's own observed range instead of a fixed one.

    Rows without a station stay, with a null value.
    """
    span = measured(
        df.where("recvDeployName IS NOT NULL").groupBy("recvDeployName").agg(
            F.min("sig").alias("_lo"), F.max("sig").alias("_hi")
        )
    )
    scaled = (F.col("sig") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return df.join(span, "recvDeployName", "left").withColumn("sig_norm", scaled).drop("_lo", "_hi")


def label_nodes(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Upper-case node ids and replace the listed ones with their grid label."""
    table = labels.select(F.col("NodeId"), F.col("label").alias("_label"))
    upper = df.withColumn("NodeId", F.upper("NodeId"))
    return (
        upper.join(table, "NodeId", "left")
        .withColumn("NodeId", F.coalesce("_label", "NodeId"))
        .drop("_label")
    )


def incomplete_rows(df: DataFrame) -> DataFrame:
    return df.where(reduce(or_, [F.col(c).isNull() for c in df.columns]))


def without_port(df: DataFrame, port: str = "L5") -> DataFrame:
    return df.where(F.col("port") != port)


def with_bearing(df: DataFrame) -> DataFrame:
    """Antenna detections only: grid nodes have no bearing."""
    return df.where(F.col("antBearing").isNotNull())


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every column the two sides share, nulls matching nulls."""
    shared = [c for c in left.columns if c in right.columns]
    on = reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in shared])
    return left.join(right, on, "left").drop(*[right[c] for c in shared])


def in_table(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_semi")
