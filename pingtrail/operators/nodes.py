"""Grid-node beeps: enrichment, resampling and signal-strength localisation.

Localisation formulas are this library's own choice from published practice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pingtrail.functions.geo import EARTH_RADIUS, haversine_m, local_xy_m
from pingtrail.functions.timeutil import col
from pingtrail.operators.joins import interval_join


def known_beeps(beeps: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Beeps with a node, of the tag list when given."""
    beeps = beeps.where("NodeId IS NOT NULL")
    if tags is not None:
        beeps = beeps.join(tags.select("TagId").distinct(), "TagId", "left_semi")
    return beeps


def enrich_beeps(beeps: DataFrame, nodes: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Beeps with their node's position, restricted to the tag list when given."""
    placed = nodes.select(
        "NodeId", F.col("lat").alias("node_lat"), F.col("lng").alias("node_lng")
    )
    return known_beeps(beeps, tags).join(placed, "NodeId")


def resample_beeps(
    beeps: DataFrame,
    nodes: DataFrame,
    freq: str = "3 minutes",
    tags: DataFrame | None = None,
    drop_single: bool = False,
) -> DataFrame:
    """Per tag, node and time bin: strongest and sd of signal, beeps, node position mode and mean.

    Beeps are reduced to bins before node positions are joined; positions are summarised per node.
    ``drop_single`` removes bins of one beep, whose sd is null.
    """
    bins = F.window(F.col("Time").cast("timestamp"), freq)["start"]
    out = known_beeps(beeps, tags).groupBy("TagId", "NodeId", bins.alias("freq")).agg(
        F.max("TagRSSI").alias("TagRSSI_max"),
        F.stddev_samp("TagRSSI").alias("TagRSSI_sd"),
        F.count(F.lit(1)).alias("beep_count"),
    )
    if drop_single:
        out = out.where("TagRSSI_sd IS NOT NULL")
    positions = nodes.groupBy("NodeId").agg(
        F.mode("lat", True).alias("node_lat_mode"),
        F.mode("lng", True).alias("node_lng_mode"),
        F.avg("lat").alias("node_lat_mean"),
        F.avg("lng").alias("node_lng_mean"),
    )
    return out.join(positions, "NodeId").select(
        "TagId", "NodeId", "freq", "TagRSSI_max", "TagRSSI_sd", "beep_count", "node_lat_mode",
        "node_lng_mode", "node_lat_mean", "node_lng_mean",
    )


def resample_many(beeps: DataFrame, nodes: DataFrame, freqs_s: list[int], tags=None) -> DataFrame:
    """Strongest signal and beeps for several bin widths (seconds) in one pass."""
    placed = known_beeps(beeps, tags).join(nodes.select("NodeId").distinct(), "NodeId", "left_semi")
    width = F.explode(F.array(*[F.lit(int(f)) for f in freqs_s]))
    wide = placed.withColumn("freq_s", width)
    epoch = F.unix_seconds(F.col("Time").cast("timestamp"))
    start = F.timestamp_seconds(epoch - F.pmod(epoch, F.col("freq_s")))
    return wide.groupBy("freq_s", "TagId", "NodeId", start.alias("freq")).agg(
        F.max("TagRSSI").alias("TagRSSI_max"), F.count(F.lit(1)).alias("beep_count")
    )


def linear_power(rssi: Column | str) -> Column:
    """Received power relative to 1 mW."""
    return F.pow(F.lit(10.0), col(rssi) / 10.0)


def weighted_location(
    beeps: DataFrame,
    nodes: DataFrame,
    freq: str = "3 minutes",
    max_nodes: int = 0,
    min_rssi: float | None = None,
    tags: DataFrame | None = None,
    min_nodes: int = 0,
) -> DataFrame:
    """Power-weighted mean node position per tag and bin, from each node's strongest beep.

    ``max_nodes`` keeps the strongest nodes of a bin (0 = all); only bins with more than
    ``min_nodes`` nodes are returned. The ranking window holds one row per node of a bin.
    """
    heard = known_beeps(beeps, tags)
    if min_rssi is not None:
        heard = heard.where(F.col("TagRSSI") >= min_rssi)
    bins = F.window(F.col("Time").cast("timestamp"), freq)["start"]
    strongest_beep = heard.groupBy("TagId", bins.alias("freq"), "NodeId").agg(
        F.max("TagRSSI").alias("rssi")
    )
    per_node = enrich_beeps(strongest_beep, nodes)
    if max_nodes:
        strongest = Window.partitionBy("TagId", "freq").orderBy(F.col("rssi").desc(), "NodeId")
        per_node = per_node.withColumn("_r", F.row_number().over(strongest)).where(
            F.col("_r") <= max_nodes
        )
    w = linear_power("rssi")
    located = per_node.groupBy("TagId", "freq").agg(
        (F.sum(w * F.col("node_lng")) / F.sum(w)).alias("avg_x"),
        (F.sum(w * F.col("node_lat")) / F.sum(w)).alias("avg_y"),
        F.count("NodeId").alias("unique_nodes")  # a row is a node,
    )
    return located.where(F.col("unique_nodes") > min_nodes)


def calibrate(
    beeps: DataFrame, calibration: DataFrame, nodes: DataFrame, cell_s: float = 3600.0
) -> DataFrame:
    """Beeps of each calibration session with the node's distance from the known tag position."""
    placed = enrich_beeps(beeps, nodes)
    joined = interval_join(placed, calibration, ["TagId"], "Time", "start", "end", cell_s)
    return joined.withColumn(
        "distance", haversine_m("TagLat", "TagLng", "node_lat", "node_lng")
    )


def fit_relation(calibrated: DataFrame) -> DataFrame:
    """One row: RSSI = intercept + slope x ln(distance), and the range of distances that it was fitted on."""
    used = calibrated.where("distance > 0 AND TagRSSI IS NOT NULL").select(
        "TagRSSI", F.log("distance").alias("x")
    )
    return used.agg(
        F.regr_slope("TagRSSI", "x").alias("slope"),
        F.regr_intercept("TagRSSI", "x").alias("intercept"),
        F.regr_r2("TagRSSI", "x").alias("r2"),
        F.count(F.lit(1)).alias("n"),
        F.exp(F.min("x")).alias("nearest"),
        F.exp(F.max("x")).alias("farthest"),
    )


def predicted_distance(relation: DataFrame, rssi: Column) -> Column:
    """Metres at which the relation (one row) expects this signal."""
    of = lambda c: relation.select(c).scalar()
    log = F.try_divide(rssi - of("intercept"), of("slope"))
    if {"nearest", "farthest"} <= set(relation.columns):
        log = F.least(F.greatest(log, F.log(of("nearest"))), F.log(of("farthest")))
    return F.when(rssi.isNotNull(), F.exp(log))


def multilaterate(resampled: DataFrame, relation: DataFrame) -> DataFrame:
    """Least-squares position per tag and bin from distances predicted by ``relation`` (one row).

    Where the relation tells the range it was fitted on (nearest, farthest), distances stay within it: a logarithm that
    is extrapolated soon leaves the earth.

    Linearised range equations: two normal equations from grouped sums, solved in closed form. Null
    below three nodes or when they are collinear. Window and sums share one exchange on (tag, bin),
    whose groups hold one row per node.
    """
    bin_nodes = Window.partitionBy("TagId", "freq")
    x, y = local_xy_m("node_lat_mode", "node_lng_mode", "lat0", "lng0")
    pts = (
        resampled.withColumns(
            {
                "lat0": F.avg("node_lat_mode").over(bin_nodes),
                "lng0": F.avg("node_lng_mode").over(bin_nodes),
            }
        )
        .withColumn("d", predicted_distance(relation, F.col("TagRSSI_max")))
        .withColumns({"x": x, "y": y})
        .withColumn("q", F.col("x") * F.col("x") + F.col("y") * F.col("y")
                    - F.col("d") * F.col("d"))
    )
    sums = pts.groupBy("TagId", "freq").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.first("lat0").alias("lat0"),
        F.first("lng0").alias("lng0"),
        *[
            F.covar_samp(a, b).alias(f"s{a}{b}")
            for a, b in (("x", "x"), ("y", "y"), ("x", "y"), ("x", "q"), ("y", "q"))
        ],
        F.avg("x").alias("mx"),
        F.avg("y").alias("my"),
    )
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    solid = (F.col("n_nodes") >= 3) & (F.abs(det) > 1e-6 * F.col("sxx") * F.col("syy"))
    east = (F.col("sxq") * F.col("syy") - F.col("syq") * F.col("sxy")) / (2 * det)
    north = (F.col("syq") * F.col("sxx") - F.col("sxq") * F.col("sxy")) / (2 * det)
    return sums.select(
        "TagId", "freq", "n_nodes",
        F.when(solid, F.col("lat0") + F.degrees(north / EARTH_RADIUS)).alias("lat"),
        F.when(
            solid,
            F.col("lng0") + F.degrees(east / (EARTH_RADIUS * F.cos(F.radians("lat0")))),
        ).alias("lng"),
    )
