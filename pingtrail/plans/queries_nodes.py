"""Sun calendar, geography, grid nodes, localisation and streaming forms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pingtrail.functions import fixed, geo, solar
from pingtrail.operators import aggregates as agg, joins, nodes as nd
from pingtrail.plans import analyses as an
from pingtrail.plans.oracle import LABELS, NODES_CTE, query as q, r6, solar_day, sun
from pingtrail.plans.queries_events import TIME_OF_DAY, TWILIGHT
from pingtrail.plans.registry import query, scratch
from pingtrail.session import measured
from pingtrail.streaming import streams

DET = "detections"
MONTH = 2592000
THIRTY = "30 days"
SITE = (fixed.SUN_SITE_LAT, fixed.SUN_SITE_LON)
RISE_SET = {k: solar.SUN_EVENTS[k] for k in ("sunrise", "sunset")}


def binned(time: str, seconds: int) -> str:
    us = seconds * 1_000_000
    return f"(epoch_us({time}) - epoch_us({time}) % {us})"


# ---- sun ----------------------------------------------------------------------------------------

DAYS = """days AS (SELECT CAST(unnest(generate_series(date_trunc('day', min(ts)),
    date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS DATE) AS date FROM detections)"""


def calendar(t):
    """Sun times of every date of the detections at the fixed site."""
    span = t.detections.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("date"))
    return days.withColumns({"lat": F.lit(SITE[0]), "lon": F.lit(SITE[1])})


@query("L1_sun_calendar", q(DET, DAYS,
    f"cal AS ({sun('days', 'date', f'{SITE[0]}e0', f'{SITE[1]}e0', solar.SUN_EVENTS)})",
    body="SELECT CAST(date AS VARCHAR) AS date, " + ", ".join(
        f"CAST(floor({c} / 1000e0) AS BIGINT) AS {c}" for c in solar.SUN_EVENTS) + " FROM cal"))
def _(t):
    keep = tuple(solar.SUN_EVENTS)
    cal = solar.add_sun_times(calendar(t), "date", "lat", "lon", keep)
    return cal.select(
        "date", *[F.floor(F.unix_micros(c) / 1000.0).cast("bigint").alias(c) for c in keep]
    )


@query("J2_F19_join_on_date", q(DET, DAYS,
    f"cal AS ({sun('days', 'date', f'{SITE[0]}e0', f'{SITE[1]}e0', TWILIGHT)})",
    body=f"""SELECT hitID, {TIME_OF_DAY} AS time_of_day FROM (
        SELECT hitID, {solar_day('ts', f'{SITE[1]}e0')} AS day, epoch_us(ts) AS us FROM detections)
        LEFT JOIN cal ON day = cal.date"""))
def _(t):
    from pingtrail.functions.timeutil import solar_date

    cal = solar.add_sun_times(calendar(t), "date", "lat", "lon")
    dated = t.detections.select("hitID", "ts", solar_date("ts", F.lit(SITE[1])).alias("date"))
    return solar.time_of_day(dated.join(cal, "date", "left")).select("hitID", "time_of_day")


@query("L2_sunrise_sunset_per_detection", q(DET,
    f"""dated AS (SELECT hitID, recvDeployLat, recvDeployLon,
        {solar_day('ts', 'recvDeployLon')} AS day FROM detections)""",
    f"cal AS ({sun('dated', 'day', 'recvDeployLat', 'recvDeployLon', RISE_SET)})",
    body="""SELECT hitID, CAST(floor(sunrise / 1000e0) AS BIGINT) AS sunrise,
        CAST(floor(sunset / 1000e0) AS BIGINT) AS sunset FROM cal"""))
def _(t):
    lit = solar.with_sun(t.detections.select("hitID", "ts", "recvDeployLat", "recvDeployLon"))
    return lit.select(
        "hitID",
        *[F.floor(F.unix_micros(c) / 1000.0).cast("bigint").alias(c) for c in RISE_SET],
    )


@query("L4_day_length", q(DET, body=f"""SELECT doy, {r6('''24 - (24 / pi()) * acos(least(greatest(
    (sin(radians(0.8333e0)) + sin(phi) * sin(p)) / (cos(phi) * cos(p)), -1), 1))''', 'hours')} FROM (
    SELECT doy, radians(36.48946e0) AS phi, asin(0.39795e0 * cos(0.2163108e0
        + 2 * atan(0.9671396e0 * tan(0.0086e0 * (doy % 365 - 186))))) AS p
    FROM (SELECT DISTINCT CAST(dayofyear(ts) AS INT) AS doy FROM detections))"""))
def _(t):
    days = t.detections.select(F.dayofyear("ts").alias("doy")).distinct()
    return days.select("doy", solar.day_length(F.lit(36.48946), "doy").alias("hours"))


@query("L4_day_length_from_sun", q(DET, DAYS,
    f"cal AS ({sun('days', 'date', f'{SITE[0]}e0', f'{SITE[1]}e0', RISE_SET)})",
    body=f"""SELECT CAST(date AS VARCHAR) AS date,
        {r6('(sunset - sunrise) / 3600000000e0', 'hours')} FROM cal"""))
def _(t):
    cal = solar.add_sun_times(calendar(t), "date", "lat", "lon", ("sunrise", "sunset"))
    span = F.unix_micros("sunset") - F.unix_micros("sunrise")
    return cal.select("date", (span / 3.6e9).alias("hours"))


def _utm_sql(lat: str, lon: str) -> tuple[str, str]:
    n = geo.FLAT / (2 - geo.FLAT)
    ecc = 2 * math.sqrt(n) / (1 + n)
    scale = 0.9996 * geo.AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alphas = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    t = f"sinh(atanh(sin(radians({lat}))) - {ecc!r} * atanh({ecc!r} * sin(radians({lat}))))"
    lam = f"radians({lon} + 105)"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + {t} * {t}))"
    east = " + ".join([eta] + [
        f"{a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(alphas, 1)])
    north = " + ".join([xi] + [
        f"{a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(alphas, 1)])
    return f"500000 + {scale!r} * ({east})", f"{scale!r} * ({north})"


_EAST, _NORTH = _utm_sql("recvDeployLat", "recvDeployLon")


@query("L6_utm_projection", q(DET, body=f"""SELECT hitID, {r6(_EAST, 'easting', 3)},
    {r6(_NORTH, 'northing', 3)} FROM detections"""))
def _(t):
    east, north = geo.to_utm("recvDeployLat", "recvDeployLon", 13)
    return t.detections.select(
        "hitID", F.round(east, 3).alias("easting"), F.round(north, 3).alias("northing")
    )


def vincenty_sql(source: str, p1: tuple[str, str], p2: tuple[str, str], iters: int = 8) -> list[str]:
    """CTEs v0..v<iters>, then ``measured`` with metres in column m."""
    f, a, b = repr(geo.FLAT), repr(geo.AXIS), repr(geo.MINOR)
    ctes = [f"""v0 AS (SELECT *, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2,
        big AS lam FROM (SELECT *, atan((1 - {f}) * tan(radians({p1[0]}))) AS u1,
        atan((1 - {f}) * tan(radians({p2[0]}))) AS u2, radians({p2[1]}) - radians({p1[1]}) AS big
        FROM {source}))"""]
    parts = """SELECT *, atan2(ss, cs) AS sg, 1 - sa * sa AS ca,
        CASE WHEN 1 - sa * sa = 0 THEN 0 ELSE cs - 2 * s1 * s2 / (1 - sa * sa) END AS mid FROM (
        SELECT *, CASE WHEN ss = 0 THEN 0 ELSE c1 * c2 * sin(lam) / ss END AS sa FROM (
        SELECT *, sqrt((c2 * sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * cos(lam)) ** 2) AS ss,
        s1 * s2 + c1 * c2 * cos(lam) AS cs FROM {src}))"""
    for i in range(iters):
        ctes.append(f"""v{i + 1} AS (SELECT * EXCLUDE (lam, ss, cs, sa, sg, ca, mid, c),
            big + (1 - c) * {f} * sa * (sg + c * ss * (mid + c * cs * (2 * mid * mid - 1))) AS lam
            FROM (SELECT *, {f} / 16 * ca * (4 + {f} * (4 - 3 * ca)) AS c
            FROM ({parts.format(src=f'v{i}')})))""")
    ctes.append(f"""measured AS (SELECT *, {b} * aa * (sg - bb * ss * (mid + bb / 4 * (cs *
        (2 * mid * mid - 1) - bb / 6 * mid * (4 * ss * ss - 3) * (4 * mid * mid - 3)))) AS m FROM (
        SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS aa,
        uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS bb FROM (
        SELECT *, ca * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS uu
        FROM ({parts.format(src=f'v{iters}')}))))""")
    return ctes


PLACED = f"""placed AS (SELECT hitID, recvDeployLat AS a1, recvDeployLon AS o1, tagDepLat AS a2,
    tagDepLon AS o2 FROM {DET})"""


@query("L5_geodesic_distance", q(DET, PLACED, *vincenty_sql("placed", ("a1", "o1"), ("a2", "o2")),
    body=f"SELECT hitID, {r6('m / 1000', 'km', 5)} FROM measured"))
def _(t):
    km = geo.geodesic_m("recvDeployLat", "recvDeployLon", "tagDepLat", "tagDepLon") / 1000.0
    return t.detections.select("hitID", F.round(km, 5).alias("km"))


@query("L5_haversine_distance", q(DET, PLACED, body=f"""SELECT hitID, {r6('''CASE WHEN a1 + o1 + a2 + o2 IS NOT NULL THEN
    2 * 6371.0088e0 * asin(least(sqrt(sin(radians(a2 - a1) / 2) ** 2 + cos(radians(a1)) * cos(radians(a2))
    * sin(radians(o2 - o1) / 2) ** 2), 1)) END''', 'km', 5)} FROM placed"""))
def _(t):
    km = geo.haversine_m("recvDeployLat", "recvDeployLon", "tagDepLat", "tagDepLon") / 1000.0
    return t.detections.select("hitID", F.round(km, 5).alias("km"))


# ---- node activity ------------------------------------------------------------------------------


def resampled_sql(seconds: int = MONTH, having: str = "true") -> str:
    return f"""res AS (SELECT TagId, b.NodeId, {binned('Time', seconds)} AS freq,
        max(TagRSSI) AS mx, stddev_samp(TagRSSI) AS sd, count(*) AS beep_count,
        any_value(lat) AS node_lat_mode, any_value(lng) AS node_lng_mode
        FROM beeps b JOIN nodes n ON b.NodeId = n.NodeId GROUP BY ALL HAVING {having})"""


MULTI = "count(*) > 1"


@query("J8_enrich_beeps", q("beeps", NODES_CTE, body="""SELECT TagId, b.NodeId, lat AS node_lat,
    lng AS node_lng, count(*) AS n FROM beeps b JOIN nodes n ON b.NodeId = n.NodeId
    WHERE TagId IN (SELECT TagId FROM beeps GROUP BY TagId HAVING count(*) > 4) GROUP BY ALL"""))
def _(t):
    busy = t.beeps.groupBy("TagId").agg(F.count(F.lit(1)).alias("n")).where("n > 4")
    placed = nd.enrich_beeps(t.beeps, t.nodes, busy)
    return placed.groupBy("TagId", "NodeId", "node_lat", "node_lng").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("A10_resampled_beeps", q("beeps", NODES_CTE, resampled_sql(), body=f"""SELECT TagId, NodeId,
    freq, mx AS TagRSSI_max, {r6('sd', 'TagRSSI_sd')}, beep_count, node_lat_mode, node_lng_mode,
    {r6('node_lat_mode', 'node_lat_mean')}, {r6('node_lng_mode', 'node_lng_mean')} FROM res"""))
def _(t):
    return nd.resample_beeps(t.beeps, t.nodes, THIRTY)


@query("F25_multi_beep_bins", q("beeps", NODES_CTE, resampled_sql(having=MULTI), body=f"""
    SELECT TagId, NodeId, freq, {r6('sd', 'TagRSSI_sd')}, beep_count FROM res"""))
def _(t):
    res = nd.resample_beeps(t.beeps, t.nodes, THIRTY, drop_single=True)
    return res.select("TagId", "NodeId", "freq", "TagRSSI_sd", "beep_count")


@query("N6_several_bin_widths", q("beeps", NODES_CTE, body=" UNION ALL ".join(
    f"""SELECT {s} AS freq_s, TagId, b.NodeId, {binned('Time', s)} AS freq, max(TagRSSI)
        AS TagRSSI_max, count(*) AS beep_count FROM beeps b JOIN nodes n ON b.NodeId = n.NodeId
        GROUP BY ALL""" for s in (86400, MONTH))))
def _(t):
    return nd.resample_many(t.beeps, t.nodes, [86400, MONTH])


@query("A11_activity_by_clock", q("beeps", NODES_CTE, resampled_sql(10800), body="""SELECT
    strftime(make_timestamp(freq), '%H:%M:%S') AS Time, count(*) AS count,
    CAST(sum(beep_count) AS BIGINT) AS beep_count FROM res GROUP BY ALL"""))
def _(t):
    return agg.activity_by_clock(nd.resample_beeps(t.beeps, t.nodes, "3 hours"))


@query("Q6_activity_budget", q("beeps", NODES_CTE, LABELS, resampled_sql(10800), body="""SELECT TagId,
    label AS NodeId, strftime(make_timestamp(freq), '%H:%M:%S') AS Time, count(*) AS count,
    CAST(sum(beep_count) AS BIGINT) AS beep_count FROM res JOIN node_labels l
    ON upper(res.NodeId) = l.NodeId GROUP BY ALL"""))
def _(t):
    return an.activity_budget(nd.resample_beeps(t.beeps, t.nodes, "3 hours"), t.labels)


# ---- localisation -------------------------------------------------------------------------------


def located_sql(where: str = "true", keep: str = "true", having: str = "true") -> str:
    w = "10 ** (rssi / 10)"
    return f"""loc AS (SELECT TagId, freq, sum({w} * lng) / sum({w}) AS avg_x,
        sum({w} * lat) / sum({w}) AS avg_y, count(DISTINCT NodeId) AS unique_nodes FROM (
        SELECT *, row_number() OVER (PARTITION BY TagId, freq ORDER BY rssi DESC, NodeId) AS r FROM (
        SELECT TagId, {binned('Time', MONTH)} AS freq, b.NodeId, lat, lng, max(TagRSSI) AS rssi
        FROM beeps b JOIN nodes n ON b.NodeId = n.NodeId WHERE {where} GROUP BY ALL))
        WHERE {keep} GROUP BY TagId, freq HAVING {having})"""


LOC_BODY = f"""SELECT TagId, freq, {r6('avg_x', 'avg_x')}, {r6('avg_y', 'avg_y')}, unique_nodes
    FROM loc"""


@query("N1_weighted_location", q("beeps", NODES_CTE, located_sql(), body=LOC_BODY))
def _(t):
    return nd.weighted_location(t.beeps, t.nodes, THIRTY)


@query("N1_strongest_nodes", q("beeps", NODES_CTE,
                               located_sql("TagRSSI >= -80", "r <= 4"), body=LOC_BODY))
def _(t):
    return nd.weighted_location(t.beeps, t.nodes, THIRTY, max_nodes=4, min_rssi=-80.0)


@query("N2_minimum_nodes", q("beeps", NODES_CTE, located_sql(
    having="count(DISTINCT NodeId) > 1"), body=LOC_BODY))
def _(t):
    return nd.weighted_location(t.beeps, t.nodes, THIRTY, min_nodes=1)


MOVED = f"""moved AS (SELECT *, Lat - std_lat AS lowlat, Lat + std_lat AS uplat,
    Lon - std_lon AS lowlon, Lon + std_lon AS uplon FROM (
    SELECT freq - freq % {12 * MONTH * 1000000} AS bin, TagId, avg(avg_y) AS Lat, avg(avg_x) AS Lon,
    stddev_samp(avg_y) AS std_lat, stddev_samp(avg_x) AS std_lon, count(*) AS N FROM loc GROUP BY ALL))"""
MOVE_COLS = ["Lat", "Lon", "std_lat", "std_lon", "lowlat", "uplat", "lowlon", "uplon"]
MOVE_BODY = "SELECT bin, TagId, N, " + ", ".join(r6(c, c) for c in MOVE_COLS)


@query("A15_movement_per_bin", q("beeps", NODES_CTE, located_sql(), MOVED,
                                 body=MOVE_BODY + " FROM moved"))
def _(t):
    return agg.daily_movement(nd.weighted_location(t.beeps, t.nodes, THIRTY), "360 days")


@query("Q7_localisation_and_movement", q("beeps", NODES_CTE, located_sql(
    having="count(DISTINCT NodeId) > 1"), MOVED,
    *vincenty_sql("moved", ("lowlat", "lowlon"), ("uplat", "uplon")),
    body=MOVE_BODY + ", " + r6("m / 1000", "d") + " FROM measured"))
def _(t):
    return an.movement(t.beeps, t.nodes, THIRTY, "360 days", min_nodes=1)


CALIBRATED = """cal AS (SELECT session_id, b.TagId, b.NodeId, epoch_us(Time) AS Time, TagRSSI,
    2 * 6371008.8e0 * asin(least(sqrt(sin(radians(lat - TagLat) / 2) ** 2 + cos(radians(TagLat))
    * cos(radians(lat)) * sin(radians(lng - TagLng) / 2) ** 2), 1)) AS distance
    FROM beeps b JOIN calibration c ON b.TagId = c.TagId AND Time BETWEEN c.start AND c."end"
    JOIN nodes n ON b.NodeId = n.NodeId)"""


@query("J9_interval_join", q("beeps", "calibration", body="""SELECT session_id, b.TagId,
    epoch_us(Time) AS Time, TagRSSI FROM beeps b JOIN calibration c ON b.TagId = c.TagId
    AND Time BETWEEN c.start AND c."end" """))
def _(t):
    joined = joins.interval_join(
        t.beeps, t.calibration, ["TagId"], "Time", "start", "end", 172800.0
    )
    return joined.select("session_id", "TagId", "Time", "TagRSSI")


@query("N3_calibration_set", q("beeps", "calibration", NODES_CTE, CALIBRATED, body=f"""SELECT
    session_id, TagId, NodeId, Time, TagRSSI, {r6('distance', 'distance', 3)} FROM cal"""))
def _(t):
    cal = nd.calibrate(t.beeps, t.calibration, t.nodes, 172800.0)
    return cal.select(
        "session_id", "TagId", "NodeId", "Time", "TagRSSI", F.round("distance", 3).alias("distance")
    )


@query("N4_signal_distance_relation", q("beeps", "calibration", NODES_CTE, CALIBRATED, body=f"""SELECT
    {r6('regr_slope(TagRSSI, ln(distance))', 'slope')},
    {r6('regr_intercept(TagRSSI, ln(distance))', 'intercept')},
    {r6('regr_r2(TagRSSI, ln(distance))', 'r2')}, count(*) AS n,
    {r6('min(distance)', 'nearest', 4)}, {r6('max(distance)', 'farthest', 3)} FROM cal WHERE distance > 0"""))
def _(t):
    fit = nd.fit_relation(nd.calibrate(t.beeps, t.calibration, t.nodes, 172800.0))
    return fit.withColumns({"nearest": F.round("nearest", 4), "farthest": F.round("farthest", 3)})


@query("N5_multilateration", q("beeps", "calibration", NODES_CTE, CALIBRATED, resampled_sql(),
    """rel AS (SELECT regr_slope(TagRSSI, ln(distance)) AS slope, regr_intercept(TagRSSI, ln(distance)) AS intercept,
        ln(min(distance)) AS low, ln(max(distance)) AS high FROM cal WHERE distance > 0)""",
    """pts AS (SELECT *, x * x + y * y - d * d AS q FROM (SELECT *,
        6371008.8e0 * radians(node_lng_mode - lng0) * cos(radians(lat0)) AS x,
        6371008.8e0 * radians(node_lat_mode - lat0) AS y, exp(least(greatest((mx - intercept) / slope, low), high)) AS d FROM (
        SELECT *, avg(node_lat_mode) OVER w AS lat0, avg(node_lng_mode) OVER w AS lng0 FROM res, rel
        WINDOW w AS (PARTITION BY TagId, freq))))""",
    """sums AS (SELECT TagId, freq, count(*) AS n_nodes, any_value(lat0) AS lat0,
        any_value(lng0) AS lng0, covar_samp(x, x) AS xx, covar_samp(y, y) AS yy,
        covar_samp(x, y) AS xy, covar_samp(x, q) AS xq, covar_samp(y, q) AS yq
        FROM pts GROUP BY TagId, freq)""",
    body=f"""SELECT TagId, freq, n_nodes, {r6('''CASE WHEN n_nodes >= 3 AND abs(xx * yy - xy * xy)
        > 1e-6 * xx * yy THEN lat0 + degrees((yq * xx - xq * xy) / (2 * (xx * yy - xy * xy))
        / 6371008.8e0) END''', 'lat', 5)}, {r6('''CASE WHEN n_nodes >= 3
        AND abs(xx * yy - xy * xy) > 1e-6 * xx * yy THEN lng0 + degrees((xq * yy - yq * xy)
        / (2 * (xx * yy - xy * xy)) / (6371008.8e0 * cos(radians(lat0)))) END''', 'lng', 5)}
        FROM sums"""))
def _(t):
    """Calibrate, relate, locate: distances come from the relation that the calibration sessions give."""
    relation = measured(nd.fit_relation(nd.calibrate(t.beeps, t.calibration, t.nodes, 172800.0)))
    out = nd.multilaterate(nd.resample_beeps(t.beeps, t.nodes, THIRTY), relation)
    return out.withColumns({"lat": F.round("lat", 5), "lng": F.round("lng", 5)})


# ---- streaming ----------------------------------------------------------------------------------


def _events_stream(t):
    schema = t.source("events").schema
    raw = streams.read_stream(t.spark, t.folder, schema, "events.parquet")
    return raw.select(
        F.col("event_id").alias("hitID"), F.col("user_id").alias("motusTagID"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("recvDeployName"),
    )


def _drained(t, stream):
    out, marks = scratch(t.spark), scratch(t.spark)
    streams.run_to_folder(stream, out, marks)
    return t.spark.read.schema(stream.schema).parquet(out)


@query("T1_streaming_sessions", q(DET, """ev AS (SELECT *, sum(brk) OVER (PARTITION BY motusTagID
    ORDER BY us ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id AS motusTagID, event_type,
    epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id
    ORDER BY ts) <= 3600000000 THEN 0 ELSE 1 END AS brk FROM events))""", body="""SELECT motusTagID,
    min(us) AS first_ts, max(us) AS last_ts, count(*) AS n_pings, count(DISTINCT event_type)
    AS w_towers FROM ev GROUP BY motusTagID, g"""))
def _(t):
    folder = scratch(t.spark)
    streams.run_session_parts(_events_stream(t), folder, scratch(t.spark), "1 hour")
    return streams.read_sessions(t.spark, folder, 3600)


@query("T2_streaming_resample", f"""SELECT TagId, NodeId, freq, max(value) AS TagRSSI_max,
    {r6('stddev_samp(value)', 'TagRSSI_sd')}, count(*) AS beep_count FROM (
        SELECT CAST(user_id AS VARCHAR) AS TagId, event_type AS NodeId, value,
        {binned('ts', 86400)} AS freq FROM events)
    GROUP BY TagId, NodeId, freq""")
def _(t):
    schema = t.source("events").schema
    raw = streams.read_stream(t.spark, t.folder, schema, "events.parquet")
    beeps = raw.select(
        F.col("user_id").cast("string").alias("TagId"), F.col("event_type").alias("NodeId"),
        F.col("ts").cast("timestamp").alias("Time"), F.col("value").alias("TagRSSI"),
    )
    folder = scratch(t.spark)
    binned_beeps = streams.stream_resample(beeps, "1 day", "1 hour")
    streams.run_upserts(binned_beeps, folder, scratch(t.spark))
    return streams.read_upserts(t.spark, folder, binned_beeps.schema, ["TagId", "NodeId", "freq"])


@query("T3_streaming_new_rows", q(DET, body="SELECT hitID, motusTagID FROM detections"))
def _(t):
    # every detection arrives twice
    twice = _events_stream(t).union(_events_stream(t))
    return _drained(t, streams.stream_new_rows(twice, "40 days")).select("hitID", "motusTagID")
