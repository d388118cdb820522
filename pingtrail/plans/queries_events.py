"""Sessions, transitions, bursts and the detection analyses.

The supplied detections are sparse (about one per tag and three hours), so gaps and windows are
scaled up from their defaults of seconds to hours.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pingtrail.functions import solar
from pingtrail.functions.angles import circular_mean
from pingtrail.functions.counts import n_distinct
from pingtrail.operators import aggregates as agg, filters as flt
from pingtrail.operators import joins, sessions as ses
from pingtrail.operators.slicing import running_total, with_slice
from pingtrail.plans import analyses as an
from pingtrail.plans.oracle import OFFSETS, query as q, r6, solar_day, sun, wrap360
from pingtrail.plans.queries_rows import SECTOR_SQL, rounded_sql
from pingtrail.plans.registry import query, scratch
from pingtrail.sources import sinks
from pingtrail.sources.sinks import ordered_track

DET = "detections"
GAP = 3600.0
WEEK = 604800.0
ORDER = "PARTITION BY motusTagID ORDER BY ts, recvDeployName, sig DESC NULLS LAST, hitID"


def events_of(source: str, name: str = "ev", gap: float = GAP) -> str:
    return f"""{name} AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY motusTagID
        ORDER BY ts, recvDeployName, port, hitID ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event_id
        FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= {int(gap * 1e6)}
        THEN 0 ELSE 1 END AS brk FROM {source}
        WINDOW w AS (PARTITION BY motusTagID ORDER BY ts, recvDeployName, port, hitID)))"""


COUNTS = """count(DISTINCT coalesce(recvDeployName, '~')) AS w_towers,
    count(DISTINCT coalesce(recvDeployName, '~') || '/' || coalesce(port, '~')) AS w_antennas"""
STUDY = f"""study AS (SELECT d.*, antBearing + coalesce(o.off, 0) AS antBearing_adj
    FROM detections d LEFT JOIN bearing_offsets o ON d.recvDeployName = o.recvDeployName
    WHERE tagDeployTest = 0 AND d.recvDeployName <> 'CTT HQ'
    AND recvDeployLat BETWEEN 36.2e0 AND 36.6e0 AND recvDeployLon BETWEEN -103.1e0 AND -102.1e0
    AND ts > TIMESTAMP '2023-10-01 00:00:00')"""


def study(t):
    return an.study_detections(t.detections, t.offsets)


# ---- events -------------------------------------------------------------------------------------


@query(
    "W1_sessionize",
    q(DET, events_of("detections"), body="SELECT hitID, motusTagID, event_id FROM ev"),
)
def _(t):
    used = t.detections.select("hitID", "motusTagID", "ts")
    return ses.sessionize(used, gap=GAP, slice_s=WEEK).select("hitID", "motusTagID", "event_id")


@query(
    "W2_A5_event_tower_counts",
    q(DET, events_of("detections"), body=f"""SELECT hitID, motusTagID, event_id, w_towers, w_antennas
        FROM ev JOIN (SELECT motusTagID, event_id, {COUNTS} FROM ev GROUP BY motusTagID, event_id)
        USING (motusTagID, event_id)"""),
)
def _(t):
    used = t.detections.select("hitID", "motusTagID", "ts", "recvDeployName", "port")
    events = ses.sessionize(used, gap=GAP, slice_s=WEEK)
    return ses.with_event_counts(events).select(
        "hitID", "motusTagID", "event_id", "w_towers", "w_antennas"
    )


@query(
    "A5_distinct_with_null",
    q(DET, body=f"SELECT motusTagID, {COUNTS} FROM detections GROUP BY motusTagID"),
)
def _(t):
    return t.detections.groupBy("motusTagID").agg(
        n_distinct("recvDeployName").alias("w_towers"),
        n_distinct("recvDeployName", "port").alias("w_antennas"),
    )


@query(
    "W11_first_row_per_event",
    q(DET, events_of("detections"), body=f"""SELECT motusTagID, event_id, hitID, recvDeployName,
        {r6('sig', 'sig')} FROM (SELECT *, row_number() OVER (PARTITION BY motusTagID, event_id
        ORDER BY ts, recvDeployName, port, hitID) AS r FROM ev) WHERE r = 1"""),
)
def _(t):
    used = t.detections.select("hitID", "motusTagID", "ts", "recvDeployName", "port", "sig")
    events = ses.sessionize(used, gap=GAP, slice_s=WEEK)
    order = F.struct(
        "ts", F.isnull("recvDeployName"), "recvDeployName", F.isnull("port"), "port", "hitID"
    )
    first = F.min_by(F.struct("hitID", "recvDeployName", "sig"), order)
    return events.groupBy("motusTagID", "event_id").agg(first.alias("f")).select(
        "motusTagID", "event_id", "f.*"
    )


@query(
    "W12_last_row_per_tag",
    q(DET, body=f"""SELECT motusTagID, epoch_us(ts) AS ts, hitID, recvDeployName, port FROM (
        SELECT *, row_number() OVER (PARTITION BY motusTagID ORDER BY ts DESC, recvDeployName, port,
        hitID) AS r FROM detections) WHERE r = 1"""),
)
def _(t):
    return agg.last_per_key(
        t.detections, "motusTagID", "ts", ["ts", "hitID", "recvDeployName", "port"],
        ["recvDeployName", "port", "hitID"],
    )


@query(
    "A14_last_time_per_event",
    q(DET, events_of("detections"), body="""SELECT motusTagID, event_id,
        max(epoch_us(ts)) AS last_ts, count(*) AS n_pings FROM ev GROUP BY motusTagID, event_id"""),
)
def _(t):
    used = t.detections.select("motusTagID", "ts")
    events = ses.sessionize(used, gap=GAP, slice_s=WEEK)
    return events.groupBy("motusTagID", "event_id").agg(
        F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_pings")
    )


@query(
    "W_running_total",
    q(DET, body="""SELECT hitID, CAST(sum(runLen) OVER (PARTITION BY motusTagID ORDER BY ts, hitID
        ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM detections"""),
)
def _(t):
    used = with_slice(t.detections.select("hitID", "motusTagID", "ts", "runLen"), "ts", WEEK)
    order = [F.col("ts"), F.col("hitID")]
    return running_total(used, ["motusTagID"], order, "runLen", "total").select("hitID", "total")


# ---- transitions and bursts ---------------------------------------------------------------------

TRANS = f"""trans AS (SELECT * FROM (SELECT *, lag(recvDeployName) OVER ({ORDER}) AS prev
    FROM detections) WHERE recvDeployName <> prev)"""
NEAR = f"""near AS (SELECT * EXCLUDE (prev, us, back, fwd), us FROM (
    SELECT *, us - lag(us) OVER w AS back, us - lead(us) OVER w AS fwd FROM (
        SELECT *, {rounded_sql(1, 500000)} AS us FROM trans WHERE antBearing IS NOT NULL)
    WINDOW w AS (PARTITION BY motusTagID ORDER BY us, recvDeployName, hitID))
    WHERE back < 18000000000 OR fwd BETWEEN -17640000000 AND 17640000000)"""
THREE = """three AS (SELECT * EXCLUDE (b1, b2, f1, f2) FROM (SELECT *,
    us - lag(us) OVER w AS b1, us - lag(us, 2) OVER w AS b2, lead(us) OVER w - us AS f1,
    lead(us, 2) OVER w - us AS f2 FROM near
    WINDOW w AS (PARTITION BY motusTagID ORDER BY us, recvDeployName, hitID))
    WHERE b1 < 14400000000 AND f1 < 14400000000 OR b2 < 14400000000 OR f2 < 14400000000)"""
BURST = """burst AS (SELECT * EXCLUDE (us, gap), us - 1000000 AS us FROM (
    SELECT *, us - lag(us) OVER (PARTITION BY motusTagID ORDER BY us, recvDeployName, hitID) AS gap
    FROM three) WHERE gap <= 7200000000)"""


def trans(t):
    used = t.detections.select(
        "motusTagID", "ts", "recvDeployName", "sig", "hitID", "antBearing", "port"
    )
    return ses.transitions(used, slice_s=WEEK)


def near(t):
    return ses.near_simultaneous(trans(t), 18000, 17640, slice_s=WEEK)


def three(t):
    return ses.run_of_three(near(t), 14400, slice_s=WEEK)


@query("W3_station_transitions",
       q(DET, TRANS, body="SELECT hitID, motusTagID, recvDeployName, port FROM trans"))
def _(t):
    return trans(t).select("hitID", "motusTagID", "recvDeployName", "port")


def sliced(t, *columns):
    folder = scratch(t.spark)
    return sinks.write_sliced(t.detections.select(*columns), f"sliced_{uuid.uuid4().hex}", folder, slice_s=WEEK)


@query("S6_sliced_sessions", q(DET, events_of("detections"), body="SELECT hitID, motusTagID, event_id FROM ev"))
def _(t):
    stored = sliced(t, "hitID", "motusTagID", "ts")
    return ses.sessionize_sliced(stored, gap=GAP).select("hitID", "motusTagID", "event_id")


@query("S6_sliced_transitions",
       q(DET, TRANS, body="SELECT hitID, motusTagID, recvDeployName, port FROM trans"))
def _(t):
    stored = sliced(t, "hitID", "motusTagID", "ts", "recvDeployName", "port", "sig")
    return ses.transitions_sliced(stored).select("hitID", "motusTagID", "recvDeployName", "port")


@query("W4_near_simultaneous",
       q(DET, TRANS, NEAR, body="SELECT hitID, motusTagID, us AS ts FROM near"))
def _(t):
    return near(t).select("hitID", "motusTagID", "ts")


@query("W5_run_of_three",
       q(DET, TRANS, NEAR, THREE, body="SELECT hitID, motusTagID, us AS ts FROM three"))
def _(t):
    return three(t).select("hitID", "motusTagID", "ts")


_LAGS = range(1, 11)


@query(
    "W6_lag_bins",
    q(DET, body="SELECT hitID, " + ", ".join(
        r6(f"(us - lag(us, {k}) OVER w) / 1000000e0", f"lag_diff{k}") + f""", CASE WHEN
        us - lag(us, {k}) OVER w > -1000000 AND us - lag(us, {k}) OVER w <= 43200000000
        THEN '(-1,43200]' END AS bin{k}""" for k in _LAGS)
      + """ FROM (SELECT hitID, motusTagID, recvDeployName, epoch_us(ts) AS us FROM detections)
        WINDOW w AS (PARTITION BY motusTagID ORDER BY us, recvDeployName, hitID)"""),
)
def _(t):
    used = t.detections.select("hitID", "motusTagID", "ts", "recvDeployName")
    binned = ses.lag_bins(used, 10, -1, 43200, slice_s=WEEK)
    return binned.select("hitID", *[f"{c}{k}" for k in _LAGS for c in ("lag_diff", "bin")])


@query("W7_bursts",
       q(DET, TRANS, NEAR, THREE, BURST, body="SELECT hitID, motusTagID, us AS ts FROM burst"))
def _(t):
    return ses.bursts(three(t), 7200, slice_s=WEEK).select("hitID", "motusTagID", "ts")


def _pool_sql(n: str) -> str:
    return q(DET, body=f"""SELECT motusTagID, {rounded_sql(21600, 10800000000)} AS ts, {n} AS n
        FROM detections GROUP BY ALL HAVING {n} > 2""")


@query("W8_pool_rows", _pool_sql("count(*)"))
def _(t):
    return ses.pool(t.detections, 21600)


@query("W8_pool_stations", _pool_sql("count(DISTINCT coalesce(recvDeployName, '~'))"))
def _(t):
    return ses.pool(t.detections, 21600, distinct_stations=True)


@query(
    "W9_pooled_proximity",
    q(DET, f"""pools AS (SELECT motusTagID, {rounded_sql(7200, 3600000000)} AS us, count(*) AS n
        FROM detections GROUP BY ALL HAVING count(*) > 1)""",
      """kept AS (SELECT * FROM (SELECT *, us - lag(us) OVER w AS b1, us - lag(us, 2) OVER w AS b2,
        lead(us) OVER w - us AS f1, lead(us, 2) OVER w - us AS f2 FROM pools
        WINDOW w AS (PARTITION BY motusTagID ORDER BY us)) WHERE b1 < 172800000000 AND
        f1 < 172800000000 OR b2 < 172800000000 OR f2 < 172800000000)""",
      body="SELECT motusTagID, us AS ts, n, " + ", ".join(f"""CASE WHEN us - lag(us, {k}) OVER w > -1000000
        AND us - lag(us, {k}) OVER w <= 172800000000 THEN '(-1,172800]' END AS bin{k}""" for k in _LAGS)
      + " FROM kept WINDOW w AS (PARTITION BY motusTagID ORDER BY us)"),
)
def _(t):
    pools = ses.pool(t.detections, 7200, 2)
    kept = ses.run_of_three(pools, 172800, slice_s=WEEK)
    binned = ses.lag_bins(kept, 10, -1, 172800, slice_s=WEEK)
    return binned.select("motusTagID", "ts", "n", *[f"bin{k}" for k in _LAGS])


@query(
    "W10_anchored_bursts",
    q(DET, "p AS (SELECT motusTagID AS g, epoch_us(ts) AS us, recvDeployName, sig FROM detections)",
      body=f"""SELECT g AS motusTagID, s AS burst_start, e AS burst_end, n_towers, recvDeployName,
        {r6('max_sig', 'max_sig')} FROM (SELECT g, s, recvDeployName, max(sig) AS max_sig,
        max(max(us)) OVER (PARTITION BY g, s) AS e, count(*) OVER (PARTITION BY g, s) AS n_towers
        FROM (SELECT p.*, (SELECT max(b.s) FROM starts b WHERE b.g = p.g AND b.s <= p.us) AS s FROM p)
        GROUP BY g, s, recvDeployName)""").replace("WITH ", "WITH RECURSIVE ", 1).replace(
        "\nSELECT g AS", """,\nstarts AS (SELECT g, min(us) AS s FROM p GROUP BY g UNION ALL
        SELECT b.g, min(p.us) FROM starts b JOIN p ON p.g = b.g AND p.us > b.s + 43200000000
        GROUP BY b.g)\nSELECT g AS""", 1),
)
def _(t):
    used = t.detections.select("motusTagID", "ts", "recvDeployName", "sig")
    return ses.anchored_bursts(used, 43200, slice_s=WEEK)


# ---- centroids ----------------------------------------------------------------------------------


def _centroid_sql(source: str, weight: str) -> str:
    return f"""cents AS (SELECT motusTagID, event_id, avg(recvDeployLat) AS simple_lat,
        avg(recvDeployLon) AS simple_lon,
        CASE WHEN count(sig) = count(*) THEN sum({weight} * recvDeployLat) / sum({weight}) END
            AS weighted_lat,
        CASE WHEN count(sig) = count(*) THEN sum({weight} * recvDeployLon) / sum({weight}) END
            AS weighted_lon,
        min(epoch_us(ts)) AS ts, count(DISTINCT coalesce(recvDeployName, '~')) AS w_towers,
        count(*) AS n_pings FROM (SELECT *, min(sig) OVER e AS lo, max(sig) OVER e AS hi
            FROM {source} WINDOW e AS (PARTITION BY motusTagID, event_id))
        GROUP BY motusTagID, event_id
        HAVING count(DISTINCT coalesce(recvDeployName, '~')) >= 2)"""


CENT_BODY = ("SELECT motusTagID, event_id, ts, w_towers, n_pings, "
             + ", ".join(r6(c, c) for c in ("simple_lat", "simple_lon", "weighted_lat",
                                            "weighted_lon")) + " FROM cents")
CENT_COLS = ["motusTagID", "event_id", "ts", "w_towers", "n_pings", "simple_lat", "simple_lon",
             "weighted_lat", "weighted_lon"]


@query("Q2_A6_event_centroids",
       q(DET, OFFSETS, STUDY, events_of("study"), _centroid_sql("ev", "(sig - lo + 1)"),
         body=CENT_BODY))
def _(t):
    return an.event_centroids(study(t), GAP, slice_s=WEEK).select(*CENT_COLS)


@query("A7_event_centroids_as_written",
       q(DET, OFFSETS, STUDY, events_of("study"), _centroid_sql("ev", "(hi - sig + 1)"),
         body=CENT_BODY))
def _(t):
    return an.event_centroids(study(t), GAP, weighting="as_written", slice_s=WEEK).select(*CENT_COLS)


# ---- flagship analyses --------------------------------------------------------------------------

TWILIGHT = {k: solar.SUN_EVENTS[k] for k in solar.TWILIGHT}
TIME_OF_DAY = """CASE WHEN us <= nauticalDawn OR us >= nauticalDusk THEN 'Night'
    WHEN us > nauticalDawn AND us < sunrise THEN 'Pre-Sunrise Twilight (Nautical/Civil)'
    WHEN us > sunset AND us < nauticalDusk THEN 'Post-Sunset Twilight (Civil/Nautical)'
    ELSE 'Day' END"""


def _q1_sql(day: str) -> str:
    return q(
        DET, OFFSETS, STUDY, events_of("study"),
        f"""firsts AS (SELECT motusTagID, event_id, min(ts) AS first_ts, {COUNTS},
            (SELECT avg(recvDeployLat) FROM study) AS la, (SELECT avg(recvDeployLon) FROM study) AS lo
            FROM ev GROUP BY motusTagID, event_id)""",
        f"dated AS (SELECT *, {day} AS day, epoch_us(first_ts) AS us FROM firsts)",
        f"sunny AS ({sun('dated', 'day', 'la', 'lo', TWILIGHT)})",
        body=f"""SELECT {TIME_OF_DAY} AS time_of_day, w_towers, count(*) AS event_count
            FROM sunny GROUP BY ALL""",
    )


@query("Q1_multi_tower_by_time_of_day", _q1_sql(solar_day("first_ts", "lo")))
def _(t):
    return an.multi_tower_by_time_of_day(study(t), GAP, WEEK)


@query("A13_F19_time_of_day_utc_date", _q1_sql("CAST(first_ts AS DATE)"))
def _(t):
    return an.multi_tower_by_time_of_day(study(t), GAP, WEEK, date_mode="utc")


@query(
    "Q3_departure_inference",
    q(DET, OFFSETS, STUDY, events_of("study"), _centroid_sql("ev", "(sig - lo + 1)"),
      """lse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY motusTagID
        ORDER BY ts DESC, event_id) AS r FROM cents) WHERE r = 1)""",
      f"""final AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.motusTagID
        ORDER BY s.ts DESC, recvDeployName, port, hitID) AS r FROM study s
        JOIN lse ON s.motusTagID = lse.motusTagID AND epoch_us(s.ts) > lse.ts
        AND epoch_us(s.ts) <= lse.ts + 86400000000) WHERE r = 1)""",
      body=f"""SELECT lse.motusTagID, lse.ts AS last_centroid_ts, {r6('weighted_lat', 'last_lat')},
        {r6('weighted_lon', 'last_lon')}, lse.w_towers, lse.n_pings, last_ping_ts,
        epoch_us(f.ts) AS final_ping_ts, f.recvDeployName AS final_receiver, f.port AS final_port,
        {r6('f.sig', 'final_sig')}, {r6('f.antBearing_adj', 'final_bearing')}, {SECTOR_SQL}
        AS direction FROM lse LEFT JOIN (SELECT motusTagID, max(epoch_us(ts)) AS last_ping_ts
            FROM study GROUP BY motusTagID) p ON lse.motusTagID = p.motusTagID
        LEFT JOIN (SELECT *, {wrap360('antBearing_adj')} AS b FROM final) f
        ON lse.motusTagID = f.motusTagID"""),
)
def _(t):
    return an.departures(study(t), GAP, minutes=24 * 60, slice_s=WEEK)


_SUN2 = {k: solar.SUN_EVENTS[k] for k in ("sunrise", "sunset")}


def relative_sun(source: str, lat: str, lon: str) -> list[str]:
    """CTEs from ``source`` (with column us) to ``rel`` with sun-relative hours."""
    day = solar_day("make_timestamp(us)", lon)
    three_days = f"""days AS (SELECT s.*, {day} AS day, {day} + CAST(off AS INTEGER) AS d
        FROM (SELECT *, row_number() OVER () AS rid FROM {source}) s,
        (VALUES (-1), (0), (1)) AS o(off))"""
    lit = f"lit AS ({sun('days', 'd', lat, lon, _SUN2)})"
    rel = """rel AS (SELECT rid, max(CASE WHEN d = day THEN sunrise END) AS sunrise,
        max(CASE WHEN d = day THEN sunset END) AS sunset,
        (any_value(us) - max(CASE WHEN sunrise <= us THEN sunrise END)) / 3600000000e0
            AS ts_since_rise,
        (min(CASE WHEN sunrise > us THEN sunrise END) - any_value(us)) / 3600000000e0 AS ts_to_rise,
        (any_value(us) - max(CASE WHEN sunset <= us THEN sunset END)) / 3600000000e0 AS ts_since_set,
        (min(CASE WHEN sunset > us THEN sunset END) - any_value(us)) / 3600000000e0 AS ts_to_set,
        any_value(motusTagID) AS motusTagID, any_value(us) AS ts, any_value(n) AS n
        FROM lit GROUP BY rid)"""
    return [three_days, lit, rel]


SUN_NAMES = ["ts_since_rise", "ts_to_rise", "ts_since_set", "ts_to_set"]


@query(
    "Q4_simultaneous_with_sun",
    q(DET, TRANS, NEAR, THREE, BURST,
      """pools AS (SELECT motusTagID, (us + 10800000000) - (us + 10800000000) % 21600000000 AS us,
        count(*) AS n FROM burst GROUP BY ALL HAVING count(*) > 2)""",
      *relative_sun("pools", "36.37e0", "-102.8e0"),
      body="SELECT motusTagID, ts, n, " + ", ".join(r6(c, c, 4) for c in SUN_NAMES) + " FROM rel"),
)
def _(t):
    used = t.detections.select(
        "motusTagID", "ts", "recvDeployName", "sig", "hitID", "antBearing", "port"
    )
    rows = an.angulated(used, 18000, 17640, 14400, 7200, slice_s=WEEK)
    pooled = an.pooled_with_sun(rows, 21600)
    return pooled.select("motusTagID", "ts", "n", *[F.round(c, 4).alias(c) for c in SUN_NAMES])


@query(
    "Q5_A8_vanishing_bearing",
    q(DET, "departures", body=f"""SELECT motusTagID, recvDeployName, recvDeployLat, recvDeployLon,
        {r6(f"CASE WHEN complete AND sqrt(s * s + c * c) / n >= 1e-12 THEN "
            f"{wrap360('degrees(atan2(s, c))')} END", 'vanish_bearing')},
        {r6('seconds_used', 'seconds_used')}, n FROM (
        SELECT d.motusTagID, recvDeployName, recvDeployLat, recvDeployLon,
        sum(w * sin(radians(antBearing))) AS s, sum(w * cos(radians(antBearing))) AS c,
        count(w * antBearing) = count(*) AS complete, count(*) AS n,
        (max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000e0 AS seconds_used FROM (
            SELECT *, (sig + 78.0691e0) / (78.0691e0 - 17.8707e0) AS w FROM detections) d
        JOIN departures p ON d.motusTagID = p.motusTagID AND ts >= ts_depart
        WHERE speciesEN IS NOT NULL AND tagDeployTest = 0 AND tagProjName = 'Plains'
        AND recvDeployName = 'Tumbleweed' GROUP BY ALL)"""),
)
def _(t):
    return an.vanishing(t.detections, t.departures, "Tumbleweed", "Plains")


@query(
    "A9_circular_mean",
    q(DET, body=f"""SELECT recvDeployName, {r6('CASE WHEN count(antBearing) = count(*) THEN '
        + wrap360('degrees(atan2(avg(sin(radians(antBearing))), avg(cos(radians(antBearing)))))') + ' END', 'mean_bearing')}
        FROM detections GROUP BY recvDeployName"""),
)
def _(t):
    return t.detections.groupBy("recvDeployName").agg(
        circular_mean("antBearing").alias("mean_bearing")
    )


@query(
    "J10_after_event",
    q(DET, "departures", body="""SELECT hitID, d.motusTagID FROM detections d JOIN departures p
        ON d.motusTagID = p.motusTagID AND epoch_us(ts) > epoch_us(ts_depart)
        AND epoch_us(ts) <= epoch_us(ts_depart) + 43200000000"""),
)
def _(t):
    hits = t.detections.select("hitID", "motusTagID", "ts")
    return joins.after_event(
        hits, t.departures, "motusTagID", "ts", "ts_depart", 12 * 60
    ).select("hitID", "motusTagID")


@query(
    "R10_ordered_track",
    q(DET, body=f"""SELECT hitID, motusTagID, recvDeployName, {r6('sig', 'sig')} FROM detections
        WHERE tagProjID = 500"""),
)
def _(t):
    return ordered_track(t.detections, 500).select("hitID", "motusTagID", "recvDeployName", "sig")


@query("R1_sort_null_last",
       q(DET, body=f"SELECT motusTagID, recvDeployName, hitID, {r6('sig', 'sig')} FROM detections"))
def _(t):
    used = t.detections.select("motusTagID", "ts", "recvDeployName", "sig", "hitID")
    return used.orderBy(
        F.col("motusTagID").asc_nulls_last(), F.col("ts").asc_nulls_last(),
        F.col("recvDeployName").asc_nulls_last(), F.col("sig").desc_nulls_last(), F.col("hitID"),
    ).drop("ts")


@query(
    "residency_daily",
    q(DET, body="""SELECT motusTagID, recvDeployName, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n
        FROM detections WHERE recvDeployName IS NOT NULL GROUP BY ALL"""),
)
def _(t):
    named = t.detections.where("recvDeployName IS NOT NULL")
    return named.groupBy("motusTagID", "recvDeployName", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "silence_after_departure",
    q(DET, body="""SELECT motusTagID, hitID, us AS ts, nxt FROM (SELECT motusTagID, hitID,
        epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY motusTagID ORDER BY ts, hitID)
        AS nxt FROM detections) WHERE nxt IS NULL OR nxt - us >= 43200000000"""),
)
def _(t):
    return ses.silences(t.detections.select("motusTagID", "hitID", "ts"), 43200, slice_s=WEEK)


