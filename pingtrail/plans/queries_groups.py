"""Joins, summaries, reshaping, metadata audits, profiles and fits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pingtrail.functions.solar import time_to_sun
from pingtrail.operators import aggregates as agg, deployments as dep, filters as flt
from pingtrail.operators import incidence as inc, models
from pingtrail.operators.quantiles import column_profile, group_quantiles
from pingtrail.plans import analyses as an
from pingtrail.plans.oracle import query as q, r6
from pingtrail.plans.queries_events import SUN_NAMES, relative_sun
from pingtrail.plans.queries_rows import rounded_sql
from pingtrail.plans.registry import query

DET, TAGS, DEPS, RECV = "detections", "tags", "tag_deployments", "receiver_deployments"


# ---- joins --------------------------------------------------------------------------------------


@query("J3_left_join_on_tag", q(DET, "departures", body="""SELECT hitID, d.motusTagID,
    epoch_us(ts_depart) AS ts_depart FROM detections d LEFT JOIN departures p ON d.motusTagID = p.motusTagID"""))
def _(t):
    return t.detections.select("hitID", "motusTagID").join(t.departures, "motusTagID", "left")


@query("J4_right_join_filtered", q(DET, "departures", body="""SELECT hitID, p.motusTagID
    FROM detections d RIGHT JOIN departures p ON d.motusTagID = p.motusTagID
    WHERE d.ts >= p.ts_depart AND recvDeployName = 'Tumbleweed'"""))
def _(t):
    hits = t.detections.select("hitID", "motusTagID", "ts", "recvDeployName")
    joined = hits.join(t.departures, "motusTagID", "right")
    kept = joined.where("ts >= ts_depart AND recvDeployName = 'Tumbleweed'")
    return kept.select("hitID", "motusTagID")


@query("J5_never_deployed", q(TAGS, DEPS, body="""SELECT tagID, projectID FROM tags
    WHERE NOT EXISTS (SELECT 1 FROM tag_deployments d WHERE d.tagID = tags.tagID)"""))
def _(t):
    return dep.never_deployed(t.tags, t.tag_deployments)


@query("J6_natural_join", q(TAGS, DEPS, body="""SELECT t.tagID, t.projectID, deployID, speciesID
    FROM tags t LEFT JOIN tag_deployments d ON t.tagID = d.tagID AND t.projectID = d.projectID"""))
def _(t):
    right = t.tag_deployments.select("tagID", "projectID", "deployID", "speciesID")
    return flt.natural_left_join(t.tags, right)


@query("J7_renamed_key", q(DET, body="""SELECT l.motusTagID, l.last_ts, d.hitID FROM (
    SELECT motusTagID, max(epoch_us(ts)) AS last_ts FROM detections GROUP BY motusTagID) l
    LEFT JOIN detections d ON d.motusTagID = l.motusTagID AND epoch_us(d.ts) = l.last_ts"""))
def _(t):
    hits = t.detections.select(F.col("motusTagID").alias("tag"), "ts", "hitID")
    last = t.detections.groupBy("motusTagID").agg(F.max("ts").alias("last_ts"))
    joined = last.join(
        hits, (last["motusTagID"] == hits["tag"]) & (last["last_ts"] == hits["ts"]), "left"
    )
    return joined.select("motusTagID", "last_ts", "hitID")


# ---- aggregation --------------------------------------------------------------------------------


@query("A1_count_tag_station", q(DET, body="""SELECT motusTagID, recvDeployName, count(*) AS n
    FROM detections GROUP BY ALL"""))
def _(t):
    return t.detections.groupBy("motusTagID", "recvDeployName").agg(F.count(F.lit(1)).alias("n"))


def _track(keys: str, where: str) -> str:
    return q(DET, body=f"""SELECT {keys}, max(runLen) AS max_runLen,
        CAST(floor(sum(CAST(epoch_us(ts) AS HUGEINT))::DOUBLE / count(*) / 1000) AS BIGINT)
        AS ts_mean_ms FROM detections WHERE recvDeployLat IS NOT NULL AND {where} GROUP BY ALL""")


def _ms(df):
    # mean times agree across engines to well below a millisecond; compare whole milliseconds
    ms = F.floor(F.unix_micros("ts_mean") / 1000).cast("bigint")
    return df.withColumn("ts_mean_ms", ms).drop("ts_mean")


@query("A2_track_summary", _track("motusTagID, runID, recvDeployName, ambigID, tagDepLon, tagDepLat,"
                                  " recvDeployLat, recvDeployLon", "true"))
def _(t):
    return _ms(agg.track_summary(t.detections))


@query("A3_path_summary", _track("motusTagID, tagDeployID, recvDeployName, tagDepLon, tagDepLat,"
                                 " recvDeployLat, recvDeployLon", "tagProjID = 500"))
def _(t):
    return _ms(agg.path_summary(t.detections, 500))


@query("A4_distinct_antennas", q(DET, body="SELECT DISTINCT recv, port, motusTagID FROM detections"))
def _(t):
    return t.detections.select("recv", "port", "motusTagID").distinct()


_NUMERIC = ["sig", "runLen", "antBearing", "recvDeployLat", "gpsLat"]


@query("A16_column_profile", q(DET, body=" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {r6(f'min({c})::DOUBLE', 'min')},
        {r6(f'quantile_cont({c}::DOUBLE, 0.25)', 'q1')},
        {r6(f'quantile_cont({c}::DOUBLE, 0.5)', 'median')}, {r6(f'avg({c})', 'mean')},
        {r6(f'quantile_cont({c}::DOUBLE, 0.75)', 'q3')}, {r6(f'max({c})::DOUBLE', 'max')},
        count(*) FILTER ({c} IS NULL) AS nulls FROM detections""" for c in _NUMERIC)))
def _(t):
    return column_profile(t.detections, _NUMERIC)


@query("A17_extent", q(RECV, body="""SELECT min(longitude) - 2 AS xmin, max(longitude) + 2 AS xmax,
    min(latitude) - 2 AS ymin, max(latitude) + 2 AS ymax FROM receiver_deployments"""))
def _(t):
    return agg.extent(t.receiver_deployments, "latitude", "longitude")


@query("A18_dispersion", q(DET, body=f"""SELECT {r6('avg(runLen)', 'mean')},
    {r6('var_samp(runLen)', 'var')}, {r6('var_samp(runLen) / avg(runLen)', 'ratio')}
    FROM detections"""))
def _(t):
    return agg.dispersion(t.detections, "runLen")


@query("A19_histogram_width", q(DET, body="""SELECT floor(sig / 5) * 5e0 AS bin, count(*) AS n
    FROM detections WHERE NOT sig > -25 GROUP BY ALL"""))
def _(t):
    return agg.histogram(t.detections, "sig", 5.0, hi=-25.0)


@query("A19_histogram_breaks", q(DET, body="""SELECT bin, count(*) AS n FROM (SELECT CASE
    WHEN runLen BETWEEN 2 AND 3 THEN '(2,3]' WHEN runLen BETWEEN 4 AND 9
    THEN '(' || (runLen - 1) || ',' || runLen || ']' END AS bin FROM detections)
    WHERE bin IS NOT NULL GROUP BY ALL"""))
def _(t):
    return agg.histogram(t.detections, "runLen", breaks=list(range(2, 10)))


@query("A21_hourly_presence", q(DET, body="""SELECT DISTINCT motusTagID, port,
    epoch_us(tagDeployStart) AS tagDeployStart, tagDepLat, tagDepLon, recvDeployLat, recvDeployLon,
    recvDeployName, antBearing, speciesEN, CAST(year(ts) AS INT) AS year,
    CAST(dayofyear(ts) AS INT) AS doy, CAST(hour(ts) AS INT) AS hour FROM detections
    WHERE recvDeployLat IS NOT NULL"""))
def _(t):
    return agg.hourly_presence(t.detections)


@query("A21_rounded_hours", q(DET, body=f"""SELECT DISTINCT mfgID, recvDeployName,
    {rounded_sql(3600, 1800000000)} AS hour FROM detections WHERE recvDeployName = 'Tumbleweed'"""))
def _(t):
    return agg.rounded_hours(
        t.detections.where("recvDeployName = 'Tumbleweed'"), ["mfgID", "recvDeployName"]
    )


# ---- reshaping ----------------------------------------------------------------------------------


@query("R2_top_three_tags", q(DET, """top AS (SELECT motusTagID FROM detections GROUP BY motusTagID
    ORDER BY count(*) DESC, motusTagID LIMIT 3)""",
    body="SELECT hitID, motusTagID FROM detections WHERE motusTagID IN (SELECT motusTagID FROM top)"))
def _(t):
    counts = t.detections.groupBy("motusTagID").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), "motusTagID").limit(3)
    return t.detections.select("hitID", "motusTagID").join(top, "motusTagID", "left_semi")


@query("R3_union_all", q(DET, "departures", body="""SELECT motusTagID, epoch_us(ts) AS ts
    FROM detections UNION ALL SELECT motusTagID, epoch_us(ts_depart) FROM departures"""))
def _(t):
    left = t.detections.select("motusTagID", "ts")
    return left.unionByName(t.departures.select("motusTagID", F.col("ts_depart").alias("ts")))


@query("R5_W15_deployment_timeline", q(RECV, """long AS (
    SELECT deviceID, deployID, 'timeStart' AS "when", epoch_us(tsStart) AS us
        FROM receiver_deployments UNION ALL
    SELECT deviceID, deployID, 'timeEnd', epoch_us(tsEnd) FROM receiver_deployments)""",
    body="""SELECT deviceID, deployID, "when", coalesce(us, (SELECT max(us) FROM long)
        + 2629800000000) AS time FROM long"""))
def _(t):
    return dep.deployment_timeline(t.receiver_deployments)


@query("R6_run_length_split", q(DET, body="""SELECT motusTagID,
    nullif(count(*) FILTER (runLen <> 2), 0) AS n_other,
    nullif(count(*) FILTER (runLen = 2), 0) AS n_two FROM detections GROUP BY motusTagID"""))
def _(t):
    return agg.run_length_split(t.detections)


@query("R7_incidence", q(DET, """pts AS (SELECT DISTINCT motusTagID, epoch_us(tsCorrected)
    AS tsCorrected, recvDeployLat, recvDeployLon FROM detections)""", body="""SELECT *, 1 AS presence,
    count(*) OVER (PARTITION BY motusTagID) AS n_points FROM pts
    QUALIFY count(*) OVER (PARTITION BY motusTagID) > 4"""))
def _(t):
    return agg.incidence(t.detections, min_points=5)


DENSE = """kept AS (SELECT * FROM (SELECT DISTINCT motusTagID, epoch_us(tsCorrected) AS us, recvDeployLat AS lat, recvDeployLon AS lon
    FROM detections) QUALIFY count(*) OVER (PARTITION BY motusTagID) > 4)"""
POINTS = """ids AS (SELECT *, row_number() OVER (ORDER BY us NULLS FIRST, lat NULLS FIRST, lon NULLS FIRST) AS point_id
    FROM (SELECT us, lat, lon, count(*) AS n_tags FROM kept GROUP BY us, lat, lon)),
    cells AS (SELECT k.motusTagID, (point_id - 1) // 32768 + 1 AS block, (point_id - 1) % 32768 AS pos, n_tags FROM kept k JOIN ids i
    ON k.us IS NOT DISTINCT FROM i.us AND k.lat IS NOT DISTINCT FROM i.lat AND k.lon IS NOT DISTINCT FROM i.lon)"""


def dense(t):
    return inc.dense_incidence(t.detections, min_points=5)


@query("R7_dense_blocks", q(DET, DENSE, POINTS, """bytes AS (SELECT motusTagID, block, pos // 8 AS byte, count(*) AS n,
    sum(1 << (pos % 8)) AS v FROM cells GROUP BY ALL),
    gaps AS (SELECT *, byte - lag(byte, 1, -1) OVER (PARTITION BY motusTagID, block ORDER BY byte) - 1 AS gap FROM bytes)""",
    body="""SELECT motusTagID, block, sum(n)::BIGINT AS n_present,
    sha256(from_hex(rpad(string_agg(repeat('00', gap) || printf('%02X', v::INT), '' ORDER BY byte), 8192, '0'))) AS bits_sha256
    FROM gaps GROUP BY motusTagID, block"""))
def _(t):
    blocks, _ = dense(t)
    return blocks.select("motusTagID", "block", "n_present", F.sha2("bits", 256).alias("bits_sha256"))


@query("R7_dense_points", q(DET, DENSE, POINTS, body="""SELECT us AS tsCorrected, lat AS recvDeployLat, lon AS recvDeployLon,
    n_tags, point_id FROM ids"""))
def _(t):
    return dense(t)[1]


@query("R7_dense_sums", q(DET, DENSE, POINTS, body="""SELECT motusTagID, count(*) AS n_points,
    count(*) FILTER (n_tags = 1) AS n_alone FROM cells GROUP BY motusTagID"""))
def _(t):
    return inc.tag_sums(*dense(t))


@query("R8_split_date_time", q(DET, body="""SELECT hitID, strftime(ts, '%Y-%m-%d') AS Date,
    strftime(ts, '%H:%M:%S') AS Time FROM detections WHERE strftime(ts, '%H:%M:%S') > '13:00:00'"""))
def _(t):
    split = t.detections.select(
        "hitID", F.to_date("ts").alias("Date"), F.date_format("ts", "HH:mm:ss").alias("Time")
    )
    return split.where(F.col("Time") > "13:00:00")


@query("R9_bind_columns", q(DET, body=f"""SELECT hitID, recvDeployLat, runLen + 1 AS runLen1,
    {r6('exp(runLen / 10e0)', 'e')} FROM detections"""))
def _(t):
    bound = t.detections.withColumns(
        {"runLen1": F.col("runLen") + 1, "e": F.exp(F.col("runLen") / 10.0)}
    )
    return bound.select("hitID", "recvDeployLat", "runLen1", "e")


@query("W13_multi_deployments", q(DET, body="""SELECT * FROM (SELECT motusTagID, tagDeployID,
    count(*) OVER (PARTITION BY motusTagID) AS n FROM (SELECT DISTINCT motusTagID, tagDeployID
    FROM detections WHERE tagDeployID IS NOT NULL)) WHERE n > 1"""))
def _(t):
    return dep.multi_deployments(t.detections)


@query("W14_station_ranks", q(DET, body=f"""SELECT recvDeployName, {r6('m', 'mean_lat')},
    CAST(dense_rank() OVER (ORDER BY m) AS INT) AS rank FROM (SELECT recvDeployName,
    avg(recvDeployLat) AS m FROM detections WHERE recvDeployName IS NOT NULL GROUP BY 1)"""))
def _(t):
    return dep.station_ranks(t.detections)


@query("Q8_deployment_audit", q(TAGS, DEPS, "species", body="""SELECT s.*, k.species FROM (
    SELECT projectID, count(*) AS registered, count(n) AS deployed,
    count(*) FILTER (n IS NULL) AS never_deployed, count(*) FILTER (n > 1) AS multi_deployed
    FROM tags LEFT JOIN (SELECT tagID, count(*) AS n FROM tag_deployments GROUP BY tagID) d
    ON tags.tagID = d.tagID GROUP BY projectID) s
    LEFT JOIN (SELECT projectID, count(DISTINCT speciesID) AS species FROM tag_deployments
    WHERE speciesID IN (SELECT id FROM species) GROUP BY projectID) k
    ON s.projectID = k.projectID"""))
def _(t):
    return an.deployment_audit(t.tags, t.tag_deployments, t.species)


@query("Q8_project_species", q(DEPS, "species", body="""SELECT id, name FROM species
    WHERE id IN (SELECT speciesID FROM tag_deployments WHERE projectID = 3)"""))
def _(t):
    return dep.project_species(t.tag_deployments, t.species, 3)


@query("Q9_quality_report", q(DET, body="""SELECT motusTagID, count(*) AS n,
    count(*) FILTER (motusFilter = 0) AS dubious, count(*) FILTER (runLen <= 3) AS short,
    count(*) FILTER (recvDeployLat IS NULL OR recvDeployName IS NULL) AS unplaced,
    count(*) FILTER (runLen = 2) AS n_two, count(*) FILTER (runLen <> 2) AS n_other
    FROM detections GROUP BY motusTagID"""))
def _(t):
    return an.quality_report(t.detections)


# ---- fits ---------------------------------------------------------------------------------------


def _activity(t):
    """Run lengths against hours since sunrise at the fixed study position."""
    placed = t.detections.select("motusTagID", "ts", "runLen").withColumns(
        {"recvDeployLat": F.lit(36.37), "recvDeployLon": F.lit(-102.8)}
    )
    return time_to_sun(placed)


_RUNS = "obs AS (SELECT motusTagID, epoch_us(ts) AS us, runLen AS n FROM detections)"
_ACT = [_RUNS, *relative_sun("obs", "36.37e0", "-102.8e0")]


@query("M1_linear_regression", q(DET, *_ACT, body=f"""SELECT n, {r6('b', 'slope')}, {r6('a',
    'intercept')}, {r6('r2', 'r2')}, {r6('sqrt(rss / (n - 2))', 'sigma')},
    {r6('sqrt(rss / (n - 2) / sxx)', 'slope_se')},
    {r6('n * (ln(2 * pi()) + ln(rss / n) + 1) + 6', 'aic', 3)} FROM (SELECT count(*) AS n,
    regr_slope(n, ts_since_rise) AS b, regr_intercept(n, ts_since_rise) AS a,
    regr_r2(n, ts_since_rise) AS r2, regr_sxx(n, ts_since_rise) AS sxx, regr_syy(n, ts_since_rise)
    - regr_slope(n, ts_since_rise) * regr_sxy(n, ts_since_rise) AS rss FROM rel)"""))
def _(t):
    fit = models.ols(_activity(t), "ts_since_rise", "runLen")
    return fit.withColumn("aic", F.round("aic", 3))


# Newton's method on the slope; each tag's intercept follows from it
_POISSON = [
    """obs2 AS MATERIALIZED (SELECT CAST(motusTagID AS VARCHAR) AS g, ts_since_rise AS x, CAST(n AS DOUBLE) AS y FROM rel
        WHERE motusTagID IS NOT NULL AND ts_since_rise IS NOT NULL AND n IS NOT NULL)""",
    """steps AS (SELECT 0 AS i, 0e0 AS beta UNION ALL SELECT i + 1, beta + greatest(-1e0, least(1e0, score / info)) FROM (
        SELECT i, beta, sum(xy - y * s1 / s0) AS score, sum(y * (s2 / s0 - s1 / s0 * s1 / s0)) AS info FROM (
            SELECT i, beta, g, sum(y) AS y, sum(x * y) AS xy, sum(exp(beta * x)) AS s0, sum(x * exp(beta * x)) AS s1,
                sum(x * x * exp(beta * x)) AS s2 FROM steps, obs2 WHERE i < 15 GROUP BY i, beta, g) GROUP BY i, beta))""",
    """levels AS MATERIALIZED (SELECT g, beta, count(*) AS n, sum(y) AS y, sum(exp(beta * x)) AS s0, sum(x * exp(beta * x)) / sum(exp(beta * x)) AS mean,
        sum(x * x * exp(beta * x)) / sum(exp(beta * x)) AS square FROM obs2, (SELECT beta FROM steps WHERE i = 15) GROUP BY g, beta)""",
    """alphas AS MATERIALIZED (SELECT *, CASE WHEN y > 0 THEN ln(y / s0) ELSE CAST('-Infinity' AS DOUBLE) END AS alpha FROM levels)""",
    """base AS (SELECT g AS base, alpha AS alpha0, mean AS mean0, y AS y0 FROM alphas WHERE g = (SELECT min(g) FROM alphas WHERE y > 0))""",
    """known AS (SELECT 1 / sum(y * (square - mean * mean)) AS v, sum(n) FILTER (y > 0) - count(*) FILTER (y > 0) - 1 AS df FROM alphas)""",
    """pearson AS (SELECT sum((obs2.y - exp(alpha + beta * x)) * (obs2.y - exp(alpha + beta * x)) / exp(alpha + beta * x)) AS p
        FROM obs2 JOIN alphas ON obs2.g = alphas.g WHERE alphas.y > 0)""",
]


def _poisson_sql(scale: str) -> str:
    text = q(DET, *_ACT, *_POISSON, body=f"""SELECT 'ts_since_rise' AS term, {r6('beta', 'estimate')}, {r6(f'{scale} * sqrt(v)', 'std_error')}
        FROM steps, known, pearson WHERE i = 15 UNION ALL
        SELECT CASE WHEN g = base THEN '(Intercept)' ELSE g END, round(CASE WHEN g = base THEN alpha ELSE alpha - alpha0 END, 6) + 0,
            round({scale} * sqrt(CASE WHEN y = 0 THEN NULL WHEN g = base THEN 1 / y + v * mean * mean
                ELSE 1 / y + 1 / y0 + v * (mean - mean0) * (mean - mean0) END), 6) + 0 FROM alphas, base, known, pearson""")
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query("M2_poisson_regression", _poisson_sql("1e0"))
def _(t):
    return models.poisson_glm(_activity(t), "ts_since_rise", "runLen", "motusTagID")


@query("M3_quasi_poisson_regression", _poisson_sql("sqrt(p / df)"))
def _(t):
    return models.poisson_glm(_activity(t), "ts_since_rise", "runLen", "motusTagID", quasi=True)


_TAUS = [i / 10 for i in range(11)]


_QUANTILES = q(DET, *_ACT, body=" UNION ALL ".join(
    f"""SELECT CAST(n AS INT) AS runLen, {tau}e0 AS tau,
        {r6(f'quantile_cont(ts_since_rise, {tau})', 'quantile', 5)} FROM rel
        WHERE ts_since_rise IS NOT NULL GROUP BY n""" for tau in _TAUS))


@query("M4_group_quantiles", _QUANTILES)
def _(t):
    fit = group_quantiles(_activity(t), ["runLen"], "ts_since_rise", _TAUS)
    return fit.withColumn("quantile", F.round("quantile", 5))


@query("M4_group_quantiles_coarse_sketch", _QUANTILES)
def _(t):
    """The same quantiles by brackets of a sketch that is much coarser than the groups are large."""
    fit = group_quantiles(_activity(t), ["runLen"], "ts_since_rise", _TAUS, accuracy=50)
    return fit.withColumn("quantile", F.round("quantile", 5))


@query("M4_quantile_regression")
def _(t):
    return models.quantile_fit(_activity(t), "runLen", "ts_since_rise", 0.5)


@query("M4_quantile_regression_all_taus")
def _(t):
    """Lines at tau 0, 0.1, ... 1, fitted in the same passes."""
    return models.quantile_lines(_activity(t), "runLen", "ts_since_rise", _TAUS)


_GRID = [0.5 * i for i in range(2, 46)]


@query("M5_breakpoint", q(DET, *_ACT, "grid AS (SELECT i * 0.5e0 AS psi FROM range(2, 46) AS g(i))",
    """moments AS (SELECT psi, count(*) AS n, avg(ts_since_rise) AS mx,
        avg(greatest(ts_since_rise - psi, 0)) AS mh, avg(n) AS my,
        regr_sxx(n, ts_since_rise) AS cxx, regr_syy(n, ts_since_rise) AS cyy,
        regr_sxy(n, ts_since_rise) AS cxy, regr_sxx(n, greatest(ts_since_rise - psi, 0)) AS chh,
        regr_sxy(n, greatest(ts_since_rise - psi, 0)) AS chy,
        regr_sxy(greatest(ts_since_rise - psi, 0), ts_since_rise) AS cxh
        FROM rel, grid WHERE ts_since_rise IS NOT NULL GROUP BY psi)""",
    """fits AS (SELECT *, (cxy * chh - chy * cxh) / (cxx * chh - cxh * cxh) AS b1,
        (chy * cxx - cxy * cxh) / (cxx * chh - cxh * cxh) AS b2 FROM moments
        WHERE cxx * chh - cxh * cxh > 1e-9 * cxx * chh)""",
    body=f"""SELECT {r6('psi', 'psi')}, {r6('cyy - b1 * cxy - b2 * chy', 'rss', 3)},
        {r6('my - b1 * mx - b2 * mh', 'intercept', 4)}, {r6('b1', 'slope', 4)},
        {r6('b2', 'slope_change', 4)} FROM fits ORDER BY cyy - b1 * cxy - b2 * chy, psi LIMIT 1"""))
def _(t):
    fit = models.breakpoint(_activity(t), "ts_since_rise", "runLen", _GRID)
    return fit.select(
        "psi", F.round("rss", 3).alias("rss"),
        *[F.round(c, 4).alias(c) for c in ("intercept", "slope", "slope_change")],
    )


# the break is where the lines of both sides cross, or at a value of x
_SEGMENTS = [
    """xs AS (SELECT ts_since_rise AS x, CAST(n AS DOUBLE) AS y FROM rel WHERE ts_since_rise IS NOT NULL AND n IS NOT NULL)""",
    """mid AS MATERIALIZED (SELECT avg(x) AS x0, avg(y) AS y0 FROM xs)""",
    """pts AS MATERIALIZED (SELECT x - x0 AS px, CAST(count(*) AS DOUBLE) AS n, sum(x - x0) AS x, sum(y - y0) AS y, sum((x - x0) * (x - x0)) AS xx,
        sum((x - x0) * (y - y0)) AS xy, sum((y - y0) * (y - y0)) AS yy FROM xs, mid GROUP BY 1)""",
    """tot AS (SELECT sum(n) AS tn, sum(x) AS tx, sum(y) AS ty, sum(xx) AS txx, sum(xy) AS txy, sum(yy) AS tyy FROM pts)""",
    """cum AS MATERIALIZED (SELECT * FROM (SELECT px, lead(px) OVER (ORDER BY px) AS next, sum(n) OVER w AS n1, sum(x) OVER w AS x1, sum(y) OVER w AS y1,
        sum(xx) OVER w AS xx1, sum(xy) OVER w AS xy1, sum(yy) OVER w AS yy1 FROM pts WINDOW w AS (ORDER BY px)), tot WHERE next IS NOT NULL)""",
    """parted AS (SELECT *, tn - n1 AS n2, tx - x1 AS x2, ty - y1 AS y2, txx - xx1 AS xx2, txy - xy1 AS xy2, tyy - yy1 AS yy2 FROM cum)""",
    """var AS (SELECT *, xx1 - x1 * x1 / n1 AS c1, xx2 - x2 * x2 / n2 AS c2, xy1 - x1 * y1 / n1 AS p1, xy2 - x2 * y2 / n2 AS p2 FROM parted)""",
    """lines AS (SELECT *, CASE WHEN c1 > 1e-12 * xx1 THEN p1 / c1 END AS b1, CASE WHEN c2 > 1e-12 * xx2 THEN p2 / c2 END AS b2 FROM var)""",
    """crossed AS (SELECT *, (y1 / n1 - b1 * x1 / n1 - y2 / n2 + b2 * x2 / n2) / nullif(b2 - b1, 0) AS c FROM lines)""",
    """hinged AS (SELECT *, x2 - px * n2 AS h, xx2 - 2 * px * x2 + px * px * n2 - (x2 - px * n2) ** 2 / tn AS chh,
        xx2 - px * x2 - (x2 - px * n2) * tx / tn AS cxh, xy2 - px * y2 - (x2 - px * n2) * ty / tn AS chy,
        txx - tx * tx / tn AS cxx, txy - tx * ty / tn AS cxy, tyy - ty * ty / tn AS cyy FROM crossed)""",
    """solved AS (SELECT *, (cxy * chh - chy * cxh) / (cxx * chh - cxh * cxh) AS hb, (chy * cxx - cxy * cxh) / (cxx * chh - cxh * cxh) AS hd FROM hinged)""",
    """tried AS (SELECT c AS psi, yy1 - y1 * y1 / n1 - b1 * p1 + yy2 - y2 * y2 / n2 - b2 * p2 AS rss, (y1 - b1 * x1) / n1 AS a, b1 AS b, b2 - b1 AS d,
            n1, n2, x1, x2, c1, c2, tn FROM solved WHERE c > px AND c < next
        UNION ALL SELECT px, cyy - hb * cxy - hd * chy, (ty - hb * tx - hd * h) / tn, hb, hd, n1, n2, x1, x2,
            CASE WHEN b1 IS NOT NULL THEN c1 END, CASE WHEN b2 IS NOT NULL THEN c2 END, tn FROM solved
            WHERE cxx * chh - cxh * cxh > 1e-9 * cxx * chh)""",
]


@query("M5_segmented", q(DET, *_ACT, *_SEGMENTS, body=f"""SELECT CAST(tn AS BIGINT) AS n, {r6('psi + x0', 'psi', 4)},
    {r6('sqrt(rss / (tn - 4) * (1 / n1 + (psi - x1 / n1) ** 2 / c1 + 1 / n2 + (psi - x2 / n2) ** 2 / c2)) / abs(d)', 'psi_se', 4)},
    {r6('rss', 'rss', 3)}, {r6('a - b * x0 + y0', 'intercept', 4)}, {r6('b', 'slope', 4)}, {r6('d', 'slope_change', 4)}
    FROM tried, mid ORDER BY rss, psi LIMIT 1"""))
def _(t):
    """The break lies anywhere."""
    fit = models.segmented(_activity(t), "ts_since_rise", "runLen")
    return fit.select("n", F.round("rss", 3).alias("rss"), *[F.round(c, 4).alias(c) for c in ("psi", "psi_se", "intercept", "slope", "slope_change")])


_SLOPE = "CASE WHEN n * xx - x * x > 0 THEN (n * xy - x * y) / (n * xx - x * x) END"
_TAILS = ", ".join(f"{sum(math.exp(-1) / math.factorial(j) for j in range(k))!r}e0" for k in range(1, 12))
# draws of whole tags, each with a Poisson(1) weight from the hash of its name
_DRAWS = [
    """per AS MATERIALIZED (SELECT CAST(motusTagID AS VARCHAR) AS g, CAST(count(*) AS DOUBLE) AS n, sum(ts_since_rise) AS x, CAST(sum(n) AS DOUBLE) AS y,
        sum(ts_since_rise * ts_since_rise) AS xx, sum(ts_since_rise * n) AS xy FROM rel
        WHERE motusTagID IS NOT NULL AND ts_since_rise IS NOT NULL AND n IS NOT NULL GROUP BY 1)""",
    f"""weighed AS (SELECT per.*, rep, CASE WHEN rep = 0 THEN 1 ELSE len(list_filter([{_TAILS}], lambda t:
        CAST('0x' || substr(md5('17:' || rep || ':' || g), 1, 8) AS BIGINT) / 4294967296e0 >= t)) END AS w FROM per, range(0, 1001) AS r(rep))""",
    f"""slopes AS MATERIALIZED (SELECT rep, {_SLOPE} AS slope FROM (SELECT rep, sum(w * n) AS n, sum(w * x) AS x, sum(w * y) AS y, sum(w * xx) AS xx,
        sum(w * xy) AS xy FROM weighed GROUP BY rep))""",
]


@query("M6_bootstrap_slope", q(DET, *_ACT, *_DRAWS, body=f"""SELECT {r6('max(slope) FILTER (rep = 0)', 'estimate')},
    {r6('quantile_cont(slope, 0.025) FILTER (rep > 0)', 'lower')}, {r6('quantile_cont(slope, 0.975) FILTER (rep > 0)', 'upper')},
    count(slope) FILTER (rep > 0) AS reps FROM slopes"""))
def _(t):
    return models.bootstrap_slope(_activity(t), "ts_since_rise", "runLen", "motusTagID", reps=1000)


def _normal_cdf(z: str) -> str:
    """Series of the normal distribution function in odd powers over double factorials."""
    term = f"exp((2 * k + 1) * ln(abs({z})) + k * ln(2e0) + lgamma(k + 1e0) - lgamma(2e0 * k + 2))"
    return (f"(0.5e0 + CASE WHEN {z} = 0 THEN 0e0 ELSE sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi())"
            f" * list_sum(list_transform(range(0, 120), lambda k: {term})) END)")


# left out one by one, and the normal quantiles by halving
_BCA = [
    f"""left_out AS (SELECT {_SLOPE} AS v FROM (SELECT a.n - per.n AS n, a.x - per.x AS x, a.y - per.y AS y, a.xx - per.xx AS xx, a.xy - per.xy AS xy
        FROM per, (SELECT sum(n) AS n, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM per) a))""",
    """accel AS (SELECT sum((m - v) ** 3) / (6 * sum((m - v) ** 2) ** 1.5e0) AS a FROM left_out, (SELECT avg(v) AS m FROM left_out))""",
    """share AS (SELECT max(e) AS e, (count(*) FILTER (slope < e) + count(*) FILTER (slope = e) / 2e0) / count(*) AS s
        FROM slopes, (SELECT slope AS e FROM slopes WHERE rep = 0) WHERE rep > 0 AND slope IS NOT NULL)""",
    """halves AS (SELECT 0 AS i, p, -8e0 AS low, 8e0 AS high FROM (SELECT s AS p FROM share UNION SELECT 0.025e0 UNION SELECT 0.975e0)
        UNION ALL SELECT i + 1, p, CASE WHEN c < p THEN mid ELSE low END, CASE WHEN c < p THEN high ELSE mid END
        FROM (SELECT *, """ + _normal_cdf("mid") + """ AS c FROM (SELECT *, (low + high) / 2 AS mid FROM halves WHERE i < 60)))""",
    """z AS (SELECT max(low) FILTER (p = s) AS bias, max(low) FILTER (p = 0.025e0) AS z1, max(low) FILTER (p = 0.975e0) AS z2 FROM halves, share WHERE i = 60)""",
    """moved AS MATERIALIZED (SELECT e, a, bias, bias + (bias + z1) / (1 - a * (bias + z1)) AS m1, bias + (bias + z2) / (1 - a * (bias + z2)) AS m2
        FROM z, accel, share)""",
    f"""ends AS (SELECT e, a, bias, {_normal_cdf('m1')} AS p1, {_normal_cdf('m2')} AS p2 FROM moved)""",
    """ranked AS (SELECT slope, row_number() OVER (ORDER BY slope) - 1 AS place, count(*) OVER () AS n FROM slopes WHERE rep > 0 AND slope IS NOT NULL)""",
]


def _between(p: str) -> str:
    """Quantile at ``p`` between neighbouring ranks."""
    return f"sum(slope * greatest(0e0, 1 - abs(place - {p} * (n - 1))))"


@query("M6_bootstrap_bca", q(DET, *_ACT, *_DRAWS, *_BCA, body=f"""SELECT {r6('max(e)', 'estimate')}, {r6('max(bias)', 'bias')},
    {r6('max(a)', 'acceleration')}, {r6(_between('p1'), 'lower')}, {r6(_between('p2'), 'upper')}, count(*) AS reps
    FROM ranked, ends""").replace("WITH ", "WITH RECURSIVE ", 1))
def _(t):
    return models.bootstrap_bca(_activity(t), "ts_since_rise", "runLen", "motusTagID", reps=1000)


@query("M7_count_profile", q(DET, body=f"""SELECT n, {r6('m', 'mean')}, {r6('v', 'var')},
    {r6('m * m / (v - m)', 'nb_size')}, {r6('m', 'nb_mu')}, {r6('m * m / v', 'gamma_shape')},
    {r6('m / v', 'gamma_rate')} FROM (SELECT count(runLen) AS n, avg(runLen + 1e0) AS m,
    var_samp(runLen + 1e0) AS v FROM detections)"""))
def _(t):
    return models.count_profile(t.detections, "runLen")


def _polygamma_sql(x: str, order: int) -> str:
    """Digamma or trigamma: twenty steps of the recurrence, then the asymptotic series."""
    y, power = f"({x} + 20e0)", order + 1
    shift = f"list_sum(list_transform(range(0, 20), lambda j: 1 / ({x} + j) ** {power}))"
    if order == 0:
        return f"(ln{y} - 0.5e0 / {y} - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) - {shift})"
    return f"(1 / {y} + 1 / (2 * {y} ** 2) + 1 / (6 * {y} ** 3) - 1 / (30 * {y} ** 5) + 1 / (42 * {y} ** 7) + {shift})"


_SCORE = [
    """counted AS MATERIALIZED (SELECT runLen + 1e0 AS v, CAST(count(*) AS DOUBLE) AS k FROM detections WHERE runLen IS NOT NULL GROUP BY 1)""",
    """whole AS MATERIALIZED (SELECT n, m, logs, ln(m) - logs AS gap, (SELECT sum(k * (v - m) * (v - m)) / n FROM counted) AS spread
        FROM (SELECT sum(k) AS n, sum(k * v) / sum(k) AS m, sum(k * ln(v)) / sum(k) AS logs FROM counted))""",
    f"""sizes AS (SELECT 0 AS i, m * m / (spread - m) AS r, n, m, 0e0 AS bend FROM whole UNION ALL
        SELECT i + 1, r * exp(greatest(-1e0, least(1e0, -r * g / (r * g + r * r * h)))), n, m, h FROM (
            SELECT i, r, n, m, sum(k * ({_polygamma_sql('(v + r)', 0)} - {_polygamma_sql('r', 0)})) + n * ln(r / (r + m)) AS g,
                sum(k * ({_polygamma_sql('(v + r)', 1)} - {_polygamma_sql('r', 1)})) + n * (1 / r - 1 / (r + m)) AS h
            FROM sizes, counted WHERE i < 25 GROUP BY i, r, n, m))""",
    f"""shapes AS (SELECT 0 AS i, 0.5e0 / gap AS a, gap, n, m FROM whole UNION ALL
        SELECT i + 1, a * exp(greatest(-1e0, least(1e0, -(ln(a) - {_polygamma_sql('a', 0)} - gap) / (1 - a * {_polygamma_sql('a', 1)})))), gap, n, m
        FROM shapes WHERE i < 25)""",
    f"""shape AS (SELECT a, n, m, {_polygamma_sql('a', 1)} AS t FROM shapes WHERE i = 25)""",
]


@query("M7_count_fits", q(DET, *_SCORE, body=f"""SELECT CAST(s.n AS BIGINT) AS n, {r6('r', 'nb_size')}, {r6('1 / sqrt(-bend)', 'nb_size_se')},
    {r6('s.m', 'nb_mu')}, {r6('sqrt(s.m * (1 + s.m / r) / s.n)', 'nb_mu_se')}, {r6('a', 'gamma_shape')}, {r6('sqrt(a / (s.n * (a * t - 1)))', 'gamma_shape_se')},
    {r6('a / s.m', 'gamma_rate')}, {r6('a / s.m * sqrt(t / (s.n * (a * t - 1)))', 'gamma_rate_se')}
    FROM sizes s, shape WHERE s.i = 25""").replace("WITH ", "WITH RECURSIVE ", 1))
def _(t):
    return models.count_fits(t.detections, "runLen")


# ---- sun-relative time of every detection -------------------------------------------------------


@query("L3_X7_time_to_sun", q(DET, *_ACT, body="SELECT motusTagID, ts, n AS runLen, "
       + ", ".join(r6(c, c, 4) for c in SUN_NAMES) + " FROM rel"))
def _(t):
    return _activity(t).select(
        "motusTagID", "ts", "runLen", *[F.round(c, 4).alias(c) for c in SUN_NAMES]
    )


@query("A12_activity_since_sunrise", q(DET, *_ACT, body=f"""SELECT
    {r6('ts_since_rise', 'ts_since_rise', 1)}, count(*) AS count,
    CAST(sum(n) AS BIGINT) AS beep_count FROM rel
    WHERE ts_since_rise IS NOT NULL GROUP BY ALL"""))
def _(t):
    rows = _activity(t).where("ts_since_rise IS NOT NULL").withColumnRenamed("runLen", "beep_count")
    return agg.activity_since_sunrise(rows, 1)


