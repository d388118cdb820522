"""Sources, row filters, derivations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pingtrail.functions import angles, timeutil as tu
from pingtrail.operators import filters as flt
from pingtrail.plans.oracle import LABELS, OFFSETS, query as q, r6, wrap360
from pingtrail.plans.registry import query, scratch
from pingtrail.sources import paging, sinks, tables as src

DET = "detections"
BASIC = "hitID, motusTagID, epoch_us(ts) AS ts, " + r6("sig", "sig") + ", recvDeployName"
COLS = ["hitID", "motusTagID", "ts", "sig", "recvDeployName"]


def det(where: str, cols: str = BASIC) -> str:
    return q(DET, body=f"SELECT {cols} FROM detections WHERE {where}")


@query("S1_scan", det("true", BASIC + ", port, antBearing, speciesEN, recvDeployLat"))
def _(t):
    return t.detections.select(*COLS, "port", "antBearing", "speciesEN", "recvDeployLat")


@query(
    "S2_S4_csv_null_strings",
    det("true", "hitID, mfgID, port, speciesEN, antBearing, runLen"),
)
def _(t):
    folder = scratch(t.spark)
    sinks.write_csv(
        t.detections.select("hitID", "mfgID", "port", "speciesEN", "antBearing", "runLen"), folder
    )
    schema = "hitID BIGINT, mfgID STRING, port STRING, speciesEN STRING, antBearing DOUBLE, runLen INT"
    return src.read_csv(t.spark, folder, schema)


@query(
    "S3_S5_csv_per_tag",
    det(
        "mfgID IN ('00000003', '00000005', '0000000A')",
        "hitID, mfgID, port, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) * 1000000 AS ts",
    ),
)
def _(t):
    folder = scratch(t.spark)
    sinks.write_per_tag(t.detections.select("hitID", "ts", "port", "mfgID"), folder)
    schema = "hitID BIGINT, ts TIMESTAMP, port STRING, mfgID STRING"
    return src.read_tags(t.spark, folder, schema, ["00000003", "00000005", "0000000A"])


@query("S6_snapshot", det("true"))
def _(t):
    folder = scratch(t.spark)
    sinks.write_snapshot(t.detections.select(*COLS), folder)
    return t.spark.read.parquet(folder)


@query("S7_append_new", det("true", "hitID, batchID, motusTagID"))
def _(t):
    # the stored copy lacks the latest half; arrivals overlap it, and arrive twice
    rows = t.detections.select("hitID", "batchID", "motusTagID", "ts")
    folder = scratch(t.spark)
    sinks.write_snapshot(rows.where("ts < '2024-01-16'").drop("ts"), folder)
    arriving = rows.where("ts >= '2024-01-12' OR ts IS NULL").drop("ts")
    for _ in range(2):
        sinks.append_new(arriving, folder, ("hitID", "batchID"), batch="batchID")
    return t.spark.read.parquet(folder)


def _paged_copy(t):
    """Detections copied in pages, stopped after two rounds and taken up again, with the rows and the folder."""
    rows, folder = t.detections.select("hitID", "batchID", "motusTagID"), scratch(t.spark)
    paging.copy_pages(rows, folder, size=250, most_rounds=2)
    paging.copy_pages(rows, folder, size=250)
    return rows, folder


@query("S7_paged_copy", det("true", "hitID, batchID, motusTagID"))
def _(t):
    rows, folder = _paged_copy(t)
    return paging.read_pages(t.spark, folder, rows.schema)


@query("S7_page_cursors", q(DET, body="""SELECT batchID, max(hitID) AS last, true AS done, CAST(count(DISTINCT floor(before / 250)) AS BIGINT) AS pages
    FROM (SELECT batchID, hitID, coalesce(sum(n) OVER (PARTITION BY batchID ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT batchID, floor(hitID / 250) AS cell, max(hitID) AS hitID, count(*) AS n FROM detections GROUP BY 1, 2)) GROUP BY 1"""))
def _(t):
    return paging.page_cursors(*_paged_copy(t))


LISTED = {"hitID": "bigint", "motusTagID": "bigint", "ts": "timestamp", "sig": "double", "recvDeployName": "string", "runLen": "int",
          "antBearing": "double", "recvDeployLat": "double", "speciesEN": "string"}


@query(
    "S8_columns_of_detections",
    q(DET, body=" UNION ALL ".join(f"""SELECT '{c}' AS "column", '{kind}' AS type, count({c}) AS filled, count(*) AS n FROM detections"""
        for c, kind in LISTED.items())),
)
def _(t):
    return src.filled_columns(t.detections.select(*LISTED))


@query("S9_head", q(DET, body=f"SELECT {BASIC} FROM detections ORDER BY detections.ts, hitID LIMIT 6"))
def _(t):
    return src.head(t.detections, ["ts", "hitID"]).select(*COLS)


@query(
    "S9_tail",
    q(DET, body=f"SELECT {BASIC} FROM detections ORDER BY detections.ts DESC, hitID DESC LIMIT 6"),
)
def _(t):
    return src.tail(t.detections, ["ts", "hitID"]).select(*COLS)


@query("F1_keep_columns", det("true", "tagProjID, mfgID, motusTagID, runLen, port"))
def _(t):
    return t.detections.select("tagProjID", "mfgID", "motusTagID", "runLen", "port")


@query("F2_drop_columns", det("true", "hitID, runID, batchID, port, motusTagID"))
def _(t):
    keep = {"hitID", "runID", "batchID", "port", "motusTagID"}
    return t.detections.drop(*[c for c in t.detections.columns if c not in keep], "absent")


@query("F3_rename", det("true", "hitID, recvDeployName AS Final_RecvName, port AS Final_Port"))
def _(t):
    renamed = t.detections.withColumnsRenamed(
        {"recvDeployName": "Final_RecvName", "port": "Final_Port"}
    )
    return renamed.select("hitID", "Final_RecvName", "Final_Port")


@query(
    "F4_standard_filter",
    det("tagDeployTest = 0 AND recvDeployName IS NOT NULL AND mfg = 'CTT'"
        " AND recvSiteName <> 'Workshop'"),
)
def _(t):
    return flt.standard_filter(t.detections, not_sites=["Workshop"], mfg="CTT").select(*COLS)


@query(
    "F4_one_site",
    det("tagDeployTest = 0 AND recvDeployName IS NOT NULL AND recvSiteName IN ('West Plains')"
        " AND speciesEN = 'Species 7'"),
)
def _(t):
    kept = flt.standard_filter(t.detections, sites=["West Plains"], species="Species 7")
    return kept.select(*COLS)


@query(
    "F5_bounding_box",
    det("recvDeployLat BETWEEN 36.2e0 AND 36.6e0 AND recvDeployLon BETWEEN -103.1e0 AND -102.1e0"),
)
def _(t):
    return flt.bbox(t.detections).select(*COLS)


@query(
    "F6_time_slice",
    det("ts > TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:30:00'"
        " AND recvDeployName = 'Felt'"),
)
def _(t):
    kept = flt.time_slice(t.detections, "2024-01-05", "2024-01-20 12:30:00", station="Felt")
    return kept.select(*COLS)


@query("F7_good_runs", det("motusFilter = 1", "hitID, runID, runLen"))
def _(t):
    return flt.split_runs(t.detections)[0].select("hitID", "runID", "runLen")


@query("F7_dubious_runs", det("motusFilter = 0", "hitID, runID, runLen"))
def _(t):
    return flt.split_runs(t.detections)[1].select("hitID", "runID", "runLen")


@query("F8_short_runs", det("runLen <= 3", "hitID, runID, batchID, motusTagID, runLen"))
def _(t):
    return flt.short_runs(t.detections).select("hitID", "runID", "batchID", "motusTagID", "runLen")


@query("F8_long_runs", det("runLen > 2", "hitID, runLen"))
def _(t):
    return flt.split_runs(t.detections, "runLen")[0].select("hitID", "runLen")


@query("F8_blocked_runs", det("runLen = 2", "DISTINCT motusTagID, runID"))
def _(t):
    return flt.split_runs(t.detections, "runLen")[1]


@query(
    "F9_J1_run_probability_filter",
    q(DET, "run_filter", body=f"""SELECT hitID, {r6('p', 'probability')} FROM (
        SELECT d.hitID, coalesce(f.probability, 1) AS p FROM detections d LEFT JOIN run_filter f
        ON d.runID = f.runID AND d.motusTagID = f.motusTagID) WHERE p > 0"""),
)
def _(t):
    return flt.apply_run_filter(t.detections, t.run_filter).select("hitID", "probability")


@query(
    "F10_missing_locations",
    det("recvDeployLat IS NULL OR recvDeployName IS NULL",
        "DISTINCT recvDeployLat, recvDeployLon, recvDeployName, recvDeployID, recv, recvProjID,"
        " recvProjName"),
)
def _(t):
    return flt.missing_locations(t.detections)


@query("F11_has_location", det("recvDeployLat IS NOT NULL OR recvDeployLat <> 0",
                               "hitID, recvDeployLat"))
def _(t):
    return t.detections.where(flt.has_location()).select("hitID", "recvDeployLat")


@query("F11_has_location_strict", det("recvDeployLat IS NOT NULL AND recvDeployLat <> 0",
                                      "hitID, recvDeployLat"))
def _(t):
    return t.detections.where(flt.has_location(strict=True)).select("hitID", "recvDeployLat")


@query(
    "F12_station_name",
    det("true", """hitID, coalesce(recvDeployName, CASE WHEN recvDeployLat IS NOT NULL AND
        recvDeployLon IS NOT NULL THEN
        regexp_replace(regexp_replace(CAST(CAST(recvDeployLat AS DECIMAL(20,12)) AS VARCHAR), '0+$', ''), '[.]$', '') || ':'
        || regexp_replace(regexp_replace(CAST(CAST(recvDeployLon AS DECIMAL(20,12)) AS VARCHAR), '0+$', ''), '[.]$', '')
        END) AS recvDeployName"""),
)
def _(t):
    return flt.fill_station_name(t.detections).select("hitID", "recvDeployName")


@query(
    "F13_gps_fallback",
    det("true", "hitID, "
        + r6("CASE WHEN gpsLat IS NULL OR gpsLat = 0 THEN recvDeployLat ELSE gpsLat END", "recvLat")
        + ", "
        + r6("CASE WHEN gpsLon IS NULL OR gpsLon = 0 THEN recvDeployLon ELSE gpsLon END", "recvLon")
        + ", " + r6("CASE WHEN gpsAlt IS NULL THEN recvDeployAlt ELSE gpsAlt END", "recvAlt")),
)
def _(t):
    return flt.receiver_position(t.detections).select("hitID", "recvLat", "recvLon", "recvAlt")


def _bearing_sql(value: str) -> str:
    return q(DET, OFFSETS, body=f"""SELECT hitID, {value} FROM (
        SELECT d.*, antBearing + coalesce(o.off, 0) AS adj FROM detections d
        LEFT JOIN bearing_offsets o ON d.recvDeployName = o.recvDeployName)""")


@query("F14_bearing_correction", _bearing_sql(r6("adj", "antBearing_adj")))
def _(t):
    return flt.correct_bearing(t.detections, t.offsets).select("hitID", "antBearing_adj")


@query("F14_bearing_correction_wrapped", _bearing_sql(r6(wrap360("adj"), "antBearing_adj")))
def _(t):
    kept = flt.correct_bearing(t.detections, t.offsets, wrap=True)
    return kept.select("hitID", "antBearing_adj")


@query(
    "F15_bearing_category",
    det("true", """hitID, CASE antBearing WHEN 90 THEN 'N' WHEN 0 THEN 'E' WHEN 180 THEN 'S'
        WHEN 270 THEN 'W' END AS antBearing_cat"""),
)
def _(t):
    return t.detections.select("hitID", angles.bearing_category("antBearing").alias("antBearing_cat"))


@query(
    "F16_ambiguity",
    det("true", "hitID, CASE WHEN ambigID IS NOT NULL THEN 'ambiguous tag' ELSE 'okay tag' END"
        " AS ambig"),
)
def _(t):
    return t.detections.select("hitID", flt.ambiguity().alias("ambig"))


@query(
    "F17_run_length_bins",
    det("true", """hitID, CASE WHEN runLen > 0 AND runLen <= 5 THEN '(0,5]'
        WHEN runLen > 5 AND runLen <= 10 THEN '(5,10]' WHEN runLen > 10 AND runLen <= 20
        THEN '(10,20]' WHEN runLen > 20 THEN '(20,Inf]' END AS runLen_cat"""),
)
def _(t):
    bins = tu.cut("runLen", [0, 5, 10, 20, float("inf")])
    return t.detections.select("hitID", bins.alias("runLen_cat"))


SECTOR_SQL = """CASE WHEN b >= 337.5 OR b <= 22.5 THEN 'North' WHEN b <= 67.5 THEN 'Northeast'
    WHEN b <= 112.5 THEN 'East' WHEN b <= 157.5 THEN 'Southeast' WHEN b <= 202.5 THEN 'South'
    WHEN b <= 247.5 THEN 'Southwest' WHEN b <= 292.5 THEN 'West' WHEN b <= 337.5 THEN 'Northwest'
    ELSE 'Unknown/Omni' END"""


@query(
    "F18_compass_sector",
    q(DET, OFFSETS, body=f"""SELECT hitID, {SECTOR_SQL} AS sector FROM (
        SELECT hitID, {wrap360('antBearing + coalesce(o.off, 0)')} AS b FROM detections d
        LEFT JOIN bearing_offsets o ON d.recvDeployName = o.recvDeployName)"""),
)
def _(t):
    corrected = flt.correct_bearing(t.detections, t.offsets)
    return corrected.select("hitID", angles.compass_sector("antBearing_adj").alias("sector"))


@query(
    "F20_signal_normalised",
    det("true", "hitID, " + r6("(sig + 78.0691e0) / (-17.8707e0 + 78.0691e0)", "sig_norm")),
)
def _(t):
    return t.detections.select("hitID", flt.normalised_signal().alias("sig_norm"))


@query(
    "F20_signal_normalised_by_station",
    q(DET, body=f"""SELECT hitID, {r6('(sig - lo) / nullif(hi - lo, 0)', 'sig_norm')} FROM (
        SELECT hitID, sig,
        CASE WHEN recvDeployName IS NOT NULL THEN min(sig) OVER (PARTITION BY recvDeployName) END AS lo,
        CASE WHEN recvDeployName IS NOT NULL THEN max(sig) OVER (PARTITION BY recvDeployName) END AS hi
        FROM detections)"""),
)
def _(t):
    return flt.normalise_by_station(t.detections).select("hitID", "sig_norm")


@query(
    "F21_node_labels",
    q("beeps", LABELS, body="""SELECT l.label AS NodeId, count(*) AS n FROM beeps b
        JOIN node_labels l ON upper(b.NodeId) = l.NodeId GROUP BY l.label
        UNION ALL SELECT NULL, count(*) FROM beeps WHERE NodeId IS NULL"""),
)
def _(t):
    labelled = flt.label_nodes(t.beeps, t.labels)
    return labelled.groupBy("NodeId").agg(F.count(F.lit(1)).alias("n"))


@query("F22_membership_list", det("mfgID IN ('00000003', '0000000A')"))
def _(t):
    return t.detections.where(F.col("mfgID").isin("00000003", "0000000A")).select(*COLS)


@query(
    "F22_membership_table",
    q(DET, "run_filter", body="""SELECT hitID, motusTagID FROM detections
        WHERE runID IN (SELECT runID FROM run_filter)"""),
)
def _(t):
    return flt.in_table(t.detections, t.run_filter, "runID").select("hitID", "motusTagID")


@query(
    "F23_incomplete_rows",
    det("port IS NULL OR sig IS NULL OR antBearing IS NULL OR recvDeployLat IS NULL",
        "hitID, port, " + r6("sig", "sig") + ", antBearing, recvDeployLat"),
)
def _(t):
    return flt.incomplete_rows(
        t.detections.select("hitID", "port", "sig", "antBearing", "recvDeployLat")
    )


@query("F24_without_node_port", det("port <> 'L5'", "hitID, port"))
def _(t):
    return flt.without_port(t.detections).select("hitID", "port")


@query("F24_with_bearing", det("antBearing IS NOT NULL", "hitID, antBearing"))
def _(t):
    return flt.with_bearing(t.detections).select("hitID", "antBearing")


@query("F26_known_species", det("speciesEN IS NOT NULL", "hitID, speciesEN"))
def _(t):
    return t.detections.where("speciesEN IS NOT NULL").select("hitID", "speciesEN")


@query(
    "X1_X2_epoch_round_trip",
    det("true", "hitID, epoch_us(ts) AS back, " + r6("epoch_us(ts) / 1000000e0", "epoch")),
)
def _(t):
    epoch = tu.seconds("ts")
    return t.detections.select(
        "hitID", tu.from_seconds(epoch).alias("back"), epoch.alias("epoch")
    )


@query(
    "X3_calendar_parts",
    det("true", """hitID, CAST(year(ts) AS INT) AS year, CAST(dayofyear(ts) AS INT) AS doy,
        CAST(hour(ts) AS INT) AS hour, strftime(ts, '%Y-%m-%d') AS date"""),
)
def _(t):
    return t.detections.select(
        "hitID", F.year("ts").alias("year"), F.dayofyear("ts").alias("doy"),
        F.hour("ts").alias("hour"), F.to_date("ts").alias("date"),
    )


@query(
    "X4_local_date_and_clock",
    det("true", """hitID, strftime(ts - INTERVAL 6 HOUR, '%m-%d-%Y') AS date,
        strftime(ts - INTERVAL 6 HOUR, '%H:%M:%S') AS time"""),
)
def _(t):
    return t.detections.select(
        "hitID", tu.local_date_text("ts").alias("date"), tu.local_clock("ts").alias("time")
    )


def rounded_sql(step_s: int, shift: int) -> str:
    step = step_s * 1_000_000
    moved = f"(epoch_us(ts) + {shift})"
    return f"({moved} - {moved} % {step})"


@query(
    "X5_round_time",
    det("true", "hitID, " + ", ".join(
        f"{rounded_sql(s, shift)} AS {name}" for name, s, shift in (
            ("hour", 3600, 1_800_000_000), ("second", 1, 500_000), ("five", 5, 2_500_000),
            ("three_min", 180, 90_000_000), ("floor_five", 5, 0), ("ceil_five", 5, 4_999_999),
        ))),
)
def _(t):
    return t.detections.select(
        "hitID",
        tu.round_time("ts", 3600).alias("hour"), tu.round_time("ts", 1).alias("second"),
        tu.round_time("ts", 5).alias("five"), tu.round_time("ts", 180).alias("three_min"),
        tu.round_time("ts", 5, "floor").alias("floor_five"),
        tu.round_time("ts", 5, "ceil").alias("ceil_five"),
    )


@query(
    "X6_parse_time",
    det("true", "hitID, CASE WHEN port IS NULL THEN NULL ELSE"
        " epoch_us(date_trunc('second', ts)) END AS parsed"),
)
def _(t):
    text = F.when(F.col("port").isNull(), F.lit("2021-03-28 14:39:000")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    return t.detections.select("hitID", tu.parse_time(text).alias("parsed"))


@query(
    "X8_text_functions",
    det("true", """hitID, upper(recvDeployName) AS up, replace(recvDeployName, 'Playa', 'P') AS rep,
        concat_ws(':', mfgID, port) AS joined"""),
)
def _(t):
    return t.detections.select(
        "hitID", F.upper("recvDeployName").alias("up"),
        F.regexp_replace("recvDeployName", "Playa", "P").alias("rep"),
        F.concat_ws(":", "mfgID", "port").alias("joined"),
    )


@query(
    "X9_conditionals",
    det("true", """hitID, CASE WHEN sig IS NULL THEN 0 WHEN sig BETWEEN -60 AND -40 THEN 2 ELSE 1 END
        AS grade, coalesce(port, nodeNum, 'none') AS channel"""),
)
def _(t):
    grade = F.when(F.col("sig").isNull(), 0).when(F.col("sig").between(-60, -40), 2).otherwise(1)
    return t.detections.select(
        "hitID", grade.alias("grade"), F.coalesce("port", "nodeNum", F.lit("none")).alias("channel")
    )


@query(
    "X10_date_sequence",
    q(DET, body="""SELECT strftime(d, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(
        date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS d
        FROM detections)"""),
)
def _(t):
    span = t.detections.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("day"))
