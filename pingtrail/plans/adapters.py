"""Maps the supplied star-schema tables onto telemetry tables.

Each mapping is one select list in SQL common to Spark and ANSI engines, over whole tables, so that
results can be checked elsewhere on exactly the same input. Deployments and run filters number tags and runs from
a later start than the tables they are joined with, so that some rows of either side find no partner. The number of
beeping tags grows with the tables, so that joins within a tag grow in proportion.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from pingtrail.functions.fixed import NODE_LABELS, bearing_offsets, literal_table, node_labels

# event_type -> (station, latitude, longitude, site)
STATIONS = {
    "click": ("New Playa", 36.30, -102.90, "West Plains"),
    "view": ("Felt", 36.36, -102.80, "West Plains"),
    "purchase": ("Ying-Yang", 36.42, -102.70, "West Plains"),
    "signup": ("Mirage", 36.48, -102.60, "East Plains"),
    "error": ("Tumbleweed", 36.55, -102.45, "Workshop"),
}
NODES = [
    (node, round(36.48 + 0.002 * (i % 5), 3), round(-102.66 + 0.002 * (i // 5), 3))
    for i, (node, _) in enumerate(NODE_LABELS)
]


def _per_station(i: int) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else f"{v!r}e0"

    cases = " ".join(f"WHEN '{k}' THEN {lit(v[i])}" for k, v in STATIONS.items())
    return f"CASE event_type {cases} END"


_NODE_CASE = " ".join(
    f"WHEN {i} THEN '{node.lower()}'" for i, (node, _) in enumerate(NODE_LABELS)
)

# name -> (source query, select list); k is the number inside props ({"k": n}), 0..99
VIEWS = {
    "detections": (
        """SELECT event_id AS e, user_id AS u, event_type, value, CAST(ts AS TIMESTAMP) AS t,
            CAST(substring(props, 7, length(props) - 7) AS INT) AS k FROM events""",
        {
            "hitID": "e",
            "runID": "u * 10 + k % 10",
            "batchID": "CAST(floor(e / 1000) AS BIGINT)",
            "ts": "t",
            "tsCorrected": "t + INTERVAL '1' SECOND",
            "sig": "CASE WHEN k = 42 THEN NULL ELSE -20e0 - value END",
            "port": """CASE WHEN k = 77 THEN NULL WHEN k % 10 = 9 THEN 'L5'
                ELSE concat('L', CAST(k % 4 + 1 AS STRING)) END""",
            "antBearing": "CASE WHEN k % 10 = 9 THEN NULL ELSE (k % 8) * 45e0 END",
            "antHeight": "10e0 + k % 3",
            "nodeNum": "CASE WHEN k % 10 = 9 THEN CAST(k AS STRING) END",
            "motusFilter": "CASE WHEN k % 7 = 0 THEN 0 ELSE 1 END",
            "runLen": "k % 26",
            "motusTagID": "u",
            "ambigID": "CASE WHEN k % 6 = 0 THEN -u END",
            "mfgID": "lpad(hex(u), 8, '0')",
            "mfg": "CASE WHEN u % 4 = 0 THEN 'Lotek' ELSE 'CTT' END",
            "tagProjID": "CAST(CASE WHEN u % 3 = 0 THEN 500 ELSE 200 + u % 3 END AS INT)",
            "tagProjName": "CASE WHEN u % 3 = 0 THEN 'Plains' ELSE 'Other' END",
            "tagDeployID": "CASE WHEN k = 50 THEN NULL ELSE u * 10 + (k % 2) * (u % 2) END",
            "tagDeployStart": "CAST('2023-12-01 00:00:00' AS TIMESTAMP)",
            "tagDeployTest": "CASE WHEN k % 20 = 0 THEN 1 ELSE 0 END",
            "tagDepLat": "36e0 + (u % 10) / 10e0",
            "tagDepLon": "-103e0 + (u % 10) / 10e0",
            "speciesID": "CAST(u % 20 AS INT)",
            "speciesEN": "CASE WHEN u % 20 = 0 THEN NULL"
                         " ELSE concat('Species ', CAST(u % 20 AS STRING)) END",
            "recv": "concat('R-', event_type)",
            "recvProjID": "CAST(500 AS INT)",
            "recvProjName": "'Plains'",
            "recvDeployID": "CAST(length(event_type) AS BIGINT)",
            "recvDeployName": f"CASE WHEN k = 99 THEN NULL ELSE {_per_station(0)} END",
            "recvSiteName": f"CASE WHEN k = 96 THEN NULL ELSE {_per_station(3)} END",
            "recvDeployLat": "CASE WHEN k = 98 THEN NULL WHEN k = 97 THEN 0e0"
                             f" ELSE {_per_station(1)} END",
            "recvDeployLon": f"CASE WHEN k = 98 THEN NULL ELSE {_per_station(2)} END",
            "recvDeployAlt": "1200e0",
            "gpsLat": "CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN 0e0"
                      f" ELSE {_per_station(1)} + 0.001e0 END",
            "gpsLon": f"CASE WHEN k % 5 = 0 THEN NULL ELSE {_per_station(2)} END",
            "gpsAlt": "CASE WHEN k % 2 = 0 THEN NULL ELSE 0e0 END",
        },
    ),
    "tags": (
        "SELECT * FROM customer",
        {"tagID": "c_custkey", "projectID": "c_nationkey"},
    ),
    "tag_deployments": (
        "SELECT * FROM orders",
        {
            "deployID": "o_orderkey",
            "tagID": "o_custkey + 40",
            "projectID": "CAST(o_custkey % 25 AS INT)",
            "tsStart": "CAST(o_orderdate AS TIMESTAMP)",
            "tsEnd": """CASE WHEN o_orderkey % 5 = 0 THEN NULL
                ELSE CAST(o_orderdate AS TIMESTAMP) + INTERVAL '30' DAY END""",
            "speciesID": "CAST(o_custkey % 20 AS INT)",
            "latitude": "30e0 + o_custkey % 20",
            "longitude": "-110e0 + o_custkey % 15",
        },
    ),
    "receiver_deployments": (
        "SELECT s_suppkey, s_nationkey, n_name FROM supplier"
        " JOIN nation ON s_nationkey = n_nationkey",
        {
            "deviceID": "s_suppkey",
            "deployID": "s_suppkey * 10",
            "projectID": "s_nationkey",
            "recvProjName": "n_name",
            "tsStart": "CAST('2020-01-01 00:00:00' AS TIMESTAMP) + s_suppkey * INTERVAL '1' DAY",
            "tsEnd": """CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE
                CAST('2020-07-01 00:00:00' AS TIMESTAMP) + s_suppkey * INTERVAL '1' DAY END""",
            "latitude": "30e0 + s_suppkey % 20",
            "longitude": "-110e0 + s_suppkey % 15",
        },
    ),
    "species": ("SELECT * FROM nation", {"id": "n_nationkey", "name": "n_name"}),
    "run_filter": (
        "SELECT * FROM part",
        {
            "runID": "p_partkey + 60",
            "motusTagID": "CAST(floor((p_partkey + 60) / 10) AS BIGINT)",
            "probability": "CASE WHEN p_size % 5 = 0 THEN 0e0 ELSE p_size / 50e0 END",
        },
    ),
    "beeps": (
        "SELECT * FROM lineitem",
        {
            "Time": "CAST(l_shipdate AS TIMESTAMP) + (l_orderkey % 1440) * INTERVAL '1' MINUTE",
            "TagId": "CAST(CAST(floor(l_partkey / 40) AS BIGINT) AS STRING)",
            "NodeId": "CASE WHEN l_linenumber = 7 AND l_suppkey % 20 = 3 THEN NULL"
                      f" ELSE CASE l_suppkey % 20 {_NODE_CASE} END END",
            "TagRSSI": "-l_quantity - 40e0",
        },
    ),
    "calibration": (
        "SELECT o_custkey, min(CAST(o_orderdate AS TIMESTAMP)) AS t FROM orders GROUP BY o_custkey",
        {
            "pt": "CAST(o_custkey AS STRING)",
            "session_id": "CAST(o_custkey AS STRING)",
            "start": "t",
            "end": "t + INTERVAL '2' DAY",
            "TagId": "CAST(CAST(floor(o_custkey / 30) AS BIGINT) AS STRING)",
            "TagLat": "36.4834e0 + (o_custkey % 3) * 0.001e0",
            "TagLng": "-102.6574e0 + (o_custkey % 5) * 0.001e0",
        },
    ),
    "departures": (
        "SELECT user_id, min(CAST(ts AS TIMESTAMP)) AS t FROM events GROUP BY user_id",
        {"motusTagID": "user_id", "ts_depart": "t + INTERVAL '5' DAY"},
    ),
}
SOURCES = ["nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


class Tables:
    """Telemetry tables over one folder of parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        query, columns = VIEWS[name]
        used = {t: self.source(t) for t in SOURCES if t in query}
        base = self.spark.sql(_named(query, used), **used)
        return base.selectExpr(*[f"{sql} AS `{c}`" for c, sql in columns.items()])

    detections = cached_property(lambda self: self.view("detections"))
    tags = cached_property(lambda self: self.view("tags"))
    tag_deployments = cached_property(lambda self: self.view("tag_deployments"))
    receiver_deployments = cached_property(lambda self: self.view("receiver_deployments"))
    species = cached_property(lambda self: self.view("species"))
    run_filter = cached_property(lambda self: self.view("run_filter"))
    beeps = cached_property(lambda self: self.view("beeps"))
    calibration = cached_property(lambda self: self.view("calibration"))
    departures = cached_property(lambda self: self.view("departures"))

    @cached_property
    def nodes(self) -> DataFrame:
        rows = [(n.lower(), lat, lng) for n, lat, lng in NODES]
        return literal_table(self.spark, ["NodeId", "lat", "lng"], rows)

    @cached_property
    def offsets(self) -> DataFrame:
        return bearing_offsets(self.spark)

    @cached_property
    def labels(self) -> DataFrame:
        return node_labels(self.spark)


def _named(query: str, tables: dict[str, DataFrame]) -> str:
    """Turn table names after FROM/JOIN into references to the DataFrames handed to ``sql``."""
    for name in tables:
        for word in ("FROM", "JOIN"):
            query = query.replace(f"{word} {name}", f"{word} {{{name}}}")
    return query
