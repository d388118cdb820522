"""Explicit schemas of the telemetry tables; nothing is ever inferred.

Tag and node ids are text: an id such as ``1E193434`` would otherwise be read as a number.
"""

from __future__ import annotations

DETECTIONS = """
    hitID BIGINT, runID BIGINT, batchID BIGINT, ts TIMESTAMP, tsCorrected TIMESTAMP, sig DOUBLE,
    port STRING, antBearing DOUBLE, antHeight DOUBLE, nodeNum STRING, motusFilter INT, runLen INT,
    motusTagID BIGINT, ambigID BIGINT, mfgID STRING, mfg STRING, tagProjID INT, tagProjName STRING,
    tagDeployID BIGINT, tagDeployStart TIMESTAMP, tagDeployEnd TIMESTAMP, tagDeployTest INT,
    tagDepLat DOUBLE, tagDepLon DOUBLE, speciesID INT, speciesEN STRING, recv STRING,
    deviceID BIGINT, recvProjID INT, recvProjName STRING, recvDeployID BIGINT,
    recvDeployName STRING, recvSiteName STRING, recvDeployLat DOUBLE, recvDeployLon DOUBLE,
    recvDeployAlt DOUBLE, gpsLat DOUBLE, gpsLon DOUBLE, gpsAlt DOUBLE
"""

SCHEMAS = {
    "detections": DETECTIONS,
    "detections_gps": DETECTIONS,
    "tags": "tagID BIGINT, projectID INT",
    "tag_deployments": """tagID BIGINT, projectID INT, tsStart TIMESTAMP, tsEnd TIMESTAMP,
        speciesID INT, latitude DOUBLE, longitude DOUBLE""",
    "receiver_deployments": """deviceID BIGINT, deployID BIGINT, projectID INT,
        tsStart TIMESTAMP, tsEnd TIMESTAMP, latitude DOUBLE, longitude DOUBLE""",
    "species": "id INT, name STRING",
    "run_filter": "runID BIGINT, motusTagID BIGINT, probability DOUBLE",
    "batches": "batchID BIGINT, source STRING",
    "bearing_offsets": "recvDeployName STRING, offset DOUBLE",
    "beeps": "Time TIMESTAMP, TagId STRING, NodeId STRING, TagRSSI DOUBLE",
    "nodes": "NodeId STRING, lat DOUBLE, lng DOUBLE",
    "node_labels": "NodeId STRING, label STRING",
    "tag_list": "TagId STRING",
    "calibration": """pt STRING, session_id STRING, start TIMESTAMP, end TIMESTAMP, TagId STRING,
        TagLat DOUBLE, TagLng DOUBLE""",
    "departures": "motusTagID BIGINT, ts_depart TIMESTAMP",
}
