"""Published station, node and study-area constants that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Degrees added to the nominal antenna bearing of each surveyed station.
BEARING_OFFSETS = [
    ("New Playa", -15.0),
    ("Felt", -15.0),
    ("Nosebleed", -10.0),
    ("O.R.B.", -7.5),
    ("Mirage", -2.5),
    ("Blowdart", -5.0),
    ("Ying-Yang", 25.0),
    ("Windblown", -7.0),
]

# Grid label of each node id (W = west, N = north, E = east, S = south arm).
NODE_LABELS = [
    ("3287DE", "W1"), ("328C94", "W2"), ("328C26", "W3"), ("328591", "W4"), ("328497", "W5"),
    ("32624B", "N1"), ("328A8E", "N2"), ("328147", "N3"), ("325D6E", "N4"), ("32926A", "N5"),
    ("328E58", "E1"), ("329306", "E2"), ("325D80", "E3"), ("325EAA", "E4"), ("328D8E", "E5"),
    ("328B4C", "S1"), ("325CF3", "S2"), ("327C23", "S3"), ("3263FF", "S4"), ("329934", "S5"),
]

# Inclusive study-area box (lat_min, lat_max, lon_min, lon_max).
STUDY_BOX = (36.2, 36.6, -103.1, -102.1)

# Position given to pooled detections, and the solar reference site.
AREA_LAT, AREA_LON = 36.37, -102.80
SUN_SITE_LAT, SUN_SITE_LON = 36.490484, -102.649942

# Signal range (dB) of the departure station used to normalise strengths.
MIN_SIG, MAX_SIG = -78.0691, -17.8707

# Fixed value: seconds in one average calendar month (365.25 days / 12).
MONTH_SECONDS = 2629800


def literal_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A small constant table. Inline VALUES keep its exact size visible to the optimizer."""

    def sql(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(value, float):
            return f"{value!r}D"
        return str(value)

    values = ", ".join("(" + ", ".join(map(sql, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def bearing_offsets(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ["recvDeployName", "offset"], BEARING_OFFSETS)


def node_labels(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ["NodeId", "label"], NODE_LABELS)
