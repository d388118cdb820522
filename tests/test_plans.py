"""Shapes of the physical plans: what must not appear, and what must be shared."""

import re
import uuid

import pytest

from pingtrail.operators import sessions as ses
from pingtrail.plans import analyses as an
from pingtrail.plans.adapters import Tables
from pingtrail.plans.catalog import REGISTRY

FOLDER = "/root/testdata/sf0.001"
EAGER = ("S2", "S3", "S6", "T1", "T2", "T3", "W10", "M2", "M3", "M4_quantile_regression")
LAZY = [n for n in REGISTRY if not n.startswith(EAGER)]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_forbidden_operator(spark, name):
    plan = plan_of(REGISTRY[name].run(spark, FOLDER))
    for bad in ("NestedLoopJoin", "CartesianProduct", "PythonUDF", "ArrowEval", "MapInPandas"):
        assert bad not in plan
    if name != "W14_station_ranks":  # ranks one row per station
        for line in plan.splitlines():
            window = re.search(r"Window \[.*\], \[\], \[", line)
            assert window is None, line


def test_windows_run_per_slice(spark):
    t = Tables(spark, FOLDER)
    used = t.detections.select("hitID", "motusTagID", "ts", "recvDeployName", "sig", "antBearing")
    plan = plan_of(ses.near_simultaneous(used))
    assert re.search(r"hashpartitioning\(motusTagID#\d+L, _slice#\d+L", plan)
    # one exchange and one sort serve the whole operator
    assert plan.count("Exchange ") == 1 and plan.count("Sort ") == 1
    # the wide rows of sessionize shuffle on (tag, time), never on the tag alone
    plan = plan_of(ses.sessionize(used))
    alone = [line for line in plan.splitlines()
             if re.search(r"Exchange hashpartitioning\(_k#\d+L, _void#\d+, \d+\)", line)]
    # only the one-row-per-slice table is gathered per tag
    assert len(alone) == 1


def above_scans_of(plan: str, column: str) -> list[str]:
    """The operators above each scan that reads ``column``, by the indentation of the printed tree."""
    lines, found = plan.splitlines(), []
    for i, line in enumerate(lines):
        if "FileScan" in line and f"{column}#" in line:
            depth = re.search(r"[A-Za-z]", line).start()
            for upper in reversed(lines[:i]):
                at = re.search(r"[A-Za-z(*]", upper)
                if at and at.start() < depth:
                    depth = at.start()
                    found.append(upper)
    return found


@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
def test_sliced_tables_are_not_shuffled_again(spark, tmp_path, broadcast):
    from pingtrail.sources import sinks

    used = Tables(spark, FOLDER).detections.select("hitID", "motusTagID", "ts", "recvDeployName", "sig")
    table = f"sliced_{uuid.uuid4().hex}"
    stored = sinks.write_sliced(used, table, str(tmp_path / "t"), buckets=16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        rows = ses.sessionize_sliced(stored, gap=3600.0)
        plan = plan_of(rows)
        above = above_scans_of(plan, "hitID")
        assert above and not any("Exchange" in line for line in above), plan
        # what is shuffled is one row a slice
        shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert shuffled and all(re.search(r"hashpartitioning\(_k#\d+L, _void#\d+", line) for line in shuffled)
        plan = plan_of(ses.transitions_sliced(stored))
        # the two readings: rows within slices, unshuffled, and the rims of slices, a bounded number a slice
        assert len(re.findall("Exchange hashpartitioning", plan)) == 1, plan
        want = ses.sessionize(used, gap=3600.0)
        assert rows.exceptAll(want).isEmpty() and want.exceptAll(rows).isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from pingtrail.schemas import DETECTIONS

    folder = str(tmp_path / "det")
    spark.createDataFrame([], DETECTIONS).write.parquet(folder)
    det = spark.read.schema(DETECTIONS).parquet(folder)
    kept = an.study_detections(det, Tables(spark, FOLDER).offsets).select("motusTagID", "ts")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = plan_of(kept)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    for part in ("EqualTo(tagDeployTest,0)", "GreaterThanOrEqual(recvDeployLat,36.2)",
                 "GreaterThan(ts,"):
        assert part in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert len(schema.split(",")) == 6 and "sig" not in schema


def test_sun_columns_stay_behind_filters(spark):
    from pingtrail.functions.solar import time_to_sun

    t = Tables(spark, FOLDER)
    rows = time_to_sun(t.detections).where("ts_since_rise <= 12 AND ts_to_set > 1")
    optimized = rows._jdf.queryExecution().optimizedPlan().toString()
    assert len(optimized) < 40_000
    assert "Exchange" not in plan_of(rows)
