"""Filters, joins, summaries, node operators and metadata on hand-made rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pingtrail.functions.fixed import bearing_offsets, node_labels
from pingtrail.functions.geo import haversine_m
from pingtrail.operators import aggregates as agg, deployments as dep, filters as flt
from pingtrail.operators import joins, nodes as nd, sessions as ses
from pingtrail.operators.quantiles import column_profile, group_quantiles


def at(s, base="2021-01-20 00:00:00"):
    return dt.datetime.fromisoformat(base) + dt.timedelta(seconds=s)


def ids(df, c="hitID"):
    return sorted(r[c] for r in df.select(c).collect())


def test_location_and_names(spark):
    df = spark.createDataFrame(
        [(1, None, None, None), (2, 0.0, -102.5, None), (3, 36.25, -102.5, "A"),
         (4, 36.25, -102.5, None)],
        "hitID INT, recvDeployLat DOUBLE, recvDeployLon DOUBLE, recvDeployName STRING",
    )
    assert ids(df.where(flt.has_location())) == [2, 3, 4]
    assert ids(df.where(flt.has_location(strict=True))) == [3, 4]
    named = {r["hitID"]: r["recvDeployName"] for r in flt.fill_station_name(df).collect()}
    assert named == {1: None, 2: "0:-102.5", 3: "A", 4: "36.25:-102.5"}


def test_gps_fallback(spark):
    df = spark.createDataFrame(
        [(1, None, 0.0, None, 36.0, -102.0, 9.0), (2, 35.0, -101.0, 0.0, 36.0, -102.0, 9.0)],
        """hitID INT, gpsLat DOUBLE, gpsLon DOUBLE, gpsAlt DOUBLE, recvDeployLat DOUBLE,
        recvDeployLon DOUBLE, recvDeployAlt DOUBLE""",
    )
    got = [tuple(r) for r in flt.receiver_position(df).orderBy("hitID").select(
        "recvLat", "recvLon", "recvAlt").collect()]
    assert got == [(36.0, -102.0, 9.0), (35.0, -101.0, 0.0)]


def test_bearing_correction(spark):
    df = spark.createDataFrame(
        [(1, "Felt", 0.0), (2, "Ying-Yang", 350.0), (3, "Elsewhere", 90.0), (4, None, None)],
        "hitID INT, recvDeployName STRING, antBearing DOUBLE",
    )
    off = bearing_offsets(spark)
    plain = {r["hitID"]: r["antBearing_adj"] for r in flt.correct_bearing(df, off).collect()}
    wrapped = {r["hitID"]: r["antBearing_adj"] for r in flt.correct_bearing(df, off, True).collect()}
    assert plain == {1: -15.0, 2: 375.0, 3: 90.0, 4: None}
    assert wrapped == {1: 345.0, 2: 15.0, 3: 90.0, 4: None}


def test_run_filters(spark):
    df = spark.createDataFrame(
        [(1, 1, 10, 1, 0), (2, 2, 10, 0, 2), (3, 2, 10, 1, 2), (4, 3, 11, 1, 3)],
        "hitID INT, runID INT, motusTagID INT, motusFilter INT, runLen INT",
    )
    kept, removed = flt.split_runs(df)
    assert ids(kept) == [1, 3, 4] and ids(removed) == [2]
    long, blocked = flt.split_runs(df, "runLen")
    assert ids(long) == [4] and [tuple(r) for r in blocked.collect()] == [(10, 2)]
    assert ids(flt.short_runs(df)) == [1, 2, 3, 4]
    probs = spark.createDataFrame(
        [(1, 10, 0.0), (2, 10, None)], "runID INT, motusTagID INT, probability DOUBLE"
    )
    assert ids(flt.apply_run_filter(df, probs)) == [2, 3, 4]


def test_node_labels_and_completeness(spark):
    df = spark.createDataFrame([("3287de", 1), ("FFFFFF", None)], "NodeId STRING, n INT")
    assert sorted(r["NodeId"] for r in flt.label_nodes(df, node_labels(spark)).collect()) == [
        "FFFFFF", "W1"]
    assert flt.incomplete_rows(df).count() == 1


def test_natural_join_matches_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "k INT, s STRING")
    b = spark.createDataFrame([(1, None, 7)], "k INT, s STRING, v INT")
    got = sorted(map(tuple, flt.natural_left_join(a, b).collect()))
    assert got == [(1, None, 7), (2, "x", None)]


def test_interval_join_of_long_and_open_sessions(spark):
    day = 86400
    sessions = [("ten years", "t", 0.0, 3650.0 * day), ("open end", "t", 1700.0 * day, None), ("open start", "t", None, 40.0 * day), ("always", "t", None, None),
                ("backwards", "t", 9.0 * day, 8.0 * day), ("other", "u", None, None)] + [(f"m{i}", "t", i * 11.3 * day, i * 11.3 * day + 60) for i in range(300)]
    points = [(i, "t", i * 0.7 * day + 5) for i in range(5200)] + [(-1, "t", 11.3 * day + 60), (-2, "t", None), (-3, None, 1.0), (-4, "v", 1.0)]
    seconds = lambda c: F.timestamp_micros((F.col(c) * 1_000_000).cast("long"))
    right = spark.createDataFrame(sessions, "s STRING, TagId STRING, start DOUBLE, end DOUBLE")
    left = spark.createDataFrame(points, "p LONG, TagId STRING, Time DOUBLE")
    timed = right.withColumns({"start": seconds("start"), "end": seconds("end")})
    got = joins.interval_join(left.withColumn("Time", seconds("Time")), timed, ["TagId"], "Time", "start", "end", 60.0)
    want = [(p, s) for s, tag, a, b in sessions for p, t, at_ in points
            if t == tag and at_ is not None and (a is None or a <= at_) and (b is None or at_ <= b) and (a is None or b is None or a <= b)]
    assert sorted((r["p"], r["s"]) for r in got.select("p", "s").collect()) == sorted(want) and len(want) > 10_000
    # ten years of one-minute cells are five million; the cover is some dozen rows
    spread = joins.interval_cells(timed, "start", "end", 60.0, (0, 3650 * 1440))
    rows = {r["s"]: r["n"] for r in spread.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(rows.values()) <= 30 * 7 and sum(rows.values()) <= 2 * 301 + 5 * 210
    assert joins.interval_join(left.limit(0).withColumn("Time", seconds("Time")), timed, ["TagId"], "Time", "start", "end").count() == 0


def test_interval_join_bounds_and_hot_key(spark):
    pings = spark.createDataFrame(
        [(i, "t" if i % 3 else "u", at(i * 60)) for i in range(300)],
        "hitID INT, TagId STRING, Time TIMESTAMP",
    )
    spans = [("t", at(60), at(240)), ("t", at(200), at(20000)), ("u", at(0), at(0)),
             ("u", at(500), at(400))]
    sessions = spark.createDataFrame(spans, "TagId STRING, start TIMESTAMP, end TIMESTAMP")
    got = joins.interval_join(pings, sessions, ["TagId"], "Time", "start", "end", 300.0)
    want = sum(
        1 for i in range(300) for tag, a, b in spans
        if tag == ("t" if i % 3 else "u") and a <= at(i * 60) <= b
    )
    assert got.count() == want > 100


def test_after_event_window(spark):
    pings = spark.createDataFrame(
        [(1, 1, at(0)), (2, 1, at(1)), (3, 1, at(1800)), (4, 1, at(1801)), (5, 2, at(5))],
        "hitID INT, motusTagID INT, ts TIMESTAMP",
    )
    events = spark.createDataFrame([(1, at(0))], "motusTagID INT, last_ts TIMESTAMP")
    assert ids(joins.after_event(pings, events)) == [2, 3]


def test_centroids(spark):
    rows = [(1, 1, at(0), "A", 36.0, -103.0, -40.0), (2, 1, at(1), "B", 37.0, -102.0, -60.0),
            (3, 1, at(1), "B", 37.0, -102.0, -60.0), (4, 2, at(0), "A", 36.0, -103.0, None),
            (5, 2, at(1), "B", 37.0, -102.0, -50.0), (6, 3, at(0), "A", 36.0, -103.0, -50.0)]
    df = spark.createDataFrame(
        rows, """hitID INT, motusTagID INT, ts TIMESTAMP, recvDeployName STRING, recvDeployLat DOUBLE,
        recvDeployLon DOUBLE, sig DOUBLE""")
    events = ses.sessionize(df)
    strong = {r["motusTagID"]: r for r in agg.centroids(events).collect()}
    assert set(strong) == {1, 2}
    assert strong[1]["weighted_lat"] == pytest.approx((21 * 36 + 2 * 37) / 23)
    assert strong[1]["simple_lat"] == pytest.approx((36 + 37 + 37) / 3)
    assert strong[1]["n_pings"] == 3 and strong[1]["w_towers"] == 2
    assert strong[2]["weighted_lat"] is None
    literal = {r["motusTagID"]: r for r in agg.centroids(events, weighting="as_written").collect()}
    assert literal[1]["weighted_lat"] == pytest.approx((1 * 36 + 42 * 37) / 43)


def test_last_per_key_ties(spark):
    df = spark.createDataFrame(
        [(1, 1, at(5), None), (2, 1, at(5), "B"), (3, 1, at(5), "A"), (4, 1, at(1), "A")],
        "hitID INT, motusTagID INT, ts TIMESTAMP, recvDeployName STRING",
    )
    row = agg.last_per_key(df, "motusTagID", "ts", ["hitID"], ["recvDeployName", "hitID"]).first()
    assert row["hitID"] == 3


@pytest.mark.parametrize("accuracy", [50, 100_000])
def test_quantiles_are_exact(spark, accuracy):
    rng = np.random.default_rng(5)
    values = {1: rng.normal(size=4000).round(2), 2: rng.exponential(size=700), 3: np.ones(500),
              None: np.array([4.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [(1, None)]
    df = spark.createDataFrame(rows, "g INT, v DOUBLE").repartition(7)
    taus = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["tau"]): r["quantile"]
           for r in group_quantiles(df, ["g"], "v", taus, accuracy).collect()}
    assert len(got) == len(values) * len(taus)
    for g, vs in values.items():
        for t in taus:
            assert got[(g, t)] == pytest.approx(np.quantile(vs, t), abs=1e-12)


def test_quantiles_without_groups(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    got = [r["quantile"] for r in group_quantiles(df, [], "v", [0.1, 0.5], 20).orderBy("tau").collect()]
    assert got == pytest.approx([99.9, 499.5])


def test_column_profile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "v DOUBLE")
    assert tuple(column_profile(df, ["v"]).first()) == ("v", 1.0, 1.75, 2.5, 4.0, 4.75, 10.0, 1)


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in (2, 3, 3.5, 9, 13)] + [(None,)], "v DOUBLE")
    wide = {r["bin"]: r["n"] for r in agg.histogram(df, "v", 0.5, hi=12).collect()}
    assert wide == {2.0: 1, 3.0: 1, 3.5: 1, 9.0: 1}
    cuts = {r["bin"]: r["n"] for r in agg.histogram(df, "v", breaks=list(range(2, 10))).collect()}
    assert cuts == {"(2,3]": 2, "(3,4]": 1, "(8,9]": 1}


def test_incidence_and_split(spark):
    rows = [(1, at(i), 36.0, -102.0, 2 if i else 5) for i in range(5)] + [(2, at(0), 36.0, -102.0, 5)]
    df = spark.createDataFrame(
        rows + rows[:1],
        "motusTagID INT, tsCorrected TIMESTAMP, recvDeployLat DOUBLE, recvDeployLon DOUBLE, runLen INT",
    )
    sparse = agg.incidence(df)
    assert sparse.count() == 5 and {r["motusTagID"] for r in sparse.collect()} == {1}
    split = {r["motusTagID"]: (r["n_other"], r["n_two"])
             for r in agg.run_length_split(df).collect()}
    assert split == {1: (2, 4), 2: (1, None)}


def test_dense_incidence_equals_the_sparse_form(spark):
    from pingtrail.operators import incidence as inc

    rng = random.Random(9)
    spots = [(at(i), rng.choice([36.0, 36.1, None]), -102.0) for i in range(400)] + [(None, None, None), (None, 36.0, None)]
    rows = [(1, *p) for p in spots] + [(2 + i % 9, *rng.choice(spots)) for i in range(300)] + [(50, at(9000), 1.0, 1.0)]
    df = spark.createDataFrame(rows + rows[:50], "motusTagID INT, tsCorrected TIMESTAMP, recvDeployLat DOUBLE, recvDeployLon DOUBLE")
    df = df.repartition(5)
    blocks, points = inc.dense_incidence(df)
    lowest = lambda p: tuple((x is not None, x or 0 if not hasattr(x, "timestamp") else x.timestamp()) for x in p)
    kept = {}
    for tag, *p in rows:
        kept.setdefault(tag, set()).add(tuple(p))
    kept = {k: v for k, v in kept.items() if len(v) >= 5}
    order = sorted(set().union(*kept.values()), key=lowest)
    found = {r["point_id"]: (r["tsCorrected"], r["recvDeployLat"], r["recvDeployLon"]) for r in points.collect()}
    assert found == dict(enumerate(order, 1))
    sums = {r["point_id"]: r["n_tags"] for r in points.collect()}
    assert sums == {i: sum(p in v for v in kept.values()) for i, p in found.items()}
    got = {}
    for r in blocks.collect():
        bits = {8 * i + j for i, byte in enumerate(r["bits"]) for j in range(8) if byte >> j & 1}
        assert len(bits) == r["n_present"]
        got.setdefault(r["motusTagID"], set()).update(found[(r["block"] - 1) * 32768 + b + 1] for b in bits)
    assert got == kept
    alone = {k: sum(1 for p in v if sum(p in w for w in kept.values()) == 1) for k, v in kept.items()}
    assert {r["motusTagID"]: (r["n_points"], r["n_alone"]) for r in inc.tag_sums(blocks, points).collect()} == {
        k: (len(v), alone[k]) for k, v in kept.items()}
    twice = df.where("motusTagID = 1").unionByName(df.where("motusTagID = 1").withColumn("motusTagID", F.lit(3)))
    assert [tuple(r) for r in inc.tag_sums(*inc.dense_incidence(twice)).orderBy("motusTagID").collect()] == [(1, len(kept[1]), 0), (3, len(kept[1]), 0)]
    empty, none = inc.dense_incidence(df.limit(0))
    assert empty.count() == 0 and none.count() == 0 and inc.tag_sums(empty, none).count() == 0


def test_bits_set_in_both_bitmaps(spark):
    from pingtrail.operators.incidence import set_in_both

    rng = random.Random(4)
    full = b"\xff" * 4096
    sparse = [bytes(rng.choice([0, 0, 0, 1, 128, 255]) if rng.random() < 0.01 else 0 for _ in range(4096)) for _ in range(6)]
    dense = [bytes(rng.randrange(256) for _ in range(4096)) for _ in range(3)]
    first, last = b"\x80" + bytes(4095), bytes(4095) + b"\x01"
    maps = [full, bytes(4096), first, last, *sparse, *dense]
    rows = [(bytearray(a), bytearray(b), (int.from_bytes(a) & int.from_bytes(b)).bit_count()) for a in maps for b in maps]
    df = spark.createDataFrame(rows, "a BINARY, b BINARY, n BIGINT")
    assert df.where(set_in_both("a", "b") == F.col("n")).count() == len(rows)


def test_bitmaps_are_neither_shuffled_nor_sorted(spark):
    from pingtrail.operators import incidence as inc

    rows = [(i % 7, at(i), 36.0, -102.0) for i in range(100)]
    df = spark.createDataFrame(rows, "motusTagID INT, tsCorrected TIMESTAMP, recvDeployLat DOUBLE, recvDeployLon DOUBLE")
    plan = inc.tag_sums(*inc.dense_incidence(df))._jdf.queryExecution().executedPlan().toString().splitlines()
    made = [i for i, line in enumerate(plan) if "bitmap_construct_agg" in line]
    # cells become bitmaps without an exchange or a sort between the two steps
    assert len(made) == 2 and made[1] == made[0] + 1
    above = plan[:made[0]]
    assert not any(" Sort [" in line for line in above)
    assert sum("Exchange hashpartitioning" in line for line in above) == 1  # the sums a tag


def test_numbers_have_no_gaps_over_many_partitions(spark):
    from pingtrail.operators.incidence import numbered

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = numbered(spark.range(0, 20_000, 2).select((F.col("id") * 7919 % 100_003).alias("x")), ["x"], "n").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r["n"] for r in sorted(rows)] == list(range(1, 10_001))


def grid(spark):
    nodes = [(f"N{i}", 36.48 + 0.002 * (i % 3), -102.66 + 0.002 * (i // 3)) for i in range(9)]
    return nodes, spark.createDataFrame(nodes, "NodeId STRING, lat DOUBLE, lng DOUBLE")


def test_resample_bins_and_single_beeps(spark):
    _, nodes = grid(spark)
    beeps = spark.createDataFrame(
        [(at(0), "t", "N0", -50.0), (at(179.9), "t", "N0", -60.0), (at(180), "t", "N0", -70.0),
         (at(0), "t", None, -50.0), (at(0), "t", "absent", -50.0)],
        "Time TIMESTAMP, TagId STRING, NodeId STRING, TagRSSI DOUBLE",
    )
    rows = nd.resample_beeps(beeps, nodes).orderBy("freq").collect()
    assert [(r["beep_count"], r["TagRSSI_max"]) for r in rows] == [(2, -50.0), (1, -70.0)]
    assert rows[0]["TagRSSI_sd"] == pytest.approx(np.std([-50, -60], ddof=1))
    assert rows[1]["TagRSSI_sd"] is None and rows[0]["node_lat_mode"] == 36.48
    assert nd.resample_beeps(beeps, nodes, drop_single=True).count() == 1


def test_locations(spark):
    nodes, table = grid(spark)
    beeps = spark.createDataFrame(
        [(at(1), "t", "N0", -50.0), (at(2), "t", "N0", -90.0), (at(3), "t", "N4", -60.0),
         (at(4), "t", "N8", -110.0)],
        "Time TIMESTAMP, TagId STRING, NodeId STRING, TagRSSI DOUBLE",
    )
    w = np.array([1e-5, 1e-6, 1e-11])
    lat = np.array([nodes[i][1] for i in (0, 4, 8)])
    got = nd.weighted_location(beeps, table).first()
    assert got["unique_nodes"] == 3
    assert got["avg_y"] == pytest.approx((w * lat).sum() / w.sum(), abs=1e-9)
    assert nd.weighted_location(beeps, table, min_rssi=-105.0).first()["unique_nodes"] == 2
    assert nd.weighted_location(beeps, table, max_nodes=1).first()["avg_y"] == 36.48
    assert nd.weighted_location(beeps, table, min_nodes=3).count() == 0


def test_calibration_recovers_relation_and_position(spark):
    nodes, table = grid(spark)
    tag_lat, tag_lng = 36.4817, -102.6583
    exact = table.withColumn(
        "TagRSSI", -20.0 - 10.0 * F.log(haversine_m(F.lit(tag_lat), F.lit(tag_lng), "lat", "lng"))
    )
    beeps = exact.select(
        F.lit("2021-01-20 00:00:30").cast("timestamp").alias("Time"), F.lit("t").alias("TagId"),
        "NodeId", "TagRSSI",
    )
    sessions = spark.createDataFrame(
        [("1", "s", at(0), at(60), "t", tag_lat, tag_lng)],
        "pt STRING, session_id STRING, start TIMESTAMP, end TIMESTAMP, TagId STRING,"
        " TagLat DOUBLE, TagLng DOUBLE",
    )
    relation = nd.fit_relation(nd.calibrate(beeps, sessions, table))
    fit = relation.first()
    assert (fit["slope"], fit["intercept"]) == pytest.approx((-10.0, -20.0))
    found = nd.multilaterate(nd.resample_beeps(beeps, table), relation).first()
    assert found["lat"] == pytest.approx(tag_lat, abs=1e-6)
    assert found["lng"] == pytest.approx(tag_lng, abs=1e-6)
    line = nd.resample_beeps(beeps.where("NodeId IN ('N0','N1','N2')"), table)
    assert nd.multilaterate(line, relation).first()["lat"] is None


def test_movement_of_one_location_has_no_size(spark):
    from pingtrail.plans.analyses import movement

    _, table = grid(spark)
    beeps = spark.createDataFrame(
        [(at(1), "t", "N0", -50.0), (at(1), "t", "N1", -50.0), (at(1), "u", "N0", -50.0),
         (at(1), "u", "N1", -50.0), (at(400), "u", "N3", -50.0), (at(400), "u", "N4", -50.0)],
        "Time TIMESTAMP, TagId STRING, NodeId STRING, TagRSSI DOUBLE",
    )
    rows = {r["TagId"]: r for r in movement(beeps, table).collect()}
    assert rows["t"]["N"] == 1 and rows["t"]["d"] is None
    assert rows["u"]["N"] == 2 and 0.1 < rows["u"]["d"] < 0.4


def test_metadata(spark):
    tags = spark.createDataFrame([(1, 7), (2, 7)], "tagID BIGINT, projectID INT")
    deps = spark.createDataFrame([(1, 7)], "tagID BIGINT, projectID INT")
    assert [r["tagID"] for r in dep.never_deployed(tags, deps).collect()] == [2]
    hits = spark.createDataFrame(
        [(1, 10), (1, 11), (1, 11), (2, 12), (2, None)], "motusTagID BIGINT, tagDeployID BIGINT"
    )
    assert sorted(map(tuple, dep.multi_deployments(hits).collect())) == [(1, 10, 2), (1, 11, 2)]
    recv = spark.createDataFrame(
        [(1, 1, at(0), at(100)), (2, 2, at(50), None)],
        "deviceID INT, deployID INT, tsStart TIMESTAMP, tsEnd TIMESTAMP",
    )
    ends = {r["deviceID"]: r["time"] for r in dep.deployment_timeline(recv).collect()
            if r["when"] == "timeEnd"}
    assert ends == {1: at(100), 2: at(100 + 2629800)}
