"""Ordered operators against plain Python on skewed data: one tag holds a third of the rows, and
one ping is copied many times."""

import random
from itertools import groupby

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from pingtrail.operators import sessions as ses
from pingtrail.operators.slicing import running_total, with_halo, with_neighbours, with_slice

SCHEMA = """hitID BIGINT, motusTagID BIGINT, us BIGINT, recvDeployName STRING, port STRING,
    sig DOUBLE, antBearing DOUBLE"""
STATIONS = ["A", "B", "C", None]


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us")


def skewed(n=1500, seed=3):
    rng = random.Random(seed)
    rows = []
    clock = {tag: 1_700_000_000_000_000 for tag in range(6)}
    for i in range(n):
        tag = 0 if i % 3 == 0 else rng.randrange(1, 6)
        clock[tag] += rng.choice([0, 1000, 900_000, 2_500_000, 2_500_001, 4_000_000, 70_000_000])
        rows.append((i, tag, clock[tag], rng.choice(STATIONS), rng.choice(["1", "2", None]),
                     rng.choice([-40.0, -55.5, None]), rng.choice([0.0, 90.0, None])))
    # copies: same tag, time, station; only the hit id differs
    copy = rows[7]
    rows += [(n + i, *copy[1:]) for i in range(n // 3)]
    rng.shuffle(rows)
    return rows


def none_last(v):
    return (v is None, v if v is not None else "")


def per_tag(rows, order):
    rows = sorted(rows, key=lambda r: (r[1], *order(r)))
    return {k: list(g) for k, g in groupby(rows, key=lambda r: r[1])}


def by_time(r):
    return (r[2], none_last(r[3]), r[0])


def by_signal(r):
    return (r[2], none_last(r[3]), r[5] is None, -(r[5] or 0), r[0])


@pytest.mark.parametrize("slice_s", [1.0, 60.0, 86400.0])
def test_sessionize_matches_plain_scan(spark, slice_s):
    rows = skewed()
    want = {}
    for tag, pings in per_tag(rows, by_time).items():
        event, last = 0, None
        for r in pings:
            if last is None or r[2] - last > 2_500_000:
                event += 1
            last = r[2]
            want[r[0]] = event
    got = ses.sessionize(frame(spark, rows), gap=2.5, slice_s=slice_s)
    assert {r["hitID"]: r["event_id"] for r in got.collect()} == want


def test_gap_boundary_and_interleaved_tags(spark):
    t0 = 1_700_000_000_000_000
    rows = [
        (1, 1, t0, "A", "1", -50.0, 0.0), (2, 1, t0 + 2_500_000, "B", None, -50.0, 0.0),
        (3, 1, t0 + 5_000_001, "B", "1", -50.0, 0.0), (4, 2, t0 + 1, "A", "1", -50.0, 0.0),
    ]
    events = ses.sessionize(frame(spark, rows))
    got = {r["hitID"]: (r["event_id"], r["w_towers"], r["w_antennas"])
           for r in ses.with_event_counts(events).collect()}
    assert got == {1: (1, 2, 2), 2: (1, 2, 2), 3: (2, 1, 1), 4: (1, 1, 1)}


def test_null_port_counts_as_an_antenna(spark):
    t0 = 1_700_000_000_000_000
    rows = [(1, 1, t0, "A", None, None, None), (2, 1, t0, "A", "1", None, None)]
    (row,) = ses.event_counts(ses.sessionize(frame(spark, rows))).collect()
    assert (row["w_towers"], row["w_antennas"], row["n_pings"]) == (1, 2, 2)


@pytest.mark.parametrize("slice_s", [1.0, 3600.0])
def test_transitions(spark, slice_s):
    rows = skewed()
    want = set()
    for pings in per_tag(rows, by_signal).values():
        for a, b in zip(pings, pings[1:]):
            if a[3] is not None and b[3] is not None and a[3] != b[3]:
                want.add(b[0])
    got = ses.transitions(frame(spark, rows), slice_s=slice_s)
    assert {r["hitID"] for r in got.collect()} == want


def _rounded(us):
    return (us + 500_000) // 1_000_000 * 1_000_000


@pytest.mark.parametrize("slice_s", [3.0, 3600.0])
def test_near_simultaneous(spark, slice_s):
    rows = [r for r in skewed() if r[0] < 1500]
    want = set()
    kept = [(*r[:2], _rounded(r[2]), *r[3:]) for r in rows if r[6] is not None]
    for pings in per_tag(kept, by_time).values():
        for i, r in enumerate(pings):
            back = i > 0 and r[2] - pings[i - 1][2] < 5_000_000
            fwd = i + 1 < len(pings) and pings[i + 1][2] - r[2] <= 4_900_000
            if back or fwd:
                want.add(r[0])
    got = ses.near_simultaneous(frame(spark, rows), slice_s=slice_s)
    assert {r["hitID"] for r in got.collect()} == want


@pytest.mark.parametrize("slice_s", [3.0, 3600.0])
def test_run_of_three(spark, slice_s):
    rows = skewed()
    want = set()
    for pings in per_tag(rows, by_time).values():
        t = [r[2] for r in pings]
        close = lambda i, j: 0 <= min(i, j) and max(i, j) < len(t) and abs(t[i] - t[j]) < 4_000_000  # noqa: E731,E501
        for i, r in enumerate(pings):
            if (close(i, i - 1) and close(i, i + 1)) or close(i, i - 2) or close(i, i + 2):
                want.add(r[0])
    got = ses.run_of_three(frame(spark, rows), slice_s=slice_s)
    assert {r["hitID"] for r in got.collect()} == want


def test_literal_lag_bins_equal_collapsed_bursts(spark):
    df = frame(spark, skewed())
    a = ses.bursts_literal(df, slice_s=5.0).select("hitID", "ts").collect()
    b = ses.bursts(df, slice_s=5.0).select("hitID", "ts").collect()
    assert sorted(a) == sorted(b) and a


@pytest.mark.parametrize("reach", [1, 3])
def test_neighbours_equal_whole_window(spark, reach):
    df = frame(spark, skewed())
    order = [F.col("ts").asc(), F.col("hitID").asc()]
    derive = lambda w: {
        "prev": F.lag("hitID", reach).over(w), "next": F.lead("hitID", reach).over(w)
    }
    whole = df.withColumns(derive(Window.partitionBy("motusTagID").orderBy(*order)))
    cut = with_neighbours(df, ["motusTagID"], "ts", order, reach, derive, 2.0)
    cols = ["hitID", "prev", "next"]
    assert sorted(map(tuple, cut.select(*cols).collect()), key=str) == sorted(
        map(tuple, whole.select(*cols).collect()), key=str
    )


def test_halo_reaches_over_several_slices(spark):
    df = frame(spark, skewed())
    order = [F.col("ts").asc(), F.col("hitID").asc()]
    derive = lambda w: {"prev": F.lag("ts").over(w)}
    gap = F.unix_micros("ts") - F.unix_micros("prev")
    near = with_halo(df, ["motusTagID"], "ts", order, 5.0, derive, 2.0).where(gap <= 5_000_000)
    whole = df.withColumns(derive(Window.partitionBy("motusTagID").orderBy(*order)))
    want = whole.where(gap <= 5_000_000)
    assert sorted(r["hitID"] for r in near.collect()) == sorted(r["hitID"] for r in want.collect())


def test_running_total(spark):
    df = with_slice(frame(spark, skewed()).withColumn("one", F.lit(1)), "ts", 2.0)
    order = [F.col("ts").asc(), F.col("hitID").asc()]
    got = running_total(df, ["motusTagID"], order, "one", "n").groupBy("motusTagID").agg(
        F.max("n").alias("top"), F.count_distinct("n").alias("kinds"), F.count("n").alias("rows")
    )
    for r in got.collect():
        assert r["top"] == r["kinds"] == r["rows"]


def greedy_bursts(rows, span_us):
    out = {}
    for tag, pings in per_tag(rows, by_time).items():
        start = None
        for r in pings:
            if start is None or r[2] - start > span_us:
                start = r[2]
            out[r[0]] = (tag, start)
    return out


@pytest.mark.parametrize("span,slice_s", [(3.0, 10.0), (30.0, 3600.0)])
def test_anchored_bursts(spark, span, slice_s):
    rows = skewed()
    of_row = greedy_bursts(rows, int(span * 1e6))
    want = {}
    for r in rows:
        tag, start = of_row[r[0]]
        key = (tag, start, r[3])
        best = want.get(key)
        want[key] = max((v for v in (best, r[5]) if v is not None), default=None)
    towers = {}
    for tag, start, station in want:
        towers[(tag, start)] = towers.get((tag, start), 0) + 1
    got = ses.anchored_bursts(frame(spark, rows), span, slice_s=slice_s).withColumn(
        "us", F.unix_micros("burst_start")
    ).collect()
    assert {(r["motusTagID"], r["us"], r["recvDeployName"]): r["max_sig"] for r in got} == want
    assert {(r["motusTagID"], r["us"]): r["n_towers"] for r in got} == towers


def test_anchored_bursts_keep_pings_without_tag(spark):
    t0 = 1_700_000_000_000_000
    rows = [(i, tag, t0 + us * 1_000_000, station, "1", sig, None) for i, (tag, us, station, sig) in enumerate(
        [(None, 0, "A", 1.0), (None, 2, "B", 2.0), (None, 4, "A", 3.0), (None, 6, "A", 4.0), (None, 100, "B", 5.0), (1, 1, "A", 6.0)])]
    got = ses.anchored_bursts(frame(spark, rows), 3.0, slice_s=10.0).withColumn("us", F.unix_micros("burst_start")).collect()
    assert {(r["motusTagID"], (r["us"] - t0) // 1_000_000, r["recvDeployName"], r["n_towers"], r["max_sig"]) for r in got} == {
        (None, 0, "A", 2, 1.0), (None, 0, "B", 2, 2.0), (None, 4, "A", 1, 4.0), (None, 100, "B", 1, 5.0), (1, 1, "A", 1, 6.0)}


def test_silences(spark):
    rows = skewed()
    want = {}
    for pings in per_tag(rows, by_time).values():
        for a, b in zip(pings, [*pings[1:], None]):
            if b is None or b[2] - a[2] >= 60_000_000:
                want[(a[1], a[2])] = b and b[2]
    got = ses.silences(frame(spark, rows), 60.0, slice_s=30.0)
    have = got.select("motusTagID", F.unix_micros("ts").alias("a"), F.unix_micros("nxt").alias("b"))
    assert {(r[0], r[1]): r[2] for r in have.collect()} == want


def test_pool_rounds_ties_up_and_counts(spark):
    t0 = 1_700_000_000_000_000
    rows = [(i, 1, t0 + us, s, "1", None, None) for i, (us, s) in enumerate(
        [(0, "A"), (2_499_999, "A"), (2_500_000, "B"), (5_000_000, "C"), (7_499_999, "C")])]
    df = frame(spark, rows)
    got = {r["ts"].timestamp(): r["n"] for r in ses.pool(df, 5).collect()}
    assert list(got.values()) == [3]
    assert ses.pool(df, 5, distinct_stations=True).count() == 0
    assert ses.pool(df, 5, 2, True).count() == 1


@settings(max_examples=6, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40)), min_size=1, max_size=30))
def test_events_partition_and_are_separated(spark, pings):
    rows = [(i, tag, s * 500_000, "A", "1", None, None) for i, (tag, s) in enumerate(pings)]
    events = ses.sessionize(frame(spark, rows), gap=2.5, slice_s=4.0).select(
        "motusTagID", "event_id", F.unix_micros("ts").alias("us")
    ).collect()
    assert len(events) == len(rows)
    spans = {}
    for tag, event, us in events:
        lo, hi = spans.get((tag, event), (us, us))
        spans[(tag, event)] = (min(lo, us), max(hi, us))
    for tag in {t for t, _ in spans}:
        ordered = [spans[(tag, e)] for e in sorted(e for t, e in spans if t == tag)]
        for (_, hi), (lo, _) in zip(ordered, ordered[1:]):
            assert lo - hi > 2_500_000


def test_pings_without_tag_or_time_stay(spark):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(i, tag, None if off is None else start + timedelta(seconds=off), "s", "L1") for i, (tag, off) in enumerate(
        [(7, 0), (7, 1), (7, 9), (None, 0), (None, 2), (None, 7000), (7, None), (None, None)])]
    df = spark.createDataFrame(rows, "hitID BIGINT, motusTagID BIGINT, ts TIMESTAMP, recvDeployName STRING, port STRING")
    got = {r["hitID"]: r["event_id"] for r in ses.sessionize(df).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 1, 4: 1, 5: 2, 6: None, 7: None}
    assert ses.with_event_counts(ses.sessionize(df)).count() == 8


def test_sliced_table_gives_the_same_sessions_and_transitions(spark, tmp_path):
    from pingtrail.sources import sinks

    rng = random.Random(12)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([None, 0.0, rng.random() * 9 - 4.5, rng.random() * 20_000]),
             rng.choice(["a", "b", None]), rng.choice([None, 1.5, 2.5])) for i in range(1500)]
    df = spark.createDataFrame(rows, "hitID LONG, motusTagID INT, s DOUBLE, recvDeployName STRING, sig DOUBLE")
    df = df.select("hitID", "motusTagID", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "recvDeployName", "sig")
    for part, frame in (("all", df), ("none", df.limit(0)), ("untimed", df.where("ts IS NULL"))):
        table = f"sliced_test_{part}_{tmp_path.name.replace('-', '_')}"
        stored = sinks.write_sliced(frame, table, str(tmp_path / part), slice_s=60.0, buckets=4)
        assert sorted(map(str, ses.sessionize_sliced(stored, gap=5.0).collect())) == sorted(
            map(str, ses.sessionize(frame, gap=5.0, slice_s=100.0).collect()))
        found = ses.transitions_sliced(stored)
        want = ses.transitions(frame, slice_s=100.0).select(*found.columns)
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
