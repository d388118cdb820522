"""Sources, sinks, incremental append and streaming forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pingtrail.operators import sessions as ses
from pingtrail.operators.nodes import known_beeps
from pingtrail.sources import sinks, tables
from pingtrail.streaming import streams


def at(s):
    return dt.datetime(2021, 1, 20) + dt.timedelta(seconds=s)


IDS = ["1E193434", "614B7878", "61780778"]


def test_csv_round_trip_keeps_ids_as_text(spark, tmp_path):
    rows = [(i, None if i == "61780778" else float(n), None, at(n)) for n, i in enumerate(IDS)]
    schema = "TagId STRING, v DOUBLE, note STRING, t TIMESTAMP"
    df = spark.createDataFrame(rows, schema)
    sinks.write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "out"), schema,
                                             "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").collect())) == sorted(rows)


def test_csv_null_strings(spark, tmp_path):
    (tmp_path / "in.csv").write_text('TagId,name\nNA,x\n"",NA\n 1E193434 , y \n')
    got = tables.read_csv(spark, str(tmp_path / "in.csv"), "TagId STRING, name STRING").collect()
    assert [tuple(r) for r in got] == [(None, "x"), (None, None), ("1E193434", "y")]


def test_per_tag_export(spark, tmp_path):
    rows = [(i, IDS[0] if i % 3 == 0 else IDS[1 + i % 2], at(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "hitID BIGINT, mfgID STRING, ts TIMESTAMP")
    out = str(tmp_path / "tags")
    # without merging of small partitions, the range cuts show on little data
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_per_tag(df, out)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(p.name for p in (tmp_path / "tags").glob("mfgID=*")) == [f"mfgID={i}" for i in sorted(IDS)]
    # the tag with a third of the rows is split over several files
    assert len(list((tmp_path / "tags" / f"mfgID={IDS[0]}").glob("*.csv"))) > 1
    back = tables.read_tags(spark, out, "hitID BIGINT, ts TIMESTAMP, mfgID STRING", IDS[:1])
    assert sorted(r["hitID"] for r in back.collect()) == list(range(0, 600, 3))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(mfgID" in plan or "PartitionFilters: [mfgID" in plan


def test_small_tags_are_exported_by_many_tasks(spark, tmp_path):
    df = spark.range(400).select(F.col("id").alias("hitID"), F.format_string("%08X", F.col("id") % 80).alias("mfgID"), F.timestamp_seconds("id").alias("ts"))
    sinks.write_per_tag(df, str(tmp_path / "tags"))
    files = [f.name for f in (tmp_path / "tags").glob("mfgID=*/*.csv")]
    # 400 rows are merged into one task by their bytes
    assert len({name.split("-")[1] for name in files}) > 4 and len(files) <= 80 + 8


def test_per_tag_reading_lists_only_the_folders_of_its_tags(spark, tmp_path):
    odd = ["a/b", "c=d", "e f", "50%", "x*?{y}[z]^", "tab\t\"q\"", "ü", "__HIVE_DEFAULT_PARTITION__x", "back\\slash", "it's:#1"]
    names = [*IDS, *odd, None, ""]
    df = spark.createDataFrame([(i, names[i % len(names)], at(i)) for i in range(150)], "hitID BIGINT, mfgID STRING, ts TIMESTAMP")
    out, schema = str(tmp_path / "tags"), "hitID BIGINT, ts TIMESTAMP, mfgID STRING"
    sinks.write_per_tag(df, out)
    one = tables.read_tags(spark, out, schema, [IDS[1], "not there"])
    assert one.inputFiles() and all(f"mfgID={IDS[1]}/" in f for f in one.inputFiles())
    want = lambda tags: sorted((i, names[i % len(names)]) for i in range(150) if names[i % len(names)] in tags)
    for tags in ([IDS[1], "not there"], names[:-2], odd, [IDS[0]] * 2, ["not there"], ["not there", ""], [None], []):
        got = tables.read_tags(spark, out, schema, tags)
        assert got.columns == ["hitID", "ts", "mfgID"]
        assert sorted((r["hitID"], r["mfgID"]) for r in got.collect()) == want([t for t in tags if t])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_tags(spark, str(tmp_path / "nowhere"), schema, IDS)


def test_snapshot_and_listing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id INT, s STRING")
    sinks.write_snapshot(df, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 2
    df.createOrReplaceTempView("listed")
    assert "listed" in tables.tables_of(spark)
    assert [tuple(r) for r in tables.columns_of(spark, "listed").collect()] == [
        ("id", "int"), ("s", "string")]
    assert [r["id"] for r in tables.head(df, ["s", "id"], 1).collect()] == [1]
    assert [r["id"] for r in tables.tail(df, ["s", "id"], 1).collect()] == [2]


def test_named_table(spark, tmp_path):
    nodes = spark.createDataFrame([("3287DE", 36.4, -102.6)], "NodeId STRING, lat DOUBLE, lng DOUBLE")
    sinks.write_snapshot(nodes, str(tmp_path / "nodes"))
    assert tables.read_table(spark, "nodes", str(tmp_path / "nodes")).count() == 1
    assert spark.table("nodes").first()["NodeId"] == "3287DE"


@pytest.mark.parametrize("key, batch", [(("hitID",), None), (("hitID", "batchID"), "batchID")])
def test_append_new(spark, tmp_path, key, batch):
    schema, folder = "hitID BIGINT, batchID BIGINT, v STRING", str(tmp_path / "stored")
    sinks.write_snapshot(spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, 2, "a")], schema), folder)
    before = {p.name for p in (tmp_path / "stored").glob("*.parquet")}
    arriving = spark.createDataFrame([(3, 2, "b"), (4, 2, "z"), (4, 2, "y"), (5, 3, "x")], schema)
    for _ in range(2):
        sinks.append_new(arriving, folder, key, batch)
        got = sorted(tuple(r) for r in spark.read.parquet(folder).collect())
        assert got == [(1, 1, "a"), (2, 1, "a"), (3, 2, "a"), (4, 2, "y"), (5, 3, "x")]
    assert before <= {p.name for p in (tmp_path / "stored").glob("*.parquet")}


def test_a_stored_hit_is_not_admitted_under_another_batch(spark):
    stored = spark.createDataFrame([(1, 10)], "hitID BIGINT, batchID BIGINT")
    again = spark.createDataFrame([(1, 11)], "hitID BIGINT, batchID BIGINT")
    assert sinks.new_rows(stored, again).count() == 0
    with pytest.raises(ValueError):
        sinks.new_rows(stored, again, batch="batchID")


def _arrivals(spark, folder, rows, schema, parts=3):
    size = len(rows) // parts + 1
    for i in range(parts):
        chunk = rows[i * size:(i + 1) * size]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(str(folder))


def _drain(spark, tmp_path, stream):
    out = str(tmp_path / "out")
    streams.run_to_folder(stream, out, str(tmp_path / "marks"))
    return spark.read.schema(stream.schema).parquet(out)


def test_stream_sessions_equal_batch(spark, tmp_path):
    schema = "hitID BIGINT, motusTagID BIGINT, ts TIMESTAMP, recvDeployName STRING, port STRING"
    rows = [(i, i % 3, at(i * 1.5 + (i // 40) * 100), "AB"[i % 2], "1") for i in range(300)]
    rows.append((999, 7, at(86400), "A", "1"))  # moves the watermark past everything else
    _arrivals(spark, tmp_path / "in", rows, schema)
    stream = streams.read_stream(spark, str(tmp_path / "in"), schema)
    got = _drain(spark, tmp_path, streams.stream_sessions(stream, "5 seconds", "1 hour"))
    df = spark.createDataFrame(rows[:-1], schema)
    want = ses.event_counts(ses.sessionize(df, gap=5)).select(*got.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() > 10


def test_stream_resample_equals_batch(spark, tmp_path):
    schema = "Time TIMESTAMP, TagId STRING, NodeId STRING, TagRSSI DOUBLE"
    rows = [(at(i * 7), IDS[i % 2], ["N0", "N1", None][i % 3], -50.0 - i % 9) for i in range(400)]
    rows.append((at(86400), "z", "N0", -1.0))
    _arrivals(spark, tmp_path / "in", rows, schema)
    stream = streams.read_stream(spark, str(tmp_path / "in"), schema)
    got = _drain(spark, tmp_path, streams.stream_resample(stream))
    df = known_beeps(spark.createDataFrame(rows[:-1], schema))
    want = df.groupBy("TagId", "NodeId", F.window("Time", "3 minutes")["start"].alias("freq")).agg(
        F.max("TagRSSI").alias("TagRSSI_max"), F.count(F.lit(1)).alias("beep_count"))
    cols = want.columns
    assert sorted(got.select(*cols).collect()) == sorted(want.collect())


PINGS = "hitID BIGINT, motusTagID BIGINT, ts TIMESTAMP, recvDeployName STRING, port STRING"


def _pings():
    rows = [(i, i % 3, at(i * 1.5 + (i // 40) * 100), ["A", "B", None][i % 3], "1") for i in range(300)]
    rows += [(1000 + i, None, at(i * 20.0), "A", "1") for i in range(9)]
    return rows[::2] + rows[1::2]  # every session is spread over several arrivals, the last ones late by all of the time


def _sessions(spark, rows, gap=5):
    df = spark.createDataFrame(rows, PINGS)
    return ses.event_counts(ses.sessionize(df, gap=gap))


def test_session_parts_lose_nothing_and_survive_restarts(spark, tmp_path, monkeypatch):
    rows = _pings()
    _arrivals(spark, tmp_path / "in", rows[:200], PINGS, 2)
    source = lambda: streams.read_stream(spark, str(tmp_path / "in"), PINGS, files=1)
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    streams.run_session_parts(source(), out, marks, "5 seconds")
    _arrivals(spark, tmp_path / "in", rows[200:], PINGS, 3)
    real, calls = streams.session_parts, []

    def broken(pings, gap, key):
        calls.append(1)
        if len(calls) == 2:  # after the batch was half written
            real(pings.limit(3), gap, key).write.parquet(f"{out}/batch=3")
            raise RuntimeError("lost")
        return real(pings, gap, key)

    monkeypatch.setattr(streams, "session_parts", broken)
    with pytest.raises(Exception):
        streams.run_session_parts(source(), out, marks, "5 seconds")
    monkeypatch.setattr(streams, "session_parts", real)
    streams.run_session_parts(source(), out, marks, "5 seconds")
    want = _sessions(spark, rows)
    columns = ["motusTagID", "first_ts", "last_ts", "n_pings", "w_towers"]
    expected = sorted(want.select(*columns).collect(), key=str)
    assert sorted(streams.read_sessions(spark, out, 5).select(*columns).collect(), key=str) == expected and len(expected) > 10
    # a compacted log reads the same, also with later arrivals beside it
    late = [(5000, 1, at(3.0), "Z", "1"), (5001, 9, at(9000), None, "1")]
    streams.compact_sessions(spark, out, str(tmp_path / "compact"), 5)
    real(spark.createDataFrame(late, PINGS), "5 seconds").write.parquet(f"{tmp_path}/compact/batch=7")
    expected = sorted(_sessions(spark, rows + late).select(*columns).collect(), key=str)
    assert sorted(streams.read_sessions(spark, str(tmp_path / "compact"), 5).select(*columns).collect(), key=str) == expected


def test_upserts_show_open_windows(spark, tmp_path):
    schema = "Time TIMESTAMP, TagId STRING, NodeId STRING, TagRSSI DOUBLE"
    rows = [(at(i * 7), IDS[i % 2], ["N0", "N1", None][i % 3], -50.0 - i % 9) for i in range(400)]
    _arrivals(spark, tmp_path / "in", rows[:250], schema, 2)
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    binned = lambda: streams.stream_resample(streams.read_stream(spark, str(tmp_path / "in"), schema, files=1))
    streams.run_upserts(binned(), out, marks)
    _arrivals(spark, tmp_path / "in", rows[250:], schema, 2)
    streams.run_upserts(binned(), out, marks)
    got = streams.read_upserts(spark, out, binned().schema, ["TagId", "NodeId", "freq"])
    want = known_beeps(spark.createDataFrame(rows, schema)).groupBy("TagId", "NodeId", F.window("Time", "3 minutes")["start"].alias("freq")).agg(
        F.max("TagRSSI").alias("TagRSSI_max"), F.round(F.stddev_samp("TagRSSI"), 9).alias("TagRSSI_sd"), F.count(F.lit(1)).alias("beep_count"))
    got = got.withColumn("TagRSSI_sd", F.round("TagRSSI_sd", 9))
    assert sorted(got.select(*want.columns).collect(), key=str) == sorted(want.collect(), key=str)


def test_stream_drops_repeats(spark, tmp_path):
    schema = "hitID BIGINT, ts TIMESTAMP"
    rows = [(i % 50, at(i % 50)) for i in range(150)]
    _arrivals(spark, tmp_path / "in", rows, schema)
    stream = streams.read_stream(spark, str(tmp_path / "in"), schema)
    got = _drain(spark, tmp_path, streams.stream_new_rows(stream))
    assert sorted(r["hitID"] for r in got.collect()) == list(range(50))


def test_ordered_track_puts_nulls_last_and_strong_signals_first(spark):
    rows = [(1, 5, 7, "b", -50.0, "2024-01-01 00:00:01"), (2, 5, 7, "a", None, "2024-01-01 00:00:01"), (3, 5, 7, "a", -60.0, "2024-01-01 00:00:01"),
            (4, 5, 7, "a", -40.0, "2024-01-01 00:00:01"), (5, 5, 7, None, -10.0, "2024-01-01 00:00:01"), (6, 5, None, "a", -10.0, "2024-01-01 00:00:00"),
            (7, 5, 7, "z", -10.0, None), (8, 5, 3, "z", -10.0, "2025-01-01 00:00:00"), (9, 6, 3, "z", -10.0, "2025-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "hitID LONG, tagProjID INT, motusTagID LONG, recvDeployName STRING, sig DOUBLE, ts STRING")
    df = df.withColumn("ts", df["ts"].cast("timestamp")).repartition(4)
    assert [r["hitID"] for r in sinks.ordered_track(df, 5).collect()] == [8, 4, 3, 2, 1, 5, 7, 6]
