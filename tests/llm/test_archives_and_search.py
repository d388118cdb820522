"""WARC round trips and exact top-k."""

import base64
import glob
import gzip
import hashlib
import json
import zlib

import pytest
from pyspark.sql import functions as F

from pingtrail.llm import block_topk, warc
from pingtrail.llm.common import shared_folder
from pingtrail.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_query(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html").collect()
    first = {}
    for p in sorted(pages):
        first.setdefault(p.html or "", p.page_id)
    want = []
    for p in pages:
        data, lead = (p.html or "").encode(), first[p.html or ""]
        want.append((p.page_id, len(data), digest(data), "response" if lead == p.page_id else "revisit", None if lead == p.page_id else lead))
    assert sorted(map(tuple, QUERIES["op1_warc"](spark, FOLDER).collect()), key=str) == sorted(want, key=str)


PAGES = [(1, "u\r\nX: y", "a"), (2, None, "a"), (3, "v", None), (4, "v", ""), (None, "w", "a"), (5, "w", "é" * 9_000_000), (6, "", "x\r\n\r\nWARC/1.1\r\n"),
         (7, "r", "same"), (7, "r", "same"), (8, "s", "same")]


def test_warc_odd_rows(frame):
    pages = frame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    back = warc.round_trip(pages).collect()
    found = sorted((r.record_id, r.record_type, r.refers_to, r.uri, r.payload_bytes, len(r.payload)) for r in back)
    name = "<urn:page:{}>".format
    assert found == sorted([
        (name(1), "response", None, "u%0D%0AX: y", 1, 1), (name(2), "revisit", name(1), "", 1, 0), (name(3), "response", None, "v", 0, 0),
        (name(4), "revisit", name(3), "v", 0, 0), (name("null"), "revisit", name(1), "w", 1, 0), (name(5), "response", None, "w", 18_000_000, 18_000_000),
        (name(6), "response", None, "", 15, 15), (name(7), "response", None, "r", 4, 4), (name(7), "response", None, "r", 4, 4),
        (name(8), "revisit", name(7), "s", 4, 0)], key=lambda r: r)
    assert all(r.payload_digest == "sha1:" + digest(bytes(r.payload)) for r in back if r.record_type == "response")
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert warc.round_trip(frame(PAGES, "page_id long, url string, html string"), least_bytes=2).where("record_type = 'revisit'").count() == 1


def test_archives_are_plain_gzip_with_members_at_their_offsets(spark, frame):
    folder = shared_folder(spark, "test-warc")
    pages = frame([(i, f"http://h/{i}", "text " * (i % 7)) for i in range(40)], "page_id long, url string, html string").coalesce(2)
    warc.write_monolithic(warc.records(pages), f"{folder}/in")
    warc.normalise(spark, f"{folder}/in", f"{folder}/out")
    seen = 0
    for path in glob.glob(f"{folder}/in/*.gz"):
        archive = path.rsplit("/", 1)[-1].split(".")[0]
        (members,) = glob.glob(f"{folder}/out/kind=warc/archive={archive}/*.txt")
        (index,) = glob.glob(f"{folder}/out/kind=index/archive={archive}/*.txt")
        data = open(members, "rb").read()
        assert gzip.decompress(data) == gzip.open(path).read()
        at = 0
        for line in gzip.open(index, "rt"):
            entry = json.loads(line)
            assert entry["offset"] == at
            one = zlib.decompressobj(31)
            record = one.decompress(data[at:at + entry["length"]])
            assert one.eof and not one.unused_data and f"WARC-Record-ID: {entry['id']}".encode() in record
            at += entry["length"]
            seen += 1
        assert at == len(data)
    assert seen == 40


def test_archives_are_bounded_by_bytes(spark, frame, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 16)
    monkeypatch.setattr(warc, "CLASSES", [1 << 12, 1 << 14])
    monkeypatch.setattr(warc, "TASK_BYTES", 1 << 10)
    folder = shared_folder(spark, "test-bounded")
    html = {i: chr(97 + i % 26) * (100_000 if i == 50 else 9_000 if i % 5 == 0 else i) for i in range(101)}
    pages = frame([(i, "u" * (20_000 if i == 7 else 3), h) for i, h in html.items()], "page_id long, url string, html string").coalesce(1)
    warc.write_monolithic(warc.records(pages, least_bytes=1 << 30), f"{folder}/in")
    archives = [gzip.open(p).read() for p in glob.glob(f"{folder}/in/*.gz")]
    for data in archives:
        assert len(data) <= 1 << 16 or data.count(b"WARC/1.1\r\n") == 1
    assert sum(data.count(b"WARC/1.1\r\n") for data in archives) == 101
    warc.normalise(spark, f"{folder}/in", f"{folder}/out")
    back = warc.read_by_index(spark, f"{folder}/out").collect()
    assert {int(r.record_id[10:-1]): bytes(r.payload).decode() for r in back} == html and len(back) == 101


def test_truncated_archives_are_reported():
    whole = gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    assert len(list(warc.inflated_records(whole + whole))) == 2
    for data in (whole[:-12], gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nab")):
        with pytest.raises(ValueError):
            list(warc.inflated_records(data))


def brute_top(rows, k, every):
    clean = [(i, tuple(int(256 * x // 1) for x in v)) for i, v in rows
             if i is not None and v is not None and all(x is not None and x == x and abs(x) != float("inf") for x in v)]
    out = []
    for i, q in set(clean):
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, d, strict=True)), j) for j, d in clean if j != i and len(d) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


def test_top_k_against_brute_force(frame, monkeypatch):
    import random

    monkeypatch.setattr(block_topk, "SHARD_BLOCKS", 2)
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.003, -0.1, 0.9]) for _ in range(4)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [rows[50], rows[600], rows[600], rows[601], (100, [0.9, 0.9, -0.5, 0.25]), (150, rows[3][1]), (None, [1.0] * 4), (2000, None), (2001, [1.0, None, 0.0, 0.0]), (2002, [float("nan")] * 4), (2050, [1.0] * 3), (2051, [0.5] * 3), (2100, [0.0] * 4)]
    found = block_topk.top_k(frame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")))
    assert sorted(map(tuple, found.collect())) == brute_top(rows, 5, 50)
    few = frame(rows[:3], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, block_topk.top_k(few).collect())) == brute_top(rows[:3], 5, 50)
    assert block_topk.top_k(few.limit(0)).count() == 0


def test_top_k_of_repeated_rows_equals_its_sql(spark, frame, tmp_path):
    import duckdb

    from pingtrail.llm.queries import OP5_SQL

    rows = [(i, [(i * 7 % 13) / 13, (i * 5 % 11) / 11]) for i in range(120)] + [(7, [0.9, 0.9])] * 4 + [(50, [0.3, -0.4])] * 3 + [(50, [0.1, 0.2])]
    folder = shared_folder(spark, "test-topk")
    frame(rows, "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({OP5_SQL})").fetchall()
    assert sorted(map(tuple, QUERIES["op5_block_topk"](spark, folder).collect())) == sorted(want)


def test_bounds_hold_and_stop_early():
    import numpy as np

    rng = np.random.default_rng(2)
    docs = np.floor(rng.normal(size=(64, 8)) * 50)
    queries = np.floor(rng.normal(size=(10, 8)) * 50)
    assert (block_topk.bounds(queries, docs.min(0)[None], docs.max(0)[None])[:, 0] >= (queries @ docs.T).max(1)).all()
    near, far = (np.arange(64), docs + 500, np.ones(64, np.int64)), (np.arange(64, 128), docs - 9000, np.ones(64, np.int64))
    scored = []
    real = block_topk.products
    block_topk.products = lambda q, d: scored.append(len(d)) or real(q, d)
    try:
        block_topk.search(np.abs(queries) + 1, np.full(10, -1), np.full(10, block_topk.LOWEST), [near, far], 5)
    finally:
        block_topk.products = real
    assert scored == [64]
