"""Copies in pages: the same table after any interruption, and no page twice."""

import pytest
from pyspark.sql import functions as F

from pingtrail.sources import paging

SCHEMA = "hitID LONG, batchID LONG, v STRING"
# one batch holds a third of the rows; sparse keys, a null batch, rows without a key
ROWS = [(i, 7, "a") for i in range(40)] + [(1000 * i, 8, "b") for i in range(25)] + [(i, i % 30 + 10, "c") for i in range(40, 90)]
ROWS += [(i, None, "d") for i in range(5)] + [(None, 7, "e"), (None, 7, "f"), (3, 9, None)]


def _table(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _stored(spark, path):
    return _rows(paging.read_pages(spark, path, _table(spark).schema))


def test_pages_hold_every_row_once(spark, tmp_path):
    path, df = str(tmp_path / "t"), _table(spark)
    assert paging.copy_pages(df, path, size=10) > 3
    assert _stored(spark, path) == _rows(df)
    sizes = spark.read.parquet(f"{path}/data").groupBy("round", "batchID").count()
    assert sizes.agg(F.max("count")).first()[0] < 20
    cursors = {r["batchID"]: (r["last"], r["done"]) for r in paging.page_cursors(df, path).collect()}
    assert cursors[7] == (39, True) and cursors[8] == (24000, True) and cursors[None] == (4, True) and cursors[9] == (3, True)
    assert paging.copy_pages(df, path, size=10) == 0


@pytest.mark.parametrize("step", ["data", "cursors", "log"])
@pytest.mark.parametrize("broken_round", [1, 3])
def test_a_lost_round_is_made_anew(spark, tmp_path, monkeypatch, step, broken_round):
    path, df, write, log = str(tmp_path / "t"), _table(spark), paging._write, paging._log

    def failing_write(rows, to):
        if to.endswith(f"{step}/round={broken_round}"):
            write(rows.limit(2), to)  # half a round is there
            raise RuntimeError("lost")
        write(rows, to)

    def failing_log(line, to):
        if step == "log" and line.first()["round"] == broken_round:
            raise RuntimeError("lost")
        log(line, to)

    monkeypatch.setattr(paging, "_write", failing_write)
    monkeypatch.setattr(paging, "_log", failing_log)
    with pytest.raises(RuntimeError):
        paging.copy_pages(df, path, size=10)
    monkeypatch.setattr(paging, "_write", write)
    monkeypatch.setattr(paging, "_log", log)
    part = _stored(spark, path)
    assert len(part) < len(ROWS) and (part == []) == (broken_round == 1)
    # stored pages are not read again: the source may lack them by now
    left = [r for r in ROWS if r not in part]
    paging.copy_pages(_table(spark, left), path, size=10)
    assert _stored(spark, path) == _rows(df)


def test_later_rows_and_new_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    paging.copy_pages(_table(spark), path, size=10, most_rounds=1)
    assert not all(r["done"] for r in paging.page_cursors(_table(spark), path).collect())
    more = [*ROWS, (500, 7, "later"), (1, 99, "new")]
    paging.copy_pages(_table(spark, more), path, size=10)
    assert _stored(spark, path) == _rows(_table(spark, more))


def test_empty_source(spark, tmp_path):
    path = str(tmp_path / "t")
    assert paging.copy_pages(_table(spark, []), path) == 0
    assert _stored(spark, path) == [] and paging.page_cursors(_table(spark), path).count() == 0
