"""Writing results, and appending new arrivals to a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pingtrail.operators.sessions import KEYED, keyed
from pingtrail.operators.slicing import HOUR, with_slice


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("nullValue", "NA").csv(path)


def write_per_tag(
    df: DataFrame, path: str, tag: str = "mfgID", ts: str = "ts", mode: str = "errorifexists"
) -> None:
    """One folder per tag, in one job. Ranges over (tag, time) split a tag that holds a large share
    of the rows over several files and keep small tags together. There are as many ranges as the session has shuffle
    partitions: making folders and files takes most of the time, so tasks are not merged by their few bytes."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, tag, ts).sortWithinPartitions(tag, ts)
    (
        ranged.write.mode(mode).partitionBy(tag)
        .option("header", True).option("nullValue", "NA")
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    )


def write_snapshot(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_sliced(
    df: DataFrame, table: str, path: str, key: str = "motusTagID", ts: str = "ts",
    slice_s: float = HOUR, buckets: int | None = None,
) -> DataFrame:
    """Store ``df`` as a table in buckets of (key, time slice), sorted by these and time, and return a reader over it.

    The pings are shuffled once, here; sessions and transitions over the table (``sessionize_sliced``,
    ``transitions_sliced``) then read each bucket in place. A key with most of the rows is spread by its slices. Beside the
    columns of ``df`` the table has the key as ``_k`` and ``_void`` and ``_slice``; rows without a time are in slice 0.
    ``buckets`` should give files of some 100 MB to 1 GB; the default is the session's number of shuffle partitions.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*KEYED, "_slice"]
    rows = with_slice(df.select("*", *keyed(df, key)), ts, slice_s).repartition(n, *by)
    (rows.write.mode("errorifexists").bucketBy(n, by[0], *by[1:]).sortBy(*by, ts)
     .option("path", path).saveAsTable(table, format="parquet"))
    return spark.table(table)


def new_rows(
    existing: DataFrame, incoming: DataFrame, key: tuple[str, ...] = ("hitID",),
    batch: str | None = None,
) -> DataFrame:
    """Rows of ``incoming`` whose key is not stored yet, one per key: the smallest by all columns.

    ``batch`` names a key column the storage is clustered by, such as ``batchID``: only stored rows of the
    arriving batches are then compared. A batch outside the key could not tell a stored row under another batch.
    """
    known = existing
    if batch is not None:
        if batch not in key:
            raise ValueError("the batch must be part of the key")
        known = known.join(incoming.select(batch).distinct(), batch, "left_semi")
    fresh = incoming.join(known.select(*key), list(key), "left_anti")
    copies = Window.partitionBy(*key).orderBy(*incoming.columns)
    return fresh.withColumn("_copy", F.row_number().over(copies)).where("_copy = 1").drop("_copy")


def append_new(
    incoming: DataFrame, path: str, key: tuple[str, ...] = ("hitID",), batch: str | None = None,
) -> None:
    """Add the rows of ``incoming`` that the Parquet table at ``path`` lacks; what is stored is not rewritten.

    Only the key columns of the stored table are read. Appending the same rows again adds nothing.
    """
    columns = dict.fromkeys((*key, *([batch] if batch else [])))
    stored = incoming.sparkSession.read.schema(incoming.schema).parquet(path).select(*columns)
    new_rows(stored, incoming, key, batch).write.mode("append").parquet(path)


def ordered_track(df: DataFrame, project: int) -> DataFrame:
    """Detections of one project's tags in tag, time, station, signal-descending order."""
    return df.where(F.col("tagProjID") == project).orderBy(
        F.col("motusTagID").asc_nulls_last(), F.col("ts").asc_nulls_last(),
        F.col("recvDeployName").asc_nulls_last(), F.col("sig").desc_nulls_last(), F.col("hitID"),
    )
