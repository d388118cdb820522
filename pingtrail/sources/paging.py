"""Copying a table batch by batch in pages, with a stored cursor from which an interrupted copy goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructType

from pingtrail.session import measured

LOG = "round LONG, pages LONG"
LOWEST = -(1 << 63)


def _place(key: str) -> Column:
    """Position of a row in its batch; rows without a key come first, together."""
    return F.coalesce(F.col(key).cast("long"), F.lit(LOWEST))


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _committed(spark: SparkSession, path: str) -> int:
    """Number of the last round that is wholly stored, 0 if there is none."""
    spark.createDataFrame([], LOG).write.mode("ignore").parquet(f"{path}/log")
    return spark.read.schema(LOG).parquet(f"{path}/log").agg(F.max("round")).first()[0] or 0


def _rounds(spark: SparkSession, path: str, part: str, schema: StructType, last: int) -> DataFrame:
    """Rows of the committed rounds; what a lost round left behind is not read."""
    if not last:
        return spark.createDataFrame([], schema).withColumn("round", F.lit(0).cast("long"))
    found = spark.read.schema(StructType([*schema.fields]).add("round", LongType())).parquet(f"{path}/{part}")
    return found.where(F.col("round") <= last)


def _cursor_schema(source: DataFrame, batch: str) -> StructType:
    return StructType([source.schema[batch]]).add("last", LongType()).add("done", "boolean").add("pages", LongType())


def page_cursors(source: DataFrame, path: str, batch: str = "batchID") -> DataFrame:
    """One row per batch begun: ``batch``, ``last`` (largest key stored), ``done`` (nothing was left behind it) and ``pages``."""
    spark = source.sparkSession
    stored = _rounds(spark, path, "cursors", _cursor_schema(source, batch), _committed(spark, path))
    latest = F.max_by(F.struct("last", "done"), "round")
    return stored.groupBy(batch).agg(latest.alias("c"), F.sum("pages").alias("pages")).select(batch, "c.last", "c.done", "pages")


def plan_pages(source: DataFrame, cursors: DataFrame, batch: str, key: str, size: int) -> DataFrame:
    """(batch, page, low, high, final): the pages past each batch's cursor, from page 1; a page holds places above low up to high.

    Rows are counted in cells of ``size`` neighbouring keys and cells are put together in order, so that a page holds fewer than
    twice ``size`` rows where keys are unique. Equal keys always share a page.
    """
    at = source.select(F.col(batch).alias("_batch"), _place(key).alias("_place"))
    known = cursors.select(F.col(batch).alias("_known"), "last")
    rest = at.join(known, F.col("_batch").eqNullSafe(F.col("_known")), "left").where("last IS NULL OR _place > last")
    cells = rest.groupBy("_batch", F.floor(F.col("_place") / size).alias("_cell")).agg(
        F.count(F.lit(1)).alias("n"), F.max("_place").alias("high"), F.max("last").alias("last"))
    ordered = Window.partitionBy("_batch").orderBy("_cell")
    before = F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    numbered = cells.withColumn("_page", F.floor(F.coalesce(before, F.lit(0)) / size))
    pages = numbered.groupBy("_batch", "_page").agg(F.max("high").alias("high"), F.max("last").alias("last"))
    in_batch = Window.partitionBy("_batch").orderBy("_page")
    return pages.select(
        F.col("_batch").alias(batch), F.row_number().over(in_batch).alias("page"),
        F.coalesce(F.lag("high").over(in_batch), "last").alias("low"), "high", F.lead("high").over(in_batch).isNull().alias("final"))


def copy_pages(
    source: DataFrame, path: str, batch: str = "batchID", key: str = "hitID", size: int = 1_000_000, most_rounds: int | None = None,
) -> int:
    """Copy what lies past the cursors of ``path``, a page of every unfinished batch a round; returns the number of rounds made.

    A round writes its rows, then the cursors they lead to, then one line of the log. Only logged rounds count: one that was lost
    anywhere before is written anew under its number, so a copy that is stopped at any point and started again holds every row
    once. Stored pages are not asked for again: rows that arrive later are found if their key is above their batch's cursor, or
    if their batch is new. Keys are whole numbers; a null key comes before all others, and a null batch is one of its own.
    One copy at a time may write to a path. Batches are told apart by key ranges within a join on the batch, so a source that is
    partitioned by batch is read for unfinished batches only.
    """
    spark = source.sparkSession
    last = _committed(spark, path)
    plan = measured(plan_pages(source, page_cursors(source, path, batch), batch, key, size))
    waves = plan.agg(F.max("page")).first()[0] or 0
    rounds = waves if most_rounds is None else min(waves, most_rounds)
    for page in range(1, rounds + 1):
        here = plan.where(F.col("page") == page).withColumnRenamed(batch, "_batch")
        wanted = F.col(batch).eqNullSafe(F.col("_batch")) & (_place(key) <= F.col("high"))
        rows = source.join(here, wanted & (F.col("low").isNull() | (_place(key) > F.col("low"))), "left_semi")
        number = last + page
        _write(rows, f"{path}/data/round={number}")
        _write(here.select(F.col("_batch").alias(batch), F.col("high").alias("last"), F.col("final").alias("done"),
                           F.lit(1).cast("long").alias("pages")), f"{path}/cursors/round={number}")
        done = spark.range(1).select(F.lit(number).cast("long").alias("round"), F.lit(here.count()).cast("long").alias("pages"))
        _log(done, path)
    return rounds


def _log(line: DataFrame, path: str) -> None:
    line.write.mode("append").parquet(f"{path}/log")


def read_pages(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all committed rounds."""
    return _rounds(spark, path, "data", schema, _committed(spark, path)).drop("round")
