"""Structured Streaming forms of sessionising, resampling and de-duplicated arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pingtrail.functions.counts import n_distinct
from pingtrail.functions.timeutil import micros, us_of


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files: int | None = None) -> DataFrame:
    """Parquet files arriving in ``folder``, at most ``files`` of them a batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def stream_sessions(
    df: DataFrame, gap: str = "2500 milliseconds", late: str = "1 hour", key: str = "motusTagID"
) -> DataFrame:
    """Events per key as session windows; pings later than the watermark are dropped.

    Station and antenna sets are of installed hardware, so the state of an open session is small.
    """
    return (
        df.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), key)
        .agg(
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
            F.count(F.lit(1)).alias("n_pings"),
            n_distinct("recvDeployName").alias("w_towers"),
        )
        .drop("w")
    )


def stream_resample(
    beeps: DataFrame, freq: str = "3 minutes", late: str = "1 hour"
) -> DataFrame:
    """Strongest and sd of signal and beeps per tag, node and tumbling bin."""
    return (
        beeps.where("NodeId IS NOT NULL")
        .withWatermark("Time", late)
        .groupBy("TagId", "NodeId", F.window("Time", freq).alias("w"))
        .agg(
            F.max("TagRSSI").alias("TagRSSI_max"),
            F.stddev_samp("TagRSSI").alias("TagRSSI_sd"),
            F.count(F.lit(1)).alias("beep_count"),
        )
        .select("TagId", "NodeId", F.col("w.start").alias("freq"), "TagRSSI_max", "TagRSSI_sd",
                "beep_count")
    )


def stream_new_rows(
    df: DataFrame, late: str = "1 day", key: tuple[str, ...] = ("hitID",)
) -> DataFrame:
    """Arrivals without repeats of a key inside the lateness bound."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(key))


def run_to_folder(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Process everything available now into parquet files, then stop. Restart-safe."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", folder).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _run_batches(stream: DataFrame, checkpoint: str, write, mode: str) -> None:
    query = (
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_upserts(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Process everything available now; each batch leaves its new and changed rows in ``folder/batch=<id>``, then stop.

    Windows come out while they are still open, so nothing is held back at the end of the input. A batch that is repeated
    after a crash replaces its own folder.
    """
    _run_batches(stream, checkpoint, lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}"), "update")


def read_upserts(spark: SparkSession, folder: str, schema, key: list[str]) -> DataFrame:
    """The last state of every key that ``run_upserts`` left."""
    names = [f.name for f in schema if f.name not in key]
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(folder)
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*names), "batch").alias("_last"))
    return last.select(*key, "_last.*").select(*schema.names)


def session_parts(pings: DataFrame, gap: str, key: str = "motusTagID") -> DataFrame:
    """The parts of sessions that one batch of pings shows: first and last time, pings and stations. A ping without a time has none."""
    parts = pings.groupBy(F.session_window("ts", gap).alias("w"), key).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_pings"),
        F.collect_set(F.struct("recvDeployName")).alias("stations"),
    )
    return parts.drop("w")


def run_session_parts(stream: DataFrame, folder: str, checkpoint: str, gap: str, key: str = "motusTagID") -> None:
    """Process everything available now; each batch leaves the parts of its sessions in ``folder/batch=<id>``, then stop.

    No state is held between batches and no ping is too late: parts of different batches meet when they are read. A batch that is
    repeated after a crash replaces its own folder.
    """
    _run_batches(stream, checkpoint,
                 lambda pings, batch: session_parts(pings, gap, key).write.mode("overwrite").parquet(f"{folder}/batch={batch}"), "append")


def merged_parts(parts: DataFrame, gap_s: float, key: str = "motusTagID") -> DataFrame:
    """Parts that overlap or lie within the gap as one part. Only parts are ordered, never pings."""
    in_time = Window.partitionBy(key).orderBy("first_ts", "last_ts")
    reach = F.max(micros("last_ts")).over(in_time.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(micros("first_ts") <= reach + us_of(gap_s), 0).otherwise(1)
    numbered = parts.withColumn("_new", opens).withColumn("_session", F.sum("_new").over(in_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "_session").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n_pings").alias("n_pings"),
        F.array_distinct(F.flatten(F.collect_set("stations"))).alias("stations"),
    ).drop("_session")


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("mergeSchema", "false").parquet(folder)


def read_sessions(spark: SparkSession, folder: str, gap_s: float, key: str = "motusTagID") -> DataFrame:
    """All sessions so far, those still open included, from what ``run_session_parts`` left."""
    merged = merged_parts(_parts(spark, folder), gap_s, key)
    return merged.select(key, "first_ts", "last_ts", "n_pings", F.size("stations").cast("bigint").alias("w_towers"))


def compact_sessions(spark: SparkSession, folder: str, target: str, gap_s: float, key: str = "motusTagID") -> None:
    """The log of ``folder`` as one merged batch in ``target``, which may then be read, or extended by later batches, instead."""
    merged_parts(_parts(spark, folder), gap_s, key).write.mode("overwrite").parquet(f"{target}/batch=-1")
