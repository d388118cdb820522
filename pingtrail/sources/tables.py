"""Reading tables with explicit schemas."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from pingtrail.schemas import SCHEMAS


def read_table(spark: SparkSession, name: str, path: str, view: bool = True) -> DataFrame:
    """Parquet table of a known name; also registered as a temporary view."""
    df = spark.read.schema(SCHEMAS[name]).parquet(path)
    if view:
        df.createOrReplaceTempView(name)
    return df


def _raw_csv(spark: SparkSession, path: str | list[str], schema, timestamp_format: str, **options: str) -> DataFrame:
    return (
        spark.read.schema(schema)
        .options(**options)
        .option("header", True)
        .option("nullValue", "NA")
        .option("timestampFormat", timestamp_format)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )


def _blank_to_null(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    text = [f.name for f in df.schema if isinstance(f.dataType, StringType) and f.name not in skip]
    return df.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in text})


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str | StructType,
    timestamp_format: str = "yyyy-MM-dd HH:mm:ss",
) -> DataFrame:
    """CSV with a header where ``NA`` and empty text (quoted or not) mean null; text is trimmed."""
    return _blank_to_null(_raw_csv(spark, path, schema, timestamp_format))


def _folder(tag: str, value: str) -> str:
    """Name of the folder that Spark's writer gives a value of a partition column."""
    return f"{tag}=" + re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value)


def _is_there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("value STRING").text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def read_tags(
    spark: SparkSession,
    path: str,
    schema: str,
    tags: Iterable[str],
    tag: str = "mfgID",
    timestamp_format: str = "yyyy-MM-dd HH:mm:ss",
) -> DataFrame:
    """The listed tags of an export partitioned by tag; other folders are neither listed nor opened.

    Only if none of the tags has a folder, or tags are not compared as text, all folders are listed.
    """
    listed = list(tags)
    found, options = path, {}
    names = [t for t in listed if isinstance(t, str) and t]
    text = any(f.name == tag and isinstance(f.dataType, StringType) for f in StructType.fromDDL(schema))
    if text and len(names) == len(listed):
        folders = [f"{path.rstrip('/')}/{_folder(tag, t)}" for t in dict.fromkeys(names)]
        there = [f for f in folders if _is_there(spark, f)]
        if there:
            found, options = there, {"basePath": path}
    kept = _raw_csv(spark, found, schema, timestamp_format, **options).where(F.col(tag).isin(listed))
    return _blank_to_null(kept, (tag,))


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Table of an external database through a driver jar the caller provides."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def columns_of(spark: SparkSession, table: str) -> DataFrame:
    """(column, type) of a table or view."""
    rows = [(f.name, f.dataType.simpleString()) for f in spark.table(table).schema]
    return spark.createDataFrame(rows, "column STRING, type STRING")


def filled_columns(df: DataFrame) -> DataFrame:
    """(column, type, filled, n): how many of all rows have a value in each column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(df.schema)])
    lines = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"c{i}").alias("filled"))
                      for i, f in enumerate(df.schema)])
    return counts.select("n", F.inline(lines)).select("column", "type", "filled", "n")


def tables_of(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def head(df: DataFrame, order: list[str], n: int = 6) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n)


def tail(df: DataFrame, order: list[str], n: int = 6) -> DataFrame:
    return df.orderBy(*[F.col(c).desc_nulls_first() for c in order]).limit(n)
