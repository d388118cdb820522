"""Named queries over the supplied tables, each with its ANSI-SQL statement where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, DoubleType, TimestampType

from pingtrail.plans.adapters import Tables
from pingtrail.session import scratch  # noqa: F401


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return publish(self.build(Tables(spark, folder)))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return add


def publish(df: DataFrame) -> DataFrame:
    """Engine-neutral values: times as epoch microseconds, dates as text, doubles to 6 decimals."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, TimestampType):
            c = F.unix_micros(c)
        elif isinstance(field.dataType, DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, DoubleType):
            c = F.round(c, 6) + F.lit(0.0)
        out.append(c.alias(field.name))
    return df.select(*out)
