"""Tag and receiver metadata: audits, timelines, station ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pingtrail.functions.fixed import MONTH_SECONDS
from pingtrail.functions.timeutil import from_micros, micros, us_of


def never_deployed(tags: DataFrame, deployments: DataFrame) -> DataFrame:
    return tags.join(deployments.select("tagID").distinct(), "tagID", "left_anti")


def multi_deployments(df: DataFrame, tag: str = "motusTagID", dep: str = "tagDeployID") -> DataFrame:
    """Distinct (tag, deployment) pairs of tags with more than one deployment, and the number."""
    pairs = df.where(F.col(dep).isNotNull()).select(tag, dep).distinct()
    many = pairs.groupBy(tag).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return pairs.join(many, tag)


def deployment_timeline(
    deps: DataFrame, ids: list[str] = ["deviceID", "deployID"], open_end_s: int = MONTH_SECONDS
) -> DataFrame:
    """Start and end as one row each; an open end is the latest known time plus ``open_end_s``."""
    long = deps.select(
        *ids, F.col("tsStart").alias("timeStart"), F.col("tsEnd").alias("timeEnd")
    ).unpivot(ids, ["timeStart", "timeEnd"], "when", "time")
    latest = long.agg(F.max("time").alias("m")).select(
        from_micros(micros("m") + us_of(open_end_s)).alias("m")
    )
    return long.withColumn("time", F.coalesce("time", latest.scalar()))


def station_ranks(df: DataFrame) -> DataFrame:
    """Stations ranked by mean latitude. The window runs over one row per station."""
    means = df.where("recvDeployName IS NOT NULL").groupBy("recvDeployName").agg(
        F.avg("recvDeployLat").alias("mean_lat")
    )
    return means.withColumn(
        "rank", F.dense_rank().over(Window.orderBy(F.col("mean_lat").asc_nulls_last()))
    )


def project_species(deployments: DataFrame, species: DataFrame, project: int) -> DataFrame:
    used = deployments.where(F.col("projectID") == project).select(F.col("speciesID").alias("id"))
    return species.join(used.distinct(), "id", "left_semi")
