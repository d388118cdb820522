"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Correctness needs UTC; the rest are sizing defaults a cluster may override.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even where a following aggregate then needs its own exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app: str = "pingtrail", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and return a reader over it.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only a local session
    without one gets a temporary folder; a cluster must name shared storage itself.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_base(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a one-machine session without it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="pingtrail-")
    return base.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder name on the shared checkpoint storage."""
    return f"{shared_base(spark)}/pingtrail-{uuid.uuid4().hex}"


def measured(df: DataFrame) -> DataFrame:
    """A narrow summary written once to the shared folder and read back.

    Estimates of aggregated tables are far too high before they run. Read back, the planner knows the size in bytes
    and broadcasts or shuffles by the session's own threshold.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
