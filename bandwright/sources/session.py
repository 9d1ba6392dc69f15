"""Session settings and the shared folder for intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Wide feature tables carry names that differ by case only.
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "bandwright", **conf: str) -> SparkSession:
    """A session with the settings above; `conf` entries override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = named or context.getCheckpointDir()
    if not current:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        current = tempfile.mkdtemp(prefix="bandwright-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """The frame as a parquet table in the shared folder.

    For inputs that several passes read: the joins behind `df` run once, each pass
    reads only its columns, and a lost executor costs no recomputation.
    """
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
