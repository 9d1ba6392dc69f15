"""Parquet and catalog scans and the partitioned parquet sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.table(name)
    return df.select(*columns) if columns else df


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), spread: int | None = None
) -> None:
    """Overwrite `path`, one directory per cohort.

    Rows are rebalanced by cohort first: adaptive execution splits a hot cohort over
    several tasks and joins small ones, so that each directory gets few, even files. With
    `spread` they go through a round-robin shuffle into that many tasks instead.
    """
    if spread:
        df = df.repartition(spread)
    elif partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
