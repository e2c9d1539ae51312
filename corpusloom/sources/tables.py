"""Typed access to the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGE_TASKS = 4  # a core, where pages are parsed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The stored table; only the columns a query uses are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame, each: int = 1) -> DataFrame:
    """A scan that has fewer than `each` tasks for a core of the cluster, dealt out to so many; larger ones stay as they are.

    For queries that compute much per row: a small file is one row group, which one task reads. Where a row's work outweighs
    its shuffle by far, ask for several tasks a core: of one or two, the last leave most cores idle."""
    tasks = each * frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(tasks) if frame.rdd.getNumPartitions() < tasks else frame
