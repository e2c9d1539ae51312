"""Session factory with the settings the queries assume."""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "corpusloom", cores: int | str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass your own session instead."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="loom-"),  # of this machine, as all of this session is
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.requireAllClusterKeysForCoPartition": "false",  # rows dealt out by page stay where they are
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share, spark.checkpoint.dir. Where that is unset, a session of one
    machine gets one of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loom-")
    return posixpath.join(found, f"{name}-{uuid.uuid4().hex}")
