"""What the operators of this package share: durable intermediate tables, batch sizes, counting."""

from __future__ import annotations

import functools
import posixpath
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.shipping import ship
from corpusloom.sources.tables import table

__all__ = ["any_names", "durable", "partitions", "prepare", "shared_dir", "table", "written"]


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts don't pile up in a worker, and ship the code."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a session of one machine gets a folder of
    its own; on a cluster that is an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = context._corpusloom_dir = getattr(context, "_corpusloom_dir", None) or tempfile.mkdtemp(prefix="loom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def durable(frame: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and cut the lineage; a lost executor costs no recomputation."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def written(frame: DataFrame) -> DataFrame:
    """Like durable, but as Parquet: a third of the bytes where rows are a few numbers. Rows come back in any order."""
    path = posixpath.join(shared_dir(frame.sparkSession), f"rows-{uuid.uuid4().hex}")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def any_names(*used: str) -> Callable:
    """For operators that pass the columns of docs, their first argument, on: lets these have any names.

    Columns that the operator doesn't use by name (`used`, and strings that it is given) have plain ones meanwhile."""

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def run(docs: DataFrame, *rest, **named) -> DataFrame:
            names = docs.columns
            known = {*used, *(x for x in (*rest, *named.values()) if isinstance(x, str))}
            plain = [name if name in known and names.index(name) == i else f"c{i}_" for i, name in enumerate(names)]
            back = dict(zip(plain, names))
            found = operator(docs.toDF(*plain), *rest, **named)
            return found.toDF(*[back.get(name, name) for name in found.columns])

        return run

    return wrap
