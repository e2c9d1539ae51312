"""Makes this package importable in Python workers, wherever they run, and hands them rows in pieces of bounded size."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

PIECE = 1 << 20  # bytes
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as --py-files would."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), "corpusloom_pkg.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


def pieces(batches: Iterable[pa.RecordBatch], most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of batches, in their order, in batches of `most` bytes or of one row: a batch of Spark's is as large as its
    rows are, and as Python objects many times that."""
    for batch in batches:
        if batch.num_rows > 1 and batch.nbytes > most:
            half = batch.num_rows // 2
            yield from pieces((batch.slice(0, half), batch.slice(half)), most)
        elif batch.num_rows:
            yield batch
