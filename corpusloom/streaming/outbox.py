"""Changes handed on from a stream: an outbox of batches, sent by tasks, with what was tried and how it went."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

TRIES, AT_ONCE = 5, 100
TRIED = "id string, ok boolean, error string, origin long"


class Outbox:
    """A sink for `writeStream.foreachBatch(outbox.take)` in a folder that all executors share.

    A batch is first stored whole, each change under an id of its own content: a batch that is played again replaces
    itself, and equal changes of a batch are one. Then all stored changes that no earlier try delivered are sent, by tasks, `at_once` a call of
    `send(rows)`. Where it raises, these rows are tried again with the next batch, `tries` times in all. A try that the job was lost
    in is made again: receivers tell repeats by `id`. Batches without changes left to send move from open to done."""

    def __init__(self, folder: str, send: Callable[[list[dict]], None], key: tuple[str, ...] = ("key", "ts", "hash"), tries: int = TRIES, at_once: int = AT_ONCE):
        self.folder, self.send, self.key, self.tries, self.at_once = folder, send, key, tries, at_once

    def _path(self, spark: SparkSession, *parts: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(self.folder, *parts))
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _origins(self, spark: SparkSession) -> list[int]:
        """The batches that aren't done; one whose storing was broken off isn't there yet."""
        system, path = self._path(spark, "open")
        names = [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []
        return sorted(int(n.split("=")[1]) for n in names if system.exists(self._path(spark, "open", n, "_SUCCESS")[1]))

    def attempts(self, spark: SparkSession) -> DataFrame:
        """(id, ok, error, origin): all tries so far."""
        system, path = self._path(spark, "tried")
        return spark.read.schema(TRIED).parquet(str(path) + "/*") if system.exists(path) else spark.createDataFrame([], TRIED)

    def take(self, changes: DataFrame, batch: int) -> None:
        """Store batch number `batch` and send what is to be sent."""
        spark = changes.sparkSession
        system, done = self._path(spark, "done", f"origin={batch}")
        if system.exists(done):
            changes.write.format("noop").mode("overwrite").save()  # a stream keeps its state only if the batch is read
        else:
            parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in self.key]
            rows = changes.withColumn("id", F.sha2(F.concat(*parts), 256)).dropDuplicates(["id"])
            rows.write.mode("overwrite").parquet(posixpath.join(self.folder, "open", f"origin={batch}"))
        self.flush(spark)

    def pending(self, spark: SparkSession) -> DataFrame:
        """Stored changes that weren't delivered and may still be tried, with `origin` and how often they were."""
        origins = self._origins(spark)
        if not origins:
            return spark.createDataFrame([], "id string, origin long, tried long")
        paths = [posixpath.join(self.folder, "open", f"origin={n}") for n in origins]
        stored = spark.read.option("basePath", posixpath.join(self.folder, "open")).parquet(*paths).withColumn("origin", F.col("origin").cast("long"))
        made = self.attempts(spark).where(F.col("origin").isin(origins)).groupBy("id", "origin").agg(F.count("*").alias("tried"), F.max("ok").alias("ok"))
        return stored.join(made, ["id", "origin"], "left").where(~F.coalesce("ok", F.lit(False)) & (F.coalesce("tried", F.lit(0)) < self.tries)).withColumn("tried", F.coalesce("tried", F.lit(0))).drop("ok")

    def flush(self, spark: SparkSession) -> None:
        """Send what is pending once, and move batches that are through to done."""
        send, at_once = self.send, self.at_once

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, at_once):
                    part, error = batch.slice(start, at_once), None
                    try:
                        send(part.to_pylist())
                    except Exception as e:  # of whatever kind: the receiver's failure is the try's result
                        error = f"{type(e).__name__}: {e}"[:500]
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([error is None] * n), pa.array([error] * n, pa.string()), part.column("origin")], names=["id", "ok", "error", "origin"])

        due = self.pending(spark)
        due.mapInArrow(run, TRIED).write.parquet(posixpath.join(self.folder, "tried", uuid.uuid4().hex))
        left = {r["origin"] for r in self.pending(spark).select("origin").distinct().collect()}  # batches that are open
        for origin in self._origins(spark):
            if origin not in left:
                system, path = self._path(spark, "done", f"origin={origin}")
                system.mkdirs(path.getParent())
                system.rename(self._path(spark, "open", f"origin={origin}")[1], path)
