"""A store of snapshots on any file system that Spark writes to: append-only files and a manifest for each version of it.

Rows (key, ts, ...) are dealt over buckets by a hash of the key and sorted by key and time within a file. A manifest
lists all files with their bucket, rows and least and greatest time. It is committed by creating the next number's file,
which only one writer can: the others read the new one and try again. Readers see whole versions of the store and read the
files alone that the key's bucket and the time asked for leave.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from corpusloom.operators.snapshots import KEEP_DAYS, KEEP_VERSIONS, TOLERANCE, retained, versions

BUCKETS, SPREAD, TRIES = 16, 4, 20


class SnapshotStore:
    """Snapshots with columns key (string) and ts (seconds as a double), and any others, the same in all appends.

    Rows of one key and time are versions of their own, ordered by a hash of the row. A store without a manifest is empty."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, patience: float = 5.0):
        self.spark, self.folder, self.buckets, self.patience = spark, folder, buckets, patience

    # --- manifests

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(self.folder, *parts))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def numbers(self) -> list[int]:
        """The committed versions of the store, ascending; a manifest that isn't whole isn't committed yet."""
        system, path = self._path("manifests")
        if not system.exists(path):
            return []
        return sorted(int(f.getPath().getName()[1:-5]) for f in system.listStatus(path) if f.getPath().getName().endswith(".json"))

    def manifest(self, number: int | None = None) -> dict:
        """That of a version of the store, by default the newest."""
        for n in [number] if number is not None else reversed(self.numbers()):
            try:
                return json.loads(self.spark.read.text(posixpath.join(self.folder, "manifests", f"v{n:09d}.json"), wholetext=True).first()[0])
            except (ValueError, TypeError):
                if number is not None:
                    raise ValueError(f"version {number} isn't whole") from None
        return {"number": 0, "schema": None, "files": []}

    def _commit(self, schema: StructType, change) -> dict:
        """Write the manifest after the newest one; if another writer is first, make the change to what that one left.

        A manifest that isn't whole may be one that is being written: it is waited for, and passed over in the end."""
        waited = 0.0
        for _ in range(TRIES):
            numbers = self.numbers()
            base = self.manifest()
            if numbers and base["number"] < numbers[-1] and waited < self.patience:
                time.sleep(0.5)
                waited += 0.5
                continue
            number = max([base["number"], *numbers]) + 1
            new = {"number": number, "schema": schema.jsonValue(), "files": change(base)}
            system, path = self._path("manifests", f"v{number:09d}.json")
            try:
                out = system.create(path, False)
            except Py4JJavaError as e:
                if "AlreadyExists" not in str(e.java_exception):
                    raise
                continue
            out.write(bytearray(json.dumps(new).encode()))
            out.close()
            return new
        raise RuntimeError("too many writers")

    # --- writing

    def _bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def _write(self, shots: DataFrame) -> list[dict]:
        """Files of a batch, with what the manifest says of each. A key that many rows share goes to SPREAD tasks by time."""
        batch = posixpath.join(self.folder, "data", uuid.uuid4().hex)
        dealt = shots.withColumn("bucket", self._bucket()).repartition(self.buckets * SPREAD, "bucket", F.pmod(F.floor(F.col("ts") / 86400), F.lit(SPREAD)))
        dealt.sortWithinPartitions("bucket", "key", "ts").write.partitionBy("bucket").parquet(batch)
        found = self.spark.read.schema(StructType(shots.schema.fields)).option("basePath", batch).parquet(batch)
        rows = found.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"), F.min("ts").alias("low"), F.max("ts").alias("high")).collect()
        return [{"path": r["path"], "batch": batch, "bucket": int(r["path"].rsplit("bucket=", 1)[1].split("/")[0]), "rows": r["rows"], "low": r["low"], "high": r["high"]} for r in rows]

    def append(self, shots: DataFrame) -> int:
        """Add snapshots; the store's new version. Rows without key or time are refused."""
        if shots.where("key is null or ts is null").limit(1).count():
            raise ValueError("a snapshot needs a key and a time")
        base = self.manifest()
        if base["schema"] and StructType.fromJson(base["schema"]).simpleString() != shots.schema.simpleString():
            raise ValueError("columns differ from those of the store")
        files = self._write(shots)
        return self._commit(shots.schema, lambda now: now["files"] + files)["number"]

    def compact(self, now: float, keep: int = KEEP_VERSIONS, days: int = KEEP_DAYS) -> int:
        """Rewrite the store with what the retention keeps, one batch sorted anew; older versions of it stay readable.

        What others append meanwhile stays as it is."""
        base = self.manifest()
        if not base["files"]:
            return base["number"]
        held = self.read(base["number"])
        schema = held.schema
        kept = retained(held.withColumn("_tie", F.xxhash64(*held.columns)), F.lit(now), keep, days, tie="_tie").select(*held.columns)
        files, gone = self._write(kept), {f["path"] for f in base["files"]}
        return self._commit(schema, lambda newest: [f for f in newest["files"] if f["path"] not in gone] + files)["number"]

    # --- reading

    def files(self, number: int | None = None, at: float | None = None, since: float | None = None, keys: list[str] | None = None) -> list[dict]:
        """The files that can hold rows of these keys, not after `at` and not before `since`."""
        found = self.manifest(number)["files"]
        if keys is not None:
            own = {r["b"] for r in self.spark.createDataFrame([(k,) for k in keys], "key string").select(self._bucket().alias("b")).collect()} if keys else set()
            found = [f for f in found if f["bucket"] in own]
        return [f for f in found if (at is None or f["low"] <= at + TOLERANCE) and (since is None or f["high"] >= since)]

    def read(self, number: int | None = None, at: float | None = None, since: float | None = None, keys: list[str] | None = None) -> DataFrame:
        """The snapshots of a version of the store, of these keys and times."""
        schema = self.manifest(number)["schema"]
        if schema is None:
            return self.spark.createDataFrame([], "key string, ts double")
        chosen = self.files(number, at, since, keys)
        shape = StructType.fromJson(schema)
        found = self.spark.read.schema(shape).parquet(*[f["path"] for f in chosen]) if chosen else self.spark.createDataFrame([], shape)
        for given, test in ((at, lambda: F.col("ts") <= at + TOLERANCE), (since, lambda: F.col("ts") >= since), (keys, lambda: F.col("key").isin(keys))):
            found = found.where(test()) if given is not None else found
        return found

    def as_of(self, at: float, keys: list[str] | None = None, number: int | None = None) -> DataFrame:
        """The newest snapshot of each key not after a time."""
        found = self.read(number, at=at, keys=keys)
        own = [c for c in found.columns]
        return versions(found.withColumn("_tie", F.xxhash64(*own)), tie="_tie").where("version = 1").select(*own)

    def listed(self, keys: list[str] | None = None, number: int | None = None) -> DataFrame:
        """All snapshots with version: 1 for the newest of a key, and so on."""
        found = self.read(number, keys=keys)
        return versions(found.withColumn("_tie", F.xxhash64(*found.columns)), tie="_tie").drop("_tie")
