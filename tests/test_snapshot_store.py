"""The store of snapshots: commits, reads by time and version, pruning, retention, writers at once."""

import pytest
from pyspark.sql import functions as F

from corpusloom.sources.snapshots import SnapshotStore

SCHEMA = "key string, ts double, text string"
DAY = 86400.0


@pytest.fixture()
def store(spark, tmp_path):
    found = SnapshotStore(spark, f"file://{tmp_path}/store", buckets=4, patience=0.5)
    for day in (10, 12, 11):  # out of order
        found.append(spark.createDataFrame([(f"k{i}", day * DAY + i, f"{day}/{i}") for i in range(20)], SCHEMA))
    return found


def held(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_reads_by_time_prune_files(store):
    assert store.numbers() == [1, 2, 3]
    assert held(store.as_of(11.5 * DAY)) == sorted((f"k{i}", 11 * DAY + i, f"11/{i}") for i in range(20))
    assert store.as_of(9 * DAY).count() == 0 and store.files(at=9 * DAY) == []
    assert held(store.as_of(12 * DAY + 3 - 1e-5, ["k3"])) == [("k3", 12 * DAY + 3, "12/3")]
    every, early, one = store.files(), store.files(at=10.5 * DAY), store.files(keys=["k1"])
    assert len(early) * 3 == len(every) and len({f["bucket"] for f in one}) == 1 and len(one) == 3
    read = {p.rsplit("/", 1)[-1] for p in store.read(at=10.5 * DAY).inputFiles()}
    assert read == {f["path"].rsplit("/", 1)[-1] for f in early}  # what the plan scans
    assert store.files(since=12 * DAY) and all(f["high"] >= 12 * DAY for f in store.files(since=12 * DAY))
    assert sum(f["rows"] for f in every) == store.read().count() == 60


def test_versions_of_keys_and_of_the_store(store):
    assert [(r["version"], r["text"]) for r in store.listed(["k5"]).orderBy("version").collect()] == [(1, "12/5"), (2, "11/5"), (3, "10/5")]
    assert store.read(1).count() == 20 and store.read(2).count() == 40
    with pytest.raises(ValueError):
        store.append(store.read().withColumn("more", F.lit(1)))
    with pytest.raises(ValueError):
        store.append(store.spark.createDataFrame([(None, 1.0, "x")], SCHEMA))
    assert store.numbers() == [1, 2, 3]


def test_retention_rewrites_but_old_versions_stay(store):
    assert store.compact(13 * DAY, keep=2, days=0) == 4
    assert sorted({r["text"].split("/")[0] for r in store.read().collect()}) == ["11", "12"] and store.read().count() == 40
    assert store.read(3).count() == 60
    store.compact(13 * DAY, keep=20, days=1)
    assert {r["text"].split("/")[0] for r in store.read().collect()} == {"12"}
    assert store.compact(1000 * DAY, days=1) and store.read().count() == 0 and store.as_of(2000 * DAY).count() == 0


def test_writers_at_once_lose_nothing(store, spark):
    slow = store._write(spark.createDataFrame([("late", 13 * DAY, "x")], SCHEMA))
    tries = []

    def change(now):
        if not tries:  # another writer commits between this one's reading and writing
            SnapshotStore(spark, store.folder, buckets=4).append(spark.createDataFrame([("soon", 13 * DAY, "y")], SCHEMA))
        tries.append(now["number"])
        return now["files"] + slow

    assert store._commit(store.read().schema, change)["number"] == 5 and tries == [3, 4]
    assert {r["key"] for r in store.read(since=13 * DAY).collect()} == {"late", "soon"} and store.read().count() == 62


def test_a_torn_manifest_is_not_there_yet(store, tmp_path):
    (tmp_path / "store/manifests/v000000004.json").write_text('{"number": 4, "fi')
    assert store.manifest()["number"] == 3 and store.read().count() == 60
    store.append(store.spark.createDataFrame([("k0", 99 * DAY, "new")], SCHEMA))
    assert store.manifest()["number"] == 5 and store.read().count() == 61


def test_an_empty_store(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/none")
    assert store.read().count() == store.as_of(1.0).count() == store.compact(1.0) == 0
    assert store.append(spark.createDataFrame([], SCHEMA)) == 1 and store.read().columns == ["key", "ts", "text"]


def test_rows_of_one_key_and_time_are_versions(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/same")
    store.append(spark.createDataFrame([("k", 1.0, "a"), ("k", 1.0, "b"), ("k", 1.0, "a")], SCHEMA))
    assert sorted(r["version"] for r in store.listed().collect()) == [1, 2, 3] and store.as_of(1.0).count() == 1
