"""Changes sent from a stream: once each, through failures of the receiver and of the stream."""

import glob
import os

import pytest
from pyspark.errors import StreamingQueryException

from corpusloom.streaming.outbox import Outbox
from corpusloom.streaming.watch import detect_changes

KIND = "key string, ts double, hash string"


def receiver(folder, broken=""):
    def send(rows):
        if broken and os.path.exists(broken):
            raise ConnectionError("closed")
        for row in rows:
            with open(os.path.join(folder, row["id"]), "a") as out:
                out.write("x")

    return send


def sent(folder):
    return [open(p).read() for p in glob.glob(f"{folder}/*")]


def test_stream_broken_off_in_mid_batch_sends_each_change_once(spark, tmp_path):
    source, got = tmp_path / "in", tmp_path / "got"
    got.mkdir()
    box = Outbox(str(tmp_path / "box"), receiver(str(got)), at_once=2)

    def run(take):
        changes = detect_changes(spark.readStream.schema(KIND).parquet(str(source))).where("changed or first_seen")
        query = changes.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(60)

    def lost(frame, batch):
        box.take(frame, batch)
        raise RuntimeError("lost after sending, before the stream knows")

    spark.createDataFrame([("a", 1.0, "x"), ("a", 2.0, "y"), ("b", 1.0, "x"), ("b", 2.0, "x")], KIND).write.parquet(str(source))
    with pytest.raises(StreamingQueryException):
        run(lost)
    assert sent(got) == ["x"] * 3
    run(box.take)
    assert sent(got) == ["x"] * 3
    spark.createDataFrame([("a", 3.0, "z"), ("c", 1.0, "q")], KIND).write.mode("append").parquet(str(source))
    run(box.take)
    assert sent(got) == ["x"] * 5 and box.pending(spark).count() == 0
    assert not glob.glob(str(tmp_path / "box/open/origin*"))


def test_failures_are_tried_again_and_given_up(spark, tmp_path):
    got, broken = tmp_path / "got", tmp_path / "broken"
    got.mkdir(), broken.write_text("")
    box = Outbox(str(tmp_path / "box"), receiver(str(got), str(broken)), tries=3)
    rows = spark.createDataFrame([("a", 1.0, "x"), ("a", 1.0, "x"), (None, None, None), ("", None, "-")], KIND)
    box.take(rows, 0)
    assert sent(got) == [] and [r["tried"] for r in box.pending(spark).collect()] == [1] * 3
    broken.unlink()
    box.take(rows.limit(0), 1)
    assert sent(got) == ["x"] * 3 and {r["error"] for r in box.attempts(spark).where("not ok").collect()} == {"ConnectionError: closed"}
    broken.write_text("")
    box.take(rows.where("key = 'a'"), 2)
    for _ in range(3):
        box.flush(spark)
    assert box.attempts(spark).where("origin = 2").count() == 3 and box.pending(spark).count() == 0
    box.take(rows.where("key = 'a'"), 0)  # done long ago
    assert sent(got) == ["x"] * 3
