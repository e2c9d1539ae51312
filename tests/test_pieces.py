"""Python sees rows in pieces of bounded size, however large Spark's batches are."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.html.elements import elements
from corpusloom.operators.chunks import chunk_documents
from corpusloom.operators.snapshots import line_diff
from corpusloom.operators.vectors import hash_embedding
from corpusloom.shipping import PIECE, pieces

TEXT = "".join(f"<p>some words of line {i}\n" for i in range(600))
LARGE = pa.array([TEXT] * 240, pa.string())
LINES = pa.array([TEXT.split("\n")] * 240, pa.list_(pa.string()))
URLS = pa.array(["https://h.org/"] * 240, pa.string())
KEYS = pa.array(range(240), pa.int64())


def test_pieces_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([KEYS, LARGE, LINES], names=["k", "t", "l"])
    found = list(pieces([batch, batch.slice(0, 0), batch.slice(7, 1)]))
    assert pa.Table.from_batches(found) == pa.Table.from_batches([batch, batch.slice(7, 1)])
    assert len(found) > 5 and all(x.nbytes <= PIECE for x in found)
    assert [x.num_rows for x in pieces([batch], 1)] == [1] * 240


CASES = {
    "document_chunks": (lambda docs: chunk_documents(docs, "text", 1200, 200, "k"), [KEYS, LARGE]),
    "version_diffs": (lambda docs: line_diff(docs.withColumn("old", F.col("text")), "old", "text", "k"), [KEYS, LINES, LINES]),
    "hash_vectors": (lambda docs: hash_embedding(docs, "text"), [KEYS, LARGE, LINES]),
    "page_counts": (lambda docs: elements(docs, "k", url="text", html="text"), [KEYS, URLS, LARGE, KEYS]),
}


@pytest.mark.parametrize("name", CASES)
def test_operators_return_pieces(spark, monkeypatch, name):
    docs = spark.createDataFrame([(1, "<p>a")], "k long, text string")
    ran, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *given, **more: ran.append(run) or plain(self, run, *given, **more))
    operator, columns = CASES[name]
    assert operator(docs).count() > 0
    batch = pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])
    found = list(ran[0](iter([batch])))
    assert sum(x.num_rows for x in found) >= 240 and len(found) > 3
    assert max(x.num_rows for x in found) <= (8_000 if name == "page_counts" else 80)


def test_differences_keep_only_the_keys_asked_for(spark):
    pairs = spark.createDataFrame([(1, "a\nb", "a", "x")], "k int, now string, was string, other string")
    assert line_diff(pairs, "was", "now", "k").columns == ["k", "diff"]
    assert line_diff(pairs, "was", "now").columns == ["k", "now", "was", "other", "diff"]
    assert line_diff(pairs, "was", "now", "k").first()["diff"]["added_lines"] == 1
