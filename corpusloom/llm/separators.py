"""Token counts by a scan for separators in flat token files.

A flat file is nothing but token ids, each document followed by the end id: no index, no lengths. Files are cut in
blocks of equal bytes. A task searches a block at once for the end id. Documents that cross blocks are stitched by a
prefix scan over block summaries: ends before the block, and where the last end before it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.llm import files
from corpusloom.llm.base import durable, partitions, prepare, shared_dir
from corpusloom.llm.tokens import encoder

BLOCK_TOKENS = 1 << 21


def write_flat(docs: DataFrame, path: str, end_id: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Encode docs to one flat file of 16-bit ids per task: files (file, path, n_tokens) and order (file, ordinal, doc_id).

    Strings of special tokens in a text are ordinary text, so that no document holds the end id."""
    spark = docs.sparkSession
    prepare(spark)
    folder = files.fresh(shared_dir(spark), "flat")
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sink, uri, written, ordinal = TaskContext.get().partitionId(), None, files.attempt(folder, TaskContext.get().partitionId(), "bin"), 0, 0

        def rows(name: str | None, ordinals, ids, n: int | None) -> pa.RecordBatch:
            count = len(ids)
            return pa.RecordBatch.from_arrays([pa.array([task] * count, pa.int32()), pa.array([name] * count, pa.string()), pa.array(ordinals, pa.int64()), pa.array(ids, pa.int64()), pa.array([n] * count, pa.int64())], names=["file", "path", "ordinal", "doc_id", "n_tokens"])

        for batch in batches:
            if batch.num_rows and sink is None:
                system, where = files.at(uri)
                sink = system.open_output_stream(where)
            for ids in encoder(path, plain=True).encode_each(batch.column(1)):
                sink.write(ids + end)
                written += len(ids) // 2 + 1
            yield rows(None, range(ordinal, ordinal + batch.num_rows), batch.column(0).to_pylist(), None)
            ordinal += batch.num_rows
        if sink:
            sink.close()
            yield rows(uri, [None], [None], written)

    slim = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("_t"))
    found = durable(slim.mapInArrow(run, "file int, path string, ordinal long, doc_id long, n_tokens long"))
    return found.where("path is not null").select("file", "path", "n_tokens"), found.where("path is null").select("file", "ordinal", "doc_id")


def scan_flat(listed: DataFrame, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) of every document in flat files listed as (file, path, n_tokens).

    n_tokens counts the end id. Ids after a file's last end id are one more document with ended false; a file without
    ids has no documents; a document may be the end id alone."""
    spark = listed.sparkSession
    last = F.ceil(F.col("n_tokens") / F.lit(float(block_tokens))).cast("long") - 1
    blocks = listed.where("n_tokens > 0").select("file", "path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), F.col("n_tokens").alias("total"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block a summary (nth -1: its number of ends, its last end), then its ends."""
        for batch in batches:
            for row in batch.to_pylist():
                system, where = files.at(row["path"])
                begin = row["block"] * block_tokens
                with system.open_input_file(where) as source:
                    ids = np.frombuffer(source.read_at(2 * min(block_tokens, row["total"] - begin), 2 * begin), "<u2")
                ends = np.flatnonzero(ids == end_id) + begin + 1
                n = len(ends)
                nth = np.arange(-1, n)
                end = np.concatenate([[ends[-1] if n else -1], ends])
                previous = np.concatenate([[n, -1], ends[:-1]])[: n + 1]  # -1: in a block before
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, row["file"], np.int32)), pa.array(np.full(n + 1, row["block"])), pa.array(nth), pa.array(end), pa.array(previous)], names=["file", "block", "nth", "end", "previous"])

    spread = blocks.repartition(2 * partitions(spark), "file", "block")
    found = durable(spread.mapInArrow(run, "file int, block long, nth long, end long, previous long"))
    prior = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("end") >= 0, F.col("end"))
    stitched = found.where("nth = -1").select("file", "block", F.coalesce(F.sum("previous").over(prior), F.lit(0)).alias("_ends"), F.coalesce(F.last(known, ignorenulls=True).over(prior), F.lit(0)).alias("_from"))
    ends = found.where("nth >= 0").join(stitched, ["file", "block"])
    start = F.when(F.col("previous") >= 0, F.col("previous")).otherwise(F.col("_from"))
    whole = ends.select("file", (F.col("_ends") + F.col("nth")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    totals = found.where("nth = -1").groupBy("file").agg(F.sum("previous").alias("ordinal"), F.greatest(F.max("end"), F.lit(0)).alias("start"))
    rest = listed.join(totals, "file").where("n_tokens > start").select("file", "ordinal", "start", (F.col("n_tokens") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(rest)


def token_counts(docs: DataFrame, path: str, end_id: int = 50256, text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens) for every row of docs: encoded to flat files, then counted from these.

    end_id must be an id that no text encodes to. n_tokens includes the end id. Null and empty texts have the end id
    alone; rows with null or repeated doc_id are documents of their own; an empty table gives an empty result."""
    listed, order = write_flat(docs, path, end_id, text)
    return order.join(scan_flat(listed, end_id, block_tokens), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
