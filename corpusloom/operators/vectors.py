"""Vectors of texts and nearest neighbours by cosine likeness."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.text import terms
from corpusloom.session import shared_folder
from corpusloom.shipping import pieces, ship

DIMENSIONS = 256
QUERIES = 5_000  # of a task
ROWS = 200_000  # vectors of a task
BATCH = 10_000  # of these at once
SCORED = 4_000_000  # likenesses of a task at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def _best(k: int, query: np.ndarray, key: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, best first, ties to the lesser key."""
    order = np.lexsort((key, -score, query))
    query, key, score = query[order], key[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[place < k], key[place < k], score[place < k]


def _unit(rows: pa.Array) -> np.ndarray:
    found = np.stack([np.asarray(x, np.float64) for x in rows.to_numpy(zero_copy_only=False)])
    size = np.linalg.norm(found, axis=1, keepdims=True)
    return np.divide(found, size, out=np.zeros_like(found), where=size > 0)


def blocks(queries: DataFrame, size: int) -> tuple[DataFrame, int]:
    """queries with part, the block of about `size` rows that each is in, and how many blocks there are."""
    many = max(1, math.ceil(queries.count() / size))
    return queries.withColumn("part", F.pmod(F.xxhash64("_q"), F.lit(many)).cast("int")), many


def asked(queries: DataFrame, key: str, vector: str) -> DataFrame:
    """Queries (query_id, q) with a number each, written to the shared folder so that it stays."""
    path = shared_folder(queries.sparkSession, "asked")
    rows = queries.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    rows.select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("q")).withColumn("_q", F.monotonically_increasing_id()).write.parquet(path)
    return queries.sparkSession.read.parquet(path)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = QUERIES, rows: int = ROWS) -> DataFrame:
    """(query_id, key, score, rank): the k vectors most like each query, ties to the lesser key. Null keys and vectors
    are left out.

    Exact. Both sides are dealt out in blocks, of `rows` vectors and of `block` queries, and each two blocks meet in a task:
    it scores batches by matrix products and returns k rows a query. Nothing goes through the driver."""
    spark = vectors.sparkSession
    ship(spark)
    known = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
    pieces = max(spark.sparkContext.defaultParallelism, math.ceil(known.count() / rows))
    numbered, many = blocks(asked(queries, key, vector), block)
    side = known.select("key", "v", F.pmod(F.xxhash64("key", "v"), F.lit(pieces)).cast("int").alias("piece"), F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("part"))
    sent = numbered.select("_q", "q", "part", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"))

    def run(found: pa.Table, wanted: pa.Table) -> pa.Table:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if found.num_rows and wanted.num_rows:
            ids, unit = np.asarray(wanted.column("_q")), _unit(wanted.column("q").combine_chunks())
            for start in range(0, found.num_rows, BATCH):
                batch = found.slice(start, BATCH)
                keys, own = np.asarray(batch.column("key")), _unit(batch.column("v").combine_chunks())
                step, parts = SCORED // len(keys) + 1, [held]
                for a in range(0, len(ids), step):
                    score = np.round(unit[a : a + step] @ own.T, 9)
                    least = np.partition(score, -k, axis=1)[:, -k, None] if len(keys) > k else -np.inf
                    query, at = np.nonzero(score >= least)
                    parts.append((query + a, keys[at], score[query, at]))
                held = _best(k, *(np.concatenate(x) for x in zip(*parts)))
            held = (ids[held[0]], *held[1:])
        return pa.table({"_q": pa.array(held[0], pa.int64()), "key": pa.array(held[1], pa.int64()), "score": pa.array(held[2], pa.float64())})

    best = side.groupBy("piece", "part").cogroup(sent.groupBy("piece", "part")).applyInArrow(run, "_q long, key long, score double")
    return ranked(best, numbered, k, key)


def ranked(found: DataFrame, numbered: DataFrame, k: int, key: str) -> DataFrame:
    """The k best of (_q, key, score) by query, under the names that are returned."""
    order = Window.partitionBy("_q").orderBy(F.desc("score"), "key")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(numbered.select("_q", "query_id"), "_q").select("query_id", F.col("key").alias(key), "score", "rank")


def hash_embedding(frame: DataFrame, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """frame with vector: terms counted in signed hashed buckets, of length 1; without terms all zero."""
    ship(frame.sparkSession)
    rows = frame.withColumn("_t", terms(F.col(text)))
    at = rows.columns.index("_t")

    def embed(words: list[str]) -> np.ndarray:
        out = np.zeros(dimensions)
        for word in words:
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            out[h % dimensions] += 1.0 if h >> 63 else -1.0
        size = np.linalg.norm(out)
        return (out / size if size else out).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [embed(w or []) for w in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(found, pa.list_(pa.float32()))], names=[*batch.schema.names[:at], "vector"])

    names = ", ".join(f"`{n}` {t}" for n, t in frame.dtypes)
    return rows.mapInArrow(run, f"{names}, vector array<float>")
