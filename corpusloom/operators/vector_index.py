"""An index of vectors for nearest neighbours by cosine likeness: inverted lists of product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample; every vector is indexed. It goes to the list of its nearest
centroid, and what is left of it is coded by `parts` bytes, one for each stretch of its coordinates. A query looks into the lists of
its nearest centroids, adds up tables of its products with the codebooks, and the best of that are scored exactly. How
many lists are looked into is measured on the sample: vectors without clusters need many of them, at any size.
"""

from __future__ import annotations

import math
import pickle
import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusloom.operators.vectors import QUERIES, _unit, asked, blocks, cosine, ranked
from corpusloom.session import shared_folder
from corpusloom.shipping import ship

SAMPLE = 50_000  # rows that the index is fitted on
LISTS, PARTS, CODES, ROUNDS = 4096, 16, 256, 12
SHORT = 20  # exact scores a place of an answer
ASKED, NEIGHBOURS, FOUND = 256, 10, 0.96  # by how many sampled queries, and which share of their neighbours, probes are chosen
ROWS = 200_000  # vectors of a task: longer lists are split


def _means(points: np.ndarray, many: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by Lloyd's rounds, from points drawn at random; an empty one moves to the point farthest from its own."""
    centres = points[np.random.default_rng(seed).permutation(len(points))[:many]].copy()
    for _ in range(rounds):
        near, off = _assigned(points, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        sizes = np.bincount(near, minlength=len(centres))
        filled = sizes > 0
        centres[filled] = total[filled] / sizes[filled, None]
        far = np.argsort(-off, kind="stable")[: (~filled).sum()]
        centres[np.flatnonzero(~filled)[: len(far)]] = points[far]
    return centres


def _assigned(points: np.ndarray, centres: np.ndarray, batch: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Of each point: its nearest centre, and the square of the distance less that of its own length."""
    near, off, square = np.zeros(len(points), np.int64), np.zeros(len(points)), (centres**2).sum(axis=1)
    for a in range(0, len(points), batch):
        apart = square - 2 * points[a : a + batch] @ centres.T
        near[a : a + batch] = apart.argmin(axis=1)
        off[a : a + batch] = apart.min(axis=1) + (points[a : a + batch] ** 2).sum(axis=1)
    return near, off


class Model:
    """Centroids and codebooks: what a task needs to code vectors and to score codes. Its size is bounded by LISTS and CODES."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, seed: int):
        self.centroids = _means(sample, lists, seed)
        self.edges = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
        left = sample - self.centroids[_assigned(sample, self.centroids)[0]]
        self.books = [_means(left[:, a:b], CODES, seed + 1) for a, b in zip(self.edges, self.edges[1:])]
        self.probes = self._enough(sample, seed)

    def _enough(self, sample: np.ndarray, seed: int) -> int:
        """How many lists hold FOUND of the neighbours that sampled queries have in the sample. Those in all rows are nearer,
        and so in nearer lists."""
        chosen = np.random.default_rng(seed).permutation(len(sample))[:ASKED]
        score = sample[chosen] @ sample.T
        score[np.arange(len(chosen)), chosen] = -np.inf
        near = np.argsort(-score, axis=1, kind="stable")[:, : min(NEIGHBOURS, len(sample) - 1)]
        cell = _assigned(sample, self.centroids)[0][near]
        order = self.probed(sample[chosen], len(self.centroids))
        place = np.argsort(order, axis=1)[np.arange(len(chosen))[:, None], cell]
        return int(np.quantile(place, FOUND, method="higher")) + 1 if place.size else 1

    def code(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _assigned(unit, self.centroids)[0]
        left = unit - self.centroids[cell]
        codes = [_assigned(left[:, a:b], book)[0] for (a, b), book in zip(zip(self.edges, self.edges[1:]), self.books)]
        return cell, np.stack(codes, axis=1).astype(np.uint8)

    def probed(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists of each query."""
        apart = (self.centroids**2).sum(axis=1) - 2 * unit @ self.centroids.T
        return np.argsort(apart, axis=1, kind="stable")[:, :probes]

    def likeness(self, unit: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """About the product of one query with each coded vector of a list."""
        total = np.full(len(codes), unit @ self.centroids[cell])
        for j, book in enumerate(self.books):
            total += (book @ unit[self.edges[j] : self.edges[j + 1]])[codes[:, j]]
        return total


class VectorIndex:
    """The index in a folder that all executors share; `build` writes it, later sessions open it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.rows, self.sizes = (spark.read.parquet(posixpath.join(folder, name)) for name in ("rows", "sizes"))
        held = spark.read.parquet(posixpath.join(folder, "model")).first()
        self.model = pickle.loads(held[0]) if held else None

    @staticmethod
    def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", folder: str | None = None, lists: int | None = None, parts: int = PARTS, sample_rows: int = SAMPLE, seed: int = 7, rows: int = ROWS) -> VectorIndex:
        """Index all rows of vectors, which have one length; null keys and vectors are left out, rows equal in both count
        once. `sample_rows` rows, those of least hash, fit the model on the driver; all others are coded in tasks. By default
        there are as many lists as the root of the rows, LISTS at most and one for 30 rows of the sample."""
        spark, folder = vectors.sparkSession, folder or shared_folder(vectors.sparkSession, "vectors")
        ship(spark)
        known = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>").alias("v"), F.xxhash64(vector).alias("h"))
        n = known.count()
        drawn = known.orderBy(F.xxhash64("key", "h"), "key").limit(sample_rows).select("v").toArrow()
        model = None
        if n:
            sample = _unit(drawn.column("v").combine_chunks())
            model = Model(sample, lists or max(1, min(math.isqrt(n), LISTS, len(sample) // 30)), parts, seed)
        saved = [(bytearray(pickle.dumps(model)),)] if n else []
        spark.createDataFrame(saved, "model binary").coalesce(1).write.parquet(posixpath.join(folder, "model"))
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, codes = shared.value.code(_unit(batch.column("v")))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["key", "v", "h", "cell", "codes"])

        coded = known.mapInArrow(run, "key long, v array<float>, h long, cell int, codes binary")
        ordered = coded.repartitionByRange("cell", "key", "h").dropDuplicates(["cell", "key", "h", "v"])
        ordered.sortWithinPartitions("cell", "key").write.parquet(posixpath.join(folder, "rows"))
        written = spark.read.parquet(posixpath.join(folder, "rows"))
        written.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias("pieces")).write.parquet(posixpath.join(folder, "sizes"))
        return VectorIndex(spark, folder)

    def search(self, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", probes: int | None = None, short: int = SHORT, block: int = QUERIES) -> DataFrame:
        """(query_id, key, score, rank) as `vectors.nearest` returns them, of the `probes` lists looked into: by
        default as many as `build` found to hold 0.96 of the neighbours.

        Queries and codes meet in tasks of a list (or a piece of a long one) and `block` queries, which return k * short rows a
        query; of all of them as many are scored exactly. With all lists and no fewer exact scores than rows it is exact."""
        numbered, many = blocks(asked(queries, key, vector), block)
        if self.model is None:
            return ranked(self.spark.createDataFrame([], "_q long, key long, score double"), numbered, k, key)
        ship(self.spark)
        shared, most = self.spark.sparkContext.broadcast(self.model), k * short

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cells = shared.value.probed(_unit(batch.column("q")), probes or shared.value.probes)
                    each = np.repeat(np.arange(batch.num_rows), cells.shape[1])
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(each)).columns, pa.array(cells.ravel(), pa.int32())], names=["_q", "q", "part", "cell"])

        def run(found: pa.Table, wanted: pa.Table) -> pa.Table:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if found.num_rows and wanted.num_rows:
                model, cell = shared.value, found.column("cell")[0].as_py()
                keys, hashes = np.asarray(found.column("key")), np.asarray(found.column("h"))
                codes = np.frombuffer(b"".join(found.column("codes").to_pylist()), np.uint8).reshape(len(keys), -1)
                for q, unit in zip(np.asarray(wanted.column("_q")), _unit(wanted.column("q").combine_chunks())):
                    score = np.round(model.likeness(unit, cell, codes), 9)
                    at = np.flatnonzero(score >= np.partition(score, -most)[-most]) if len(keys) > most else np.arange(len(keys))
                    held = at[np.lexsort((hashes[at], keys[at], -score[at]))][:most]
                    out.append((np.full(len(held), q), keys[held], hashes[held], score[held]))
            columns = [np.concatenate(x) for x in zip(*out)]
            return pa.table(dict(zip(("_q", "key", "h", "near"), columns)) | {"cell": pa.array(np.full(len(columns[0]), found.column("cell")[0].as_py() if found.num_rows else 0), pa.int32())})

        probed = numbered.select("_q", "q", "part").mapInArrow(probe, "_q long, q array<double>, part int, cell int").join(F.broadcast(self.sizes), "cell")  # a row a list
        sent = probed.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
        side = self.rows.select("cell", "key", "h", "codes").join(F.broadcast(self.sizes), "cell").withColumn("piece", F.pmod(F.xxhash64("key", "h"), "pieces").cast("int")).drop("pieces")
        side = side.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
        by = ("cell", "piece", "part")
        near = side.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(run, "_q long, key long, h long, near double, cell int")
        place = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("near"), "key", "h"))
        listed = near.withColumn("_n", place).where(F.col("_n") <= most).drop("_n", "near")
        exact = listed.join(self.rows.select("cell", "key", "h", "v"), ["cell", "key", "h"]).join(numbered.select("_q", "q"), "_q")
        return ranked(exact.select("_q", "key", F.round(cosine(F.col("v"), F.col("q")), 9).alias("score")), numbered, k, key)

