"""Exact ranked lexical search by inner products over sparse ball trees.

A document's score for an item is the inner product of two vectors of whole numbers: the item's holds how often each
term is in it times the term's weight, the document's holds the saturated counts of its terms. Coordinates outside the
items' own terms add nothing, so documents are projected on these. Each task builds ball trees over blocks of its
documents: a node is a sparse centroid c, a radius r about it and a radius for each of its terms (how far the term's values
reach beyond the centroid's), so that no score below it exceeds `q . c + min(|q| r, q . reach)`. The radius alone prunes
little among long texts of many terms, which all lie far from their centroid; those by term are sums of one-term balls.
Bounds are rounded outwards by more than what their floating-point sums can be off. Nodes are visited in the order of that bound until
it falls below the k-th best score so far, which goes on from tree to tree within a task; leaves are scored in integers.
Each task returns k rows an item at most, and these are ranked over the cluster.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from corpusloom.llm.base import prepare, written
from corpusloom.llm.textkit import _FIRST_BYTES, Words

NONE = np.zeros(256, bool)
APART = NONE.copy()  # bytes that stand in no term: ASCII but for digits and letters
APART[[b for b in range(128) if not chr(b).isalnum()]] = True
BLOCK_POINTS = 8192  # documents under one tree
BLOCK_ENTRIES = 2_000_000  # and their terms
LEAF = 32
UNIT = 2.0**-52  # of double rounding


class Vocabulary:
    """Terms by number; texts to how often they hold each of them. A term is told by its bytes: its hash only finds it."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        own = Words(pa.array(terms, pa.large_string()), separators=NONE)
        self.data, self.starts, self.size = np.concatenate([own.data, np.zeros(8, np.uint8)]), own.starts, own.ends - own.starts
        hashes = own.hashes()
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.exact = {t.encode(): i for i, t in enumerate(terms)}

    def find(self, words: Words) -> np.ndarray:
        """The number of each word's term, -1 for words that are none."""
        hashes = words.hashes()
        if not len(hashes) or not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.where(self.hashes[at] == hashes, self.order[at], -1)
        mine = np.flatnonzero(found >= 0)
        term, starts = found[mine], words.starts[mine]
        size = words.ends[mine] - starts
        same = size == self.size[term]
        here, there = (np.ndarray((len(d) - 7,), "<u8", d, strides=(1,)) for d in (np.concatenate([words.data, np.zeros(8, np.uint8)]), self.data))
        for k in range(0, int(size.max(initial=0)), 8):  # eight bytes at a time
            on = np.flatnonzero(same & (size > k))
            mask = _FIRST_BYTES[np.minimum(size[on] - k, 8)]
            same[on] = (here[starts[on] + k] & mask) == (there[self.starts[term[on]] + k] & mask)
        for i in mine[~same].tolist():  # equal hashes of unlike words
            found[i] = self.exact.get(words.data[words.starts[i] : words.ends[i]].tobytes(), -1)
        return found

    def vectors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: how many terms it has, vocabulary or not; then first, term and count of those of the vocabulary."""
        words = Words(texts, lower=True, separators=APART)
        found = self.find(words)
        document = np.repeat(np.arange(len(words.first) - 1), words.counts())
        keep = found >= 0
        keys, many = np.unique(document[keep] * len(self.terms) + found[keep], return_counts=True)
        first = np.searchsorted(keys, np.arange(len(words.first)) * len(self.terms))
        return words.counts(), first, keys % max(len(self.terms), 1), many


class BallTree:
    """Points as rows (first, term, value) of whole numbers; terms are below `width`."""

    def __init__(self, first: np.ndarray, term: np.ndarray, value: np.ndarray, width: int, leaf: int = LEAF):
        self.width = width
        sizes, order, self.nodes = np.diff(first), [], []
        norms = np.add.reduceat(value.astype(float) ** 2, first[:-1]) if len(sizes) else np.zeros(0)
        centre_terms, centre_values, centre_reach, self.radius = [], [], [], []

        def entries(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Positions of the entries of points, and where each point's begin."""
            many = sizes[points]
            ends = np.cumsum(many)
            return np.repeat(first[points] - ends + many, many) + np.arange(ends[-1]), ends - many, many

        def dots(at: np.ndarray, begin: np.ndarray, dense: np.ndarray) -> np.ndarray:
            return np.add.reduceat(dense[term[at]] * value[at], begin)

        stack, dense = [(np.arange(len(sizes)), -1, 0)] if len(sizes) else [], np.zeros(width)
        while stack:
            points, parent, side = stack.pop()
            number = len(self.nodes)
            self.nodes.append([-1, -1, 0, 0])  # children, or the leaf's points
            if parent >= 0:
                self.nodes[parent][side] = number
            at, begin, _ = entries(points)
            total = np.bincount(term[at], weights=value[at], minlength=width)
            used = np.flatnonzero(total)
            centre = total / len(points)
            square = float(centre @ centre)
            off = norms[points] - 2 * dots(at, begin, centre) + square
            slack = 8 * UNIT * (width + len(points) + 64) * (norms[points] + square)
            self.radius.append(math.sqrt(max(float((off + slack).max()), 0.0)) * (1 + 8 * UNIT))
            centre_terms.append(used)
            centre_values.append(centre[used])
            top = np.zeros(width)
            np.maximum.at(top, term[at], value[at])
            centre_reach.append(top[used] - centre[used])
            if len(points) > leaf and off.max() > slack.max():
                far = points[int(off.argmax())]
                dense[:] = 0
                dense[term[first[far] : first[far + 1]]] = value[first[far] : first[far + 1]]
                other = points[int((norms[points] - 2 * dots(at, begin, dense)).argmax())]
                dense[term[first[other] : first[other + 1]]] -= value[first[other] : first[other + 1]]
                along = dots(at, begin, dense)
                half = np.argsort(along, kind="stable")
                stack += [(points[half[: len(half) // 2]], number, 0), (points[half[len(half) // 2 :]], number, 1)]
            else:
                self.nodes[number][2:] = [sum(map(len, order)), sum(map(len, order)) + len(points)]
                order.append(points)
        self.order = np.concatenate([np.zeros(0, np.int64), *order])
        at, begin, many = entries(self.order) if len(sizes) else (np.zeros(0, np.int64),) * 3
        self.first, self.term, self.value = np.append(begin, len(at)), term[at], value[at]
        self.radius = np.array(self.radius)
        self.centre_first = np.cumsum([0, *map(len, centre_terms)])[:-1]
        self.centre_term, self.centre_value, self.centre_reach = (np.concatenate(x) if x else np.zeros(0) for x in (centre_terms, centre_values, centre_reach))

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each node a number that no score below it exceeds."""
        dense = np.zeros(self.width)
        dense[terms] = weights
        own = dense[self.centre_term]
        near = np.add.reduceat(own * self.centre_value, self.centre_first)
        reach = np.add.reduceat(own * self.centre_reach, self.centre_first)
        around = math.sqrt(float(np.square(weights.astype(float)).sum())) * self.radius
        return (near + np.minimum(around, reach)) * (1 + 8 * UNIT * (self.width + 64))

    def search(self, terms: np.ndarray, weights: np.ndarray, take, limit) -> int:
        """Scores points best node first. take(points, scores) is told of a leaf; limit() is the least score of use.
        Returns how many points were scored."""
        if not len(self.nodes):
            return 0
        bound = self.bounds(terms, weights)
        dense = np.zeros(self.width, np.int64)
        dense[terms] = weights
        heap, seen = [(-bound[0], 0)], 0
        while heap and -heap[0][0] >= limit():
            left, right, a, b = self.nodes[heapq.heappop(heap)[1]]
            if left >= 0:
                for child in (left, right):
                    heapq.heappush(heap, (-bound[child], child))
                continue
            lo, hi = self.first[a], self.first[b]
            take(self.order[a:b], np.add.reduceat(dense[self.term[lo:hi]] * self.value[lo:hi], self.first[a:b] - lo))
            seen += b - a
        return seen


class Items:
    """Parsed items: how often each has each term of their vocabulary."""

    def __init__(self, rows: list[tuple[int, object, str | None]]):
        self.ids = [(number, item) for number, item, _ in rows]
        words = Words(pa.array([t for _, _, t in rows], pa.large_string()), lower=True, separators=APART)
        spelled = [words.data[a:b].tobytes().decode() for a, b in zip(words.starts.tolist(), words.ends.tolist())]
        self.terms = sorted(set(spelled))
        self.vocabulary = Vocabulary(self.terms)
        _, self.first, self.term, self.count = self.vocabulary.vectors(pa.array([t for _, _, t in rows], pa.large_string()))

    def weighted(self, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        values = self.count * weights[self.term]
        return [(self.term[a:b], values[a:b]) for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist())]


def in_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[int, object, str | None]]]:
    """(number, item_id, text) of all rows, in blocks of bounded bytes."""
    block, size = [], 0
    for number, row in enumerate(items.select(items[item_id].alias("i"), items[text].alias("t")).toLocalIterator()):
        if block and size + len(row["t"] or "") > block_bytes:
            yield block
            block, size = [], 0
        block.append((number, row["i"], row["t"]))
        size += len(row["t"] or "") + 64
    if block:
        yield block


def weights_of(n_documents: int, holding: dict[int, int], n_terms: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * holding.get(i, 0) + 1))) for i in range(n_terms)], np.int64)


def saturated(n: np.ndarray, count: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    """The value of a term that is `count` times in a document of `n` terms."""
    return (1_000_000_000 * count) // (1000 * count + 8 * (25 + (75 * n * n_documents) // n_terms))


def _searcher(shared, n_documents: int, n_terms: int, k: int, block_points: int, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        queries = items.weighted(weights)
        best: list[list[tuple[int, bool, int]]] = [[] for _ in queries]

        def search(ids: list[list[tuple[bool, int]]], n: list[int], terms: list[np.ndarray], counts: list[np.ndarray]) -> None:
            first = np.cumsum([0, *map(len, terms)])
            term, count = np.concatenate(terms).astype(np.int64), np.concatenate(counts).astype(np.int64)
            own, term = np.unique(term, return_inverse=True)  # of the vocabulary, what this block has
            lengths = np.repeat(np.array(n, np.int64), np.diff(first))
            tree = BallTree(first, term, saturated(lengths, count, n_documents, n_terms), len(own), leaf)
            for (wanted, weight), mine in zip(queries, best):
                at = np.searchsorted(own, wanted)
                here = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == wanted) & (weight > 0)
                if not here.any():
                    continue
                limit = lambda: -mine[-1][0] if len(mine) == k else 1  # noqa: B023, E731

                def take(points: np.ndarray, scores: np.ndarray) -> None:
                    for i in np.flatnonzero(scores >= limit()).tolist():  # noqa: B023
                        for void, doc in ids[points[i]]:
                            if len(mine) == k and (-int(scores[i]), void, doc) >= mine[-1]:  # noqa: B023
                                break
                            insort(mine, (-int(scores[i]), void, doc))  # noqa: B023
                            del mine[k:]  # noqa: B023

                tree.search(at[here], weight[here], take, limit)

        # equal vectors are one point, with the k least ids of its documents: more can't be among the k best
        points: dict[tuple[int, bytes, bytes], int] = {}
        ids, n, terms, counts, entries = [], [], [], [], 0
        for batch in batches:
            flat = [(np.asarray(c.offsets), np.asarray(c.flatten())) for c in (batch.column(2), batch.column(3))]
            base = [o[0] for o, _ in flat]
            for row, (doc, length) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                term, count = (v[o[row] - b : o[row + 1] - b] for (o, v), b in zip(flat, base))
                key = (length, term.tobytes(), count.tobytes())
                at = points.setdefault(key, len(ids))
                name = (doc is None, doc or 0)
                if at < len(ids):
                    if len(ids[at]) < k or name < ids[at][-1]:
                        insort(ids[at], name)
                        del ids[at][k:]
                    continue
                ids.append([name])
                n.append(length)
                terms.append(term)
                counts.append(count)
                entries += len(term)
                if len(ids) >= block_points or entries >= BLOCK_ENTRIES:
                    search(ids, n, terms, counts)
                    points, entries = {}, 0
                    ids, n, terms, counts = [], [], [], []
        if ids:
            search(ids, n, terms, counts)
        rows = [(at, None if void else doc, -score) for at, mine in enumerate(best) for score, void, doc in mine]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["at", "doc_id", "score"])

    return run


def _vectors(docs: DataFrame, text: str, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary
        for batch in batches:
            n, first, term, count = vocabulary.vectors(batch.column(1))
            lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, pa.int32())) for x in (term, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].alias("_t"))
    return slim.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20, block_points: int = BLOCK_POINTS, leaf: int = LEAF) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of docs with the highest score above zero for each row of items.

    Terms are stretches of digits, letters and everything beyond ASCII, with A-Z lower-cased. Equal scores are ranked by
    ascending doc_id, null ids last. Null texts have no terms, so such items have no rows and such documents are in none; rows
    that repeat an item or a document count each for itself; other columns are ignored; empty tables give no rows.

    Items go to the tasks in blocks of `block_bytes` of text, one pass over the documents a block; what is broadcast and
    the vocabulary whose counts come to the driver are bounded by it."""
    spark = docs.sparkSession
    prepare(spark)
    kind = items.select(items[item_id]).schema[0].dataType
    every = spark.createDataFrame([], T.StructType([T.StructField("item_id", kind)])).selectExpr("item_id", "0 rank", "0L doc_id", "0L score")
    for rows in in_blocks(items, item_id, item_text, block_bytes):
        every = every.union(_block(spark, docs, rows, kind, k, text, block_points, leaf))
    return every


def _block(spark: SparkSession, docs: DataFrame, rows: list[tuple[int, object, str | None]], kind: T.DataType, k: int, text: str, block_points: int, leaf: int) -> DataFrame:
    items = Items(rows)
    vectors = written(_vectors(docs, text, spark.sparkContext.broadcast(items)))
    totals = vectors.where("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
    holding = {r["term"]: r["n"] for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    weights = weights_of(totals["n"], holding, len(items.terms))
    shared = spark.sparkContext.broadcast((items, weights))
    some = vectors.where(F.size("terms") > 0)
    best = some.mapInArrow(_searcher(shared, totals["n"], totals["terms"] or 1, k, block_points, leaf), "at long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # k rows an item and task: ranked in parts first, so that no window grows with the number of tasks
    best = best.withColumn("_part", F.spark_partition_id() % 64)
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy("at", "_part").orderBy(*order))).where(F.col("_r") <= k)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(at, item) for at, (_, item) in enumerate(items.ids)], T.StructType([T.StructField("at", T.LongType()), T.StructField("item_id", kind)]))
    return ranked.join(F.broadcast(names), "at").select("item_id", "rank", "doc_id", "score")

