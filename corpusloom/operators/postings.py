"""An inverted index of documents, and the best documents of many queries in one pass of it.

Documents are dealt over shards of about TERMS terms by a hash of key and text, so that a frequent term's postings are
split as the documents are, and are numbered by key within their shard. A term's postings stand in blocks, one for each
window of WINDOW numbers, each with the greatest share that the term gives a score there. A task takes a shard, whose
postings come first, and then the queries as a stream: the sum of the terms' shares bounds the scores of a window, windows
are opened from the greatest bound on, and those below the k-th best score so far are left closed.

Of many queries, each with many frequent terms, the bounds close little. They are scored some hundred at a time instead: what
a term adds to a document is the same for all of them, so the terms that many documents hold are a matrix, by which one of
zeros and ones is multiplied, and lists of the other terms are added to its product. These scores are of single precision;
documents that may be among the best by the greatest error they can have are scored again in doubles.
"""

from __future__ import annotations

import math
import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusloom.functions.text import terms
from corpusloom.operators.excerpts import K1, B
from corpusloom.session import shared_folder
from corpusloom.shipping import ship

TERMS = 8_000_000  # of a shard, repeats included
WINDOW = 64  # documents
ANSWERED = 1_000  # queries whose answers are returned at once
WAVES = 3  # tasks for each core, where shards are fewer
OPENED = 32  # windows at once at first; four times as many each further time
ROUNDED = 1e-6  # more than rounding to six places moves a score
ERROR = 2.0**-22  # more than twice what rounding to single precision moves a sum by, for each of its terms
TOGETHER = 256  # queries scored at once
FEWEST = 8  # of them; fewer are answered one at a time
SCORES = 1 << 21  # held at once, of all queries and documents
DENSE = 1 / 10  # of a shard's documents: terms that more hold are in the matrix
SHORT = 40  # postings: lists of fewer are added for all queries at once
FOUND = "shard int, _q long, row int, score double, hits int"


class Shard:
    """Postings of one shard: by term, blocks of one window each."""

    def __init__(self, postings: pa.Table, average: float):
        self.terms = {t: i for i, t in enumerate(postings.column("term").to_pylist())}
        self.average = average if average > 0 else 1.0
        blocks = postings.column("blocks").combine_chunks()
        self.first = np.asarray(blocks.offsets)
        fields = blocks.values
        self.window, self.most = (np.asarray(fields.field(name)) for name in ("window", "most"))
        held = fields.field("held")
        self.begin = np.asarray(held.offsets)
        self.row, self.tf, self.length = (np.asarray(held.values.field(name)) for name in ("row", "tf", "length"))
        self.windows = int(self.window.max(initial=-1)) + 1
        self.matrix: np.ndarray | None = None

    def prepare(self, weights: np.ndarray) -> None:
        """Make what `answers` needs, of the terms' weights in their order: what each posting adds to a score, the matrix of the
        terms that many documents hold, and each document's terms."""
        bounds = self.begin[self.first]  # of each term's postings
        self.lists, sizes = bounds, np.diff(bounds)
        term = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        added = self.tf * (K1 + 1) / (self.tf + K1 * (1 - B + B * self.length / self.average)) * weights[term]
        self.added, self.at = added.astype(np.float32), self.row.astype(np.intp)
        documents = self.windows * WINDOW
        dense = np.flatnonzero(sizes > DENSE * documents)
        self.column = np.full(len(sizes), -1, np.int32)
        self.column[dense] = np.arange(len(dense))
        self.matrix = np.zeros((len(dense), documents), np.float32)
        for i, t in enumerate(dense.tolist()):
            held = slice(bounds[t], bounds[t + 1])
            self.matrix[i, self.at[held]] = self.added[held]
        by_document = np.argsort(self.row, kind="stable")
        self.held, self.gives = term[by_document], added[by_document]
        self.document = np.concatenate([[0], np.cumsum(np.bincount(self.row, minlength=documents))])
        self.names = np.fromiter(self.terms, np.int64, len(self.terms))
        self.by_name = np.argsort(self.names)
        self.names = self.names[self.by_name]

    def together(self) -> int:
        """How many queries' scores of all documents are held at once."""
        return min(TOGETHER, SCORES // max(1, self.windows * WINDOW))

    def answers(self, ids: np.ndarray, counts: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some queries, whose terms' names follow each other in ids, `counts` of each: query, row, score and hits of the
        best documents of each, ties to the lesser row."""
        n, documents = len(counts), self.windows * WINDOW
        query, at = np.repeat(np.arange(n), counts), np.searchsorted(self.names, ids)
        known = self.names[np.minimum(at, len(self.names) - 1)] == ids
        query, term = query[known], self.by_name[at[known]]
        column, first = self.column[term], self.lists[term]
        size = self.lists[term + 1] - first
        asked = np.zeros((n, len(self.matrix)), np.float32)
        asked[query[column >= 0], column[column >= 0]] = 1
        score = asked @ self.matrix
        short = np.flatnonzero((column < 0) & (size < SHORT))
        if len(short):
            many = size[short]
            posting = np.repeat(first[short] - np.cumsum(many) + many, many) + np.arange(many.sum())
            np.add.at(score.reshape(-1), np.repeat(query[short] * documents, many) + self.at[posting], self.added[posting])
        long = np.flatnonzero((column < 0) & (size >= SHORT))
        for q, a, b in zip(query[long].tolist(), first[long].tolist(), (first + size)[long].tolist()):
            score[q][self.at[a:b]] += self.added[a:b]
        # as many documents as `top` reach the least of so many windows' greatest scores
        windows = score.reshape(n, self.windows, WINDOW)
        most = windows.max(axis=2)
        least = np.partition(most, -top, axis=1)[:, -top] if top < self.windows else np.zeros(n, np.float32)
        least = np.maximum(least * (1 - (counts + 4) * ERROR) - ROUNDED, 0)
        opened, window = np.nonzero((most > 0) & (most >= least[:, None]))
        inside = windows[opened, window]
        i, place = np.nonzero((inside > 0) & (inside >= least[opened][:, None]))
        of, row = opened[i], window[i] * WINDOW + place
        # again, by all that a document's terms give
        ends, own = np.searchsorted(of, np.arange(n + 1)), np.searchsorted(query, np.arange(n + 1))
        found, hits, marked = np.zeros(len(of)), np.zeros(len(of), np.int64), np.zeros(len(self.column), bool)
        for q in np.flatnonzero(np.diff(ends)).tolist():
            mine = term[own[q] : own[q + 1]]
            marked[mine] = True
            for j in range(ends[q], ends[q + 1]):
                a, b = self.document[row[j]], self.document[row[j] + 1]
                given = self.gives[a:b][marked[self.held[a:b]]]
                found[j], hits[j] = given.sum(), len(given)
            marked[mine] = False
        found = np.round(found, 6)
        order = np.lexsort((row, -found, of))
        of, row, found, hits = of[order], row[order], found[order], hits[order]
        keep = (np.arange(len(of)) - ends[of] < top) & (found > 0)
        return of[keep], row[keep], found[keep], hits[keep]

    def best(self, asked: list[tuple[str, float]], top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Rows, scores and hits of the best documents, ties to the lesser row, and how many windows were opened."""
        lists = [(w, np.arange(self.first[i], self.first[i + 1])) for i, w in ((self.terms.get(t), w) for t, w in asked) if i is not None]
        rows, scores, hits = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        if not lists:
            return rows, scores, hits, 0
        block, weight = np.concatenate([b for _, b in lists]), np.repeat([w for w, _ in lists], [len(b) for _, b in lists])
        window = self.window[block]
        bound = np.bincount(window, weight * self.most[block], self.windows)
        order = np.flatnonzero(bound > 0)
        order = order[np.argsort(-bound[order], kind="stable")]
        slot, at, many = np.full(self.windows, -1, np.int64), 0, OPENED
        while at < len(order):
            opened = order[at : at + many]
            if len(scores) == top:  # the rest are no better than these
                opened = opened[bound[opened] >= scores[-1] - ROUNDED]
            if not len(opened):
                break
            slot[opened] = np.arange(len(opened)) * WINDOW
            mine = np.flatnonzero(slot[window] >= 0)
            first = self.begin[block[mine]]
            sizes = self.begin[block[mine] + 1] - first
            posting = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            place = np.repeat(slot[window[mine]], sizes) + self.row[posting] % WINDOW
            tf = self.tf[posting]
            share = np.repeat(weight[mine], sizes) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.length[posting] / self.average))
            hit = np.bincount(place, minlength=len(opened) * WINDOW)
            score = np.bincount(place, share, len(opened) * WINDOW)  # summed in the order of the terms
            slot[opened] = -1
            some = np.flatnonzero(hit)
            rows = np.concatenate([rows, opened[some // WINDOW] * WINDOW + some % WINDOW])
            scores, hits = np.concatenate([scores, np.round(score[some], 6)]), np.concatenate([hits, hit[some]])
            if len(scores) > 4 * top:  # what is below the k-th best goes before the sort
                keep = scores >= np.partition(scores, -top)[-top]
                rows, scores, hits = rows[keep], scores[keep], hits[keep]
            keep = np.lexsort((rows, -scores))[:top]
            rows, scores, hits = rows[keep], scores[keep], hits[keep]
            at, many = at + len(opened), many * 4
        good = scores > 0
        return rows[good], scores[good], hits[good], at


class SearchIndex:
    """The index in a folder that all executors share; `build` writes it, later sessions open it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.documents, self.postings, self.frequencies, self.statistics = (spark.read.parquet(posixpath.join(folder, name)) for name in ("documents", "postings", "frequencies", "statistics"))

    @staticmethod
    def build(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, size: int = TERMS) -> SearchIndex:
        """Index all rows of docs. A row is a document: null and repeated keys, null and empty texts count as any other.

        One pass for the statistics and one shuffle, of terms by shard; the rest happens where the shard is. Rows equal in
        key and text stand in one shard."""
        spark, folder = docs.sparkSession, folder or shared_folder(docs.sparkSession, "index")
        rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), terms(F.col(text)).alias("terms")).withColumn("length", F.size("terms"))
        totals = rows.agg(F.count("*").alias("n"), F.avg("length").alias("average"), F.sum(F.col("length").cast("long")).alias("terms")).first()
        cores, average = spark.sparkContext.defaultParallelism, totals["average"] or 0.0
        shards = max(cores, math.ceil((totals["terms"] or 0) / size))
        tasks = min(4 * shards, max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        spark.range(1).select(F.lit(totals["n"]).alias("n"), F.lit(average).alias("average"), F.lit(shards).alias("shards")).write.parquet(posixpath.join(folder, "statistics"))
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key", "h"), F.lit(shards)).cast("int")).repartition(tasks, "shard")
        numbered = dealt.withColumn("row", F.row_number().over(Window.partitionBy("shard").orderBy("key", "h")) - 1)
        numbered.select("shard", "row", "key").write.parquet(posixpath.join(folder, "documents"))
        tallied = numbered.select("shard", "row", "length", F.explode("terms").alias("term")).groupBy("shard", "term", "row", "length").agg(F.count("*").cast("int").alias("tf"))
        share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / (average if average > 0 else 1.0)))
        held = F.array_sort(F.collect_list(F.struct("row", "tf", "length")))
        blocks = tallied.groupBy("shard", "term", F.floor(F.col("row") / WINDOW).cast("int").alias("window")).agg(F.max(share).alias("most"), held.alias("held"))
        lists = blocks.groupBy("shard", "term").agg(F.sum(F.size("held").cast("long")).alias("df"), F.array_sort(F.collect_list(F.struct("window", "most", "held"))).alias("blocks"))
        lists.sortWithinPartitions("term").write.parquet(posixpath.join(folder, "postings"))
        written = spark.read.parquet(posixpath.join(folder, "postings"))
        written.groupBy("term").agg(F.sum("df").alias("df")).write.parquet(posixpath.join(folder, "frequencies"))
        return SearchIndex(spark, folder)

    def search(self, queries: DataFrame, top: int = 10, key: str = "query_id", text: str = "query", block: int | None = None) -> DataFrame:
        """(query key, key, score, hits, rank): the `top` documents by BM25 of each row of queries, as excerpts.search ranks
        them; ties go to the lesser key. Queries without a term that some document holds have no rows.

        Only postings of the queries' terms are read. Each shard's go to one task, which all queries pass through as arrays
        of numbers of terms, and return `top` rows each; postings are copied only where shards are fewer than WAVES tasks a
        core, or where `block` queries a task are asked for."""
        ship(self.spark)
        path = shared_folder(self.spark, "asked")
        queries.select(F.col(key).alias("query"), F.array_distinct(terms(F.col(text))).alias("terms")).withColumn("_q", F.monotonically_increasing_id()).write.parquet(posixpath.join(path, "queries"))
        asked = self.spark.read.parquet(posixpath.join(path, "queries"))
        known = self.statistics.first()
        average, n, shards = known["average"], known["n"], known["shards"]
        parts = max(math.ceil(WAVES * self.spark.sparkContext.defaultParallelism / shards), math.ceil(asked.count() / block) if block else 1)
        weight = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        named = asked.select(F.explode("terms").alias("term")).distinct().join(self.frequencies, "term").select("term", F.monotonically_increasing_id().alias("id"), weight.alias("weight"))
        named.write.parquet(posixpath.join(path, "terms"))  # numbers stay as they are
        named = self.spark.read.parquet(posixpath.join(path, "terms"))
        each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
        held = self.postings.join(named, "term").select("shard", each(parts).alias("part"), F.lit(None).cast("long").alias("_q"), "id", "weight", "blocks", F.lit(None).cast("array<bigint>").alias("ids"))
        numbers = asked.select("_q", F.posexplode("terms").alias("pos", "term")).join(named, "term").groupBy("_q").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
        passed = numbers.select(each(shards).alias("shard"), F.pmod(F.xxhash64("_q"), F.lit(parts)).cast("int").alias("part"), "_q", *[F.lit(None).cast(held.schema[c].dataType).alias(c) for c in ("id", "weight", "blocks")], "ids")
        # a null _q sorts first: postings stand before the queries that pass through them
        tasks = held.unionByName(passed).repartition(shards * parts, "shard", "part").sortWithinPartitions("shard", "part", "_q")
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.int32())

        def answered(shard: Shard, weights: dict[int, float], number: int, rows: pa.Table) -> pa.RecordBatch:
            out, together = [], shard.together()
            if rows.num_rows >= FEWEST and together >= FEWEST:
                if shard.matrix is None:
                    shard.prepare(np.fromiter(weights.values(), np.float64, len(weights)))
                names, lists = rows.column("_q").to_numpy(), rows.column("ids").combine_chunks()
                offsets, ids = np.asarray(lists.offsets), np.asarray(lists.values)
                for a in range(0, len(names), together):
                    cut = offsets[a : a + together + 1]
                    of, found, score, hits = shard.answers(ids[cut[0] : cut[-1]], np.diff(cut), top)
                    out.append((np.full(len(of), number), names[a + of], found, score, hits))
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), kind) for x, kind in zip(zip(*out), kinds)], names=["shard", "_q", "row", "score", "hits"])
            for q, ids in zip(rows.column("_q").to_pylist(), rows.column("ids").to_pylist()):
                found, score, hits, _ = shard.best([(i, weights[i]) for i in ids if i in weights], top)
                out.append((np.full(len(found), number), np.full(len(found), q), found, score, hits))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), kind) for x, kind in zip(zip(*out), kinds)], names=["shard", "_q", "row", "score", "hits"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, read, shard, weights = None, [], None, {}
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                places = list(zip(rows.column("shard").to_pylist(), rows.column("part").to_pylist(), rows.column("_q").is_null().to_pylist()))
                cuts = [i for i in range(len(places)) if not i or places[i] != places[i - 1]]
                for a, b in zip(cuts, [*cuts[1:], len(places)]):
                    number, part, posting = places[a]
                    if (number, part) != at:
                        at, read, shard = (number, part), [], None
                    if posting:
                        read.append(rows.slice(a, b - a).select(["id", "weight", "blocks"]).rename_columns(["term", "weight", "blocks"]))
                        continue
                    if read:
                        postings = pa.concat_tables(read).combine_chunks()
                        read, shard, weights = [], Shard(postings, average), dict(zip(postings.column("term").to_pylist(), postings.column("weight").to_pylist()))
                    if shard:
                        for c in range(a, b, ANSWERED):
                            yield answered(shard, weights, number, rows.slice(c, min(ANSWERED, b - c)))

        best = Window.partitionBy("_q").orderBy(F.desc("score"))
        found = tasks.mapInArrow(run, FOUND).withColumn("place", F.rank().over(best)).where(F.col("place") <= top)
        place = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), "key", "shard", "row"))
        ranked = found.join(self.documents, ["shard", "row"]).withColumn("rank", place).where(F.col("rank") <= top)
        return ranked.join(asked.select("_q", "query"), "_q").select(F.col("query").alias(key), "key", "score", "hits", "rank")
