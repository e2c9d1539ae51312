"""The inverted index against one search at a time, and what it leaves closed."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.operators import excerpts, postings


def corpus(spark, n=700, seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rnd.choices(words, [1 / (i + 1) for i in range(300)], k=rnd.randint(0, 60))) for _ in range(n)]
    rows = [(i // 2 if i < 20 else i, t) for i, t in enumerate(texts)] + [(None, "w0 w1"), (9001, None), (9002, ""), (9003, "w3 " * 5000), (9004, "数据库 w5"), (9005, texts[30]), (9005, texts[30])]
    return spark.createDataFrame(rows, "doc_id long, text string"), rnd, words


def test_equals_one_search_at_a_time(spark):
    docs, rnd, words = corpus(spark)
    index = postings.SearchIndex.build(docs, size=2000)
    assert index.statistics.first()["shards"] > 3 and index.documents.count() == docs.count()
    asked = [" ".join(rnd.choices(words, k=rnd.randint(1, 6))) for _ in range(12)] + ["w0", "数据库", "!", "", "w3 w3 W3", "absent w7", None]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    plain = {i: sorted((r["rank"], r["doc_id"], r["score"], r["hits"]) for r in excerpts.search(docs, query or "", 7).collect()) for i, query in enumerate(asked)}
    for block in (5, 1000):
        found = {}
        for r in index.search(queries, 7, block=block).collect():
            found.setdefault(r["query_id"], []).append((r["rank"], r["key"], r["score"], r["hits"]))
        assert {i: sorted(found.get(i, [])) for i in plain} == plain


def test_repeated_queries_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a")], "`doc.id` int, text string").withColumn("term", F.lit(1)).withColumn("shard", F.lit("x"))
    index = postings.SearchIndex.build(docs.withColumnRenamed("doc.id", "k"), "k")
    queries = spark.createDataFrame([(None, "a"), (None, "a"), (5, "b")], "query_id int, query string")
    assert sorted((r["query_id"] or 0, r["key"]) for r in index.search(queries).collect()) == [(0, 1), (0, 1), (0, 2), (0, 2), (5, 1)]
    assert index.search(queries.limit(0)).count() == 0
    empty = postings.SearchIndex.build(docs.withColumnRenamed("doc.id", "k").limit(0), "k")
    assert empty.search(queries).count() == 0


def test_windows_below_the_best_stay_closed():
    rnd = np.random.default_rng(5)
    n, average = 64 * 400, 100.0
    lists = []
    for term, share in (("rare", 0.002), ("often", 0.6)):
        rows = np.flatnonzero(rnd.random(n) < share)
        blocks = {}
        for r in rows.tolist():
            tf, length = int(rnd.geometric(0.5)), int(rnd.integers(20, 300))
            blocks.setdefault(r // 64, []).append({"row": r, "tf": tf, "length": length})
        most = lambda held: max(x["tf"] * 2.5 / (x["tf"] + 1.5 * (0.25 + 0.75 * x["length"] / average)) for x in held)
        lists.append({"term": term, "blocks": [{"window": w, "most": most(held), "held": held} for w, held in blocks.items()]})
    kind = pa.schema([("term", pa.string()), ("blocks", pa.list_(pa.struct([("window", pa.int32()), ("most", pa.float64()), ("held", pa.list_(pa.struct([("row", pa.int32()), ("tf", pa.int32()), ("length", pa.int32())])))])))])
    shard = postings.Shard(pa.Table.from_pylist(lists, kind), average)
    asked = [("rare", 6.0), ("often", 0.4)]
    rows, scores, hits, opened = shard.best(asked, 10)
    every = {}
    for (_, weight), given in zip(asked, lists):
        for block in given["blocks"]:
            for x in block["held"]:
                every[x["row"]] = every.get(x["row"], 0.0) + weight * x["tf"] * 2.5 / (x["tf"] + 1.5 * (0.25 + 0.75 * x["length"] / average))
    plain = sorted((-round(s, 6), r) for r, s in every.items())[:10]
    assert [(-s, r) for s, r in zip(scores.tolist(), rows.tolist())] == plain
    assert opened < 100 and set(hits.tolist()) <= {1, 2}


def test_postings_are_not_copied_for_more_queries(spark, monkeypatch):
    docs, _, _ = corpus(spark)
    index = postings.SearchIndex.build(docs, size=700)
    assert index.statistics.first()["shards"] >= postings.WAVES * spark.sparkContext.defaultParallelism
    queries = spark.range(5000).select(F.col("id").alias("query_id"), F.concat(F.lit("w"), F.pmod("id", F.lit(9)).cast("string"), F.lit(" w7")).alias("query"))
    passed, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, *given, **more: passed.append(self) or plain(self, *given, **more))
    assert index.search(queries, 2).where("query_id is null").count() == 0
    assert passed[-1].where("_q is null").count() == index.postings.where(F.col("term").rlike("^w[0-8]$")).count()


def test_many_queries_at_once_equal_one_at_a_time(monkeypatch):
    rnd, average = np.random.default_rng(7), 90.0
    documents = 64 * 30 + 5
    lengths = rnd.integers(1, 300, documents)
    lists = {}
    for term in range(60):
        for r in np.flatnonzero(rnd.random(documents) < 0.7 / (1 + term)).tolist():
            lists.setdefault(term * 3 + 1, {}).setdefault(r // 64, []).append({"row": r, "tf": int(rnd.geometric(0.4)), "length": int(lengths[r])})
    most = lambda held: max(x["tf"] * 2.5 / (x["tf"] + 1.5 * (0.25 + 0.75 * x["length"] / average)) for x in held)
    names = rnd.permutation(list(lists)).tolist()
    table = [{"term": t, "blocks": [{"window": w, "most": most(held), "held": held} for w, held in lists[t].items()]} for t in names]
    kind = pa.schema([("term", pa.int64()), ("blocks", pa.list_(pa.struct([("window", pa.int32()), ("most", pa.float64()), ("held", pa.list_(pa.struct([("row", pa.int32()), ("tf", pa.int32()), ("length", pa.int32())])))])))])
    shard = postings.Shard(pa.Table.from_pylist(table, kind), average)
    weights = dict(zip(names, rnd.uniform(0.1, 6, len(names)).tolist()))
    shard.prepare(np.array(list(weights.values())))
    assert 0 < len(shard.matrix) < len(names)
    asked = [rnd.choice(190, int(rnd.integers(0, 40)), replace=False).tolist() for _ in range(70)] + [[], [names[0]], [999]]
    monkeypatch.setattr(postings, "SHORT", 40)
    for top in (1, 5, 40):
        of, row, score, hits = shard.answers(np.array([t for q in asked for t in q], np.int64), np.array([len(q) for q in asked]), top)
        for i, q in enumerate(asked):
            rows, scores, held, _ = shard.best([(t, weights[t]) for t in q if t in weights], top)
            assert (row[of == i].tolist(), score[of == i].tolist(), hits[of == i].tolist()) == (rows.tolist(), scores.tolist(), held.tolist())


def test_search_of_many_queries_equals_that_of_few(spark, monkeypatch):
    docs, rnd, words = corpus(spark)
    index = postings.SearchIndex.build(docs, size=20000)
    asked = [" ".join(rnd.choices(words, k=rnd.randint(1, 9))) for _ in range(400)]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string").coalesce(1)
    of = lambda frame: sorted((r["query_id"], r["rank"], str(r["key"]), r["score"], r["hits"]) for r in frame.collect())
    many = of(index.search(queries, 7))
    plain = of(index.search(queries, 7, block=4))  # fewer than FEWEST a task, most of them
    assert many == plain and len({r[0] for r in many}) == 400
