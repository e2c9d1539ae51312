"""The pipeline against plain versions of its stages, on a small corpus."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import decontaminate, simhash


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd, top = random.Random(8), tmp_path_factory.mktemp("tables")
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [text(30) for _ in range(3)]
    docs = [(i, text(rnd.randint(60, 120)), "en", f"s{i % 4}") for i in range(150)]
    docs += [(200 + i, docs[i][1], "en", "s0") for i in range(20)]
    docs += [(300 + i, f"{text(20)} {items[i % 3]} {text(20)}", "en", "s1") for i in range(9)]
    docs += [(400 + i, text(30) + " vile" * 12, "en", "s2") for i in range(30)]
    near = [d[1].split() for d in docs[20:35]]  # a word less at the end, and one changed
    docs += [(600 + i, " ".join(["first", *w[1:-1]]), "en", "s2") for i, w in enumerate(near)]
    docs += [(500, None, None, None), (None, text(50), "en", "s3"), docs[0]]
    labels = [(d[0], 1, 0) for d in docs[:100]] + [(400 + i, 1, 1) for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages_take_effect_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    benchmark = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, folder).cache()
        after = docs.collect()
        ids = {r["doc_id"] for r in after}
        if name != "shard":
            assert docs.columns == columns
        if name == "quality":
            assert not ids & set(range(400, 430)) and len(ids & set(range(150))) > 140
        if name == "simhash":
            fps = dict(zip((r["doc_id"] for r in before), simhash.wide_fingerprints(pa.array([r["text"] for r in before]))))
            apart = lambda x, y: int(np.bitwise_count(x ^ y).sum())
            kept = [fps[r["doc_id"]] for r in after]
            assert all(apart(a, b) > simhash.WIDE_RADIUS for k, a in enumerate(kept) for b in kept[:k])
            assert all(any(apart(f, k) <= simhash.WIDE_RADIUS for k in kept) for f in fps.values())
            assert not ids & set(range(600, 615)) and set(range(20, 35)) <= ids
        if name == "decontaminate":
            assert {r["doc_id"] for r in before} - ids == {r["doc_id"] for r in before if any(x in (r["text"] or "") for x in benchmark)}
        if name == "mix":
            assert ids <= {r["doc_id"] for r in before} and len(after) > len(before)
        if name == "shard":
            assert sorted(map(str, ([r[c] for c in columns] for r in before))) == sorted(map(str, ([r[c] for c in columns] for r in after)))
            sizes = [sum(r["shard"] == s for r in after) for s in range(40)]
            assert max(sizes) - min(sizes) <= 1


def test_run_is_the_stages_one_after_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    order = sorted(docs.columns)
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, got.select(order).collect())) == sorted(map(str, docs.select(order).collect()))
    assert got.count() > 100


def test_contamination_has_no_false_alarms(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert {r["doc_id"] for r in found.collect()} == set(range(300, 309))
