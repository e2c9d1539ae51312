"""Nearest vectors, exact and by the index, against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators.vector_index import VectorIndex
from corpusloom.operators.vectors import nearest

KIND = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def points():
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(60, 32))
    found = centres[rnd.integers(0, 60, 6000)] + 0.5 * rnd.normal(size=(6000, 32))
    found[2000:4000] = found[0]  # a third of all rows are copies
    return found.astype(np.float32)


@pytest.fixture(scope="module")
def vectors(spark, points):
    odd = [(None, [1.0] * 32), (9001, None), (9002, [0.0] * 32), (9003, points[5].tolist()), (9003, points[6].tolist()), (9003, points[6].tolist())]
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + odd, KIND).repartition(6)


def plain(points, queries, k):
    known = [(i, p) for i, p in enumerate(points)] + [(9002, np.zeros(32)), (9003, points[5]), (9003, points[6])]
    keys, unit = np.array([i for i, _ in known]), np.array([p for _, p in known], np.float64)
    size = np.linalg.norm(unit, axis=1, keepdims=True)
    unit = unit / np.where(size > 0, size, 1)
    out = {}
    for i in queries:
        score = np.round(unit @ unit[i], 7)
        out[i] = [int(k) for k in keys[np.lexsort((keys, -score))[:k]]]
    return out


def answers(frame):
    found = {}
    for r in sorted(frame.collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    return found


def test_exact_in_blocks_of_both_sides(spark, vectors, points):
    asked = vectors.where("vec_id % 97 = 0 and vec_id < 6000")
    want = plain(points, [i for i in range(0, 6000, 97) if not 2000 <= i < 4000], 6)
    for block, rows in ((7, 900), (5000, 200_000)):
        found = answers(nearest(vectors.dropDuplicates(), asked, 6, block=block, rows=rows))
        assert len(found) == 62 and all(found[i] == want[i] for i in want)
        assert all(found[i] == [0, 2000, 2001, 2002, 2003, 2004] for i in range(0, 6000, 97) if i == 0 or 2000 <= i < 4000)


def test_index_finds_most_and_with_all_lists_everything(spark, vectors, points):
    index = VectorIndex.build(vectors, sample_rows=2000, parts=8, rows=500)
    assert index.rows.count() == 6003 and index.sizes.agg(F.max("pieces")).first()[0] >= 4
    asked = vectors.where("vec_id % 50 = 0 and vec_id < 6000 and not vec_id between 2000 and 3999")
    want = plain(points, [r["vec_id"] for r in asked.collect()], 5)
    found = answers(index.search(asked, 5, short=10, block=30))
    recall = np.mean([len(set(found[i]) & set(want[i])) / 5 for i in want])
    assert set(found) == set(want) and recall >= 0.9, recall
    assert index.model.probes < len(index.model.centroids) / 2  # clustered vectors need few lists
    some = asked.where("vec_id % 500 = 0")
    every = answers(index.search(some, 5, probes=10_000, short=1300))
    assert every == {i: want[i] for i in every} and len(every) == some.count()


def test_odd_tables(spark, vectors):
    none = VectorIndex.build(vectors.limit(0))
    assert none.search(vectors.limit(3)).count() == 0
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0]), (4, None)], KIND)
    assert answers(VectorIndex.build(few).search(few, 2)) == {1: [1, 2], 2: [2, 1]} == answers(nearest(few, few, 2))
    assert VectorIndex.build(few).search(few.limit(0)).count() == 0


def test_recall_of_the_query(spark):
    from corpusloom import catalog

    exact, near = (answers(catalog.queries()[n](spark, "/root/testdata/sf0.1")) for n in ("vector_neighbours", "vector_index_neighbours"))
    assert set(exact) == set(near)
    assert np.mean([len(set(near[i]) & set(exact[i])) / len(exact[i]) for i in exact]) >= 0.9
