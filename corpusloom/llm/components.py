"""Connected components of a link table, by alternating star contractions.

Every round is a join and an aggregation over links, written to the shared folder, so neither links nor
components ever meet on the driver, and a star's centre is pre-aggregated before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.base import durable


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of each batch: each node with the least node of its batch-local component."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, find(x)) for x in parent]
        pairs = [(x, r) for x, r in pairs if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["node", "root"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `links` (two long columns a, b) but the roots; root: least node reachable.

    An empty link table gives an empty result; loops and repeated links are ignored."""
    a, b = links.columns
    stars = durable(links.where(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b")).mapInArrow(_contract, "node long, root long").distinct())
    before = None
    for _ in range(rounds):
        state = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            return stars
        before = state
        # large star: a node's larger neighbours are tied to its least neighbour
        both = stars.union(stars.select(F.col("root").alias("node"), F.col("node").alias("root")))
        # written, so that both sides of the join are plain exchanges and a star's centre can be split
        least = durable(both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("low")))
        large = both.where(F.col("root") > F.col("node")).join(least, "node").select(F.col("root").alias("node"), F.col("low").alias("root")).where("node != root").distinct()
        # small star: a node and its smaller neighbours are tied to the least of them
        large = durable(large)
        low = durable(large.groupBy("node").agg(F.min("root").alias("low")))
        tied = large.join(low, "node")
        small = tied.select(F.col("root").alias("node"), F.col("low").alias("root")).where("node != root")
        stars = durable(small.union(low.select("node", F.col("low").alias("root"))).distinct())
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
