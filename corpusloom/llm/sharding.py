"""Consistent-hash sharding with virtual nodes and bounded loads, in DataFrame functions only.

The ring is cut by `n_shards * replicas` virtual nodes; an arc is the stretch of keys that ends at one node. A
shard takes no more than its capacity. Keys that find their shard full go on clockwise to the next node with room,
keys of a first choice before keys that were turned away. Within an arc, keys are taken in the order of their ring
position, so an arc is a few intervals of ranks, each of one shard. A key has SALTS positions on the ring, among which
its rows are dealt by their content, so that a key which many rows share isn't one arc.

Only the counts of the arcs (a table whose size depends on the ring, not on the rows) reach the driver, which
settles the overflow there; the rows are shuffled once, by arc, to learn their rank in it.
"""

from __future__ import annotations

import json
import struct
from hashlib import blake2b

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.base import any_names

CELLS = 1 << 20
BLOCKS = 1 << 12
SALTS = 16


def ring(n_shards: int, replicas: int) -> list[tuple[int, int]]:
    """(position, shard) of each virtual node, in ring order; of nodes at one position the least shard's stays."""
    nodes: dict[int, int] = {}
    for shard in range(n_shards):
        for replica in range(replicas):
            at = struct.unpack("<Q", blake2b(f"{shard}/{replica}".encode(), digest_size=8).digest())[0] % CELLS
            nodes[at] = min(shard, nodes.get(at, shard))
    return sorted(nodes.items())


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns but those of types that can't be hashed."""
    return F.xxhash64(*[docs[c] for c, t in docs.dtypes if "map" not in t and "variant" not in t])


def _position(docs: DataFrame, key: str) -> Column:
    """The hash that places a row: of its key and its salt, or of the whole row where the key is null."""
    whole = _row_hash(docs)
    return F.when(docs[key].isNull(), whole).otherwise(F.xxhash64(docs[key], F.pmod(whole, F.lit(SALTS))))


def _arc(position: Column, nodes: list[tuple[int, int]]) -> Column:
    """The first node at or after a ring position, after the last node the first again."""
    cell = F.pmod(position, F.lit(CELLS)).cast("int")
    near = F.floor(cell / F.lit(CELLS // BLOCKS)).cast("int")
    # of each block of the ring: how many nodes are before it, and the nodes in it
    before, inside, at = [], [], 0
    for block in range(BLOCKS):
        start = at
        while at < len(nodes) and nodes[at][0] < (block + 1) * (CELLS // BLOCKS):
            at += 1
        before.append(start)
        inside.append([p for p, _ in nodes[start:at]])
    table = F.from_json(F.lit(json.dumps([{"n": n, "at": p} for n, p in zip(before, inside)])), "array<struct<n:int,at:array<int>>>")
    found = F.get(table, near)
    return F.pmod(found["n"] + F.size(F.filter(found["at"], lambda p: p < cell)), F.lit(len(nodes))).cast("int")


def settle(arcs: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, from, to, shard): who takes which ranks of each arc. arcs: keys per arc; sum(capacity) must suffice.

    Round by round, what is pending at a node is offered to the node's shard, in ring order; what doesn't fit goes
    to the next node clockwise."""
    free = list(capacity)
    pending = [[(i, 0, n)] if n else [] for i, n in enumerate(arcs)]
    taken = []
    while any(pending):
        following: list[list[tuple[int, int, int]]] = [[] for _ in arcs]
        for node, offers in enumerate(pending):
            for arc, low, high in offers:
                n = min(high - low, free[owners[node]])
                if n:
                    free[owners[node]] -= n
                    taken.append((arc, low, low + n, owners[node]))
                if low + n < high:
                    following[(node + 1) % len(arcs)].append((arc, low + n, high))
        pending = following
    return sorted(taken)


@any_names("doc_id", "shard", "slot")
def assign_shards(docs: DataFrame, n_shards: int = 40, replicas: int = 128, headroom: float = 0.0, key: str = "doc_id", shard: str = "shard", slot: str = "slot") -> DataFrame:
    """docs with two more columns: shard (0 to n_shards - 1) and slot (gapless from 0 within a shard).

    A shard takes at most (1 + headroom) times its share of the rows: with no headroom, the counts of shards are at
    most one apart. Rows with a null key are placed by their other columns; rows of one ring position are ranked by a hash
    of all columns, so repeated rows differ in slot only. An empty table gives an empty result. Columns of docs that have
    the names asked for are replaced; all others keep theirs, whatever these are."""
    spark = docs.sparkSession
    docs = docs.drop(shard, slot)
    nodes = ring(n_shards, replicas)
    # the columns of docs travel as one, so that none can clash with those of the ring
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), _position(docs, key).alias("_at"), _row_hash(docs).alias("_tie"))
    arc = _arc(F.col("_at"), nodes)
    per_arc = {r["arc"]: r["n"] for r in rows.select(arc.alias("arc")).groupBy("arc").agg(F.count("*").alias("n")).collect()}
    arcs = [per_arc.get(i, 0) for i in range(len(nodes))]
    total = sum(arcs)
    capacity = [-(-int(total * (1 + headroom)) // n_shards)] * n_shards if headroom else [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    offset = [0] * n_shards
    plan = []
    for at, low, high, owner in settle(arcs, [s for _, s in nodes], capacity):
        plan.append({"arc": at, "low": low, "high": high, "shard": owner, "base": offset[owner] - low})
        offset[owner] += high - low
    schema = "array<struct<arc:int,low:bigint,high:bigint,shard:int,base:bigint>>"
    intervals = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plan)), schema)))
    ranked = Window.partitionBy("_arc").orderBy("_at", "_tie")
    placed = rows.withColumn("_arc", arc).withColumn("_rank", F.row_number().over(ranked) - 1)
    inside = (F.col("_arc") == intervals["arc"]) & (F.col("_rank") >= intervals["low"]) & (F.col("_rank") < intervals["high"])
    return placed.join(F.broadcast(intervals), inside).select("_row.*", intervals["shard"].alias(shard), (F.col("_rank") + intervals["base"]).alias(slot))
