"""Best-fit packing of documents' ids into sequences, over many tasks.

Documents are tokenised and cut into pieces of at most `capacity` ids; only longer ones are cut. Pieces are dealt evenly
over partitions, and each packs its own by best-fit, largest first. Within a partition no two bins could be joined, so
at most one is half full or less, and only such bins can still be saved. Partitions are then merged as a tree, `fan_in` at
a time: underfull bins are the items of the next round, and best-fit puts those of half or less into others of the group. A
group hands on its one bin that is still half full or less, and the `fan_in` others with the most room (a round has no
use for more hosts than items); all others are emitted. So a task of the tree reads fan_in * (fan_in + 1) rows at most,
whatever the sizes, and there are as many rounds as the logarithm of the partitions.

What a bin's pieces are is kept in a table of its own: only moves, of whole bins into others, are made by the tree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.base import durable, partitions, prepare, written
from corpusloom.llm.tokens import encoder

FAN_IN = 8
PART_PIECES = 8192  # the more pieces a partition has, the fuller its bins
BIN = 1 << 32  # a bin's number is its partition's times this, and its own in it


def cut(ids: np.ndarray, capacity: int) -> list[np.ndarray]:
    return [ids[i : i + capacity] for i in range(0, len(ids), capacity)]


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = 4096, text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: its ids by the vocabulary file (of the kind that drops
    white space), then the end id, in pieces of at most `capacity`. ids_crc32: of 32-bit little-endian ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first = encoder(path, words=True).encode(batch.column(1))
            rows = []
            for doc, a, b in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                whole = np.append(ids[a:b], end_id).astype("<u4")
                rows += [(doc, i, i * capacity, len(p), zlib.crc32(p)) for i, p in enumerate(cut(whole, capacity))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].alias("_t"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins by the room they have. The room that fits best is the lowest set bit of a number, so a search is one step."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.open = capacity, 0, {}

    def place(self, size: int, fresh: int) -> tuple[int, int]:
        """The bin that takes `size`, and where in it: of those with room that with the least, else bin `fresh`."""
        fits = self.rooms >> size
        room, number = self.capacity, fresh
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            number = self.open[room].pop()
            if not self.open[room]:
                self.rooms &= ~(1 << room)
        if room > size:
            self.open.setdefault(room - size, []).append(number)
            self.rooms |= 1 << room - size
        return number, self.capacity - room

    def hand_on(self, fan_in: int) -> list[tuple[int, int]]:
        """(bin, fill) of the bin that is half full or less, if there is one, and of the fan_in others with the most room."""
        every = ((number, self.capacity - room) for room in sorted(self.open, reverse=True) for number in self.open[room])
        found, hosts = [], 0
        for number, fill in every:
            if 2 * fill > self.capacity:
                hosts += 1
                if hosts > fan_in:
                    break
            found.append((number, fill))
        return found


def merge(bins: list[tuple[int, int]], capacity: int, fan_in: int = FAN_IN) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Best-fit over underfull bins (bin, fill), the fullest first: moves (bin, host, place), and what is handed on.

    Bins over half find no host, so a host stays where it is in its round."""
    open_, moves = Bins(capacity), []
    for number, fill in sorted(bins, key=lambda b: (-b[1], b[0])):
        host, place = open_.place(fill, number)
        if host != number:
            moves.append((number, host, place))
    return moves, open_.hand_on(fan_in)


def _local(capacity: int, fan_in: int):
    """Over rows (row, length) sorted by descending length: (row, bin, offset), then without a row the bins handed on and
    how full they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, bins, n, kind = TaskContext.get().partitionId() * BIN, Bins(capacity), 0, None
        for batch in batches:
            found, kind = [], batch.schema.field(0).type
            for size in batch.column(1).to_pylist():
                found.append(bins.place(size, base + n))
                n += found[-1][0] == base + n
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], pa.int64()) for i in range(2))], names=["row", "bin", "offset"])
        if kind is not None:
            last = bins.hand_on(fan_in)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(last), kind), *(pa.array([b[i] for b in last], pa.int64()) for i in range(2))], names=["row", "bin", "offset"])

    return run


def _tree(bins: DataFrame, nodes: int, capacity: int, fan_in: int) -> list[DataFrame]:
    """Moves (bin, host, place) of each round over what nodes hand on (node, bin, fill)."""

    def join_node(rows: pd.DataFrame) -> pd.DataFrame:
        moved, left = merge(list(zip(rows["bin"].tolist(), rows["fill"].tolist())), capacity, fan_in)
        out = [(*m, 0) for m in moved] + [(number, None, None, fill) for number, fill in left]
        frame = pd.DataFrame(out, columns=["bin", "host", "place", "fill"]).astype({"bin": "int64", "host": "Int64", "place": "Int64", "fill": "int64"})
        return frame.assign(node=int(rows["node"].iloc[0]))[["node", "bin", "host", "place", "fill"]]

    rounds = []
    while nodes > 1:
        nodes = -(-nodes // fan_in)
        groups = bins.withColumn("node", F.floor(F.col("node") / F.lit(fan_in)).cast("long")).groupBy("node")
        done = written(groups.applyInPandas(join_node, "node long, bin long, host long, place long, fill long"))
        rounds.append(done.where("host is not null").select("bin", "host", "place"))
        bins = done.where("host is null").select("node", "bin", "fill")
    return rounds


def pack(found: DataFrame, capacity: int = 4096, fan_in: int = FAN_IN, parts: int | None = None, length: str = "length", sequence: str = "sequence_id", offset: str = "offset") -> DataFrame:
    """found, whose lengths are 1 to `capacity`, with two more columns: sequence and offset, gapless from 0 in a sequence.

    Repeated rows are packed each for itself; columns of found that have the names asked for are replaced, all others
    keep theirs, whatever these are; an empty table gives an empty result."""
    spark = found.sparkSession
    prepare(spark)
    parts = parts or max(1, min(2 * partitions(spark), found.count() // PART_PIECES))
    kept = [(i, c) for i, c in enumerate(found.columns) if c not in (sequence, offset)]
    at = found.columns.index(length)
    plain = found.toDF(*[f"c{i}" for i in range(len(found.columns))])
    tie = F.xxhash64(*[f"c{i}" for i, f in enumerate(found.schema) if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
    rows = plain.select(F.struct(*[f"c{i}" for i, _ in kept]).alias("row"), F.col(f"c{at}").cast("long").alias("length"), tie.alias("tie"))
    dealt = rows.repartition(parts).sortWithinPartitions(F.col("length").desc(), "tie").select("row", "length")
    placed = durable(dealt.mapInArrow(_local(capacity, fan_in), f"row {rows.schema['row'].dataType.simpleString()}, bin long, offset long"))
    handed = placed.where("row is null").select(F.floor(F.col("bin") / F.lit(BIN)).cast("long").alias("node"), "bin", F.col("offset").alias("fill"))
    # where moved bins are in the end: fewer than there are partitions, since each brings one bin that can move
    final = None
    for moves in reversed(_tree(handed, parts, capacity, fan_in)):
        if final is not None:
            later = final.select(F.col("bin").alias("host"), F.col("host").alias("to"), F.col("place").alias("at"))
            moves = final.union(moves.join(later, "host", "left").select("bin", F.coalesce("to", "host").alias("host"), (F.col("place") + F.coalesce("at", F.lit(0))).alias("place")))
        final = moves
    pieces_ = placed.where("row is not null")
    if final is None:
        final = spark.createDataFrame([], "bin long, host long, place long")
    joined = pieces_.join(F.broadcast(written(final)), "bin", "left")
    there = [F.coalesce("host", "bin").alias(f"n{len(kept)}"), (F.col("offset") + F.coalesce("place", F.lit(0))).alias(f"n{len(kept) + 1}")]
    return joined.select("row.*", *there).toDF(*[c for _, c in kept], sequence, offset)


def packed_documents(docs: DataFrame, path: str, end_id: int, capacity: int = 4096, text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document of docs.

    A null text is an empty one, and has its end id; rows with null or repeated doc_id are documents of their own; texts
    of any length are cut, never shortened; other columns are ignored; an empty table gives an empty result."""
    prepare(docs.sparkSession)
    return pack(written(pieces(docs, path, end_id, capacity, text)), capacity)
