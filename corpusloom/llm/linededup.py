"""Removal of lines that repeat across documents.

Lines' keys are hashed to 128 bits; rows (hash, document, position) are range-partitioned and sorted by all three,
so a line that fills a third of the corpus is cut over many ranges. Each task streams its range once. What a task
can't know is how its first and last hash go on in the neighbouring ranges: those two runs of each range are
summarised first (two rows a range), joined end to end, and given to all tasks. The result is a bitmap of kept lines
per document, not text. A row is known by its doc_id and a hash of its text, so that rows with one doc_id but
different texts lose their own lines only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.base import durable, partitions, prepare

WHITE = b" \t\n\x0b\x0c\r"


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        for batch in batches:
            docs, at, high, low, own = [], [], [], [], []
            for doc, text, hashed in zip(*(c.to_pylist() for c in batch.columns)):
                for i, line in enumerate((text or "").encode().split(b"\n")):
                    key = line.strip(WHITE).lower()
                    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
                        continue
                    h = digest(key)
                    docs.append(doc)
                    at.append(i)
                    high.append((h >> 64) - (1 << 63))
                    low.append((h & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                    own.append(hashed)
            yield pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(docs, pa.int64()), pa.array(own, pa.int64()), pa.array(at, pa.int32())], names=["high", "low", "doc_id", "text_hash", "line"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        if batch.num_rows:
            yield tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the first and the last hash of a range: distinct documents, the first and the last of them."""
    first = last = None

    def add(high: int, low: int, docs: np.ndarray) -> None:
        nonlocal first, last
        n = 1 + int((docs[1:] != docs[:-1]).sum())
        if last and last[:2] == [high, low]:
            last[2] += n - (last[4] == docs[0])
            last[4] = int(docs[-1])
        else:
            last = [high, low, n, int(docs[0]), int(docs[-1])]
            first = first or last

    for high, low, doc, _, _ in _runs(batches):
        new = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
        ends = [*new[1:].tolist(), len(doc)]
        add(int(high[0]), int(low[0]), doc[: ends[0]])
        if len(new) > 1:
            add(int(high[-1]), int(low[-1]), doc[new[-1] :])
    rows = [] if first is None else [first] if first is last else [first, last]
    task = TaskContext.get().partitionId()
    names = ["task", "place", "high", "low", "n", "first", "last"]
    columns = list(zip(*[(task, i, *r) for i, r in enumerate(rows)])) or [()] * 7
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _joined(edges: list) -> dict[tuple[int, int], tuple[int, int]]:
    """(documents, largest document) of the hashes at the ends of ranges."""
    found: dict[tuple[int, int], list[int]] = {}
    for r in sorted(edges, key=lambda r: (r["task"], r["place"])):
        key = (r["high"], r["low"])
        if key in found:
            n, last, _ = found[key]
            found[key] = [n + r["n"] - (last == r["first"]), r["last"], r["last"]]
        else:
            found[key] = [r["n"], r["last"], r["last"]]
    return {k: (v[0], v[2]) for k, v in found.items()}


def _decide(known: dict[tuple[int, int], tuple[int, int]], min_docs: int):
    """Lines to drop. Runs within a range are decided when they end, those at its ends by what is known of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def decide(high, low, doc, own, line):
            new = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
            size = np.diff(np.concatenate([new, [len(doc)]]))
            fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
            fresh[new] = True
            n = np.add.reduceat(fresh.astype(np.int64), new)
            best = doc[new + size - 1]
            for i in {0, len(new) - 1}:
                if (found := known.get((int(high[new[i]]), int(low[new[i]])))) is not None:
                    n[i], best[i] = found
            gone = np.repeat(n >= min_docs, size) & (doc != np.repeat(best, size))
            return pa.RecordBatch.from_arrays([pa.array(doc[gone]), pa.array(own[gone]), pa.array(line[gone])], names=["doc_id", "text_hash", "line"])

        for now in _runs(batches):
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now))
            high, low = now[0], now[1]
            if (int(high[-1]), int(low[-1])) in known:  # no need to wait for its end
                held = None
                yield decide(*now)
                continue
            tail = np.flatnonzero((high != high[-1]) | (low != low[-1]))
            cut = int(tail[-1]) + 1 if len(tail) else 0
            held = tuple(x[cut:] for x in now)
            if cut:
                yield decide(*(x[:cut] for x in now))
        if held is not None:
            yield decide(*held)

    return run


def _slim(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].alias("_t"), F.xxhash64(docs[text]).alias("text_hash"), *more)


def dropped_lines(docs: DataFrame, text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, text_hash, line) of lines to drop: their key is found in min_docs documents, and doc_id isn't the largest
    of them. A row stands for every row of docs with this doc_id and text; it may come repeatedly if these do."""
    spark = docs.sparkSession
    prepare(spark)
    order = ["high", "low", "doc_id", "text_hash", "line"]
    rows = durable(_slim(docs, text).where("doc_id is not null").mapInArrow(_keys(min_chars), "high long, low long, doc_id long, text_hash long, line int"))
    rows = durable(rows.repartitionByRange(2 * partitions(spark), *order).sortWithinPartitions(*order))
    edges = rows.mapInArrow(_edges, "task long, place long, high long, low long, n long, first long, last long").collect()  # two rows a range
    return rows.mapInArrow(_decide(_joined(edges), min_docs), "doc_id long, text_hash long, line int")


def bitmap(n_lines: int, dropped) -> bytes:
    """One bit a line, 1 if it stays, deflated."""
    keep = np.ones(n_lines, np.uint8)
    keep[np.asarray(dropped, np.int64)] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def kept_lines(lines: list, packed: bytes) -> list:
    """The lines whose bit is 1."""
    keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=len(lines), bitorder="little")
    return [x for x, k in zip(lines, keep) if k]


def keep_bitmaps(docs: DataFrame, text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, keep): keep is the deflated bitmap of lines that stay; no text.

    Lines are split at \\n; a null or empty text is one empty line. Keys are lines without ASCII white space at their
    ends, A-Z lower-cased. A line repeated in one document counts once. Rows with null doc_id keep all lines and
    aren't counted; rows that repeat a doc_id count as one document, each of its texts has a bitmap, and rows that repeat
    both share one. An empty table gives an empty result; other columns are ignored."""
    gone = dropped_lines(docs, text, min_chars, min_docs).groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("_gone"))
    lines = F.coalesce(F.length("_t") - F.length(F.replace("_t", F.lit("\n"))) + 1, F.lit(1))
    rows = _slim(docs, text).select("doc_id", "text_hash", lines.cast("long").alias("n_lines")).distinct()
    joined = rows.join(gone, ["doc_id", "text_hash"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost = [sorted(g or ()) for g in batch.column(3).to_pylist()]
            keep = [bitmap(m, g) for m, g in zip(batch.column(2).to_pylist(), lost)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(g) for g in lost], pa.int64()), pa.array(keep, pa.binary())], names=["doc_id", "text_hash", "n_lines", "n_dropped", "keep"])

    return joined.mapInArrow(run, "doc_id long, text_hash long, n_lines long, n_dropped long, keep binary")


def digests(docs: DataFrame, maps: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every row of docs: the lines that keep_bitmaps keeps, joined by \\n,
    hashed."""
    # written, so that both sides of the join are plain exchanges and rows that repeat can be split
    maps = durable(maps.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), "n_lines", "n_dropped", "keep"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_h"))
    joined = _slim(docs, text).join(maps, same).select("doc_id", "_t", "n_lines", "n_dropped", "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sha256(b"\n".join(kept_lines((t or "").encode().split(b"\n"), k))).hexdigest() for t, k in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(found, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
