"""Repeated passages by sparse suffix arrays.

Suffixes are kept at content-selected positions only: the least hash of 16 consecutive words in every window of 35
such hashes. Any 50 words that occur twice hold the same selected position. Grouping by the hash of these 16 words
tells the few that occur at two places. A repeat that holds such a seed begins 0 to 34 words before it, so all suffixes
that begin there are sorted over the cluster, by two hashes of their first 50 words: suffixes that share 50 words or
more are neighbours in that one order, whatever other texts have the seed too. Matches are extended left and right by
uniting the 50 words of all suffixes of a text that match, as far as they go on.

Texts that are equal as a whole take part once; their copies are matched as whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.base import durable, partitions, prepare, written
from corpusloom.llm.textkit import Words, mix, shingles

SEED, PASSAGE = 16, 50
REACH = PASSAGE - SEED  # words before the seed where a repeat that holds it can begin
_OTHER = np.uint64(0xD1B54A32D192ED03)


def selected(grams: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Positions of the (leftmost) least hash in each window of a document's hashes.

    Of a stretch of equal hashes (one word over and over) the first of every `window` is enough, and the last."""
    at = np.arange(len(grams))
    best, reach = at.copy(), 1
    while reach < window:
        step = min(reach, window - reach)
        other = best[np.minimum(at + step, len(at) - 1)] if len(at) else best
        best = np.where(grams[other] < grams[best], other, best)
        reach += step
    starts = np.zeros(len(grams) + 1, np.int64)
    counts = np.maximum(np.diff(first) - window + 1, 0)
    np.add.at(starts, first[:-1], counts > 0)
    np.add.at(starts, first[:-1] + counts, -(counts > 0).astype(np.int64))
    found = np.unique(best[np.cumsum(starts[:-1]) > 0])
    same = np.concatenate([[False], grams[1:] == grams[:-1]])
    since = at - np.maximum.accumulate(np.where(same, 0, at)) if len(at) else at
    ends = np.concatenate([~same[1:], [True]])[: len(at)]
    return found[(since[found] % window == 0) | ends[found]]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = Words(batch.column(2))
        grams, first = shingles(words.hashes(), words.first, SEED)
        keep = words.counts() >= PASSAGE
        at = selected(grams, first, REACH + 1)
        doc = np.searchsorted(first, at, side="right") - 1
        at, doc = at[keep[doc]], doc[keep[doc]]
        columns = [pa.array(grams[at].view(np.int64)), batch.column(1).take(pa.array(doc)), pa.array((at - first[doc]).astype(np.int32)), batch.column(0).take(pa.array(doc))]
        yield pa.RecordBatch.from_arrays(columns, names=["g", "h", "pos", "doc_id"])


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, h2, n): two hashes of a text and its number of words, of texts of PASSAGE words or more."""
    for batch in batches:
        n = Words(batch.column(2)).counts()
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 3)), pa.array(n.astype(np.int32))], names=["doc_id", "h", "h2", "n"]).filter(pa.array(n >= PASSAGE))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each (doc_id, text, positions, h) the suffixes that begin up to REACH words before a seed: two hashes of the
    first PASSAGE words of each."""
    for batch in batches:
        words = Words(batch.column(1))
        hashes = words.hashes()
        keys, first = shingles(hashes, words.first, PASSAGE)
        checks, _ = shingles(mix(hashes ^ _OTHER), words.first, PASSAGE)
        positions = batch.column(2)
        counts = np.diff(np.asarray(positions.offsets))
        doc = np.repeat(np.arange(batch.num_rows), counts)
        pos = positions.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        # 1 where the starts of a seed's suffixes begin, -1 behind them
        many = first[doc + 1] - first[doc]
        edge = np.zeros(len(keys) + 1, np.int64)
        np.add.at(edge, first[doc] + np.minimum(np.maximum(pos - REACH, 0), many), 1)
        np.add.at(edge, first[doc] + np.minimum(pos + 1, many), -1)
        chosen = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        for at in np.array_split(chosen, max(1, len(chosen) // 20_000)):
            d = np.searchsorted(first, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(checks[at].view(np.int64)), batch.column(0).take(pa.array(d)), pa.array((at - first[d]).astype(np.int32)), batch.column(3).take(pa.array(d))], names=["k", "c", "doc_id", "pos", "h"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's sorted suffixes: the first group's key, least and next doc_id, the last group's key and least doc_id."""
    head = tail = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, c, doc = (batch.column(i).to_numpy() for i in range(3))
        head = head or {"k": int(k[0]), "c": int(c[0]), "low": int(doc[0]), "next": None}
        if head["next"] is None:
            later = np.flatnonzero((k == head["k"]) & (c == head["c"]) & (doc != head["low"]))
            head["next"] = int(doc[later[0]]) if len(later) else None
        start = int(np.argmax((k == k[-1]) & (c == c[-1])))
        if start or tail is None or tail[:2] != (int(k[-1]), int(c[-1])):
            tail = (int(k[-1]), int(c[-1]), int(doc[start]))
    if head:
        row = head | {"task": TaskContext.get().partitionId(), "last_k": tail[0], "last_c": tail[1], "last_low": tail[2]}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("task", pa.int32()), *[(n, pa.int64()) for n in ("k", "c", "low", "next", "last_k", "last_c", "last_low")]]))


def _groups_across(sorted_rows: DataFrame) -> tuple[dict[int, tuple], dict[int, int]]:
    """Groups that tasks share (one row a task): (key, least doc_id) of the group that a task's first row goes on with,
    and the doc_id after the least in the group of its last row, where that is in a later task."""
    names = "task int, k long, c long, low long, next long, last_k long, last_c long, last_low long"
    rows = sorted((r.asDict() for r in sorted_rows.mapInArrow(_edges, names).collect()), key=lambda r: r["task"])
    key, end = lambda r: (r["k"], r["c"]), lambda r: (r["last_k"], r["last_c"])
    least: list[int] = []  # of each task's last group, over all tasks
    goes_on: dict[int, tuple] = {}
    for i, r in enumerate(rows):
        if i and end(rows[i - 1]) == key(r):
            goes_on[r["task"]] = (*key(r), least[-1])
        least.append(least[-1] if r["task"] in goes_on and key(r) == end(r) else r["last_low"])
    follows: dict[int, int] = {}
    for i in range(len(rows) - 2, -1, -1):
        r, after = rows[i], rows[i + 1]
        if end(r) == key(after):
            other = after["low"] if after["low"] != least[i] else after["next"]
            if other is None and key(after) == end(after):
                other = follows.get(after["task"])
            if other is not None:
                follows[r["task"]] = other
    return goes_on, follows


def _shared(goes_on: dict[int, tuple], follows: dict[int, int]):
    """Suffixes whose first PASSAGE words another doc_id has: (doc_id, h, start, other_id), other_id the least that
    has them, for that one the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        low, held = goes_on.get(task), None

        def decide(rows, low, last):
            k, c, doc, pos, h = rows
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
            group = np.cumsum(new) - 1
            least = doc[new]
            if low is not None and low[:2] == (k[0], c[0]):
                least[0] = low[2]
            differs = doc != least[group]
            other, known = np.zeros(len(least), np.int64), np.zeros(len(least), bool)
            d = np.flatnonzero(differs)[::-1]
            other[group[d]], known[group[d]] = doc[d], True  # the first of each group stays
            if last is not None and not known[-1]:
                other[-1], known[-1] = last, True
            hit = differs | known[group]
            found = np.where(differs, least[group], other[group])[hit]
            columns = [pa.array(doc[hit]), pa.array(h[hit]), pa.array(pos[hit].astype(np.int32)), pa.array(found)]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "start", "other_id"]), (k[-1], c[-1], least[-1])

        for batch in batches:
            now = tuple(x.to_numpy() for x in batch.columns)
            if not len(now[0]):
                continue
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now))
            k, c, doc, _, _ = now
            start = int(np.argmax((k == k[-1]) & (c == c[-1])))
            least = low[2] if not start and low is not None and low[:2] == (k[-1], c[-1]) else doc[start]
            # rows of one doc_id wait for another one
            cut = start if doc[-1] == least else len(k)
            held = tuple(x[cut:] for x in now) if cut < len(k) else None
            if cut:
                found, low = decide(tuple(x[:cut] for x in now), low, None)
                yield found
        if held is not None:
            yield decide(held, low, follows.get(task))[0]

    return run


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping or touching spans of a text as one; other_id: the least text it shares."""
    for batch in (b for b in batches if b.num_rows):
        lists = batch.column(1)
        spans = lists.flatten()
        row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
        start, other = (spans.field(n).to_numpy(zero_copy_only=False) for n in ("start", "other_id"))
        order = np.lexsort((start, row))
        row, start, other = row[order], start[order], other[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + PASSAGE)]))
        last = np.append(new[1:], len(row)) - 1
        own = pa.array(row[new])
        columns = [batch.column(0).take(own), pa.array(start[new]), pa.array(start[last] + np.int32(PASSAGE)), pa.array(np.minimum.reduceat(other, new)), batch.column(2).take(own)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start_word", "end_word", "other_id", "h"])


def repeated_passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, other_id): words of doc_id, by number, that other_id has too, 50 or more in a row.

    Words are what stands between ASCII white space. Each side of a repeat has its row; spans of one document that
    overlap or touch are one span. Equal texts of 50 words or more repeat as a whole: each copy with the least doc_id,
    that one with the next. Repeats within one document only, null and short texts, and rows with null doc_id give
    nothing; rows that repeat a doc_id and its text count
    once, each of several texts under one doc_id for itself, an empty table gives an empty result, other columns are ignored."""
    spark = docs.sparkSession
    prepare(spark)
    n = 2 * partitions(spark)
    given = docs.where(F.col("doc_id").isNotNull() & F.col(text).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("_t"))
    entries = written(given.mapInArrow(_entries, "g long, h long, pos int, doc_id long"))
    # written, so that both sides of the join are plain exchanges and a seed of many texts can be split
    place = F.struct("h", "pos")
    seeds = written(entries.groupBy("g").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low != high").select("g"))
    # copies of a place are one row: the texts that are equal take part once
    places = entries.join(seeds, "g").groupBy("h", "pos").agg(F.min("doc_id").alias("doc_id"))
    positions = places.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("pos")).alias("_p"))
    rows = given.join(positions, ["doc_id", "h"]).select("doc_id", "_t", "_p", "h")
    order = ["k", "c", "doc_id", "h", "pos"]
    windows = rows.mapInArrow(_windows, "k long, c long, doc_id long, pos int, h long")
    windows = durable(windows.repartitionByRange(n, *order).sortWithinPartitions(*order))
    matches = windows.mapInArrow(_shared(*_groups_across(windows)), "doc_id long, h long, start int, other_id long")
    grouped = matches.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "other_id")).alias("_s"))
    partial = grouped.select("doc_id", "_s", "h").mapInArrow(_union, "doc_id long, start_word int, end_word int, other_id long, h long")
    # whole copies: two hashes of the text, its least and its next doc_id
    sized = written(given.select("doc_id", "h", "_t", F.xxhash64("_t", F.lit(1)).alias("h2")).mapInArrow(_sized, "doc_id long, h long, h2 long, n int"))
    least = written(sized.groupBy("h", "h2", "n").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high"))
    # written first, so that both sides of the join are plain exchanges and a large group of copies can be split
    copies = sized.join(least, ["h", "h2", "n"])
    other = F.when(F.col("doc_id") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    whole = copies.select("doc_id", "h", F.lit(0).alias("start_word"), F.col("n").alias("end_word"), other.alias("other_id")).distinct()
    return partial.join(whole.select("doc_id", "h"), ["doc_id", "h"], "left_anti").unionByName(whole).drop("h")
