"""Benchmark items found in documents, by CGK embedding and bit-sampling LSH over item-sized windows.

Texts are compared as words (A-Z lower-cased, ASCII signs dropped) under edit distance: an item of n words is found
where a window is within n // 5 edits, a similarity of 0.8 or more. All in one pass over each document:
1. The CGK walk embeds words in a string of symbols: at each step the word under the cursor is copied, and a random
   function of step and word says whether the cursor moves on. An edit changes the walk only until both cursors meet
   again, so strings at a small edit distance are at a small Hamming distance.
2. A walk is begun at every word of an item, and at every word of a document: the walks of windows of all item sizes
   are then the same ones, made once. Each of WALKS independent walks is sampled at a few steps (bit-sampling LSH); the
   sampled symbols are the key of a bucket. The items' keys, with the item and the word where the walk began, make one
   bucket table a walk; a document's keys are looked up in it by array operations. A hit at a word of the document says
   where the item-sized window would begin.
3. Windows that share a bucket are candidates, one an item and stretch of n // 5 + 1 starts. Those with fewer words of
   the item than n // 5 edits leave can't match and go; the others are verified by the exact edit distance with free
   ends, many at once.

Items are sent to all tasks in blocks of bounded bytes; a benchmark of any size is read in as many passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.base import any_names, prepare
from corpusloom.llm.quality import _SIGN
from corpusloom.llm.textkit import Words, mix

BLOCK_BYTES = 1 << 20
WALKS = 8
SAMPLED = (0, 2, 4)  # steps of a walk
SHORT, WHOLE = 10, 5  # items of fewer words: keys of two words do; keys of the first word alone do
WALKED = 1 << 14  # walks made together
EXPANDED = 1 << 20  # candidates looked at together
CELLS = 1 << 17  # of a batch's region matrix: at most so many rows of it are verified together


def edits_allowed(n):
    return n // 5


def walk_keys(hashes: np.ndarray, last: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A walk from every word: the key of its sampled symbols, and how many different words these are.

    last: the last word that a walk from each word may reach; a walk that runs past it has 0 words."""
    keys, words = np.empty(len(hashes), np.uint64), np.empty(len(hashes), np.int8)
    for a in range(0, len(hashes), WALKED):
        b = min(a + WALKED, len(hashes))
        own = hashes[a : b + SAMPLED[-1]]
        coins = mix(own ^ mix(np.full(1, seed + 1, np.uint64)))
        end = last[a:b] - a
        here = at = np.arange(b - a)
        key, seen = np.zeros(b - a, np.uint64), np.ones(b - a, np.int8)
        for step in range(SAMPLED[-1] + 1):
            if step in SAMPLED:
                key = mix(key ^ own[at]) + np.uint64(step)
                seen += at != here
                here = at
            if step < SAMPLED[-1]:
                at = at + ((coins[at] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
                seen[at > end] = -100
                at = np.minimum(at, end)
        keys[a:b], words[a:b] = key, np.maximum(seen, 0)
    return keys, words


def first_keys(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes + np.uint64(17))


def edit_distances(items: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row, the least edits that turn the item into some stretch of the region, and the stretch."""
    rows, n = regions.shape
    place = np.arange(n + 1, dtype=np.int32)
    cost = np.zeros((rows, n + 1), np.int32)
    begin = np.broadcast_to(place, (rows, n + 1))
    for i in range(items.shape[1]):
        swap = cost[:, :-1] + (regions != items[:, i, None])
        drop = cost[:, 1:] + 1
        take = swap <= drop
        new, start = np.empty_like(cost), np.empty((rows, n + 1), np.int32)
        new[:, 0], start[:, 0] = i + 1, 0
        new[:, 1:], start[:, 1:] = np.where(take, swap, drop), np.where(take, begin[:, :-1], begin[:, 1:])
        # words of the region that the item lacks: the least of new[k] + (j - k) over k <= j
        slope = new - place
        low = np.minimum.accumulate(slope, axis=1)
        source = np.maximum.accumulate(np.where(slope == low, place, 0), axis=1)
        cost, begin = low + place, np.take_along_axis(start, source, axis=1)
    end = cost.argmin(axis=1)
    each = np.arange(rows)
    return cost[each, end], begin[each, end], end


def edit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    return tuple(int(x[0]) for x in edit_distances(item[None, :], region[None, :]))


@dataclass
class Items:
    """A block of items: ids, sizes, words one after another, and a bucket table for each walk (the last: first words).

    A table is sorted keys with item and word; `likely` has a bit set for each key's last bits, `own` for those of each
    word of an item mixed with the item's number."""

    ids: list
    sizes: np.ndarray
    starts: np.ndarray
    hashes: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    likely: list[np.ndarray]
    own: np.ndarray
    seed: int


def _bits(n: int) -> int:
    return 1 << max(12, int(16 * n).bit_length())


def _marked(codes: np.ndarray) -> np.ndarray:
    table = np.zeros(_bits(len(codes)), bool)
    table[codes & np.uint64(len(table) - 1)] = True
    return table


def _in(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[codes & np.uint64(len(table) - 1)]


def _own_code(item: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(item.astype(np.uint64)))


def index(ids: list, texts: list, seed: int = 7, walks: int = WALKS) -> Items:
    """Items without words are left out."""
    found = Words(pa.array(texts, pa.large_string()), lower=True, separators=_SIGN)
    hashes, sizes = found.hashes(), found.counts()
    kept = np.flatnonzero(sizes)
    sizes = sizes[kept]
    starts = np.cumsum(sizes) - sizes
    item = np.repeat(np.arange(len(sizes)), sizes)
    word = np.arange(len(hashes)) - starts[item]
    n = sizes[item]
    tables = []
    for r in range(walks):
        key, words = walk_keys(hashes, (starts + sizes - 1)[item], seed + r)
        at = np.flatnonzero((n >= WHOLE) & (words >= np.where(n < SHORT, 2, 3)))
        tables.append((key[at], item[at], word[at]))
    at = np.flatnonzero((n < WHOLE) & (word == 0))
    tables.append((first_keys(hashes[at]), item[at], word[at]))
    ordered = [tuple(x[np.argsort(t[0], kind="stable")] for x in t) for t in tables]
    return Items([ids[i] for i in kept], sizes, starts, hashes, ordered, [_marked(t[0]) for t in tables], _marked(_own_code(item, hashes)), seed)


def candidates(hashes: np.ndarray, first: np.ndarray, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, item, stretch of starts) that share a bucket, by parts; a part has no repeats."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    last = first[1:][doc] - 1
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for r, (keys, _, _) in enumerate(items.tables):
        if not len(keys):
            continue
        own = walk_keys(hashes, last, items.seed + r)[0] if r + 1 < len(items.tables) else first_keys(hashes)
        at = np.flatnonzero(_in(own, items.likely[r]))
        low, high = np.searchsorted(keys, own[at]), np.searchsorted(keys, own[at], side="right")
        met = high > low
        hits.append((np.full(met.sum(), r), at[met], np.stack([low[met], high[met]], axis=1).reshape(-1, 2)))
    if not hits:
        return
    table, position, ranges = (np.concatenate(x) for x in zip(*hits))
    order = np.argsort(position, kind="stable")  # what concerns one stretch is in one part, mostly
    table, position, ranges = table[order], position[order], ranges[order]
    many = ranges[:, 1] - ranges[:, 0]
    part = (np.cumsum(many) - many) // EXPANDED
    offset = np.cumsum([0, *[len(t[0]) for t in items.tables]])
    all_item, all_word = (np.concatenate([t[i] for t in items.tables]) for i in (1, 2))
    for cut in np.split(np.arange(len(many)), np.flatnonzero(np.diff(part)) + 1):
        if not len(cut):
            continue
        count = many[cut]
        ends = np.cumsum(count)
        row = np.repeat(offset[table[cut]] + ranges[cut, 0] - ends + count, count) + np.arange(ends[-1])
        item = all_item[row]
        place = np.repeat(position[cut], count)
        d = doc[place]
        start = place - all_word[row] - first[d] + items.sizes[item]  # from the document's first word on, never negative
        cell = start // (edits_allowed(items.sizes[item]) + 1)
        code = np.unique((d * len(items.ids) + item) * (len(hashes) + int(items.sizes.max()) + 1) + cell)
        pair, cell = np.divmod(code, len(hashes) + int(items.sizes.max()) + 1)
        yield pair // len(items.ids), pair % len(items.ids), cell


def verified(hashes: np.ndarray, first: np.ndarray, items: Items, doc: np.ndarray, item: np.ndarray, cell: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, item, edits, start, end) of candidates within reach of one size of items; words counted over the batch."""
    padded = np.append(hashes, np.uint64(0))
    for n in np.unique(items.sizes[item]).tolist():
        k = edits_allowed(n)
        of_size = np.flatnonzero(items.sizes[item] == n)
        width = n + 3 * k
        for at in np.array_split(of_size, -(-len(of_size) * width // CELLS)):
            d, i = doc[at], item[at]
            begin = first[d] - n + cell[at] * (k + 1) - k
            places = begin[:, None] + np.arange(width + 1)
            inside = (places >= first[d][:, None]) & (places < first[d + 1][:, None])
            region = padded[np.where(inside, places, len(hashes))]
            # n - k or more words of the region are the item's
            shared = (_in(_own_code(i[:, None], region), items.own) & inside).sum(axis=1)
            rest = np.flatnonzero(shared >= n - k)
            if not len(rest):
                continue
            words = items.hashes[items.starts[i[rest]][:, None] + np.arange(n)]
            cost, s, e = edit_distances(words, np.where(inside[rest], region[rest], ~words[:, :1]))
            near = (cost <= k) & (e > s)
            chosen = rest[near]
            low, high = first[d[chosen]], first[d[chosen] + 1]  # words beyond the text, put for words it lacks, aren't its own
            yield d[chosen], i[chosen], cost[near], np.maximum(begin[chosen] + s[near], low), np.minimum(begin[chosen] + e[near], high)


def find(texts: pa.Array, items: Items) -> list[tuple[int, object, int, int, int, int]]:
    """(row of texts, item id, edits, words of the item, start and end byte) of the best match of each item per text."""
    found = Words(texts, lower=True, separators=_SIGN)
    hashes = found.hashes()
    if not len(hashes) or not items.ids:
        return []
    parts = [x for c in candidates(hashes, found.first, items) for x in verified(hashes, found.first, items, *c) if len(x[0])]
    if not parts:
        return []
    doc, item, edits, start, end = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((end, start, edits, item, doc))
    doc, item, edits, start, end = (x[order] for x in (doc, item, edits, start, end))
    best = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
    base = found.offsets[doc[best]]
    columns = (doc[best], edits[best], items.sizes[item[best]], found.starts[start[best]] - base, found.ends[end[best] - 1] - base)
    d, e, n, a, b = (x.tolist() for x in columns)
    return list(zip(d, (items.ids[i] for i in item[best].tolist()), e, n, a, b))


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Items]:
    """The items, in blocks of about block_bytes bytes of text."""
    block, size = [], 0
    for row in benchmark.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        block.append(row)
        size += len(row["text"]) + 64
        if size >= block_bytes:
            yield index([r["item_id"] for r in block], [r["text"] for r in block])
            block, size = [], 0
    if block:
        yield index([r["item_id"] for r in block], [r["text"] for r in block])


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, edits, item_words, start_byte, end_byte): for each document and item its best match.

    The best match has the fewest edits; of equal ones the first counts. Null, empty and sign-only texts match nothing, on
    either side; items that repeat match each by its id; rows that repeat a doc_id have a row each. Without documents or
    items the result is empty; other columns are ignored. Items of fewer than five words are found only unchanged."""
    spark = docs.sparkSession
    prepare(spark)
    schema = "doc_id long, item_id long, edits int, item_words int, start_byte long, end_byte long"
    slim = docs.where(F.col(text).isNotNull()).select(F.col("doc_id").cast("long"), F.col(text).alias("_t"))
    result = spark.createDataFrame([], schema)
    for items in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = find(batch.column(1), shared.value)
                d, item, edits, n, start, end = zip(*rows) if rows else [()] * 6
                ids = batch.column(0).take(pa.array(d, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(item, pa.int64()), pa.array(edits, pa.int32()), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "item_id", "edits", "item_words", "start_byte", "end_byte"])

        result = result.union(slim.mapInArrow(run, schema))
    return result


@any_names("text")
def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs whose text holds no benchmark item; each row is decided by its own text, whatever its doc_id."""
    spark = docs.sparkSession
    prepare(spark)
    at = docs.columns.index(text)
    result = docs
    for items in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in find(batch.column(at), shared.value)]] = False
                yield batch.filter(pa.array(keep))

        result = result.mapInArrow(run, docs.schema)
    return result
