"""SimHash near-duplicates found through a segment-popcount embedding.

A fingerprint is embedded as the counts of set bits in its segments of 2 bits (a 64-bit word has 32 such fields). The
Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints. A grid over the embedding
serves the range join: points whose chosen fields are equal share a cell. Within a cell, the Manhattan bound is
tested, then the Hamming distance itself.

`links` is complete: the fields form `radius + kept` blocks; embeddings within Manhattan distance `radius` differ in at
most `radius` blocks, so they share the cell of at least one choice of `kept` blocks. More blocks are kept the more
points there are, so that cells of unrelated points stay small.
`wide_links` is for radii at which that takes too many grids: fingerprints of 256 bits in two levels of grids whose fields
are chosen at random. The first level's cells are what a task takes at once, some thousand points; within each, a second
level finds the pairs without another shuffle. Each level has as many grids as find a pair at the radius itself with the
recall asked for, for any number of points, closer pairs more surely.

Equal fingerprints are one point, so groups of copies cost nothing. A cell with more than `cell_rows` points is
cut in chunks, and pairs of chunks are compared by different tasks; a comparison returns a spanning forest of its
points instead of all pairs, which keeps every component and grows with the points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.base import any_names, durable, partitions, prepare
from corpusloom.llm.components import components
from corpusloom.llm.textkit import Words, mix, shingles

FIELD = 0x5555555555555555
CELL_ROWS = 2048
FIELD_BITS = 1.5  # what a field tells of a random fingerprint
WIDE = 4  # words of a wide fingerprint
WIDE_RADIUS = 46  # of 256 bits: texts of similarity 0.8 differ in 39 of these on average, and in 46 or fewer nine times of ten
WIDE_RECALL = 0.92  # at the radius
WIDE_CELL_ROWS = 1 << 17  # points of a cell of the first level that one task takes
SUBCELL = 64  # unrelated points that meet in a cell of the second level
SHINGLES = 1 << 15  # whose bits are counted together


def fingerprint(text: str | None, width: int = 4) -> int:
    """The fingerprint of one text, unsigned; `fingerprints` runs this over a table.

    Words are split at ASCII white space after lower-casing A-Z. A text of fewer words than `width` is one
    shingle; a text without words (or null) has fingerprint zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(words) - width + 1, 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:last].tolist(), ends[-last:].tolist())), np.uint64, last)
    bits = np.unpackbits(h.view(np.uint8).reshape(last, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > last, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp) with the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("_t")).mapInArrow(run, "doc_id long, fp long")


def wide_fingerprints(texts: pa.Array, width: int = 5) -> np.ndarray:
    """A row of WIDE words for each text, from hashes of its shingles; equal word sequences have equal rows.

    Words are those of `fingerprint`; a text without words has a row of zeros."""
    words = Words(texts, lower=True)
    hashes, first = shingles(words.hashes(), words.first, width)
    out = np.zeros((len(first) - 1, WIDE), np.uint64)
    filled = np.flatnonzero(np.diff(first))
    counts = np.zeros((len(first) - 1, WIDE * 64), np.int32)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for a in range(0, len(hashes), SHINGLES):
        own, of = hashes[a : a + SHINGLES], doc[a : a + SHINGLES]
        wide = np.stack([mix(own + np.uint64(w)) for w in range(WIDE)], axis=1)
        bits = np.unpackbits(wide.view(np.uint8).reshape(len(own), -1), axis=1, bitorder="little")
        new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        counts[of[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int32)
    many = np.diff(first)[filled]
    out[filled] = np.packbits(2 * counts[filled] > many[:, None], axis=1, bitorder="little").view(np.uint64)
    return out


def embedding(x: np.ndarray) -> np.ndarray:
    """Counts of set bits in each 2-bit segment, as 2-bit fields."""
    return x - ((x >> np.uint64(1)) & np.uint64(FIELD))


def manhattan(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Manhattan distance of embeddings: per field, the larger minus the smaller."""
    one, two = np.uint64(FIELD), np.uint64(FIELD << 1)
    # fields hold 0, 1 or 2; in unary (0, 1, 3) the distance is the number of differing bits
    unary = lambda v: (v & two) | (v & one) | ((v & two) >> np.uint64(1))
    return np.bitwise_count(unary(p) ^ unary(q))


def _linked(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Of rows of words: whether they are within the radius."""
    near = manhattan(embedding(x), embedding(y)).sum(axis=-1, dtype=np.int32) <= radius
    near &= np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int32) <= radius
    return near


def _forest(ids: np.ndarray, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among points, by their ids."""
    a, b, rest, front = [], [], np.arange(len(points)), []
    while len(rest) or front:
        if not front:
            front, rest = [rest[0]], rest[1:]
        at = front.pop()
        if not len(rest):
            continue
        near = _linked(points[rest], points[at], radius)
        hit = rest[near]
        a.append(np.full(len(hit), ids[at]))
        b.append(ids[hit])
        front += hit.tolist()
        rest = rest[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def blocks_kept(points: int, radius: int) -> int:
    """Blocks of a grid's cell: the fewest that leave few unrelated points in a cell."""
    wanted = math.log2(max(points, 2)) + 2
    return next((k for k in range(3, 6) if 32 * FIELD_BITS * k / (radius + k) >= wanted), 6)


def masks(radius: int, kept: int = 3) -> list[list[int]]:
    """Fields of each grid: every choice of `kept` of `radius + kept` blocks of segments."""
    blocks = [sum(3 << (2 * int(s)) for s in part) for part in np.array_split(np.arange(32), radius + kept)]
    return [[sum(choice)] for choice in combinations(blocks, kept)]


def random_masks(fields: int, share: float, recall: float, seed: int = 3) -> list[list[int]]:
    """Grids for wide fingerprints, each of `fields` fields: as many as find a pair that differs in a share of its bits with
    the recall asked for."""
    same = ((1 - share) ** 2 + share**2 / 2) ** fields  # all fields of a grid are equal
    rng, out = np.random.default_rng([seed, fields]), []
    for _ in range(math.ceil(math.log(1 - recall) / math.log(1 - same)) if fields else 1):
        chosen = rng.choice(32 * WIDE, fields, replace=False).tolist()
        out.append([sum(3 << 2 * (f % 32) for f in chosen if f // 32 == w) for w in range(WIDE)])
    return out


def coarse_fields(points: int) -> int:
    """Fields of the first level: its cells get 4,096 unrelated points, or up to 65,536 the more points there are, so that
    a point has fewer rows."""
    target = min(max(points / 64, 1 << 12), 1 << 16)
    return max(0, math.ceil(math.log2(max(points, 1) / target) / FIELD_BITS))


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of rows by key, where each key's run begins in it, and how long it is."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return order, at, np.diff(np.append(at, len(keys)))


def near_pairs(x: np.ndarray, radius: int, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions i, j) among points of one cell by the second level of grids; of dense groups a spanning forest."""
    fields = max(0, math.ceil(math.log2(max(len(x), 1) / SUBCELL) / FIELD_BITS))
    embedded, found = embedding(x), []
    for grid in random_masks(fields, radius / (64 * WIDE), recall, seed=11):
        key = np.zeros(len(x), np.uint64)
        for w, m in enumerate(grid):
            key = mix(key ^ (embedded[:, w] & np.uint64(m)))
        order, at, size = _groups(key)
        for g in np.flatnonzero(size > 1).tolist():
            own = order[at[g] : at[g] + size[g]]
            points = x[own]
            if size[g] <= 4 * SUBCELL:
                apart = np.bitwise_count(points[:, None, 0] ^ points[None, :, 0]).astype(np.int16)
                for w in range(1, WIDE):
                    apart += np.bitwise_count(points[:, None, w] ^ points[None, :, w])
                i, j = np.nonzero(np.triu(apart <= radius, 1))
                if len(i) <= 4 * size[g]:
                    if len(i):
                        found.append(np.stack([own[i], own[j]]))
                    continue
            found.append(np.stack(_forest(own, points, radius)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(found, axis=1)
    code = np.unique(np.minimum(i, j) * len(x) + np.maximum(i, j))
    return code // len(x), code % len(x)


def _words(ids: np.ndarray, rest: list[np.ndarray]) -> np.ndarray:
    """Rows of words; a point without words is its id."""
    return np.stack([c.view(np.uint64) for c in rest or [ids]], axis=1)


def _cells(radius: int, limit: int, near):
    """Over rows (grid, cell, id, words) sorted by cell: links of cells up to `limit` points, the points of larger ones.

    near(ids, words): links within a cell of more than 8 points."""

    def within(run: np.ndarray, size: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        group = np.repeat(np.arange(len(run)), size)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for shift in range(1, 8):  # cells of up to 8 points: pairs at each distance at once
            if len(x) <= shift:
                break
            i = np.flatnonzero((group[shift:] == group[:-shift]) & (size[group[shift:]] <= 8))
            i = i[_linked(x[i], x[i + shift], radius)]
            a.append(ids[i])
            b.append(ids[i + shift])
        for g in np.flatnonzero((size > 8) & (size <= limit)):
            own = slice(run[g], run[g] + size[g])
            for part, found in zip((a, b), near(ids[own], x[own])):
                part.append(found)
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        spilled = None  # the large cell whose points are being passed on

        def rows(kind: int, grid, a, b) -> pa.RecordBatch:
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(grid, np.int32) if kind else np.zeros(n, np.int32)), pa.array(a), pa.array(b)], names=["kind", "grid", "a", "b"])

        def close(now):
            if not len(now[0]):
                return
            at = np.flatnonzero(np.concatenate([[True], (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])]))
            size = np.diff(np.concatenate([at, [len(now[0])]]))
            a, b = within(at, size, now[2], _words(now[2], now[3:]))
            if len(a):
                yield rows(0, None, a, b)
            large = np.repeat(size, size) > limit
            if large.any():
                yield rows(1, *(x[large] for x in now[:3]))

        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if spilled is not None:
                more = (now[0] == spilled[0]) & (now[1] == spilled[1])
                if more.any():
                    yield rows(1, *(x[more] for x in now[:3]))
                    now = [x[~more] for x in now]
                spilled = spilled if more.all() else None
            if not len(now[0]):
                held = None
                continue
            other = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            tail = int(other[-1]) + 1 if len(other) else 0  # the last cell may go on in the next batch
            held = [x[tail:] for x in now]
            now = [x[:tail] for x in now]
            if len(held[0]) > limit:
                spilled = (held[0][0], held[1][0])
                yield rows(1, *held[:3])
                held = None
            yield from close(now)
        if held is not None:
            yield from close(held)

    return run


def _chunk_pairs(near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def close():
            now = [np.concatenate(x) for x in zip(*held)]
            a, b = near(now[0], _words(now[0], now[1:]))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            grid, cell, i, j, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cut = np.flatnonzero((grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for part in np.split(np.arange(len(grid)), cut):
                if not len(part):
                    continue
                at = (grid[part[0]], cell[part[0]], i[part[0]], j[part[0]])
                if key is not None and at != key:
                    yield close()
                    held = []
                key = at
                held.append([x[part] for x in rest])
        if held:
            yield close()

    return run


def _fields(x: Column) -> Column:
    """The embedding of a word: a field's low bit, if one of two bits is set; its high bit, if both are."""
    high = F.lit(_signed(FIELD << 1))
    return x.bitwiseXOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(FIELD)).bitwiseOR(x.bitwiseAND(F.shiftleft(x, 1)).bitwiseAND(high))


def _signed(m: int) -> int:
    return m - (1 << 64) if m >= 1 << 63 else m


def _join(points: DataFrame, words: list[str], grids: list[list[int]], radius: int, cell_rows: int, near=None) -> DataFrame:
    """Links (a, b) between ids of points (id, words; without words the id is the fingerprint) that share a cell of a grid
    and are within the radius: as many as connect what these links connect. near: see _cells; all points that are linked,
    unless it is given."""
    near = near or (lambda ids, x: _forest(ids, x, radius))
    n = 2 * partitions(points.sparkSession)
    embedded = points.select("id", *words, *[_fields(F.col(w)).alias(f"_e{i}") for i, w in enumerate(words or ["id"])])
    parts = lambda grid: [F.col(f"_e{i}").bitwiseAND(F.lit(_signed(m))) for i, m in enumerate(grid)]
    cell = lambda grid: parts(grid)[0] if len(grid) == 1 else F.xxhash64(*parts(grid))
    keys = F.array(*[F.struct(F.lit(i).alias("grid"), cell(grid).alias("cell")) for i, grid in enumerate(grids)])
    cells = embedded.select("id", *words, F.explode(keys).alias("k")).select("k.grid", "k.cell", "id", *words)
    sorted_cells = cells.repartition(n, "grid", "cell").sortWithinPartitions("grid", "cell", "id")
    found = durable(sorted_cells.mapInArrow(_cells(radius, cell_rows, near), "kind int, grid int, a long, b long"))
    direct = found.where("kind = 0").select("a", "b")
    # cells beyond cell_rows: every pair of chunks of at most about half that size is one group
    hot = found.where("kind = 1").select("grid", F.col("a").alias("cell"), F.col("b").alias("id"))
    sizes = hot.groupBy("grid", "cell").agg(F.ceil(F.count("*") / F.lit(cell_rows / 2)).cast("int").alias("chunks"))
    chunked = hot.join(sizes, ["grid", "cell"]).withColumn("c", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    if words:
        chunked = chunked.join(points, "id")
    paired = chunked.select("grid", "cell", "id", *words, F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, F.col("c")).alias("i"), F.greatest(o, F.col("c")).alias("j")))).alias("p"))
    paired = paired.select("grid", "cell", "p.i", "p.j", "id", *words).repartition(n, "grid", "cell", "i", "j").sortWithinPartitions("grid", "cell", "i", "j", "id")
    return direct.union(paired.mapInArrow(_chunk_pairs(near), "a long, b long"))


def links(points: DataFrame, radius: int = 4, cell_rows: int = CELL_ROWS, kept: int | None = None) -> DataFrame:
    """Links (a, b) that connect what fingerprints (column fp, distinct) at `radius` or fewer differing bits connect."""
    kept = kept or blocks_kept(points.count(), radius)
    return _join(points.select(F.col("fp").alias("id")), [], masks(radius, kept), radius, cell_rows)


def wide_links(points: DataFrame, radius: int = WIDE_RADIUS, recall: float = WIDE_RECALL, cell_rows: int = WIDE_CELL_ROWS) -> DataFrame:
    """Links (a, b) between ids of wide fingerprints (id, w0 to w3, distinct) within `radius` of 256 bits.

    Pairs that differ in `radius` bits are found with the recall asked for whatever the number of points, closer ones
    more surely; no other pairs are linked."""
    words = [f"w{i}" for i in range(WIDE)]
    each = math.sqrt(recall)

    def near(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = near_pairs(x, radius, each)
        return ids[i], ids[j]

    grids = random_masks(coarse_fields(points.count()), radius / (64 * WIDE), each)
    return _join(points.select("id", *words), words, grids, radius, cell_rows, near)


def _named(points: DataFrame, found: DataFrame) -> DataFrame:
    """points (id, least) with component_id, the smallest `least` of those that the links join."""
    roots = components(found).select(F.col("node").alias("id"), "root")
    # written, so that both sides of the joins are plain exchanges and a large component or group of copies can be split
    classed = durable(points.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"), "least"))
    named = durable(classed.groupBy("root").agg(F.min("least").alias("component_id")))
    return durable(classed.join(named, "root").select("id", "component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", radius: int = 4, width: int = 4, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id: least doc_id among documents reachable over links. Rows with null doc_id get their class's least
    non-null id, null if it has none. Null and empty texts have fingerprint zero and link like any other; repeated
    rows come back as often as they come in; an empty table gives an empty result; other columns are ignored."""
    prepare(docs.sparkSession)
    marked = durable(fingerprints(docs, text, width))
    points = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = _named(points.withColumnRenamed("fp", "id"), links(points, radius, cell_rows))
    return marked.join(named.withColumnRenamed("id", "fp"), "fp").select("doc_id", "fp", "component_id")


def _row_hash(docs: DataFrame) -> Column:
    """A hash of the row's columns, those of types that can't be hashed apart."""
    return F.xxhash64(*[docs[c] for c, t in docs.dtypes if "map" not in t and "variant" not in t])


def wide_marks(docs: DataFrame, text: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, h, id, w0 to w3) for every row of docs: its hash, its wide fingerprint and that one's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = wide_fingerprints(batch.column(2), width)
            ids = np.zeros(len(found), np.uint64)
            for w in range(WIDE):
                ids = mix(ids ^ found[:, w]) + np.uint64(w)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (ids, *found.T)]], names=["doc_id", "h", "id", *[f"w{i}" for i in range(WIDE)]])

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _row_hash(docs).alias("h"), docs[text].alias("_t"))
    return slim.mapInArrow(run, "doc_id long, h long, id long, " + ", ".join(f"w{i} long" for i in range(WIDE)))


@any_names("doc_id", "text")
def drop_near_duplicates(docs: DataFrame, text: str = "text", width: int = 5, radius: int = WIDE_RADIUS, recall: float = WIDE_RECALL, cell_rows: int = WIDE_CELL_ROWS) -> DataFrame:
    """One row of each class of near duplicates: that with the least doc_id, of several that with the least row hash.

    Texts are linked if their wide fingerprints differ in `radius` or fewer of 256 bits; pairs at the radius itself are found
    with the recall given, closer ones more surely, in tables of any size. Null ids come last; null and
    empty texts are one class; of rows that are equal in every column one stays; each of several texts under one doc_id
    is decided for itself; an empty table gives an empty result."""
    prepare(docs.sparkSession)
    marked = durable(wide_marks(docs, text, width))
    points = durable(marked.groupBy("id", *[f"w{i}" for i in range(WIDE)]).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("least")))
    named = _named(points.select("id", "least"), wide_links(points, radius, recall, cell_rows))
    counts = marked.groupBy("doc_id", "h").agg((F.count("*") > 1).alias("_again"))
    first = named.select(F.col("component_id.doc_id").alias("_id"), F.col("component_id.h").alias("_h")).distinct()
    leaders = first.join(counts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    # written, so that both sides of the join are plain exchanges and rows that repeat can be split
    leaders = durable(leaders.select("_id", "_h", "_again"))
    rows = docs.select(docs["doc_id"].cast("long").alias("_d"), _row_hash(docs).alias("_r"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    kept = rows.join(leaders, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_r") == F.col("_h")))
    one = kept.where("_again").groupBy("_d", "_r").agg(F.first("_row").alias("_row"))  # a row a task and key
    return kept.where("not _again").select("_row").union(one.select("_row")).select("_row.*")
