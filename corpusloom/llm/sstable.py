"""Token ids in sorted-string-table shards.

Layout of a shard: data blocks, sparse index, Bloom filter, footer; all integers little-endian.
- data block: entries in key order, then the crc32 of what is before it. An entry is three varints (bytes of the key
  shared with the entry before it in the block, bytes that are not, bytes of the value), the rest of the key, the value.
- key: doc_id as 8 bytes, big-endian with the sign bit flipped, so that bytes sort as ids do; a null doc_id is the
  empty key, which sorts first. Repeated ids are repeated entries.
- value: ids as unsigned 16-bit integers, the end id included.
- index: per block, varint key length, first key, then offset and length (8 and 4 bytes).
- Bloom filter: bits of 7 probes by double hashing, about 10 bits a key.
- footer (60 bytes): offset and length of index and filter, entries, tokens, blocks (8, 8, 8, 8, 8, 8, 4 bytes), magic.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.llm import files
from corpusloom.llm.base import durable, partitions, prepare, shared_dir
from corpusloom.llm.tokens import encoder

MAGIC = b"LOOMSST1"
FOOTER = struct.Struct("<QQQQQQI8s")
BLOCK_BYTES = 1 << 16
PROBES = 7
MANIFEST = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return (low[:, None] + high[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


class Writer:
    """Entries in key order to one shard; holds one block, the index and 8 bytes a key."""

    def __init__(self, sink):
        self.sink, self.at, self.block, self.previous = sink, 0, bytearray(), b""
        self.index, self.first, self.hashes, self.tokens = bytearray(), None, [], 0
        self.blocks = 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.first is None:
            self.first, self.previous = key, b""
        shared = 0
        while shared < len(key) and shared < len(self.previous) and key[shared] == self.previous[shared]:
            shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.previous = key
        self.hashes.append(xxhash.xxh64_intdigest(key))
        self.tokens += len(value) // 2
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.first is None:
            return
        self.block += struct.pack("<I", zlib.crc32(self.block))
        self.sink.write(bytes(self.block))
        self.index += varint(len(self.first)) + self.first + struct.pack("<QI", self.at, len(self.block))
        self.at += len(self.block)
        self.block, self.first, self.blocks = bytearray(), None, self.blocks + 1

    def close(self) -> None:
        self._end_block()
        bits = max(64, 10 * len(self.hashes) + 7 & ~7)
        bloom = np.zeros(bits, np.uint8)
        for i in range(0, len(self.hashes), 1 << 16):
            bloom[_probes(np.array(self.hashes[i : i + (1 << 16)], np.uint64), bits).ravel()] = 1
        bloom = np.packbits(bloom, bitorder="little").tobytes()
        self.sink.write(bytes(self.index))
        self.sink.write(bloom)
        self.sink.write(FOOTER.pack(self.at, len(self.index), self.at + len(self.index), len(bloom), len(self.hashes), self.tokens, self.blocks, MAGIC))
        self.sink.close()


class Reader:
    """One shard, read by block."""

    def __init__(self, uri: str):
        system, path = files.at(uri)
        self.source = system.open_input_file(path)
        size = self.source.size()
        footer = self.source.read_at(FOOTER.size, size - FOOTER.size)
        self.index_at, self.index_n, self.bloom_at, self.bloom_n, self.entries, self.tokens, self.blocks, magic = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't a whole shard")
        data, at = self.source.read_at(self.index_n, self.index_at), 0
        self.keys, self.places = [], []
        for _ in range(self.blocks):
            n, at = read_varint(data, at)
            self.keys.append(data[at : at + n])
            self.places.append(struct.unpack_from("<QI", data, at + n))
            at += n + 12

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        at, n = self.places[i]
        data = self.source.read_at(n, at)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block is damaged")
        at, key = 0, b""
        while at < n - 4:
            shared, at = read_varint(data, at)
            own, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            yield key, data[at + own : at + own + size]
            at += own + size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(self.blocks):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids stored under doc_id: Bloom filter, binary search of the index, then its blocks."""
        key = key_of(doc_id)
        bloom = np.frombuffer(self.source.read_at(self.bloom_n, self.bloom_at), np.uint8)
        probes = _probes(np.array([xxhash.xxh64_intdigest(key)], np.uint64), 8 * len(bloom))[0]
        if not all(bloom[int(p) >> 3] >> (int(p) & 7) & 1 for p in probes):
            return []
        found, i = [], max(bisect_right(self.keys, key) - 1, 0)
        while i > 0 and self.keys[i] == key:  # repeated entries may start in the block before
            i -= 1
        while i < self.blocks and self.keys[i] <= key:
            found += [np.frombuffer(v, "<u2") for k, v in self.block(i) if k == key]
            i += 1
        return found


def write_shards(docs: DataFrame, path: str, end_id: int = 0, text: str = "text", shards: int | None = None) -> DataFrame:
    """Encode and write docs in ascending doc_id order; the manifest (shard, path, n_docs, n_tokens, start).

    path: a tokenizers vocabulary file. start: ids in all shards before. Null texts count as empty and hold the end
    id alone. An empty table has a manifest without rows. Other columns are ignored."""
    spark = docs.sparkSession
    prepare(spark)
    folder = files.fresh(shared_dir(spark), "sst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, writer, end = TaskContext.get().partitionId(), None, struct.pack("<H", end_id)
        uri = files.attempt(folder, task, "sst")
        for batch in batches:
            if batch.num_rows and writer is None:
                system, where = files.at(uri)
                writer = Writer(system.open_output_stream(where))
            for doc, ids in zip(batch.column(0).to_pylist(), encoder(path).encode_each(batch.column(1))):
                writer.add(key_of(doc), ids + end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": task, "path": uri, "n_docs": len(writer.hashes), "n_tokens": writer.tokens}], MANIFEST)

    # rows of one or of no doc_id lie in the order of a hash of their text, and are cut over ranges by it
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].alias("_t"), F.xxhash64(docs[text]).alias("_h"))
    ranges = slim.repartitionByRange(shards or 2 * partitions(spark), "doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "_t")
    manifest = durable(ranges.mapInArrow(run, "shard int, path string, n_docs long, n_tokens long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every entry: ids before it, ids in it, crc32 of them as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = []
                for key, value in Reader(uri).scan():
                    ids = np.frombuffer(value, "<u2")
                    out.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 10_000:
                        yield rows(out)
                        out = []
                if out:
                    yield rows(out)

    spread = manifest.select("path", "start").repartition(2 * partitions(manifest.sparkSession))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
