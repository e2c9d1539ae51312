"""Bottom-k sketches of documents' shingles.

A sketch is the k least distinct 40-bit hashes of a text's shingles of five words (A-Z lower-cased), ascending. Sketches
of parts merge to the sketch of the whole, and estimate resemblance, containment and the number of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.base import prepare
from corpusloom.llm.ranges import in_order, with_next
from corpusloom.llm.textkit import Words, shingles

K, WIDTH, BITS = 128, 5, 40


def sketches(texts: pa.Array, k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    """The sketch of each text; a text of fewer words than width is one shingle, one without words has no hashes."""
    words = Words(texts, lower=True)
    hashes, first = shingles(words.hashes(), words.first, width)
    hashes >>= np.uint64(64 - BITS)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        own = hashes[a:b]
        if len(own) > 4 * k:  # the least hashes of many, with room for repeats
            low = np.unique(np.partition(own, 2 * k)[: 2 * k])
            if len(low) >= k:
                out.append(low[:k])
                continue
        out.append(np.unique(own)[:k])
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both parts."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness: the share of the union's k least hashes that both have; 1 for two empty texts."""
    both = np.sort(np.concatenate([a, b]))
    if not len(both):
        return 1.0
    twice = np.concatenate([both[1:] == both[:-1], [False]])
    distinct = np.concatenate([[True], both[1:] != both[:-1]])
    end = np.flatnonzero(distinct)[:k]
    return float(twice[end].sum() / len(end))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << BITS) / (float(a[k - 1]) + 1.0)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    n = distinct_shingles(a, k)
    return min(1.0, resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / n) if n else 1.0


def to_text(sketch: np.ndarray) -> str:
    """Ten hex digits a hash."""
    return sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.array([int(text[i : i + 10], 16) for i in range(0, len(text), 10)], np.uint64)


def fingerprint(docs: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """(doc_id, fingerprint) of every row of docs; null texts count as empty and have an empty fingerprint."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_text(s) for s in sketches(batch.column(1), k)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("_t")).mapInArrow(run, "doc_id long, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """The last half of the text's code points replaced by as many of the next text's first, or by all of it."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def edited_fingerprints(docs: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """For every row of docs, by ascending doc_id: its own sketch, that of its edited text, and likenesses.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts count
    as empty. Null ids come first; rows that repeat a doc_id follow each other by a hash of their text, and are spread over
    tasks by it. After the last row comes the first, so a table of one row edits it with itself. An empty table gives an empty result."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, following in with_next(batches):
            edited = [edited_text(t, f) for t, f in zip(texts, following)]
            own, new = sketches(pa.array(texts, pa.large_string()), k), sketches(pa.array(edited, pa.large_string()), k)
            # the next row's sketch is mostly the next one here
            apart = [i for i in range(len(texts)) if i + 1 == len(texts) or texts[i + 1] is not following[i]]
            after = [*own[1:], None]
            for i, s in zip(apart, sketches(pa.array([following[i] for i in apart], pa.large_string()), k)):
                after[i] = s
            columns = [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([to_text(s) for s in own], pa.string()),
                pa.array([to_text(s) for s in new], pa.string()),
                pa.array([resemblance(a, b, k) for a, b in zip(own, new)], pa.float64()),
                pa.array([resemblance(a, b, k) for a, b in zip(own, after)], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return in_order(docs, text).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
