"""Documents in ascending order over many tasks, each row beside the next one.

Rows are cut into ranges of doc_id with bounds from the ids' own quantiles, and those of an id that many rows share into
ranges of a hash of their text: a function of the row alone. The first row
of each range is also sent to the range before it (that of the first range to the last), so that a task sees every
row of its ranges and the one that follows, without a global window or a second pass over the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from corpusloom.llm.base import partitions

NULL_ID = -(1 << 63)


def _ranges(quantiles: list[int]) -> Callable[[pd.Series, pd.Series], np.ndarray]:
    """The range of an id and a hash. An id that is m quantiles at once is cut in m ranges, evenly by hash."""
    bounds, many = np.unique(np.array(quantiles, np.int64), return_counts=True)
    before = np.concatenate([[0], np.cumsum(many)])
    step = np.uint64((1 << 64) - 1) // many.astype(np.uint64)

    def of(ids: pd.Series, hashes: pd.Series) -> np.ndarray:
        ids, place = ids.to_numpy(np.int64), hashes.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        at = np.searchsorted(bounds, ids)
        found = before[at]
        hit = np.flatnonzero(at < len(bounds))
        hit = hit[bounds[at[hit]] == ids[hit]]
        found[hit] += np.minimum(place[hit] // step[at[hit]] + np.uint64(1), many[at[hit]].astype(np.uint64)).astype(np.int64)
        return found

    return of


def in_order(docs: DataFrame, text: str = "text", ranges: int | None = None) -> DataFrame:
    """(doc_id, text, range, extra): partitioned by range and sorted, extra rows last; null ids come first.

    Rows of one or of no doc_id lie in the order of a hash of their text."""
    n = ranges or 4 * partitions(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    quantiles = docs.select(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000).alias("b")).first()["b"] if n > 1 else []
    number = _ranges(quantiles or [])

    @pandas_udf("int")
    def range_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(number(ids, hashes).astype(np.int32))

    rows = docs.select(key.alias("_k"), F.xxhash64(F.col(text)).alias("_h"), F.col(text).alias("_t"))
    least = rows.select("_k", "_h").withColumn("r", range_of("_k", "_h")).groupBy("r").agg(F.min(F.struct("_k", "_h")).alias("least"))
    heads = sorted((r["r"], tuple(r["least"])) for r in least.collect())  # one row a range
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}

    @pandas_udf("array<int>")
    def ranges_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        own = (2 * number(ids, hashes)).tolist()
        also = [before.get(row) for row in zip(ids.tolist(), hashes.tolist())]
        return pd.Series([[a] if b is None else [a, 2 * b + 1] for a, b in zip(own, also)])

    placed = rows.withColumn("_r", F.explode(ranges_of("_k", "_h"))).select(F.col("_k").alias("doc_id"), "_h", F.col("_t").alias("text"), F.shiftright("_r", 1).alias("range"), (F.col("_r") % 2).alias("extra"))
    ordered = placed.repartition(2 * partitions(docs.sparkSession), "range").sortWithinPartitions("range", "extra", "doc_id", "_h", "text")
    return ordered.select("doc_id", "text", "range", "extra")


def with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """Of in_order's batches: ids, texts and the texts that follow."""
    held: tuple | None = None
    for batch in batches:
        ids, texts, ranges, extra = (c.to_pylist() for c in batch.columns)
        if held is not None:
            ids, texts, ranges, extra = [held[0], *ids], [held[1], *texts], [held[2], *ranges], [held[3], *extra]
        take = [i for i in range(len(ids) - 1) if not extra[i] and ranges[i] == ranges[i + 1]]
        if ids:
            held = (ids[-1], texts[-1], ranges[-1], extra[-1])
        if take:
            yield [None if ids[i] == NULL_ID else ids[i] for i in take], [texts[i] or "" for i in take], [texts[i + 1] or "" for i in take]
