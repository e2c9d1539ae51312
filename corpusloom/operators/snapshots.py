"""Versions of watched pages: numbering, retention, reading as of a time, changes of lines and of fields.

Snapshots are rows (key, ts, hash, text, ...); the order is that of ts, whatever the order of arrival.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.web import content_lines
from corpusloom.operators.linediff import hunks
from corpusloom.shipping import pieces, ship

TOLERANCE, KEEP_VERSIONS, KEEP_DAYS, DIFF_LINES, CHANGES = 1e-4, 20, 90, 40, 20


def newest(key: str = "key", ts: str = "ts", tie: str | None = None):
    return Window.partitionBy(key).orderBy(F.desc(ts), *([F.desc(tie)] if tie else []))


def versions(snapshots: DataFrame, key: str = "key", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """With version: 1 for the newest of a key, and so on."""
    return snapshots.withColumn("version", F.row_number().over(newest(key, ts, tie)))


def retained(snapshots: DataFrame, now: Column, keep: int = KEEP_VERSIONS, days: int = KEEP_DAYS, key: str = "key", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The newest `keep` versions that are no older than `days` (0 or less: of any age); ts in seconds."""
    young = F.lit(True) if days <= 0 else F.col(ts) >= now - days * 86400
    return versions(snapshots, key, ts, tie).where((F.col("version") <= keep) & young)


def as_of(snapshots: DataFrame, moments: DataFrame, key: str = "key", ts: str = "ts", at: str = "at", values: tuple[str, ...] = ("hash",)) -> DataFrame:
    """For each (key, at) the values of the newest snapshot not after it (0.1 ms tolerance), null before the first.

    One sort-merge of both tables by key and time: snapshots and moments are laid in one order, and each moment
    takes the last snapshot before it; no pair of rows is ever built."""
    value = F.struct(F.col(ts).alias(ts), *[F.col(v).alias(v) for v in values])
    left = snapshots.select(F.col(key).alias(key), F.col(ts).alias("_t"), F.lit(0).alias("_moment"), value.alias("_v"), F.lit(None).cast(dict(moments.dtypes)[at]).alias(at))
    right = moments.select(F.col(key).alias(key), (F.col(at) + TOLERANCE).alias("_t"), F.lit(1).alias("_moment"), F.lit(None).cast(left.schema["_v"].dataType).alias("_v"), F.col(at).alias(at))
    order = Window.partitionBy(key).orderBy("_t", "_moment")
    filled = left.union(right).withColumn("_last", F.last("_v", ignorenulls=True).over(order))
    return filled.where("_moment = 1").select(key, at, F.col(f"_last.{ts}").alias(ts), *[F.col(f"_last.{v}").alias(v) for v in values])


def moment(text: str) -> float | None:
    """Seconds of an ISO date or time; without a zone it is UTC. None for anything else."""
    try:
        read = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return (read if read.tzinfo else read.replace(tzinfo=timezone.utc)).timestamp()


def resolve(snapshots: DataFrame, target: str = "latest", key: str = "key", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """One version of each key: latest, prev, an ordinal from 1, or the newest not after an ISO time (ts in seconds).

    version is counted among all of the key's snapshots."""
    name = (target or "latest").strip().lower()
    n = {"latest": 1, "": 1, "prev": 2}.get(name) or (int(name) if name.isdigit() else 0)
    found = versions(snapshots, key, ts, tie)
    if n > 0:
        return found.where(F.col("version") == n)
    at = moment(target)
    if at is None or name.isdigit():
        raise ValueError("latest, prev, an ordinal from 1 or an ISO time")
    least = F.min(F.when(F.col(ts) <= at + TOLERANCE, F.col("version"))).over(Window.partitionBy(key))
    return found.withColumn("_least", least).where(F.col("version") == F.col("_least")).drop("_least")


def changes(snapshots: DataFrame, key: str = "key", ts: str = "ts", tie: str | None = None, digest: str = "hash", chars: str = "chars") -> DataFrame:
    """With previous_hash, previous_chars, first_seen and changed, against the snapshot before."""
    order = Window.partitionBy(key).orderBy(ts, *([tie] if tie else []))
    out = snapshots.withColumn("previous_hash", F.lag(digest).over(order)).withColumn("previous_chars", F.lag(chars).over(order))
    first = F.row_number().over(order) == 1
    return out.withColumn("first_seen", first).withColumn("changed", ~F.col("first_seen") & ~F.col("previous_hash").eqNullSafe(F.col(digest)))


def line_diff(pairs: DataFrame, old: str, new: str, *keys: str) -> DataFrame:
    """pairs, or their keys only, with diff: struct(added_lines, removed_lines, diff, diff_truncated) of lines that aren't blank, up to 40 shown.

    The script is a shortest one (see linediff). A null text has no lines."""
    ship(pairs.sparkSession)
    schema = "struct<added_lines:int,removed_lines:int,diff:array<string>,diff_truncated:boolean>"
    keys = keys or tuple(pairs.columns)
    at = len(keys)
    rows = pairs.select(*keys, content_lines(F.col(old)).alias("_lines_before"), content_lines(F.col(new)).alias("_lines_after"))

    def compare(a: list, b: list) -> dict:
        shown, added, removed = [], 0, 0
        for went, came in hunks(a, b):
            gone, come = ["-" + x for x in went], ["+" + x for x in came]
            # what a unified diff's own headers look like isn't counted as a line
            gone, come = [x for x in gone if not x.startswith("---")], [x for x in come if not x.startswith("+++")]
            removed, added = removed + len(gone), added + len(come)
            shown += gone + come
        return {"added_lines": added, "removed_lines": removed, "diff": shown[:DIFF_LINES], "diff_truncated": len(shown) > DIFF_LINES}

    kind = pa.struct([("added_lines", pa.int32()), ("removed_lines", pa.int32()), ("diff", pa.list_(pa.string())), ("diff_truncated", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [compare(a or [], b or []) for a, b in zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(found, kind)], names=[*batch.schema.names[:at], "diff"])

    names = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:at])
    return rows.mapInArrow(run, f"{names}, diff {schema}")


def _leaves(value, path: str = "") -> Iterator[tuple[str, str]]:
    """Paths and JSON texts below an object or array; an array in an array is a leaf, an empty one has none."""
    inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for name, x in inner:
        at = f"{path}[{name}]" if isinstance(value, list) else f"{path}.{name}" if path else name
        if isinstance(x, dict) or isinstance(x, list) and not isinstance(value, list):
            yield from _leaves(x, at)
        else:
            yield at, json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def flatten_json(frame: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, path, value) of every leaf of a JSON text, as items[0].price; value is JSON text. Texts that aren't JSON and
    scalars have no leaves."""
    ship(frame.sparkSession)
    at = len(keys)

    def leaves(text: str | None) -> list[tuple[str, str]]:
        try:
            return list(_leaves(json.loads(text or "null")))
        except (ValueError, RecursionError):
            return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *leaf) for i, text in enumerate(batch.column(at).to_pylist()) for leaf in leaves(text)]
            row, path, value = zip(*found) if found else [()] * 3
            own = [c.take(pa.array(row, pa.int64())) for c in batch.columns[:at]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(path, pa.string()), pa.array(value, pa.string())], names=[*keys, "path", "value"])

    kinds = dict(frame.dtypes)
    return frame.select(*keys, column).mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "path string", "value string"]))


def field_changes(previous: DataFrame, current: DataFrame, *keys: str) -> DataFrame:
    """Full outer join of (keys, path, value): kind added, removed or modified, with delta and pct of numbers.

    value is JSON text; true and false aren't numbers, and 1 is no other number than 1.0. delta has 6 places; pct 1, null on
    a base of zero."""
    on = [*keys, "path"]
    a, b = previous.withColumnRenamed("value", "old").withColumn("_a", F.lit(1)), current.withColumnRenamed("value", "new").withColumn("_b", F.lit(1))
    both = a.join(b, on, "full_outer")
    left, right = F.col("old").try_cast("double"), F.col("new").try_cast("double")
    numbers = left.isNotNull() & right.isNotNull()
    same = F.when(numbers, left == right).otherwise(F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~same, "modified")
    numeric = (kind == "modified") & numbers
    delta = F.when(numeric, F.round(right - left, 6))
    pct = F.when(numeric & (left != 0), F.round((right - left) / F.abs(left) * 100, 1))
    return both.select(*on, kind.alias("kind"), "old", "new", delta.alias("delta"), pct.alias("pct")).where("kind is not null")


def first_changes(found: DataFrame, *keys: str, most: int = CHANGES) -> DataFrame:
    """The first `most` changes of each key by path, with n_changes, the number of all of its changes."""
    own = Window.partitionBy(*keys)
    numbered = found.withColumn("n_changes", F.count("*").over(own)).withColumn("_n", F.row_number().over(own.orderBy("path")))
    return numbered.where(F.col("_n") <= most).drop("_n")


def change_line(path: Column, kind: Column, old: Column, new: Column, pct: Column) -> Column:
    """A change as a sentence: price 299→249（-16.7%）."""
    plain = lambda c: F.regexp_replace(c, '^"|"$', "")
    share = F.when(pct.isNotNull(), F.concat(F.lit("（"), F.when(pct > 0, "+").otherwise(""), pct.cast("string"), F.lit("%）"))).otherwise("")
    return F.when(kind == "modified", F.concat(path, F.lit(" "), plain(old), F.lit("→"), plain(new), share)).when(kind == "added", F.concat(F.lit("新增 "), path)).otherwise(F.concat(F.lit("移除 "), path))
