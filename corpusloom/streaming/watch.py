"""Changes of watched pages as they arrive, and quotas of callers: state by key, kept by the engine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE = "key string, ts double, hash string, previous_hash string, first_seen boolean, changed boolean, late boolean"


def detect_changes(snapshots: DataFrame) -> DataFrame:
    """For a stream of (key string, ts double, hash string): each snapshot against the newest one seen of its key.

    State is one row a key. Within a micro-batch snapshots go by ts; one older than the newest seen is late: it is
    reported, but never becomes what others are compared with."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, known = state.get if state.exists else (float("-inf"), None)
        rows = []
        for r in pd.concat(list(frames)).sort_values("ts", kind="stable").itertuples():
            late = r.ts < newest
            rows.append((key[0], r.ts, r.hash, known, known is None, known is not None and not late and known != r.hash, late))
            if not late:
                newest, known = r.ts, r.hash
        state.update((newest, known))
        yield pd.DataFrame(rows, columns=["key", "ts", "hash", "previous_hash", "first_seen", "changed", "late"])

    return snapshots.select("key", "ts", "hash").groupBy("key").applyInPandasWithState(step, CHANGE, "ts double, hash string", "append", GroupStateTimeout.NoTimeout)


VERDICT = "tenant string, ts double, allowed boolean, reason string"


def enforce_quotas(requests: DataFrame, per_second: float, per_day: int) -> DataFrame:
    """For a stream of (tenant string, ts double): whether each request is allowed, and why not.

    A tenant has a bucket of per_second tokens that fills as fast, and per_day requests each UTC day. The daily quota is
    asked first; a refused request uses up nothing."""
    capacity = max(per_second, 1.0)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last, day, used = state.get if state.exists else (capacity, None, -1, 0)
        rows = []
        for ts in sorted(t for f in frames for t in f["ts"]):
            used, day = (used, day) if ts // 86400 == day else (0, int(ts // 86400))
            tokens = min(capacity, tokens + max(0.0, ts - (last if last is not None else ts)) * per_second)
            last = ts
            reason = "daily_quota" if used >= per_day else "rate" if tokens < 1 else ""
            if not reason:
                tokens, used = tokens - 1, used + 1
            rows.append((key[0], ts, not reason, reason))
        state.update((tokens, last, day, used))
        yield pd.DataFrame(rows, columns=["tenant", "ts", "allowed", "reason"])

    return requests.select("tenant", "ts").groupBy("tenant").applyInPandasWithState(step, VERDICT, "tokens double, last double, day int, used int", "append", GroupStateTimeout.NoTimeout)


def first_of_each(requests: DataFrame, key: str, ts: str, within: str = "10 minutes") -> DataFrame:
    """One of the requests that ask for the same within a time: others are answered by it."""
    return requests.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def counts(events: DataFrame, ts: str, length: str, slide: str | None = None, late: str = "1 hour", *keys: str) -> DataFrame:
    """An addition to the reference's operators: counts by tumbling or sliding windows, late rows up to `late`."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length, slide) if slide else F.window(ts, length), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, gap: str, late: str = "1 hour", *keys: str) -> DataFrame:
    """An addition to the reference's operators: counts by sessions that end after a gap."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6
