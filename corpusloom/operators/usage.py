"""Counters over a log of requests, by caller too, and their text for a metrics collector; freshness of stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fetch_counters(log: DataFrame) -> DataFrame:
    """One row of counters over (result_hit boolean, cached boolean, tokens, bytes).

    A result hit is answered without a fetch; cached tells fetches that an HTTP cache answered. The rate has 3 places."""
    hit, fetch = F.col("result_hit"), ~F.col("result_hit")
    hits = F.count_if(hit)
    return log.agg(
        F.count("*").alias("requests"),
        F.count_if(fetch).alias("fetches"),
        hits.alias("result_cache_hits"),
        F.count_if(fetch & F.col("cached")).alias("http_cache_hits"),
        F.when(F.count("*") > 0, F.round(hits / F.count("*"), 3)).otherwise(F.lit(0.0)).alias("cache_hit_rate"),
        F.coalesce(F.sum(F.greatest("tokens", F.lit(0))), F.lit(0)).cast("long").alias("tokens_returned"),
        F.coalesce(F.sum(F.when(fetch, F.greatest("bytes", F.lit(0)))), F.lit(0)).cast("long").alias("bytes_in"),
    )


def counts_by(log: DataFrame, *columns: str) -> DataFrame:
    """(dimension, value, n): how often each value of each column occurs, unknown for null or empty. One shuffle for all."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias("value")) for c in columns])
    return log.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def tenant_usage(log: DataFrame) -> DataFrame:
    """(tenant, requests, tool_calls, rejections): maps of counts by tool and by reason, from (tenant, tool, reason).

    A rejected request has a reason and counts as no call of its tool. Counts are summed by tenant and name first, so a
    tenant's group holds a row for each name, not for each request."""
    named = log.groupBy("tenant", "tool", "reason").agg(F.count("*").alias("n"))
    entry = lambda name, held: F.map_from_entries(F.array_sort(F.collect_list(F.when(held, F.struct(name, "n")))))
    tools = named.groupBy("tenant", "tool").agg(F.sum(F.when(F.col("reason").isNull(), F.col("n"))).alias("n"))
    reasons = named.where("reason is not null").groupBy("tenant", "reason").agg(F.sum("n").alias("n"))
    calls = tools.groupBy("tenant").agg(entry("tool", F.col("tool").isNotNull() & F.col("n").isNotNull()).alias("tool_calls"))
    refused = reasons.groupBy("tenant").agg(entry("reason", F.lit(True)).alias("rejections"))
    totals = named.groupBy("tenant").agg(F.sum("n").alias("requests"))
    none = F.from_json(F.lit("{}"), "map<string,bigint>")
    return totals.join(calls, "tenant", "left").join(refused, "tenant", "left").select("tenant", "requests", F.coalesce("tool_calls", none).alias("tool_calls"), F.coalesce("rejections", none).alias("rejections"))


def exposition(counts: DataFrame, name: str, value: str, labels: tuple[str, ...] = (), kind: str = "counter", text: str = "") -> DataFrame:
    """(line) in the text format of metrics: a header, then a line for each row, labels escaped, in order of labels."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    shown = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"')) for c in labels]), F.lit("}")) if labels else F.lit("")
    lines = counts.select(F.lit(1).alias("_o"), F.concat(F.lit(name), shown, F.lit(" "), F.col(value).cast("string")).alias("line"))
    head = counts.sparkSession.createDataFrame([(0, f"# HELP {name} {text}\n# TYPE {name} {kind}")], "_o int, line string")
    return head.union(lines).orderBy("_o", "line").select("line")


def fresh(stored: DataFrame, now: Column, ttl: float, key: str = "key", ts: str = "ts") -> DataFrame:
    """The newest stored row of each key, with stale: whether it is older than ttl seconds and must be asked for again."""
    whole = F.struct(*[F.col(c) for c in stored.columns])
    newest = stored.groupBy(key).agg(F.max_by(whole, F.col(ts)).alias("_r")).select("_r.*")
    return newest.withColumn("stale", now - F.col(ts) > ttl)


def missing_checks(content: Column, checks: Column) -> Column:
    """The required snippets that a content lacks, whatever their case."""
    low = F.lower(F.coalesce(content, F.lit("")))
    return F.filter(checks, lambda c: ~F.contains(low, F.lower(c)))
