"""Recurring tasks as a table: which are due, and what a run changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.web import task_id

INTERVAL_LEAST, INTERVAL_MOST = 60, 604_800
KINDS = ("watch", "index")


def valid_interval(seconds: Column) -> Column:
    return seconds.isNotNull() & seconds.between(INTERVAL_LEAST, INTERVAL_MOST)


def valid_webhook(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^/\s]+"), F.lit(True))


def checked(requests: DataFrame) -> DataFrame:
    """Requests (kind, url, selector, interval_s, webhook_url) with their id and a problem, null if there is none."""
    problem = F.when(~F.col("kind").isin(*KINDS), "kind").when(~valid_interval(F.col("interval_s")), "interval_s").when(~valid_webhook(F.col("webhook_url")), "webhook_url")
    return requests.withColumn("id", task_id(F.col("kind"), F.col("url"), F.col("selector"))).withColumn("problem", problem)


def merged(tasks: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """tasks (id, kind, url, selector, interval_s, enabled, next_run_at, run_count) after requests of the same kind of
    rows: a known id is updated and keeps its runs and pause, a new one is due at once. A webhook_url, where tasks have
    one, is replaced by that of the request, by none if it names none."""
    hooked = [c for c in ("webhook_url",) if c in tasks.columns]
    new = requests.select("id", "kind", "url", "selector", "interval_s", *hooked).dropDuplicates(["id"])
    a, b = tasks.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.id") == F.col("b.id"), "full_outer")
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c)
    known = F.col("a.id").isNotNull()
    return both.select(pick("id"), pick("kind"), pick("url"), F.when(F.col("b.id").isNotNull(), F.col("b.selector")).otherwise(F.col("a.selector")).alias("selector"), pick("interval_s"), F.when(known, F.col("a.enabled")).otherwise(F.lit(True)).alias("enabled"), F.when(known, F.col("a.next_run_at")).otherwise(now).alias("next_run_at"), F.coalesce("a.run_count", F.lit(0)).alias("run_count"), *[F.when(F.col("b.id").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in hooked])


def due(tasks: DataFrame, now: Column) -> DataFrame:
    return tasks.where(F.col("enabled") & (F.col("next_run_at") <= now))


def ran(tasks: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """tasks after those of ids ran: the next run is an interval from now, runs missed meanwhile aren't made up for."""
    done = ids.select("id").distinct().withColumn("_ran", F.lit(True))
    joined = tasks.join(done, "id", "left")
    return joined.withColumn("next_run_at", F.when(F.col("_ran"), now + F.col("interval_s")).otherwise(F.col("next_run_at"))).withColumn("run_count", F.col("run_count") + F.when(F.col("_ran"), 1).otherwise(0)).select(*tasks.columns)


def paused(tasks: DataFrame, task: str) -> DataFrame:
    return tasks.withColumn("enabled", F.col("enabled") & (F.col("id") != task))


def resumed(tasks: DataFrame, task: str, now: Column) -> DataFrame:
    hit = F.col("id") == task
    return tasks.withColumn("enabled", F.col("enabled") | hit).withColumn("next_run_at", F.when(hit, now).otherwise(F.col("next_run_at")))
