"""Operational statistics over fetch logs and stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The histogram's buckets in milliseconds and the number of latest samples looked at.
BUCKETS = (("lt_100", 0, 100), ("lt_300", 100, 300), ("lt_1000", 300, 1000), ("lt_3000", 1000, 3000), ("lt_10000", 3000, 10000), ("gte_10000", 10000, None))
WINDOW = 1024


def nearest_rank(values: str, q: float) -> Column:
    """The value at rank ceil(q * n)."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {values})")


def rounded_rank(values: Column, q: float) -> Column:
    """The value at index round(q * (n - 1)), halves to even: another rule than nearest_rank, kept for site runs."""
    rows = F.array_sort(F.collect_list(values))
    return F.element_at(rows, (F.bround(F.lit(q) * (F.size(rows) - 1)) + 1).cast("int"))


def histogram(ms: Column) -> list[Column]:
    """Counts of [low, high) by bucket, zero where empty."""
    return [F.count_if((ms >= low) & (F.lit(True) if high is None else ms < high)).alias(name) for name, low, high in BUCKETS]


def cumulative(ms: Column, bounds: tuple[int, ...]) -> list[Column]:
    """Counts below each bound."""
    return [F.count_if(ms < b).alias(f"below_{b}") for b in bounds]


def latest(frame: DataFrame, ts: str, tie: str, n: int = WINDOW, *keys: str) -> DataFrame:
    """The n latest rows, of each key if keys are given."""
    if not keys:
        return frame.orderBy(F.desc(ts), F.desc(tie)).limit(n)
    order = Window.partitionBy(*keys).orderBy(F.desc(ts), F.desc(tie))
    return frame.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def record_summary(records: DataFrame) -> DataFrame:
    """Records by tool: count, first and last ts, means of tokens and chars, rounded to whole numbers."""
    return records.groupBy("tool").agg(F.count("*").alias("records"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.bround(F.avg("tokens")).cast("long").alias("avg_tokens"), F.bround(F.avg("chars")).cast("long").alias("avg_chars"))


def regressions(run: DataFrame, baseline: DataFrame, least: float = -0.2) -> DataFrame:
    """(id, delta) of sites whose content shrank by more than 20 % against the baseline."""
    both = run.select("id", "chars").join(baseline.select("id", F.col("chars").alias("base")), "id").where("base > 0")
    return both.select("id", F.round((F.col("chars") - F.col("base")) / F.col("base"), 4).alias("delta")).where(F.col("delta") < least)


def slow_sites(run: DataFrame, baseline: DataFrame, factor: float = 3.0, floor_ms: int = 3000) -> DataFrame:
    """(id, ratio) of sites slower than both `factor` times the baseline and `floor_ms` beyond it, the slowest first."""
    both = run.select("id", "elapsed_ms").join(baseline.select("id", F.col("elapsed_ms").alias("base")), "id").where("base > 0")
    slow = both.where(F.col("elapsed_ms") > F.greatest(F.col("base") * factor, F.col("base") + floor_ms))
    return slow.select("id", F.round(F.col("elapsed_ms") / F.col("base"), 2).alias("ratio")).orderBy(F.desc("ratio"), "id")
