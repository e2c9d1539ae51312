"""Which search hits are read, and how much of each: de-duplication, caps by host, a budget filled greedily."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.web import canonical_url, host

TOP_K, PER_HOST = 3, 2


def read_targets(hits: DataFrame, top_k: int = TOP_K, per_host: int = PER_HOST, query: str = "query", rank: str = "rank", url: str = "url") -> DataFrame:
    """Hits to read for each query, with `place` from 1: repeats of an address (without tracking) and hits beyond the
    host's cap are passed over. A repeat shares its host with the first and takes nothing of its cap."""
    keyed = hits.withColumn("_k", canonical_url(F.col(url))).withColumn("_h", host(F.col(url)))
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(query, "_k").orderBy(rank))).where("_n = 1")
    capped = first.withColumn("_n", F.row_number().over(Window.partitionBy(query, "_h").orderBy(rank))).where(F.col("_n") <= per_host)
    placed = capped.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(rank)))
    return placed.where(F.col("place") <= top_k).drop("_k", "_h", "_n")


def fill_budget(sizes: Column, budget: Column) -> Column:
    """Which of the sizes, in order, are taken: one that overflows is passed over, unless nothing was taken yet; smaller
    ones after it may still fit. An array of booleans."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("taken"))

    def step(s: Column, n: Column) -> Column:
        fits = (s["used"] + n <= budget) | (s["used"] == 0)
        return F.struct((s["used"] + F.when(fits, n).otherwise(F.lit(0))).cast("long").alias("used"), F.array_append(s["taken"], fits).alias("taken"))

    return F.aggregate(sizes, start, step, lambda s: s["taken"])


def read_hits(targets: DataFrame, pages: DataFrame, budget: int, query: str = "query", url: str = "url") -> DataFrame:
    """targets with their page's content (null where there is none) and whether it fits in the query's budget of tokens.

    pages: (url, content, tokens). At most top_k hits a query meet in one row, never their contents."""
    joined = targets.join(pages.select(url, "content", "tokens"), url, "left")
    order = F.array_sort(F.collect_list(F.struct("place", F.coalesce("tokens", F.lit(0)).cast("long").alias("n"))))
    plan = targets.join(pages.select(url, "tokens"), url, "left").groupBy(query).agg(order.alias("_o"))
    taken = fill_budget(F.transform("_o", lambda o: o["n"]), F.lit(budget))
    plan = plan.select(query, F.explode(F.zip_with("_o", taken, lambda o, t: F.struct(o["place"].alias("place"), t.alias("taken")))).alias("_p")).select(query, "_p.place", "_p.taken")
    return joined.join(plan, [query, "place"])
