"""Inventories of sites: what sitemaps list, what changed since, and the merged map of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.text import strip, text_of
from corpusloom.functions.web import canonical_url

LIMIT, MAP_LIMIT, SITEMAPS, DEPTH, CONTENT_CHECKS = 1000, 500, 20, 2, 20


def sitemaps_of(robots: Column) -> Column:
    """Addresses of Sitemap: lines, in their order, without repeats."""
    rows = F.filter(F.split(text_of(robots), r"\r\n|\n|\r"), lambda x: x.rlike(r"(?i)^\s*sitemap\s*:"))
    return F.array_distinct(F.filter(F.transform(rows, lambda x: strip(F.regexp_replace(x, r"^[^:]*:", ""))), lambda x: x != ""))


def decoded(raw: Column) -> Column:
    """Text of a sitemap's bytes that aren't compressed; files ending in .gz are inflated by the reader of the source."""
    return F.decode(raw, "UTF-8")


def sitemap_entries(files: DataFrame, xml: str = "xml", *keys: str) -> DataFrame:
    """(keys, kind, pos, url, lastmod) of each file: kind url or sitemap. Files that aren't sitemaps have no rows."""
    body = F.regexp_replace(text_of(F.col(xml)), r"(?s)<!--.*?-->", "")
    kind = F.regexp_extract(body, r"(?s)\A\s*(?:<\?.*?\?>\s*)*(?:<!DOCTYPE[^>]*>\s*)?<(?:[\w.-]+:)?(urlset|sitemapindex)\b", 1)
    tag = F.when(kind == "urlset", "url").when(kind == "sitemapindex", "sitemap")
    item = F.when(tag == "url", F.regexp_extract_all(body, F.lit(r"(?s)<(?:[\w.-]+:)?url\b[^>]*>(.*?)</(?:[\w.-]+:)?url\s*>"), 1)).otherwise(F.regexp_extract_all(body, F.lit(r"(?s)<(?:[\w.-]+:)?sitemap\b[^>]*>(.*?)</(?:[\w.-]+:)?sitemap\s*>"), 1))
    rows = files.select(*keys, tag.alias("kind"), item.alias("_i")).where("kind is not null").select(*keys, "kind", F.posexplode("_i").alias("pos", "_x"))

    def child(name: str) -> Column:
        inner = F.regexp_extract("_x", rf"(?s)<(?:[\w.-]+:)?{name}\b[^>]*>(.*?)</(?:[\w.-]+:)?{name}\s*>", 1)
        inner = F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
        for mark, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            inner = F.replace(inner, F.lit(mark), F.lit(by))
        return strip(inner)

    return rows.select(*keys, "kind", "pos", child("loc").alias("url"), child("lastmod").alias("lastmod")).where("url <> ''")


def expand_sitemaps(start: DataFrame, files: DataFrame, most: int = SITEMAPS, depth: int = DEPTH) -> DataFrame:
    """(url, lastmod) of all sitemaps reachable from start (url) in files (url, xml), level by level, none read twice.

    At most `depth` levels of indexes and `most` files, the first in order; three joins, whatever the size of files."""
    parsed = sitemap_entries(files.select(F.col("url").alias("file"), "xml"), "xml", "file")
    frontier, seen, out, room = start.select(F.col("url").alias("file")).distinct(), None, None, most
    for _ in range(depth + 1):
        frontier = frontier.orderBy("file").limit(room)
        read = parsed.join(F.broadcast(frontier), "file")  # at most `most` rows
        pages = read.where("kind = 'url'").select("url", "lastmod")
        out = pages if out is None else out.union(pages)
        seen = frontier if seen is None else seen.union(frontier)
        room = max(most - seen.count(), 0)
        frontier = read.where("kind = 'sitemap'").select(F.col("url").alias("file")).distinct().join(seen, "file", "left_anti")
        if not room or frontier.isEmpty():
            break
    return out


def best_entries(entries: DataFrame) -> DataFrame:
    """One row an address: one with lastmod before one without, then the first by pos."""
    order = Window.partitionBy("url").orderBy(F.desc(text_of(F.col("lastmod")) != ""), "pos")
    return entries.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def diff(previous: DataFrame, current: DataFrame, key: str = "url") -> DataFrame:
    """(key, state): new, changed (another lastmod), unchanged or removed. Tables of (key, lastmod), one row a key."""
    a = previous.select(key, text_of(F.col("lastmod")).alias("_old"), F.lit(1).alias("_a"))
    b = current.select(key, text_of(F.col("lastmod")).alias("_new"), F.lit(1).alias("_b"))
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def carry_hashes(previous: DataFrame, current: DataFrame, key: str = "url") -> DataFrame:
    """current with hash: the previous one where lastmod is as it was, else null, to be read anew."""
    a = previous.select(key, text_of(F.col("lastmod")).alias("_old"), F.col("hash").alias("_hash"))
    kept = F.when(F.col("_old") == text_of(F.col("lastmod")), F.col("_hash"))
    return current.join(a, key, "left").select(*[c for c in current.columns if c != "hash"], kept.alias("hash"))


def index_site(previous: DataFrame, entries: DataFrame, include: str | None = None, exclude: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(url, lastmod, state) of a site: filtered, one row an address, the first `limit` by address; removed ones too."""
    rows = entries
    rows = rows.where(F.col("url").rlike(include)) if include else rows
    rows = rows.where(~F.col("url").rlike(exclude)) if exclude else rows
    rows = best_entries(rows)
    reported = rows.orderBy("url").limit(limit).select("url", "lastmod", F.lit(True).alias("_shown"))
    states = diff(previous, rows).join(reported, "url", "left")
    return states.where((F.col("state") == "removed") | F.col("_shown")).select("url", "lastmod", "state")


def site_map(*sources: DataFrame, limit: int = MAP_LIMIT) -> DataFrame:
    """(url, source) merged from tables (url, source), the first table first: an address belongs to the first that has it."""
    merged = None
    for i, frame in enumerate(sources):
        rows = frame.select("url", "source", F.lit(i).alias("_p"))
        merged = rows if merged is None else merged.unionByName(rows)
    keyed = merged.withColumn("_k", canonical_url(F.col("url")))
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy("_p", "url"))).where("_n = 1")
    return first.orderBy("_p", "url").limit(limit).select("url", "source")
