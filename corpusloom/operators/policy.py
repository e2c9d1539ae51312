"""Which rule holds for an address: robots rules by longest prefix, recipes by longest host suffix, host lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.functions.web import bare_host, host_suffixes


def parse_robots(robots: DataFrame, agents: tuple[str, ...] = ("*",), host: str = "host", text: str = "text") -> DataFrame:
    """(host, allow, pattern) of the groups that name one of agents, empty patterns left out.

    A group is the agent lines that follow one another, and the rules up to the next agent line."""
    lines = robots.select(host, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("pos", "_l"))
    lines = lines.select(host, "pos", F.trim(F.regexp_replace("_l", "#.*", "")).alias("_l")).where("_l like '%:%'")
    lines = lines.select(host, "pos", F.lower(F.trim(F.substring_index("_l", ":", 1))).alias("field"), F.trim(F.regexp_replace("_l", "^[^:]*:", "")).alias("value"))
    lines = lines.where(F.col("field").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy(host).orderBy("pos")
    opens = (F.col("field") == "user-agent") & ~F.coalesce(F.lag("field").over(order) == "user-agent", F.lit(False))
    grouped = lines.withColumn("_opens", opens.cast("int")).withColumn("_g", F.sum("_opens").over(order))
    ours = grouped.where((F.col("field") == "user-agent") & F.lower("value").isin(*agents)).select(host, "_g").distinct()
    rules = grouped.where("field <> 'user-agent' and value <> ''").join(ours, [host, "_g"], "left_semi")
    return rules.select(host, (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))


def robots_allowed(pages: DataFrame, rules: DataFrame, host: str = "host", path: str = "path", key: str = "page_id") -> DataFrame:
    """(key, allowed): the longest pattern that starts the path decides, allow before disallow; none: allowed.

    The rules of a host, which its robots.txt bounds, are one row of a small table; a page is decided in its own row."""
    by_host = rules.groupBy(host).agg(F.collect_set(F.struct(F.length("pattern").alias("n"), "allow", "pattern")).alias("_rules"))
    joined = pages.select(key, host, path).join(by_host, host, "left")
    best = F.array_max(F.filter("_rules", lambda r: F.startswith(F.col(path), r["pattern"])))
    return joined.select(key, F.coalesce(best["allow"], F.lit(True)).alias("allowed"))


def match_recipes(pages: DataFrame, recipes: DataFrame, host: str = "host", key: str = "page_id") -> DataFrame:
    """(key, recipe): the recipe whose host is the page's or the longest that ends it after a dot; null if there is none."""
    probes = pages.select(key, F.explode(host_suffixes(F.lower(F.col(host)))).alias("_h"))
    hits = probes.join(recipes.select(F.lower("host").alias("_h")), "_h").groupBy(key).agg(F.max_by("_h", F.length("_h")).alias("recipe"))
    return pages.select(key).join(hits, key, "left")


def host_allowed(pages: DataFrame, allow: list[str], deny: list[str], host: str = "host") -> DataFrame:
    """Rows whose host isn't denied and, if there is a list of allowed hosts, is on it; www. doesn't matter."""
    name = bare_host(F.col(host))
    rows = pages.where(~name.isin(*[x.lower().removeprefix("www.") for x in deny])) if deny else pages
    return rows.where(name.isin(*[x.lower().removeprefix("www.") for x in allow])) if allow else rows
