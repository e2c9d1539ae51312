"""Answers of search services, stored as JSON or as pages, as rows of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.text import SPACE, json_object, strip, text_of
from corpusloom.functions.web import redirect_target
from corpusloom.html.pages import Request, parse_pages

# Where each service keeps its hits and what it calls their parts.
LAYOUTS = {
    "searxng": {"path": "$.results", "snippet": "content", "engine": "engine", "published": ("publishedDate",)},
    "brave": {"path": "$.web.results", "snippet": "description", "engine": None, "published": ("page_age", "age")},
    "tavily": {"path": "$.results", "snippet": "content", "engine": None, "published": ("published_date",)},
}
CARDS = {"card": "div.result", "advert": "result--ad", "link": "a.result__a", "snippet": ".result__snippet"}


def one_line(c: Column) -> Column:
    return strip(F.regexp_replace(text_of(c), rf"{SPACE}+", " "))


def _ranked(hits: DataFrame, most: int, *keys: str) -> DataFrame:
    """Web addresses only, the first of those that repeat, `most` of each answer."""
    web = hits.where(F.col("url").rlike("^https?://"))
    first = web.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "url").orderBy("_pos"))).where("_n = 1")
    placed = first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_pos")))
    return placed.where(F.col("rank") <= most).drop("_n", "_pos")


def json_hits(answers: DataFrame, service: str, body: str = "body", most: int = 10, *keys: str) -> DataFrame:
    """(keys, rank, title, url, snippet, engine, published_at) of JSON answers; JSON may stand inside other text.

    Entries that aren't objects are passed over. An answer without a list of hits has no rows; see `broken_answers`."""
    layout = LAYOUTS[service]
    opened = answers.select(*keys, F.posexplode(_items(F.col(body), layout["path"])).alias("_pos", "_i"))
    part = lambda n: one_line(F.try_variant_get("_i", f"$.{n}", "string"))
    url = strip(text_of(F.try_variant_get("_i", "$.url", "string")))
    engine = part(layout["engine"]) if layout["engine"] else F.lit("")
    published = F.coalesce(*[F.nullif(part(n), F.lit("")) for n in layout["published"]], F.lit(""))
    hits = opened.select(*keys, "_pos", part("title").alias("title"), url.alias("url"), part(layout["snippet"]).alias("snippet"), engine.alias("engine"), published.alias("published_at"))
    hits = hits.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.col("url"))).withColumn("engine", F.coalesce(F.nullif("engine", F.lit("")), F.lit(service)))
    return _ranked(hits, most, *keys).select(*keys, "rank", "title", "url", "snippet", "engine", "published_at")


def _items(body: Column, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(json_object(body)), path, "array<variant>")


def broken_answers(answers: DataFrame, service: str, body: str = "body") -> DataFrame:
    """The answers that hold no list of hits."""
    return answers.where(_items(F.col(body), LAYOUTS[service]["path"]).isNull())


def page_hits(pages: DataFrame, most: int = 10, url: str = "url", html: str = "html", *keys: str) -> DataFrame:
    """(keys, rank, title, url, snippet) of pages of results: cards that aren't advertisements, redirects undone."""
    schema = {
        "hits": {
            "selector": CARDS["card"],
            "type": "list",
            "fields": {
                "title": {"selector": CARDS["link"]},
                "href": {"selector": CARDS["link"], "type": "attr", "attr": "href", "abs_url": True},
                "snippet": {"selector": CARDS["snippet"]},
                "advert": {"selector": f"{CARDS['card']}.{CARDS['advert']} {CARDS['link']}", "type": "count"},
            },
        }
    }
    cards = parse_pages(pages, Request("fields", schema=schema), url, html, *keys)
    cards = cards.select(*keys, F.posexplode("fields.data.hits").alias("_pos", "_c")).where("_c.advert = 0")
    hits = cards.select(*keys, "_pos", one_line(F.col("_c.title")).alias("title"), redirect_target(F.col("_c.href")).alias("url"), one_line(F.col("_c.snippet")).alias("snippet"))
    return _ranked(hits, most, *keys).select(*keys, "rank", "title", "url", "snippet")


def query_text(query: Column, site: Column) -> Column:
    """A query held to one site, where there is one."""
    return F.when(text_of(site) != "", F.concat(strip(query), F.lit(" site:"), site)).otherwise(strip(query))
