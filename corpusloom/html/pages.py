"""Pages to columns: one table of elements, and from it just what is asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.text import text_of
from corpusloom.html import content, inspect
from corpusloom.html.elements import elements, heads, kept
from corpusloom.html.fields import EXTRACTORS, Extraction, parse_rules, register_extractor

OUTPUTS = ("compact", "links", "next_link", "interactions", "region", "grounding", "candidates", "fields")


class Request:
    """What to compute of each page. Keys of `outputs`: those of OUTPUTS; the rest are their parameters.

    closed: whether `&amp` and the like stay as they are where no semicolon follows; browsers read them as `&amp;`.
    named: the names of the only references to read, where a semicolon follows; all others stay as they are."""

    def __init__(self, *outputs: str, links: str = "internal", max_tokens: int | None = None, root: str | None = None, same_host: bool = True, most_links: int = 200, next_selector: str = "", region: str = "", schema: dict | None = None, extractors: dict | None = None, closed: bool = False, named: tuple[str, ...] | None = None):
        unknown = set(outputs) - set(OUTPUTS)
        if unknown or links not in ("internal", "all", "none"):
            raise ValueError(f"not known: {sorted(unknown) or links}")
        self.outputs, self.links, self.max_tokens, self.root = outputs, links, max_tokens, root
        self.same_host, self.most_links, self.next_selector, self.region = same_host, most_links, next_selector, region
        self.closed, self.named = closed, named
        for name, function in (extractors or {}).items():
            register_extractor(name, function)
        self.rules = parse_rules(schema) if schema else []


def _lists(frame: DataFrame, item: Column, order: str, name: str) -> DataFrame:
    """(page, name): the items of each page in order."""
    held = frame.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), item.alias("x")))).alias("all"))
    return held.select("page", F.transform("all", lambda x: x["x"]).alias(name))


def parse_pages(pages: DataFrame, request: Request, url: str = "url", html: str = "html", *keys: str) -> DataFrame:
    """(keys, one column an output, error): a page that can't be parsed has an error, not a failure.

    Only the keys, the address and the page are read; all outputs come from one table of elements."""
    asked = set(request.outputs)
    found = elements(pages, *keys, url=url, html=html, source="grounding" in asked, closed=request.closed, named=request.named)
    out = heads(found).select("page", *[F.col(f"keys.{k}").alias(k) for k in keys], "error")

    def add(frame: DataFrame, name: str, kind: str | None = None) -> None:
        nonlocal out
        out = out.join(frame, "page", "left")
        if kind:
            out = out.withColumn(name, F.coalesce(name, F.array().cast(kind)))

    compact = None
    if {"compact", "grounding"} & asked or "region" in asked and not request.region:
        compact = content.compact(found, request.links, request.root, request.max_tokens if "grounding" not in asked else None)
    if "compact" in asked:
        cut = compact if "grounding" not in asked else content.compact(found, request.links, request.root, request.max_tokens)
        add(cut.select("page", F.struct(*[c for c in cut.columns if c != "page"]).alias("compact")), "compact")
    if "links" in asked:
        add(_lists(inspect.links(found, request.same_host, request.most_links), F.col("dst"), "pos", "links"), "links", "array<string>")
    if "next_link" in asked:
        add(inspect.next_link(found, request.next_selector, request.same_host), "next_link")
    if "interactions" in asked:
        acts = inspect.interactions(found)
        add(acts.select("page", F.struct("elements", "forms", "next").alias("interactions")), "interactions")
    if "region" in asked:
        texts = inspect.region(found, request.region) if request.region else compact.select("page", F.col("content").alias("region"))
        add(texts, "region")
        out = out.withColumn("region", text_of(F.col("region")))
    if {"fields", "grounding", "candidates"} & asked:
        extraction = Extraction(found, request.rules)
        data = kept(extraction.pages())
        if "fields" in asked:
            add(data.select("page", F.struct("data", "errors", "required_missing").alias("fields")), "fields")
        if "grounding" in asked:
            texts = heads_with_source(found).join(compact.select("page", "content"), "page")
            placed = inspect.grounded(inspect.anchored(found, extraction.places()), texts)
            add(_lists(placed, F.struct("path", "selector", "snippet", "offset", "basis"), "path", "grounding"), "grounding", "array<struct<path:string,selector:string,snippet:string,offset:int,basis:string>>")
        if "candidates" in asked:
            near = _candidates(found, data, request)
            add(near, "candidates")
            out = out.withColumn("candidates", F.coalesce("candidates", F.create_map().cast("map<string,array<struct<selector:string,snippet:string>>>")))
    return out.select(*keys, *request.outputs, "error")


def heads_with_source(found: DataFrame) -> DataFrame:
    return found.where("node = 0").select("page", text_of(F.col("text")).alias("html"))


def _candidates(found: DataFrame, data: DataFrame, request: Request) -> DataFrame:
    """(page, candidates): for each required field that a page lacks, elements near its selector."""
    parts = []
    for rule in request.rules:
        if not rule.required or not rule.selector:
            continue
        lacking = data.where(F.array_contains("required_missing", rule.key)).select("page")
        near = inspect.candidates(found.join(lacking, "page", "left_semi"), rule.selector)
        parts.append(lacking.join(near, "page", "left").select("page", F.struct(F.lit(rule.key).alias("key"), F.coalesce("candidates", F.array().cast("array<struct<selector:string,snippet:string>>")).alias("value")).alias("e")))
    if not parts:
        return found.limit(0).select("page", F.create_map().cast("map<string,array<struct<selector:string,snippet:string>>>").alias("candidates"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("page").agg(F.map_from_entries(F.collect_list("e")).alias("candidates"))


def link_table(pages: DataFrame, same_host: bool = True, most: int = 200, url: str = "url", html: str = "html") -> DataFrame:
    """(src, pos, dst): the links a crawl may follow from each address, the first `most`, each once.

    Links are in the order of the page's anchors. Pages that share an address are read side by side: all first anchors, then
    all second ones; equal places go by dst."""
    found = inspect.followed(elements(pages, url=url, html=html), same_host)
    first = found.groupBy(F.col("url").alias("src"), "dst").agg(F.min("turn").alias("turn"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("turn", "dst"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("src", (F.col("place") - 1).alias("pos"), "dst")


__all__ = ["EXTRACTORS", "Request", "link_table", "parse_pages"]
