"""Recipes of sites: read as a small table, and checked before they are used."""

from __future__ import annotations

import json
import re
from difflib import get_close_matches
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusloom.functions.text import strip
from corpusloom.html.elements import chains
from corpusloom.html.fields import parse_rules

# The keys of a recipe.
KEYS = ("host", "wait_for", "scroll", "click", "root_selector", "extract", "crawl", "note")
SELECTORS = ("wait_for", "click", "root_selector")
CRAWL_KEYS = ("next_selector", "max_pages")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """(host, root_selector, next_selector, max_pages, extract, note) of a folder of JSON files.

    A byte order mark is allowed; files that aren't JSON objects are passed over. The host is that in the file, else
    the file's name; of files for one host the last by name counts."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.regexp_replace("value", "^﻿", "").alias("_j"), F.col("_metadata.file_name").alias("_f"))
    good = files.where(F.try_parse_json("_j").isNotNull() & strip(F.col("_j")).startswith("{"))
    text = lambda p: F.nullif(strip(F.get_json_object("_j", p)), F.lit(""))
    pages = F.get_json_object("_j", "$.crawl.max_pages").try_cast("int")
    host = F.coalesce(text("$.host"), F.regexp_replace("_f", r"\.json$", ""))
    rows = good.select(F.regexp_replace(F.lower(host), r"^\.+", "").alias("host"), text("$.root_selector").alias("root_selector"), text("$.crawl.next_selector").alias("next_selector"), F.when(pages > 0, pages).alias("max_pages"), text("$.extract").alias("extract"), text("$.note").alias("note"), "_f")
    last = Window.partitionBy("host").orderBy(F.desc("_f"))
    return rows.where("host <> ''").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_f")


def problems(recipe: Any, stem: str = "") -> list[tuple[str, str]]:
    """(error or warning, message) of one recipe; empty if it is sound. Runs on the driver: recipes are few."""
    if not isinstance(recipe, dict):
        return [("error", "a recipe is a JSON object")]
    out = [("warning", f"unknown key {k}{_meant(k, KEYS)}") for k in recipe if k not in KEYS]
    if recipe.get("host") is not None:
        out += _host_problems(recipe["host"], stem)
    out += [p for k in SELECTORS if k in recipe for p in _selector_problems(recipe[k], k)]
    if not isinstance(recipe.get("scroll", False), bool):
        out.append(("error", "scroll is true or false"))
    if not isinstance(recipe.get("note", ""), str):
        out.append(("warning", "note should be text"))
    crawl = recipe.get("crawl")
    if isinstance(crawl, dict):
        out += [("warning", f"unknown key crawl.{k}{_meant(k, CRAWL_KEYS)}") for k in crawl if k not in CRAWL_KEYS]
        if "next_selector" in crawl:
            out += _selector_problems(crawl["next_selector"], "crawl.next_selector")
        most = crawl.get("max_pages", 1)
        if isinstance(most, bool) or not isinstance(most, int) or most <= 0:
            out.append(("error", "crawl.max_pages is a positive whole number"))
    elif crawl is not None:
        out.append(("error", "crawl is an object"))
    if recipe.get("extract") is not None:
        try:
            parse_rules(recipe["extract"])
        except ValueError as e:
            out.append(("error", f"extract: {e}"))
    return out


def _meant(key: str, known: tuple[str, ...]) -> str:
    near = get_close_matches(str(key), known, n=1)
    return f", perhaps {near[0]}" if near else ""


def _host_problems(host: Any, stem: str) -> list[tuple[str, str]]:
    name = host.strip().lower().lstrip(".") if isinstance(host, str) else ""
    if not re.fullmatch(r"[a-z0-9]([a-z0-9.-]*[a-z0-9])?", name):
        return [("error", f"not the name of a host: {host!r}")]
    return [("warning", f"host {name} counts, not the file's name {stem}")] if stem and stem.lower() != name else []


def _selector_problems(selector: Any, label: str) -> list[tuple[str, str]]:
    if not isinstance(selector, str) or not selector.strip():
        return [("error", f"{label} is a selector")]
    try:
        chains(selector)
    except ValueError as e:
        return [("error", f"{label}: {e}")]
    return []


def check_folder(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """(file, error or warning, message) over a folder of recipes."""
    out = []
    for row in spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_name").alias("f")).orderBy("f").toLocalIterator():
        try:
            found = problems(json.loads(row["value"].removeprefix("﻿")), row["f"].removesuffix(".json"))
        except ValueError as e:
            found = [("error", f"not JSON: {e}")]
        out += [(row["f"], *p) for p in found]
    return out
