"""Column functions over addresses and identities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusloom.functions.text import SPACE, strip, text_of

# Query parameters that only track visits, and suffixes that tell a document's kind.
TRACKING = ("gclid", "fbclid", "msclkid", "spm")
STATIC_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".bmp", ".avif", ".css", ".js", ".mjs", ".json", ".xml",
    ".rss", ".zip", ".rar", ".7z", ".gz", ".tar", ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".woff", ".woff2", ".ttf",
    ".otf", ".eot", ".exe", ".dmg", ".apk", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
)
OFFICE = {"pdf": "application/pdf", "docx": "wordprocessingml", "xlsx": "spreadsheetml", "pptx": "presentationml"}

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, i: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; empty where absent."""
    return F.regexp_extract(url, _URL, i)


def host(url: Column) -> Column:
    """The host in lower case, without user and port."""
    return F.regexp_replace(F.lower(part(url, 2)), r"^.*@|:\d*$", "")


def _without_dots(path: Column) -> Column:
    """A path whose . and .. are resolved."""
    steps = F.split(path, "/")
    folder = F.element_at(steps, -1).isin(".", "..")
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda found, step: F.when(step == ".", found).when(step != "..", F.concat(found, F.array(step))).when(F.size(found) > 1, F.slice(found, 1, F.size(found) - 1)).otherwise(found))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(F.when(folder, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")).otherwise(path)


def absolute(base: Column, reference: Column) -> Column:
    """A reference of a page as an address, by the page's own; one with a scheme stays as it is."""
    origin = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    path, rest = F.regexp_extract(reference, r"^([^?#]*)", 1), F.regexp_extract(reference, r"^[^?#]*(.*)$", 1)
    here = part(base, 3)
    query = F.when(part(base, 4) != "", F.concat(F.lit("?"), part(base, 4))).otherwise("")
    folder = F.regexp_replace(F.when(here == "", "/").otherwise(here), "[^/]*$", "")
    return (
        F.when(reference.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (part(base, 1) == ""), reference)
        .when(reference.startswith("//"), F.concat(part(base, 1), F.lit(":"), reference))
        .when(reference == "", base)
        .when(path == "", F.concat(origin, here, F.when(rest.startswith("#"), query).otherwise(""), rest))
        .otherwise(F.concat(origin, _without_dots(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))), rest))
    )


def bare_host(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """Scheme and authority in lower case, no fragment, no parameters that only track; others keep their order."""
    kept = F.filter(F.split(part(url, 4), "&"), lambda p: (p != "") & ~F.lower(p).rlike(rf"^(utm_[^=]*|{'|'.join(TRACKING)})(=|$)"))
    query = F.array_join(F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))), "&")
    base = F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), part(url, 3))
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def host_suffixes(name: Column) -> Column:
    """a.b.c, b.c, c."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def redirect_target(url: Column, parameter: str = "uddg") -> Column:
    """The address that a redirecting link carries in a parameter, else the link itself."""
    found = F.regexp_extract(url, rf"[?&]{parameter}=([^&#]*)", 1)
    return F.when(found != "", F.try_url_decode(found)).otherwise(url)


def content_kind(content_type: Column, url: Column) -> Column:
    """pdf, docx, xlsx or pptx by type or suffix, text for other plain types, else html."""
    kind, path = F.lower(text_of(content_type)), F.lower(part(url, 3))
    out = F.lit(None).cast("string")
    for name, mark in OFFICE.items():
        out = F.coalesce(out, F.when(F.contains(kind, F.lit(mark)) | path.endswith(f".{name}"), name))
    plain = kind.startswith("text/plain") | F.contains(kind, F.lit("json")) | kind.startswith("text/csv") | kind.startswith("text/markdown")
    return F.coalesce(out, F.when(plain, "text"), F.lit("html"))


def watch_key(url: Column, selector: Column) -> Column:
    return F.substring(F.sha2(F.concat(url, F.lit("\n"), text_of(selector)), 256), 1, 32)


def task_id(kind: Column, url: Column, selector: Column) -> Column:
    return F.substring(F.sha2(F.concat(kind, F.lit("\n"), url, F.lit("\n"), text_of(selector)), 256), 1, 12)


def point_id(url: Column, stamp: Column, chunk: Column) -> Column:
    return F.concat(F.substring(F.sha1(F.concat(url, F.lit("|"), stamp)), 1, 16), F.lit(":"), chunk.cast("string"))


def content_lines(text: Column) -> Column:
    """Lines that aren't blank, without white space at their right ends."""
    rows = F.split(F.replace(text_of(text), F.lit("\r\n"), F.lit("\n")), "\n")
    return F.filter(F.transform(rows, lambda x: F.regexp_replace(x, rf"{SPACE}+\z", "")), lambda x: strip(x) != "")


def content_hash(text: Column) -> Column:
    """Equal for texts that differ in blank lines, line breaks or trailing white space only."""
    return F.sha2(F.array_join(content_lines(text), "\n"), 256)
