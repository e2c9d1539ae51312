"""Column functions over text: token estimates, terms, plain text, lines, numbers, dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The classes of characters that results depend on.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CJK = r"[\u3000-\u303f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef]"
HAN = r"[\u4e00-\u9fff]+"
LATIN = r"[a-z0-9_]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unpacked(value: Column) -> Column:
    """The fields of a struct as columns, the struct computed once; as fields of a column, it might be once for each."""
    return F.inline(F.array(value))


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def _rare(common: str, rare: str) -> str:
    """The class of characters `rare`, for regular expressions of Spark, which ask for each of its ranges in turn: characters of
    `common`, of which it holds none, fail at once."""
    return rf"[[^{common}]&&{rare}]"


def token_estimate(c: Column) -> Column:
    """One token a CJK character, a quarter for any other that isn't white space; at least 1, 0 for an empty text.

    The ideographic space counts as CJK and as white space, so it lowers what is left."""
    cjk = F.regexp_count(c, F.lit(_rare(r"\x00-\u2fff", CJK)))
    ink = F.length(F.translate(c, BLANKS, ""))
    estimate = F.greatest(F.lit(1), F.floor((ink + 3 * cjk) / 4.0).cast("int"))
    return F.when(text_of(c) == "", 0).otherwise(estimate)


def terms(c: Column) -> Column:
    """Search terms: words of Latin letters, digits and _, then pairs of neighbours in each run of Han characters."""
    low = F.lower(text_of(c))
    latin = F.regexp_extract_all(low, F.lit(LATIN), 0)
    runs = F.regexp_extract_all(low, F.lit(HAN), 0)
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, 2)))))
    return F.concat(latin, pairs)


def query_hits(query: Column, content: Column) -> Column:
    """How many distinct terms of the query the content holds somewhere."""
    low = F.lower(text_of(content))
    return F.size(F.filter(F.array_distinct(terms(query)), lambda t: F.contains(low, t)))


def plain_text(c: Column) -> Column:
    """Markdown without its marks; texts of links and of code stay."""
    steps = [(r"(?m)^```.*$", ""), (r"(?m)^#{1,6}\s*", ""), (r"(?m)^\s{0,2}[-*]\s+", ""), (r"(?m)^\s{0,2}>\s?", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"`([^`]*)`", "$1"), (r"\n{2,}", "\n")]
    out = text_of(c)
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return strip(out)


def lines(c: Column) -> Column:
    return F.split(F.replace(text_of(c), F.lit("\r\n"), F.lit("\n")), _rare(r" -~\xa0-\u2027", r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"))


def nonblank_lines(c: Column) -> Column:
    """Lines without white space at their ends, and without those that are nothing else."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def tidy(c: Column) -> Column:
    """Runs of spaces as one, none around line breaks, no blank lines; zero-width spaces dropped."""
    odd = BLANKS.replace("\n", "").replace(" ", "")
    out = F.translate(text_of(c), odd + "\u200b", " " * len(odd))  # the last has no counterpart, and goes
    out = F.regexp_replace(out, " {2,}", " ")
    out = F.replace(F.replace(out, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return strip(F.regexp_replace(out, "\n{2,}", "\n"))


def csv_cell(c: Column) -> Column:
    return F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def locate(snippet: Column, text: Column) -> Column:
    """Offset of the snippet, or of its first 40, 20, 10, 6 or 4 characters; null if none is found."""
    at = lambda s: F.nullif(F.instr(text, s), F.lit(0)) - 1
    shorter = [F.when(F.length(snippet) > n, at(F.substring(snippet, 1, n))) for n in (40, 20, 10, 6, 4)]
    return F.when((text_of(snippet) != "") & (text_of(text) != ""), F.coalesce(at(snippet), *shorter))


def should_fall_back(excerpt_chars: Column, content_chars: Column, hits: Column) -> Column:
    """Whether excerpts found too little: nothing, or no term and under 5 % of the content."""
    least = F.greatest(F.lit(1), F.floor(content_chars * 0.05))
    return (excerpt_chars <= 0) | ((hits == 0) & (excerpt_chars < least))


def number(c: Column) -> Column:
    """The first number in a text, thousands separators dropped; null without one."""
    return F.replace(F.nullif(F.regexp_extract(c, r"-?\d[\d,]*(?:\.\d+)?", 0), F.lit("")), F.lit(","), F.lit("")).try_cast("double")


def iso_date(c: Column) -> Column:
    """ISO form of a date in one of the usual notations; midnight without a zone is a date alone. Null otherwise."""
    raw = strip(c)
    day = F.regexp_replace(F.regexp_replace(raw, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3"), r"^(\d{4})年(\d{1,2})月(\d{1,2})日$", "$1-$2-$3")
    parts = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2})(\.\d+)?)?)?(Z|[+-]\d{2}:\d{2})?$"
    g = lambda i: F.regexp_extract(day, parts, i)
    date = F.concat_ws("-", g(1), F.lpad(g(2), 2, "0"), F.lpad(g(3), 2, "0"))
    clock = F.concat_ws(":", F.lpad(g(4), 2, "0"), F.lpad(g(5), 2, "0"), F.lpad(F.when(g(6) == "", "00").otherwise(g(6)), 2, "0"))
    fraction = F.when(g(7) == "", "").otherwise(F.substring(F.rpad(g(7), 7, "0"), 1, 7))
    zone = F.when(g(8) == "Z", "+00:00").otherwise(g(8))
    bare = (g(4) == "") | ((clock == "00:00:00") & (zone == ""))
    valid = day.rlike(parts) & date.try_cast("date").isNotNull() & ((g(4) == "") | F.concat(date, F.lit(" "), clock).try_cast("timestamp").isNotNull())
    return F.when(valid, F.when(bare, date).otherwise(F.concat(date, F.lit("T"), clock, fraction, zone)))


def retry_after(c: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After value, in seconds or as an HTTP date; never below 0, null if unreadable."""
    stamp = F.try_to_timestamp(F.regexp_replace(strip(c), r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.coalesce(strip(c).try_cast("double"), F.unix_timestamp(stamp).cast("double") - F.unix_timestamp(now))
    return F.greatest(F.lit(0.0), seconds)


def json_object(c: Column) -> Column:
    """The text from the first { to the last }, if it is a JSON object; null otherwise."""
    found = F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(found).isNotNull(), found)
