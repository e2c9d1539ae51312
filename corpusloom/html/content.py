"""The content of pages as compact text, from the table of elements: where it is, and how its blocks read."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from corpusloom.functions.text import csv_cell, let, strip, text_of, tidy, token_estimate
from corpusloom.functions.web import absolute, part
from corpusloom.html.elements import TEXT, attribute, heads, joined_text, kept, ordered, select
from corpusloom.operators.chunks import truncate_texts

# Elements and names of each kind, and limits.
DROPPED = "script style noscript svg iframe template canvas form button input select textarea object embed video audio source track map area link meta".split()
BOILERPLATE = "nav navigation navbar menu sidebar footer contentinfo complementary comment share related recommend advert ad ads breadcrumb cookie popup modal banner toolbar pagination foot copyright license beian".split()
INLINE = "a span strong b em i u s del ins sup sub mark small code br img wbr time abbr cite q kbd samp var bdi bdo ruby rt meter progress".split()
PROSE = "p h1 h2 h3 h4 h5 h6 pre blockquote li td dd dt figcaption".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
ROOT_LEAST, ROOT_SHARE, CANDIDATES, TIGHT, TABLE_ROWS, SPAN_MOST, SHORT_BLOCK = 400, 0.15, 25, 0.9, 100, 50, 120
NO_TARGET = ("#", "javascript:", "mailto:", "tel:")
TRUNCATED_TABLE = "…(表格已截断)"

NESTED = 2  # links and code within each other that are read as such
_ALL = 1 << 20
_LANGUAGE = r"(?:^|\s)(?:brush(?::\s*|\s+)|language-|lang-|highlight-)[^a-z0-9_+#.\s-]*([a-z0-9_+#.-]+)"


def _any(tags: list[str], array: str) -> Column:
    return F.arrays_overlap(F.col(array), F.array(*[F.lit(t) for t in tags]))


def live(found: DataFrame) -> DataFrame:
    """Rows that aren't in, and aren't, elements without content."""
    return found.where(~F.col("tag").isin(DROPPED) & ~_any(DROPPED, "lineage"))


def titles(found: DataFrame) -> DataFrame:
    """(page, title): that of the first title element, else of the first h1."""
    named = found.where(F.col("tag").isin("title", "h1"))
    first = named.groupBy("page", "tag").agg(F.min("node").alias("node"))
    texts = joined_text(found, first).withColumn("text", tidy(F.col("text")))
    of = lambda tag: F.max(F.when((F.col("tag") == tag) & (F.col("text") != ""), F.col("text")))
    return texts.groupBy("page").agg(F.coalesce(of("title"), of("h1")).alias("title"))


def containers(rows: DataFrame) -> DataFrame:
    """(page, node, last, depth, tag, semantic, wide, raw, size, score) of elements that content may be in, the body among
    them: sums over the text below, of which each stretch counts once for each of its ancestors."""
    semantic = F.coalesce(F.col("tag").isin("article", "main") | (attribute("role") == "main"), F.lit(False))
    wide = semantic | F.col("tag").isin("div", "section")
    # what counts for a stretch of text is the prose around it, less the links, but below the container only
    around = lambda tags: F.size(F.filter(tags, lambda t: t.isin(PROSE))) - F.size(F.filter(tags, lambda t: t == "a"))
    own = around(F.concat("lineage", F.array("tag")))
    held = rows.where((F.col("tag") == "body") | (F.col("node") == 0) | wide).select("page", "node", "last", F.size("above").alias("depth"), "tag", semantic.alias("semantic"), wide.alias("wide"), own.alias("own"))
    n = F.length("text")
    measured = rows.where(F.col("tag") == TEXT).select("page", "above", n.alias("n"), "letters", "words", (n * around(F.col("lineage"))).alias("prose"))
    ups = measured.select("page", "n", "letters", "words", "prose", F.explode("above").alias("node"))
    sums = ups.groupBy("page", "node").agg(F.sum("n").alias("n"), F.count("*").alias("texts"), *[F.sum(c).alias(c) for c in ("letters", "words", "prose")])
    zero = lambda c: F.coalesce(c, F.lit(0))
    raw = zero(F.col("n") + F.col("texts") - 1)
    size = zero(F.col("letters") + F.greatest(F.col("words") - 1, F.lit(0)))
    score = F.greatest(zero(F.col("prose") - F.col("own") * F.col("n")), F.lit(0))
    return held.join(sums, ["page", "node"], "left").select(*[c for c in held.columns if c != "own"], raw.alias("raw"), size.alias("size"), score.alias("score"))


def content_roots(rows: DataFrame, selector: str | None = None) -> DataFrame:
    """(page, root, root_last, root_depth, root_tag): what the selector finds first; else a semantic container of some size;
    else the tightest of those with the most prose; else the body."""
    own = Window.partitionBy("page")
    named = F.struct("node", "last", "depth", "tag")
    held = containers(rows).withColumn("body", F.coalesce(F.min(F.when(F.col("tag") == "body", F.col("node"))).over(own), F.lit(0)))
    total = F.max(F.when(F.col("node") == F.col("body"), F.col("size"))).over(own)
    held = held.withColumn("enough", F.col("wide") & (F.col("size") >= ROOT_LEAST) & (F.col("size") >= total * ROOT_SHARE))
    held = held.withColumn("turn", F.row_number().over(own.orderBy(F.desc("wide"), F.desc("raw"), "node")))
    fit = F.col("enough") & (F.col("turn") <= CANDIDATES) & (F.col("score") > 0)
    held = held.withColumn("fit", fit & (F.col("score") >= F.max(F.when(fit, F.col("score"))).over(own) * TIGHT))
    marked = F.max(F.when(F.col("enough") & F.col("semantic"), F.struct("size", -F.col("node"), named.alias("at"))))
    dense = F.max(F.when(F.col("fit"), F.struct("depth", "raw", -F.col("node"), named.alias("at"))))
    body = F.max(F.when(F.col("node") == F.col("body"), named))
    picks = held.groupBy("page").agg(F.coalesce(marked["at"], dense["at"], body).alias("at"))
    if selector:
        try:
            asked = select(rows, selector).groupBy("page").agg(F.min(F.struct("node", "last", F.size("above").alias("depth"), "tag")).alias("asked"))
            picks = picks.join(asked, "page", "left").select("page", F.coalesce("asked", "at").alias("at"))
        except ValueError:  # a selector that isn't understood finds nothing
            pass
    return picks.select("page", *[F.col(f"at.{a}").alias(b) for a, b in (("node", "root"), ("last", "root_last"), ("depth", "root_depth"), ("tag", "root_tag"))])


def _boilerplate() -> Column:
    """By its tag, or by a word of its id, class or role, in the plural too."""
    marks = F.lower(F.concat_ws(" ", attribute("id"), attribute("class"), attribute("role")))
    return F.col("tag").isin("nav", "footer", "aside") | marks.rlike(rf"(?<![a-z0-9])(?:{'|'.join(sorted(BOILERPLATE))})s*(?![a-z0-9])")


def placed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows below each page's root that may show, with how they stand to it.

    path, ups: tags and numbers of the ancestors below the root. kinds: a letter for each, b for what makes a block, i for
    what stands in a line, u for what renders as a whole. turn: blocks opened so far. figure: the figure with a picture or
    a caption that the row stands in."""
    inside = rows.join(roots, "page").where((F.col("node") > F.col("root")) & (F.col("node") <= F.col("root_last")))
    below = F.col("root_depth") + 2
    inside = inside.withColumn("path", F.slice("lineage", below, _ALL)).withColumn("ups", F.slice("above", below, _ALL))
    kind = lambda t: F.when(t.isin(INLINE), "i").when(t.isin("pre", "table"), "u").otherwise("b")
    inside = inside.withColumn("kinds", F.array_join(F.transform("path", kind), ""))
    so_far = Window.partitionBy("page").orderBy("node")
    block = (F.col("tag") != TEXT) & ~F.col("tag").isin(INLINE)
    straight = block & F.col("kinds").rlike("^b*$")
    framed = straight & (F.col("tag") == "figure") & (F.array_contains("holds", "img") | F.array_contains("holds", "figcaption"))
    inside = inside.withColumns({
        "hidden": F.coalesce(F.max(F.when(straight & _boilerplate(), F.col("last"))).over(so_far) >= F.col("node"), F.lit(False)),
        "turn": F.count(F.when(block & ~F.col("kinds").contains("i"), 1)).over(so_far),
        "frame": F.max(F.when(framed, F.struct("node", "last"))).over(so_far),
    })
    inside = inside.where(~F.col("hidden")).withColumn("link", _link())
    figure = F.when((F.col("frame.last") >= F.col("node")) & (F.col("frame.node") < F.col("node")), F.col("frame.node"))
    return inside.withColumn("figure", figure).withColumn("blocks", F.length(F.regexp_extract("kinds", "^b*", 0)))


def _link() -> Column:
    """Where an anchor leads, if it leads somewhere: whether that is outside, and as what it is shown."""
    target = strip(text_of(attribute("href")))
    leads = (target != "") & ~F.coalesce(*[F.nullif(target.startswith(p), F.lit(False)) for p in NO_TARGET], F.lit(False))

    def shown(to: Column) -> Column:
        def of(x: Column) -> Column:
            path = F.when(x["path"] == "", "/").otherwise(x["path"])
            return F.struct(x["outside"].alias("outside"), F.when(x["outside"], x["to"]).when(x["query"] != "", F.concat(path, F.lit("?"), x["query"])).otherwise(path).alias("shown"))

        return let(F.struct(to.alias("to"), part(to, 3).alias("path"), part(to, 4).alias("query"), (F.lower(part(to, 2)) != F.lower(part(F.col("url"), 2))).alias("outside")), of)

    return F.when((F.col("tag") == "a") & leads, let(absolute(F.col("url"), target), shown))


def _outer(rows: DataFrame) -> list[Column]:
    """The ancestors of a row that make blocks, down to the first that doesn't."""
    return [F.slice("path", 1, F.col("blocks")).alias("path"), F.slice("ups", 1, F.col("blocks")).alias("ups")]


def paragraphs(inside: DataFrame, links: str) -> tuple[DataFrame, DataFrame]:
    """(page, at, path, ups, text) of what stands in a line, and (page, kept, dropped) of its links.

    Neighbours in one block make a paragraph. Links and code are put together first, the innermost ones before those
    around them."""
    special = F.col("tag").isin("a", "code")
    alone = F.col("kinds").rlike("^b*$")
    shown = (F.col("tag") == TEXT) & ~(alone & (F.col("words") == 0) & ~F.col("text").contains("\u200b")) | F.col("tag").isin("br", "img") | special
    captioned = F.col("figure").isNull() | F.array_contains("path", "figcaption")
    pieces = inside.where(F.col("kinds").rlike("^b*i*$") & shown & captioned)
    alt = strip(text_of(attribute("alt")))
    text = F.when(F.col("tag") == TEXT, F.col("text")).when(F.col("tag") == "br", "\n").when((F.col("tag") == "img") & (alt != ""), F.concat(F.lit("["), alt, F.lit("]"))).otherwise("")
    within = F.filter(F.arrays_zip(F.col("ups").alias("node"), F.col("path").alias("tag")), lambda x: x["tag"].isin("a", "code"))
    within = F.when(special, F.concat(within, F.array(F.struct("node", "tag")))).otherwise(within)
    block = F.coalesce(F.try_element_at("ups", F.nullif(F.col("blocks"), F.lit(0))), F.col("root"))
    pieces = pieces.select("page", block.alias("block"), "turn", "node", text.alias("text"), F.slice(within, 1, NESTED).alias("within"), "link", *_outer(pieces), F.lit(0).alias("kept"), F.lit(0).alias("dropped"))
    for level in range(NESTED, 0, -1):
        pieces = _put_together(pieces, level, links)
    runs = pieces.groupBy("page", "block", "turn").agg(F.min("node").alias("at"), F.first("path").alias("path"), F.first("ups").alias("ups"), tidy(ordered(F.struct("node", "text"))).alias("text"), F.sum("kept").alias("kept"), F.sum("dropped").alias("dropped"))
    counts = runs.groupBy("page").agg(F.sum("kept").alias("links_kept"), F.sum("dropped").alias("links_dropped"))
    return runs.where("text <> ''").select("page", "at", "path", "ups", "text"), counts


def _put_together(pieces: DataFrame, level: int, links: str) -> DataFrame:
    """Pieces within a link or code of this level become one piece; others stay."""
    around = F.get("within", F.lit(level - 1))
    keyed = pieces.withColumn("around", around).withColumn("key", F.coalesce("around.node", "node"))
    out = keyed.groupBy("page", "block", "turn", "key").agg(
        F.first("path").alias("path"), F.first("ups").alias("ups"), F.first("around.tag").alias("kind"), F.first("within").alias("within"),
        ordered(F.struct("node", "text")).alias("text"), F.max(F.when(F.col("node") == F.col("key"), F.col("link"))).alias("link"), F.sum("kept").alias("kept"), F.sum("dropped").alias("dropped"),
    )
    out = out.withColumn("label", F.when(F.col("kind") == "a", tidy(F.col("text"))))  # of links only: most text isn't in one
    gone = F.lit(links == "none") | (F.col("link.outside") & F.lit(links != "all")) | (F.col("label") == "")
    bracketed = F.replace(F.replace(F.col("label"), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))
    link = F.when(F.col("link").isNull(), F.col("label")).when(~gone, F.concat(F.lit("["), bracketed, F.lit("]("), F.col("link.shown"), F.lit(")"))).when(F.col("label") != "", F.concat(F.col("label"), F.lit(" "))).otherwise("")
    code = strip(F.col("text"))
    text = F.when(F.col("kind") == "a", link).when((F.col("kind") == "code") & (code != ""), F.concat(F.lit("`"), code, F.lit("`"))).when(F.col("kind") == "code", "").otherwise(F.col("text"))
    counted = (F.col("kind") == "a") & F.col("link").isNotNull()
    return out.select("page", "block", "turn", F.col("key").alias("node"), text.alias("text"), F.slice("within", 1, level - 1).alias("within"), "link", "path", "ups", (F.col("kept") + F.when(counted & ~gone, 1).otherwise(0)).alias("kept"), (F.col("dropped") + F.when(counted & gone, 1).otherwise(0)).alias("dropped"))


def code_blocks(inside: DataFrame) -> DataFrame:
    """(page, at, path, ups, text) of preformatted text: that of its first code element, or its own, fenced."""
    unit = F.get("ups", F.col("blocks"))
    owner = inside.where((F.col("tag") == "pre") & F.col("kinds").rlike("^b*$")).select("page", F.col("node").alias("at"), *_outer(inside), F.concat_ws(" ", attribute("class"), attribute("data-lang")).alias("named"))
    within = inside.where(F.col("kinds").rlike("^b*u")).withColumn("at", unit)
    held = within.groupBy("page", "at").agg(
        F.min(F.when(F.col("tag") == "code", F.struct("node", "last", F.concat_ws(" ", attribute("class"), attribute("data-lang")).alias("named")))).alias("code"),
        F.array_sort(F.collect_list(F.when(F.col("tag") == TEXT, F.struct("node", "text")))).alias("texts"),
    )
    own = F.filter("texts", lambda t: F.col("code").isNull() | t["node"].between(F.col("code.node"), F.col("code.last")))
    raw = F.regexp_replace(F.array_join(F.transform(own, lambda t: t["text"]), ""), r"\A\n+|\n+\z", "")
    joined = owner.join(held, ["page", "at"]).withColumn("raw", raw).where(strip(F.col("raw")) != "")
    language = lambda c: F.nullif(F.regexp_extract(F.lower(text_of(c)), _LANGUAGE, 1), F.lit(""))
    fence = F.coalesce(language(F.col("code.named")), language(F.col("named")), F.lit(""))
    return joined.select("page", "at", "path", "ups", F.concat(F.lit("```"), fence, F.lit("\n"), F.col("raw"), F.lit("\n```")).alias("text"))


@pandas_udf(ArrayType(ArrayType(StringType())))
def grid(tables: pd.Series) -> pd.Series:
    """Rows of cells (row, text, wide, high): a cell over columns is followed by empty ones, one over rows is repeated."""

    def one(cells) -> list[list[str]]:
        rows: dict[int, list] = {}
        for c in cells:
            rows.setdefault(c["row"], []).append(c)
        out, below = [], {}  # below: column -> (rows still to fill, text)
        for own in rows.values():
            filled, column = {c: text for c, (_, text) in below.items()}, 0
            after = {c: (n - 1, text) for c, (n, text) in below.items() if n > 1}
            taken = set(filled)
            for cell in own:
                if cell["text"] is None:
                    continue
                while column in taken:
                    column += 1
                for i in range(cell["wide"]):
                    filled[column + i] = "" if i else cell["text"]
                    if cell["high"] > 1:
                        after[column + i] = (cell["high"] - 1, filled[column + i])
                column += cell["wide"]
            below = after
            if any(filled.values()):
                out.append([filled.get(i, "") for i in range(max(filled) + 1)])
        return out

    return tables.map(one)


def tables(rows: DataFrame, inside: DataFrame) -> DataFrame:
    """(page, at, path, ups, text) of tables as lines of comma-separated cells."""
    owner = inside.where((F.col("tag") == "table") & F.col("kinds").rlike("^b*$")).select("page", F.col("node").alias("at"), *_outer(inside))
    within = inside.where(F.col("kinds").rlike("^b*u")).withColumn("at", F.get("ups", F.col("blocks")))
    cells = within.where(F.col("tag").isin("td", "th") & (F.element_at("path", -1) == "tr"))
    number = lambda name: F.regexp_extract(strip(text_of(attribute(name))), r"^[+-]?\d+$", 0).try_cast("int")
    span = lambda name: F.when(number(name).isNotNull(), F.greatest(F.lit(1), F.least(number(name), F.lit(SPAN_MOST)))).otherwise(1)
    filled = joined_text(rows, cells.select("page", "at", F.col("parent").alias("row"), "node", span("colspan").alias("wide"), span("rowspan").alias("high")), " ").withColumn("text", tidy(F.col("text")))
    empty = within.where(F.col("tag") == "tr").select("page", "at", F.col("node").alias("row"), "node", F.lit(1).alias("wide"), F.lit(1).alias("high"), F.lit(None).cast("string").alias("text"))
    whole = filled.select(*empty.columns).unionByName(empty)
    cell = F.struct("row", "node", "text", "wide", "high")
    held = whole.groupBy("page", "at").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    line = lambda row: F.array_join(F.transform(row, csv_cell), ",")
    trimmed = F.transform("grid", lambda row: F.when(F.element_at(row, -1) == "", F.regexp_replace(line(row), ",+$", "")).otherwise(line(row)))
    drawn = owner.join(held, ["page", "at"]).withColumn("grid", grid("cells")).withColumn("lines", trimmed).where(F.size("lines") > 0)
    text = F.array_join(F.when(F.size("lines") > TABLE_ROWS, F.concat(F.slice("lines", 1, TABLE_ROWS), F.array(F.lit(TRUNCATED_TABLE)))).otherwise(F.col("lines")), "\n")
    return drawn.select("page", "at", "path", "ups", text.alias("text"))


def pictures(inside: DataFrame) -> DataFrame:
    """(page, at, path, ups, text) of the first picture of each figure."""
    held = inside.where(F.col("figure").isNotNull() & (F.col("tag") == "img"))
    first = held.withColumn("nth", F.row_number().over(Window.partitionBy("page", "figure").orderBy("node"))).where("nth = 1")
    alt, source = strip(text_of(attribute("alt"))), strip(text_of(attribute("src")))
    shown = F.when((source == "") | source.startswith("data:"), F.when(alt != "", F.concat(F.lit("["), alt, F.lit("]")))).otherwise(F.concat(F.lit("!["), alt, F.lit("]("), absolute(F.col("url"), source), F.lit(")")))
    return first.select("page", F.col("node").alias("at"), *_outer(first), shown.alias("text")).where("text is not null")


def blocks(found: DataFrame) -> DataFrame:
    """(page, at, text) from blocks (page, at, path, ups, text): headings joined and marked, lists and quotes marked."""
    heading = F.array_position(F.transform("path", lambda t: t.isin(HEADINGS)), F.lit(True)).cast("int")
    found = found.withColumn("h", heading)
    key = F.when(F.col("h") > 0, F.get("ups", F.col("h") - 1)).otherwise(F.col("at"))
    cut = lambda c: F.when(F.col("h") > 0, F.slice(c, 1, F.col("h") - 1)).otherwise(F.col(c)).alias(c)
    rank = F.when(F.col("h") > 0, F.substring(F.get("path", F.col("h") - 1), 2, 1).cast("int"))
    found = found.select("page", "at", "text", key.alias("key"), rank.alias("rank"), cut("path"), cut("ups"))
    found = found.groupBy("page", "key").agg(F.min("at").alias("at"), F.first("rank").alias("rank"), F.first("path").alias("path"), F.first("ups").alias("ups"), ordered(F.struct(F.col("at").alias("node"), "text"), " ").alias("text"))
    marked = F.when(F.col("rank").isNotNull(), F.concat(F.expr("repeat('#', rank)"), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    before = F.coalesce(F.lag("at").over(Window.partitionBy("page").orderBy("at")), F.lit(-1))
    found = found.withColumn("before", before)
    prefix = F.transform(F.arrays_zip(F.col("path").alias("tag"), F.col("ups").alias("node")), lambda x: F.when(x["tag"] == "li", F.when(x["node"] > F.col("before"), "- ").otherwise("  ")).when(x["tag"] == "blockquote", "> ").otherwise(""))
    return found.select("page", "at", strip(F.concat(F.array_join(prefix, ""), marked)).alias("text"))


def distinct_blocks(found: DataFrame) -> DataFrame:
    """Short blocks once, long ones as often as they come."""
    turn = F.row_number().over(Window.partitionBy("page", "text").orderBy("at"))
    return found.where("text <> ''").withColumn("turn", turn).where((F.col("turn") == 1) | (F.length("text") > SHORT_BLOCK)).drop("turn")


def compact(found: DataFrame, links: str = "internal", selector: str | None = None, max_tokens: int | None = None) -> DataFrame:
    """(page, content, title, blocks, links_kept, links_dropped, root, truncated, tokens) of every page of a table of elements.

    links: internal (others as text), all or none. selector: where the content is, if it finds something."""
    if links not in ("internal", "all", "none"):
        raise ValueError(f"not known: {links}")
    rows = live(found)
    roots = content_roots(rows, selector)
    inside = kept(placed(rows, roots))
    lines, counts = paragraphs(inside, links)
    every = lines.unionByName(code_blocks(inside)).unionByName(tables(rows, inside)).unionByName(pictures(inside))
    content = distinct_blocks(blocks(every)).groupBy("page").agg(ordered(F.struct(F.col("at").alias("node"), "text"), "\n").alias("content"), F.count("*").cast("int").alias("blocks"))
    whole = heads(found).select("page").join(roots.select("page", F.col("root_tag").alias("root")), "page", "left").join(titles(found), "page", "left").join(counts, "page", "left").join(content, "page", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    whole = whole.select("page", text_of(F.col("content")).alias("content"), text_of(F.col("title")).alias("title"), number("blocks"), number("links_kept"), number("links_dropped"), F.coalesce("root", F.lit("html")).alias("root"))
    if max_tokens:
        cut = truncate_texts(whole.withColumnRenamed("content", "_whole"), "_whole", max_tokens)
        return cut.drop("_whole").select("page", "content", "title", "blocks", "links_kept", "links_dropped", "root", "truncated", "tokens")
    return whole.withColumn("truncated", F.lit(False)).withColumn("tokens", token_estimate(F.col("content")))
