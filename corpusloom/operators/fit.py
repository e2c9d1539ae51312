"""Lines of low value dropped from markdown: navigation, footers, comments, related links, advertisements.

One fold over a document's lines inside its row: no shuffle, whatever the length of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusloom.functions.text import let, lines, strip, text_of

# Phrases of sections and lines of each kind, and limits.
CATEGORIES = ("nav", "footer", "comments", "related", "ads")
SECTIONS = {
    "comments": "评论|留言|Comments?|Discussion|读者反馈",
    "related": "相关阅读|相关推荐|相关文章|推荐文章|推荐阅读|猜你喜欢|热门文章|热门推荐|延伸阅读|You (?:may|might) also like|Related|Recommended",
    "ads": "广告|赞助|Sponsored|Advertisement",
}
ADS = "广告|赞助|Sponsored|Advertisement"
FOOTER = "©|版权|备案|ICP备|All rights reserved|Privacy Policy|Terms of Service|隐私政策|服务条款|联系我们"
SHORT_LINE, GUARD_CHARS, LEAST_KEPT = 200, 400, 0.3
LINK = r"\[[^\]]*\]\([^)]*\)"
HEADING = r"^#{1,6}\s+(.*)$"


def section_kind(title: Column) -> Column:
    """The kind of section a heading opens, null for content."""
    out = F.lit(None).cast("string")
    for kind, phrases in SECTIONS.items():
        out = F.coalesce(out, F.when(title.rlike(f"(?i)({phrases})"), kind))
    return out


def line_kind(line: Column) -> Column:
    """ads or footer by phrase in short lines, nav by links with little beside them; null for content."""
    looked = F.struct(strip(F.regexp_replace(line, LINK, "")).alias("beside"), F.regexp_count(line, F.lit(LINK)).alias("links"))

    def decide(x: Column) -> Column:
        phrase = F.when(x["beside"] == "", line).otherwise(x["beside"])
        left = F.length(x["beside"])
        nav = ((x["links"] >= 3) & (left <= 40)) | ((x["links"] >= 2) & (left <= 16))
        return F.when(short & phrase.rlike(f"(?i)({ADS})"), "ads").when(short & phrase.rlike(f"(?i)({FOOTER})"), "footer").when(nav, "nav")

    short = F.length(line) <= SHORT_LINE
    return F.when(short | line.contains("]("), let(looked, decide))  # a long line without links is content, as most of a page is


def _looked_at(rows: Column) -> Column:
    """Each line with what doesn't depend on the lines before it, computed once."""
    bare = F.transform(rows, lambda x: F.struct(x.alias("line"), strip(x).alias("bare")))
    return F.transform(
        bare,
        lambda x: F.struct(
            x["line"].alias("line"),
            (x["bare"] == "").alias("blank"),
            x["bare"].startswith("```").alias("fence"),
            (x["bare"].startswith("#") & x["bare"].rlike(HEADING)).alias("heading"),
            F.when(x["bare"].startswith("#") & x["bare"].rlike(HEADING), section_kind(F.regexp_extract(x["bare"], HEADING, 1))).alias("opened"),
            F.when(x["bare"] != "", line_kind(x["bare"])).alias("kind"),
        ),
    )


def _step(state: Column, x: Column) -> Column:
    within = state["fence"]
    heading = x["heading"] & ~x["fence"] & ~within
    dropped = F.when(x["fence"] | within | x["blank"], F.lit(None).cast("string")).when(heading, x["opened"]).when(state["section"].isNotNull(), state["section"]).otherwise(x["kind"])
    return F.struct(
        F.when(x["fence"], ~within).otherwise(within).alias("fence"),
        F.when(heading, x["opened"]).otherwise(state["section"]).alias("section"),
        F.array_append(state["kinds"], F.struct(dropped.alias("kind"), (x["blank"] & ~within).alias("empty"))).alias("kinds"),
    )


def _count(rows: Column, kind: str) -> Column:
    return F.size(F.filter(rows, lambda r: r["kind"] == kind))


def fit_markdown(content: Column) -> Column:
    """struct(content, dropped struct by category, applied).

    Lines in code fences stay. A heading of a section of low value drops what follows up to the next heading. If that
    leaves nothing, or under 30 % of 400 characters or more, the content stays as it was. A null content is empty."""
    start = F.struct(F.lit(False).alias("fence"), F.lit(None).cast("string").alias("section"), F.array().cast("array<struct<kind:string,empty:boolean>>").alias("kinds"))

    def decided(text: Column) -> Column:
        return let(_looked_at(lines(text)), lambda rows: F.zip_with(rows, F.aggregate(rows, start, _step, lambda s: s["kinds"]), lambda r, k: F.struct(F.when(k["empty"], "").otherwise(r["line"]).alias("line"), k["kind"].alias("kind"))))

    def result(text: Column, rows: Column) -> Column:
        fitted = strip(F.array_join(F.transform(F.filter(rows, lambda r: r["kind"].isNull()), lambda r: r["line"]), "\n"))
        return let(F.struct(fitted.alias("content"), F.struct(*[_count(rows, k).alias(k) for k in CATEGORIES]).alias("dropped")), lambda x: chosen(text, x))

    def chosen(text: Column, fitted: Column) -> Column:
        kept = (fitted["content"] != "") & ~((F.length(text) >= GUARD_CHARS) & (F.length(fitted["content"]) < F.length(text) * LEAST_KEPT))
        applied = (strip(text) != "") & kept
        none = F.struct(*[F.lit(0).alias(k) for k in CATEGORIES])
        return let(applied, lambda a: F.struct(F.when(a, fitted["content"]).otherwise(text).alias("content"), F.when(a, fitted["dropped"]).otherwise(none).alias("dropped"), a.alias("applied")))

    return let(text_of(content), lambda text: let(decided(text), lambda rows: result(text, rows)))


def compression(raw_chars: Column, content: Column, tokens: Column) -> Column:
    """struct(raw_chars, output_chars, output_tokens_est, compression_ratio)."""
    out = F.length(text_of(content))
    ratio = F.when(raw_chars > 0, F.round(out / raw_chars, 4)).otherwise(F.lit(0.0))
    return F.struct(F.greatest(F.lit(0), raw_chars).alias("raw_chars"), out.alias("output_chars"), F.greatest(F.lit(0), tokens).alias("output_tokens_est"), ratio.alias("compression_ratio"))
