"""Pages as a table of elements: a row for each element and each stretch of text, in the page's order.

A thin tokeniser inside tasks says what stands where: a row's number, its last descendant's, its ancestors, its tag and
attributes. What is asked of pages are filters, joins, windows and aggregations over these rows, of the page's own
partition: a page's rows are dealt out once, by page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, reduce
from html.parser import HTMLParser
from itertools import accumulate, chain

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from corpusloom.functions.text import text_of
from corpusloom.session import shared_folder
from corpusloom.shipping import pieces, ship

TEXT = "#text"
DEEPEST = 256  # elements further down are taken for siblings
ROWS = 5_000  # of a batch
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that opens ends these, if they are open and nothing of the scope is in between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "thead": ({"tbody"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
P_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
COLUMNS = "node int, last int, parent int, place int, last_child boolean, tag string, attributes map<string,string>, text string, letters int, words int, above array<int>, lineage array<string>, holds array<string>"


class Tokeniser(HTMLParser):
    """Rows of COLUMNS, as lists; row 0 is the page's html."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[list] = []
        self.ways: list[tuple[list, list]] = [([], [])]  # above and lineage of what stands in none, one, two... of those open
        self.body = False
        self._open(self._add("html", {}))

    def _add(self, tag: str, attributes: dict | None, text: str | None = None) -> list:
        above, lineage = self.ways[-1]
        words = text.replace("\u200b", "").split() if text else []
        n = len(self.rows)
        row = [n, n, above[-1] if above else None, None, False, tag, attributes, text, sum(map(len, words)), len(words), above, lineage, set()]
        if tag != TEXT:
            for up in reversed(self.open):
                if tag in up[12]:
                    break  # and so do those above it
                up[12].add(tag)
        self.rows.append(row)
        return row

    def _open(self, row: list) -> None:
        above, lineage = self.ways[-1]
        self.open.append(row)
        self.ways.append(([*above, row[0]], [*lineage, row[5]]))

    def _close(self, n: int) -> None:
        """End the open elements from the n-th on."""
        for row in self.open[n:]:
            row[1] = len(self.rows) - 1
        del self.open[n:], self.ways[n + 1 :]

    def _end(self, tags: set[str] | frozenset[str], scope: set[str]) -> bool:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][5] in tags:
                self._close(i)
                return True
            if self.open[i][5] in scope:
                break
        return False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values: dict[str, str] = {}
        for k, v in attrs:
            values.setdefault(k, v or "")
        if tag == "html":
            self.rows[0][6] = values | self.rows[0][6]
            return
        if tag == "body" and self.body:
            return
        self.body |= tag == "body"
        if tag in P_ENDS:
            self._end({"p"}, {"td", "th", "table", "button"})
        if tag in ENDS:
            while self._end(*ENDS[tag]):
                pass
        self._close(DEEPEST)
        row = self._add(tag, values)
        if tag not in VOID:
            self._open(row)

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i][5] == tag), 0)
        if at:
            self._close(at)

    def handle_data(self, data: str) -> None:
        self._add(TEXT, None, data)


#: Scripts and style sheets, which hold no references, or the start of a named reference that no semicolon ends.
_OPEN = re.compile(r"(?is)<(script|style)\b.*?(?:</\1|\Z)|&(?=[a-z][a-z0-9]*(?![a-z0-9;]))")


@cache
def _unread(closed: bool, named: tuple[str, ...] | None) -> re.Pattern | None:
    """Scripts and style sheets, or the start of a reference that stays as it is."""
    if named is None:
        return _OPEN if closed else None
    return re.compile(r"(?is)<(script|style)\b.*?(?:</\1|\Z)|&(?!(?-i:" + "|".join(map(re.escape, named)) + ");)")


def rows_of(html: str | None, closed: bool = False, named: tuple[str, ...] | None = None) -> list[list]:
    """closed: named references are read where a semicolon ends them only, else as browsers do. named: of all references, those
    of these names alone are read, where a semicolon ends them."""
    found = Tokeniser()
    source, unread = re.sub(r"(?s)<!--.*?-->", "", html or ""), _unread(closed, named)
    found.feed(unread.sub(lambda m: m[0] if m[1] else "&amp;", source) if unread else source)
    found.close()
    found._close(0)
    children: dict[int, list[list]] = {}
    for row in found.rows:
        if row[5] != TEXT and row[2] is not None:
            children.setdefault(row[2], []).append(row)
    for own in children.values():
        for i, row in enumerate(own):
            row[3] = i + 1
        own[-1][4] = True
    return found.rows


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    """Values of one of COLUMNS. Lists are of one array cut by offsets, which costs Python a fraction of a list a value."""
    if not pa.types.is_list(kind):
        return pa.array([None if x is None else list(x.items()) for x in values] if pa.types.is_map(kind) else values, kind)
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, values))], pa.int32()), pa.array(list(chain.from_iterable(values)), kind.value_type))


def stored(frame: DataFrame) -> DataFrame:
    """As kept, for a large table: compressed files by column in the shared folder, dealt out by page as they are read, so that
    each branch moves its own columns alone and the whole rows are never shuffled. The files stay."""
    spark = frame.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        return kept(frame)
    folder = shared_folder(spark, "elements")
    frame.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page")


def kept(frame: DataFrame) -> DataFrame:
    """Rows that several branches read, dealt out by page and made once: in the shared folder where there is one, else in the
    executors' stores, from which lost parts are made again."""
    context = frame.sparkSession.sparkContext
    tasks = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frame = frame.repartition(tasks, "page")
    folder = frame.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        return frame.persist(StorageLevel.MEMORY_AND_DISK).repartition(tasks, "page")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return frame.checkpoint().repartition(tasks, "page")  # what follows knows how rows are dealt out, and leaves them there


def elements(pages: DataFrame, *keys: str, url: str = "url", html: str = "html", source: bool = False, closed: bool = False, named: tuple[str, ...] | None = None) -> DataFrame:
    """(page, url, keys, error) and COLUMNS: a row for each element and stretch of text of each page, by page.

    page numbers the rows of pages, so that equal ones stay apart; keys are on each page's first row only, as is an error
    of the tokeniser, whose page then has no other row. A null page is an empty one, of one row. source: the first row's
    text is the page's. closed, named: see rows_of."""
    ship(pages.sparkSession)
    slim = pages.select(F.monotonically_increasing_id().alias("page"), text_of(F.col(url)).alias("url"), F.col(html).alias("_html"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    taken_over = [StructField(f.name, f.dataType) for f in slim.schema.fields if f.name != "_html"]
    schema = StructType([*taken_over, *_parse_datatype_string(f"error string, {COLUMNS}").fields])
    own, n = to_arrow_schema(schema), len(taken_over)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            taken, rows, errors = [], [], []

            def flush() -> pa.RecordBatch:
                at = pa.array([i for i, _ in taken], pa.int64())  # noqa: B023
                first = pa.array([i if head else None for i, head in taken], pa.int64())  # noqa: B023
                columns = [batch.column(0).take(at), batch.column(1).take(at), *(c.take(first) for c in batch.columns[3:]), pa.array(errors, pa.string())]  # noqa: B023
                columns += [_column(column, kind.type) for column, kind in zip(zip(*rows), list(own)[n + 1 :])]  # noqa: B023
                return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, own)], schema=own)

            for i, page in enumerate(batch.column(2).to_pylist()):
                error = None
                try:
                    found = rows_of(page, closed, named)
                except Exception as e:  # one page's fault is its own
                    found, error = rows_of(None), f"{type(e).__name__}: {e}"
                found[0][7] = page if source else None
                for row in found:
                    taken.append((i, row[0] == 0))
                    rows.append(row)
                    errors.append(error if row[0] == 0 else None)
                if len(rows) >= ROWS:
                    yield flush()
                    taken, rows, errors = [], [], []
            if rows:
                yield flush()

    found = slim.mapInArrow(run, schema)
    named = F.struct(F.lit(None).cast("int").alias("_"), *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)])
    return stored(found.select("page", "url", named.alias("keys"), *found.columns[n:]))


def heads(found: DataFrame) -> DataFrame:
    """(page, url, keys, error): a row a page."""
    return found.where("node = 0").select("page", "url", "keys", "error")


def attribute(name: str) -> Column:
    return F.col("attributes")[name]


def by_ancestor(found: DataFrame, targets: DataFrame, *columns: str) -> DataFrame:
    """found's (page, node, columns) beside each of targets (page, node as target) that they stand in."""
    ups = found.select("page", "node", *columns, F.explode("above").alias("target"))
    return ups.join(targets.withColumnRenamed("node", "target"), ["page", "target"])


def joined_text(found: DataFrame, targets: DataFrame, separator: str = "") -> DataFrame:
    """(page, node, text) for each of targets (page, node): the text that stands in it, '' where none does."""
    inside = by_ancestor(found.where(F.col("tag") == TEXT), targets.select("page", "node"), "text")
    joined = inside.groupBy("page", F.col("target").alias("node")).agg(ordered(F.struct("node", "text"), separator).alias("text"))
    return targets.join(joined, ["page", "node"], "left").withColumn("text", text_of(F.col("text")))


def ordered(pairs: Column, separator: str = "") -> Column:
    """Of structs (node, text), the texts in the order of nodes, as one."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(pairs)), lambda p: p["text"]), separator)


# --- selectors: tag, #id, .class, [attr], [attr=v], *=, ^=, $=, ~=, |=, :nth-child(n), :first-child, :last-child; descent and >

_SIMPLE = re.compile(r"""\s*(?:(?P<tag>[\w-]+|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?P<q>["']?)(?P<val>.*?)(?P=q)\s*)?\]|:nth-child\(\s*(?P<nth>\d+)\s*\)|:(?P<edge>first|last)-child)""")


def _holds(name: str, op: str, value: str) -> Column:
    have = attribute(name)
    if op == "":
        return have.isNotNull()
    if op == "=":
        return have == value
    if not value:
        return F.lit(False)
    return {"*=": have.contains(value), "^=": have.startswith(value), "$=": have.endswith(value), "~=": F.array_contains(F.split(have, r"\s+"), value), "|=": (have == value) | have.startswith(value + "-")}[op]


def _compound(text: str) -> Column:
    """The filter of one compound selector."""
    tests, at = [F.col("tag") != TEXT], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m:
            raise ValueError(f"selector not understood: {text!r}")
        if m["tag"]:
            tests += [F.col("tag") == m["tag"].lower()] if m["tag"] != "*" else []
        elif m["id"] or m["cls"]:
            tests.append(_holds("id", "=", m["id"]) if m["id"] else _holds("class", "~=", m["cls"]))
        elif m["attr"]:
            tests.append(_holds(m["attr"].lower(), m["op"] or "", m["val"] or ""))
        else:
            tests.append(F.col("place") == int(m["nth"]) if m["nth"] else F.col("place") == 1 if m["edge"] == "first" else F.col("last_child"))
        at = m.end()
    return F.coalesce(reduce(Column.__and__, tests), F.lit(False)) & (F.col("node") > 0)


def chains(selector: str) -> list[list[tuple[str, str]]]:
    """For each alternative its compounds with how each is tied to the one before; ValueError if it isn't understood."""
    out = []
    for part in re.split(r",(?![^\[(]*[\])])", selector):
        steps = re.findall(r"(\s*>\s*|\s+|^)((?:\[[^\]]*\]|[^\s>\[])+)", part.strip())
        chain = [(">" if ">" in tie else " ", compound) for tie, compound in steps]
        if not chain or "".join(map("".join, steps)) != part.strip() or not all(_readable(c) for _, c in chain):
            raise ValueError(f"selector not understood: {selector!r}")
        out.append(chain)
    return out


def _readable(compound: str) -> bool:
    at = 0
    while at < len(compound) and (m := _SIMPLE.match(compound, at)):
        at = m.end()
    return at == len(compound)


def select(found: DataFrame, selector: str) -> DataFrame:
    """The elements that a selector list matches: one filter for what needs no ancestors, a join a step for what does."""
    alone, out = [], None
    for chain in chains(selector):
        if len(chain) == 1:
            alone.append(_compound(chain[0][1]))
            continue
        matched = found.where(_compound(chain[0][1])).select("page", "node")
        for tie, compound in chain[1:]:
            own = found.where(_compound(compound))
            up = F.col("parent") if tie == ">" else F.explode("above")
            under = own.select("page", "node", up.alias("up")).join(matched.withColumnRenamed("node", "up"), ["page", "up"], "left_semi")
            matched = under.select("page", "node").distinct()
        step = found.join(matched, ["page", "node"], "left_semi")
        out = step if out is None else out.unionByName(step)
    if alone:
        simple = found.where(reduce(Column.__or__, alone))
        out = simple if out is None else simple.unionByName(out)
    return out.dropDuplicates(["page", "node"]) if len(chains(selector)) > 1 and not (alone and len(alone) == len(chains(selector))) else out
