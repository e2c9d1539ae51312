"""The table of elements, selectors over it, and what is made of it."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.web import absolute
from corpusloom.html import content, elements, inspect
from corpusloom.html.fields import Extraction, parse_rules, register_extractor

URL = "https://h.org/d/p?q=1"
#: page, content, blocks, links kept and dropped, root
PAGES = [
    ("<body><div id=main><p>one <a href='/x?y=1'>li [nk] <code>c d</code></a> two</p><pre class='brush: js'>\n\na  b\n<code class='language-py'>x\n y\n</code></pre><ul><li>a<ul><li>b<li>c</ul><li>d <blockquote>q <b>r</b><p>s</blockquote></ul><h2>H <i>i</i><br>x</h2></div>", 'one [li \\[nk\\] `c d`](/x?y=1) two\n```py\nx\n y\n```\n- a\n- b\n- c\n- d\n> q r\n> s\n## H i\nx', 9, 1, 0, 'body'),
    ('<table><tr><th>a,b<th colspan=2>c<tr><td rowspan=3>d<td>e "f"<tr><td>g<td>h<tr></table><figure><img src=\'a.png\' alt=\'A\'><figcaption>cap <a href=\'http://o.org/z\'>out</a></figcaption></figure><figure>plain</figure>', '"a,b",c\nd,"e ""f"""\nd,g,h\nd\n![A](https://h.org/d/a.png)\ncap out\nplain', 4, 0, 1, 'html'),
    ("<div class='footers'>gone</div><div class='x nav'>gone2</div><section><p>word word word word word word word word word word word word</p><p>word word word word word word word word word word word word</p><p>word word word word word word word word word word word word</p><p>word word word word word word word word word word word word</p><p>word word word word word word word word word word word word</p><p>word word word word word word word word word word word word</p><p>word word word word word word word word word word word word</p><p>word word word word word word word word word word word word</p><p>word word word word word word word word word word word word</p><p>word word word word word word word word word word word word</p><p>word word word word word word word word word word word word</p><p>word word word word word word word word word word word word</p></section><p>tail</p><aside>q</aside>", 'word word word word word word word word word word word word', 1, 0, 0, 'section'),
    ("text <span>in</span> <b>line</b> <i> it </i><hr>after<br>br <img alt='pic' src=u> <a href='#f'>frag</a> <a href='//z.com/a b'></a><a href='../up/./x'>rel</a><div>blk <span>s<div>lost</div>t</span></div>", 'text inline it\nafter\nbr [pic]frag[rel](/up/x)\nblk st', 3, 1, 1, 'html'),
    ('<article><p>same short</p><p>same short</p><p>same short</p><p>long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text </p><p>long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text </p></article>', 'same short\nlong text long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text\nlong text long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text long text', 3, 0, 0, 'article'),
    ('', '', 0, 0, 0, 'html'),
    ('<p>\xa0 a\u200bb \n\n c</p><pre></pre><table></table><a>no</a>', 'ab\nc\nno', 2, 0, 0, 'html'),
    ('<nav>x</nav><ol><li><p>p1<p>p2<table><tr><td>1</table></li></ol>', '- p1\np2\n1', 3, 0, 0, 'html'),
]


def table(spark, *pages):
    rows = [(i, URL, p) for i, p in enumerate(pages)]
    return elements.elements(spark.createDataFrame(rows, "id int, url string, html string"), "id")


def by_id(found, frame):
    return {r["id"]: r for r in frame.join(elements.heads(found).select("page", "keys.id"), "page").collect()}


def test_rows_of_a_page():
    rows = elements.rows_of("<p id=a id=b>x<br><b>y<p>z</p><ul><li>1<li>2</ul>")
    short = [(r[0], r[1], r[2], r[3], r[4], r[5], r[7], r[8:10]) for r in rows]
    assert short[:4] == [(0, 12, None, None, False, "html", None, [0, 0]), (1, 5, 0, 1, False, "p", None, [0, 0]), (2, 2, 1, None, False, "#text", "x", [1, 1]), (3, 3, 1, 1, False, "br", None, [0, 0])]
    assert [(r[0], r[1], r[5]) for r in rows if r[5] in ("p", "ul", "li")] == [(1, 5, "p"), (6, 7, "p"), (8, 12, "ul"), (9, 10, "li"), (11, 12, "li")]
    assert rows[1][6] == {"id": "a"} and rows[0][12] == {"p", "br", "b", "ul", "li"}
    deep = elements.rows_of("<div>" * 5000 + "end")
    assert max(len(r[10]) for r in deep) <= elements.DEEPEST + 1 and deep[-1][7] == "end"
    assert all(r[1] >= r[0] for r in deep) and all(r[0] in range(u, deep[u][1] + 1) for r in deep[:600] for u in r[10])


def test_content_of_pages(spark):
    found = table(spark, *[p[0] for p in PAGES])
    got = by_id(found, content.compact(found))
    assert {i: (r["content"], r["blocks"], r["links_kept"], r["links_dropped"], r["root"]) for i, r in got.items()} == {i: p[1:] for i, p in enumerate(PAGES)}


def test_links_by_policy(spark):
    found = table(spark, "<p><a href='/in?x=1'>in [1]</a> <a href='http://o.org/out#f'>out</a> <a href=''>none</a></p>")
    texts = {p: by_id(found, content.compact(found, p))[0]["content"] for p in ("internal", "all", "none")}
    assert texts == {"internal": "[in \\[1\\]](/in?x=1)out none", "all": "[in \\[1\\]](/in?x=1)[out](http://o.org/out#f)none", "none": "in [1] out none"}
    with pytest.raises(ValueError):
        content.compact(found, "some")


@pytest.mark.parametrize(("selector", "want"), [
    ("p", ["a", "b", "d"]), (".x", ["a", "d"]), ("#c", ["c"]), ("div > p", ["b"]), ("div p", ["b", "d"]), ("section .x, #c", ["c", "d"]), ("[data-k]", ["d"]), ("[data-k^=v][data-k$='1']", ["d"]),
    ("p:first-child", ["a", "b", "d"]), ("div:nth-child(2)", ["c"]), ("section:last-child > p.x", ["d"]), ("*[id*=a]", ["a"]), ("p[lang|=en]", ["a"]), ("nope, p.y", []),
])
def test_selectors(spark, selector, want):
    found = table(spark, "<p id=a class='x z' lang=en-GB>1</p><div id=c><p id=b>2</p><section><p id=d class=x data-k='v 1'>3</p></section></div>")
    rows = elements.select(found, selector).select("node", F.col("attributes")["id"].alias("id")).collect()
    assert sorted(r["id"] for r in rows if r["id"] in "abcd") == want and len(rows) == len(want)


@pytest.mark.parametrize("selector", ["p:hover", "", "p[", "a:nth-child(x)"])
def test_selectors_not_understood(selector):
    with pytest.raises(ValueError):
        elements.chains(selector)


def test_addresses(spark):
    cases = {"": URL, "x": "https://h.org/d/x", "./a/../b": "https://h.org/d/b", "../../c/.": "https://h.org/c/", "/r?s": "https://h.org/r?s", "?n=2": "https://h.org/d/p?n=2", "#f": URL + "#f", "//o.org/y": "https://o.org/y", "http://z/": "http://z/", "mailto:x": "mailto:x"}
    rows = spark.createDataFrame([(k,) for k in cases], "r string").select("r", absolute(F.lit(URL), F.col("r")).alias("a")).collect()
    assert {r["r"]: r["a"] for r in rows} == cases


def test_what_a_page_offers(spark):
    page = """<div id=m><a href='/1'>one</a><button hidden>h</button><p><a href='/2' rel='next nofollow'>go</a></p><span role=tab style='display : none'>t</span>
      <form action=go method=POST><input name=q placeholder='Find it'><input type=hidden name=s><input type=submit value=Go><select aria-label=pick></select></form></div><a href='/1'>again</a><a href="x.pdf">f</a><a href="https://o.org">o</a>"""
    found = table(spark, page, "<p>nothing</p>")
    got = by_id(found, inspect.interactions(found))
    assert [(e["ref"], e["role"], e["text"]) for e in got[0]["elements"]] == [("#m > a", "link", "one"), ("#m > p:nth-child(3) > a", "link", "go"), ('input[name="q"]', "textbox", "Find it"), ("#m > form:nth-child(5) > input:nth-child(3)", "button", "Go"), ('select[aria-label="pick"]', "combobox", "pick"), ("a:nth-child(2)", "link", "again"), ("a:nth-child(3)", "link", "f"), ("a:nth-child(4)", "link", "o")]
    form = got[0]["forms"][0]
    assert (form["action"], form["method"], [(f["name"], f["type"]) for f in form["fields"]]) == ("https://h.org/d/go", "post", [("q", "input"), ("", "submit"), ("", "select")])
    assert [n["href"] for n in got[0]["next"]] == ["https://h.org/2"] and got[1]["elements"] == got[1]["forms"] == got[1]["next"] == []
    assert [(r["pos"], r["dst"]) for r in inspect.links(found).orderBy("pos").collect()] == [(0, "https://h.org/1"), (1, "https://h.org/2")]
    assert inspect.next_link(found, "p a").first()["next_link"] == "https://h.org/2" and inspect.next_link(found, "a:odd").count() == 0
    near = by_id(found, inspect.candidates(found, "div.miss > p.gone"))
    assert [(c["selector"], c["snippet"]) for c in near[1]["candidates"]] == [("p", "nothing")]
    assert by_id(found, inspect.region(found, "a, p"))[1]["region"] == "nothing"


def test_fields_by_rules(spark):
    register_extractor("longest", lambda found: F.array_max(F.transform(found, lambda x: x["text"])))
    page = """<h1>T</h1><script type="application/ld+json">[{"@graph":[{"author":[{"name":"Ann"},{"name":"Bo"}]},{"n":{"m":[5,6]}}]}]</script><script type="application/ld+json">broken</script>
      <ul><li class=i><b>one</b> <i>1,250 EUR</i><a href=x>l</a></li><li class=i><b>two</b><i>none</i></li></ul><time>2024年3月5日</time>"""
    schema = {
        "title": {"selector": "h1", "required": True}, "authors": {"type": "jsonld", "path": "author.name"}, "second": {"type": "jsonld", "path": "n.m.1"}, "day": {"selector": "time", "convert": "date"},
        "items": {"selector": "li.i", "type": "list", "fields": {"name": "b", "price": {"selector": "i", "convert": "int"}, "to": {"selector": "a", "type": "attr", "attr": "href", "abs_url": True}, "links": {"selector": "a", "type": "count"}}},
        "names": {"selector": "b", "type": "list"}, "first": {"selector": "li", "type": "object", "fields": {"bold": {"selector": "b", "type": "html"}}}, "word": {"selector": "i", "regex": "(\\d+),", "group": 1},
        "gone": {"selector": ".gone", "required": True, "default": "?"}, "lost": {"selector": "em", "required": True}, "long": {"selector": "b", "type": "longest"},
    }
    found = table(spark, page, "")
    extraction = Extraction(found, parse_rules(schema))
    got = by_id(found, extraction.pages())
    data = got[0]["data"].asDict(recursive=True)
    assert data["items"] == [{"name": "one", "price": 1250, "to": "https://h.org/d/x", "links": 1}, {"name": "two", "price": None, "to": None, "links": 0}]
    assert {k: data[k] for k in ("title", "authors", "second", "day", "names", "first", "word", "gone", "lost", "long")} == {"title": "T", "authors": '["Ann","Bo"]', "second": "6", "day": "2024-03-05", "names": ["one", "two"], "first": {"bold": "<b>one</b>"}, "word": "1", "gone": "?", "lost": None, "long": "two"}
    assert got[0]["required_missing"] == ["lost"] and got[0]["errors"] == ["items.price: not int: 'none'"]
    assert set(got[1]["required_missing"]) == {"title", "lost"} and got[1]["data"]["items"] is None
    places = {r["path"]: r["raw"] for r in extraction.places().where("page = 0 or raw is not null").collect()}
    assert places["items[0].name"] == "one" and places["items[1].name"] == "two" and places["title"] == "T"
