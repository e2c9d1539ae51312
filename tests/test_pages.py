"""Pages, files and streams."""

import gzip
import io
import zipfile

import duckdb
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.html.pages import Request, link_table, parse_pages
from corpusloom.sources import office, records
from corpusloom.streaming import watch

PAGE = """<html><head><title>T</title><script type="application/ld+json">{"author": {"name": "Ann"}}</script></head><body><nav><a href="/nav">n</a></nav>
<main><h1>Head</h1><p>A paragraph with <a href="/in">a link</a> and <a href="https://other.org/x">one</a>.</p><span class="price">1,299.50</span>
<table><tr><th>a</th><th>b</th></tr><tr><td colspan="2">c</td></tr></table><form action="/go"><input name="q"></form><a href="/2">Next</a></main></body></html>"""


def parsed(spark, *outputs, html=PAGE, **parameters):
    frame = spark.createDataFrame([(1, "https://h.org/p", html)], "page_id int, url string, html string")
    return parse_pages(frame, Request(*outputs, **parameters), "url", "html", "page_id").first()


def test_page_in_one_pass(spark):
    schema = {"price": {"selector": ".price", "convert": "float"}, "author": {"type": "jsonld", "path": "author.name"}, "gone": {"selector": ".gone", "required": True}}
    row = parsed(spark, "compact", "fields", "links", "interactions", schema=schema)
    assert row["error"] is None and "Head" in row["compact"]["content"] and "/nav" not in row["compact"]["content"]
    assert row["fields"]["data"].asDict() == {"price": 1299.5, "author": "Ann", "gone": None} and row["fields"]["required_missing"] == ["gone"]
    assert "https://h.org/in" in row["links"] and "https://other.org/x" not in row["links"]
    assert row["interactions"]["forms"][0]["fields"][0]["name"] == "q" and row["interactions"]["next"][0]["href"] == "https://h.org/2"


def test_broken_pages_do_not_fail(spark):
    for html in (None, "", "<<<>>><p", "<div>" * 500, "\x00"):
        assert parsed(spark, "compact", html=html) is not None
    frame = spark.createDataFrame([(None, None)], "url string, html string")
    assert link_table(frame).count() == 0


def test_files(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", '<d xmlns:w="u"><w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p></d>')
    rows = [(1, "docx", held.getvalue()), (2, "docx", b"no"), (3, "gzip", gzip.compress("é".encode())), (4, "text", "中".encode("gb18030")), (5, "odd", b""), (6, "text", None)]
    got = {r["id"]: r for r in office.file_texts(spark.createDataFrame(rows, "id int, kind string, content binary"), "kind", "content", "id").collect()}
    assert [got[i]["text"] for i in (1, 3, 4, 6)] == ["one\ntwo", "é", "中", ""] and got[2]["error"] and got[5]["error"].startswith("unsupported")


def test_records_round_trip(spark, tmp_path):
    payloads = spark.createDataFrame([(True, "u", "text"), (False, "v", "x")], "ok boolean, url string, content string")
    records.append_lines(records.to_records(payloads, "fetch", F.to_timestamp(F.lit("2024-01-01 00:00:00"))), f"{tmp_path}/d")
    (tmp_path / "d" / "more.json").write_text("[1]\n\nnot json\n")
    found = records.read_lines(spark, f"{tmp_path}/d")
    assert found.where("_bad").count() == 2 and found.where("not _bad").first()["chars"] == 4
    records.to_parquet(found, f"{tmp_path}/p")
    again = spark.read.parquet(f"{tmp_path}/p")
    assert again.count() == 1 and again.columns == sorted(again.columns)


def streamed(spark, tmp_path, frame, schema, query, name):
    frame.coalesce(1).write.json(f"{tmp_path}/in")
    stream = query(spark.readStream.schema(schema).json(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_changes_of_a_stream(spark, tmp_path):
    rows = [("k", 1.0, "a"), ("k", 2.0, "a"), ("k", 4.0, "b"), ("j", 3.0, "z"), ("k", 3.0, "a")]
    schema = "key string, ts double, hash string"
    got = streamed(spark, tmp_path, spark.createDataFrame(rows, schema), schema, watch.detect_changes, "changes_seen")
    assert {(r["key"], r["ts"]) for r in got if r["changed"]} == {("k", 4.0)} and {(r["key"], r["ts"]) for r in got if r["first_seen"]} == {("k", 1.0), ("j", 3.0)}


def test_quotas_of_a_stream(spark, tmp_path):
    schema = "tenant string, ts double"
    rows = [("t", 0.0), ("t", 0.1), ("t", 2.0), ("t", 4.0), ("t", 86401.0)]
    got = streamed(spark, tmp_path, spark.createDataFrame(rows, schema), schema, lambda s: watch.enforce_quotas(s, 1.0, 2), "quota_seen")
    assert [(r["ts"], r["reason"]) for r in sorted(got)] == [(0.0, ""), (0.1, "rate"), (2.0, ""), (4.0, "daily_quota"), (86401.0, "")]


def test_forms_of_pages(spark):
    from corpusloom.plans import composites

    pages = spark.createDataFrame([(1, "https://h.org/p", PAGE)], "page_id int, url string, html string")
    forms = {f: composites.read_pages(pages, f).first() for f in composites.FORMS}
    assert forms["html"]["content"] == PAGE and forms["markdown"]["content"].startswith("# ") and not forms["text"]["content"].startswith("#")
    assert isinstance(forms["blocks"]["content"], list) and forms["chunks"]["index"] == 0
    cut = composites.read_pages(pages, query="paragraph").first()
    assert cut["excerpted"] and "paragraph" in cut["content"] and "# Head" not in cut["content"]
    assert not composites.read_pages(pages, query="zzzz").first()["excerpted"]


def test_commands(spark, tmp_path, capsys):
    from corpusloom.__main__ import main

    (tmp_path / "s.json").write_text('{"a": "h1", "n": {"selector": "p", "type": "count"}}')
    assert main(["schema", "check", f"{tmp_path}/s.json"]) == 0 and "`n`:int" in capsys.readouterr().out
    (tmp_path / "s.json").write_text('{"a": {"type": "odd"}}')
    assert main(["schema", "check", f"{tmp_path}/s.json"]) == 1
    (tmp_path / "d.jsonl").write_text('{"tool": "fetch", "tokens": 3, "content": "x"}\nno\n')
    assert main(["dataset", "stats", f"{tmp_path}/d.jsonl"]) == 0 and '{"bad": 1}' in capsys.readouterr().out


CUT = '<html><head><title>A &lt;b&gt; &amp;&amp</title><script type="application/ld+json">{"author": {"name": "x&&y &amp z"}}</script></head><body><h1>A &amp;&amp</h1><p>a&copy b &amp; c &#38 d <a href="/x?p=1&amp=2">y</a></p></body></html>'


def test_references_without_a_semicolon(spark):
    schema = {"title": "title", "author": {"type": "jsonld", "path": "author.name"}, "href": {"selector": "a", "type": "attr", "attr": "href"}}
    texts = {}
    for closed in (False, True):
        row = parsed(spark, "compact", "fields", html=CUT, schema=schema, closed=closed)
        texts[closed] = [row["compact"]["title"], row["compact"]["content"].split("\n")[0], row["fields"]["data"]["author"], row["fields"]["data"]["href"]]
        assert ("© b & c & d" in row["compact"]["content"]) is not closed
    assert texts[True] == ["A <b> &&amp", "# A &&amp", "x&&y &amp z", "/x?p=1&amp=2"]
    assert texts[False][:3] == ["A <b> &&", "# A &&", "x&&y &amp z"]


def test_registered_queries_leave_cut_references_as_their_sql_does(spark, tmp_path):
    html = '<html><head><title>Cut &amp;&amp</title></head><body><article><h1>Cut &amp;&amp</h1><p>word</article></body></html>'
    spark.createDataFrame([(1, "http://h.org/p", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("page_content", "page_fields"):
        row = catalog.queries()[name](spark, str(tmp_path)).first()
        assert row["title"] == "Cut &&amp"
    assert "# Cut &&amp" in catalog.queries()["page_content"](spark, str(tmp_path)).first()["content"]


def test_pages_of_one_address_give_one_list_of_links(spark):
    page = lambda *hrefs: "".join(f'<a href="{h}">x</a>' for h in hrefs)
    rows = [("http://h.org/p", page("/c", "mailto:x", "/a", "/b")), ("http://h.org/p", page("/b", "/a", "/d")), ("http://h.org/q", page("/z", "/z", "/y"))]
    found = link_table(spark.createDataFrame(rows, "url string, html string"))
    held = sorted((r["src"][-1], r["pos"], r["dst"][-1]) for r in found.collect())
    assert held == [("p", 0, "b"), ("p", 1, "c"), ("p", 2, "a"), ("p", 3, "d"), ("q", 0, "z"), ("q", 1, "y")]
    assert link_table(spark.createDataFrame(rows, "url string, html string"), most=2).count() == 4


def test_page_fields_reads_the_references_of_its_sql_alone(spark, tmp_path):
    titles = ["a &quot;b&quot; &lt;c&gt; &amp;", "&copy; &#38; &#x26; &LT; &amp;lt; &amp;quot; &amp &ampx;", "t&nbsp;u &eacute; & &;"]
    rows = [(i, f"http://h.org/{i}", f"<html><head><title>{t}</title><script>if (a &lt; b && c) {{}}</script></head><body><article><h1>{t}</h1><p>word</article></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    plain = dict(con.execute(f"SELECT page_id, title FROM ({catalog.oracle_sql()['page_fields']})").fetchall())
    assert {r["page_id"]: r["title"] for r in catalog.queries()["page_fields"](spark, str(tmp_path)).collect()} == plain
    assert plain[0] == "a &quot;b&quot; <c> &"
