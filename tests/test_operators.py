"""Operators on small tables, odd cases included."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text, web
from corpusloom.operators import chunks, excerpts, fit, graph, inventory, policy, reading, schedule, snapshots, usage
from corpusloom.sources import recipes, searches


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_token_estimate_and_terms(spark):
    for given, n in (("", 0), (None, 0), ("a", 1), ("abcdefgh", 2), ("日本語", 3), ("日本 abcd", 3)):
        assert value(spark, text.token_estimate(F.lit(given))) == n
    assert value(spark, text.terms(F.lit("Ab_1 数据库 x 中"))) == ["ab_1", "x", "数据", "据库", "中"]


def test_fit_drops_sections_and_protects_fences(spark):
    body = "# Title\n" + "content of some length\n" * 5 + "## Related\ndrop me\n# Next\n```\n# Comments\n```\nlast"
    got = value(spark, fit.fit_markdown(F.lit(body)))
    assert got["applied"] and "drop me" not in got["content"] and "# Comments" in got["content"] and got["content"].endswith("last")
    assert got["dropped"]["related"] == 2
    assert value(spark, fit.fit_markdown(F.lit(None).cast("string")))["content"] == ""


def test_chunks_stand_where_they_say():
    rnd = random.Random(1)
    for _ in range(50):
        body = "\n".join(rnd.choice(["# A", "## B", "", "word " * rnd.randint(1, 90), "```"]) for _ in range(rnd.randint(0, 40)))
        for c in chunks.chunk(body, 300, 60):
            assert body[c["start"] : c["end"]] == c["text"] and len(c["text"]) <= 300
    assert chunks.chunk("# A\n## B\nx\n# C\ny")[-1]["heading_path"] == ["C"]
    assert chunks.chunk(None) == []


def test_truncation_keeps_head_and_tail():
    body = "\n".join(f"line {i} of the text" for i in range(400))
    cut, truncated, n = chunks.truncate(body, 200)
    assert truncated and n <= 220 and cut.startswith("line 0") and cut.endswith("line 399 of the text")
    assert chunks.truncate("short", 200) == ("short", False, 1)


def test_excerpts_rank_and_order(spark):
    body = "# One\n\nnothing here\n\n# Two\n\nspark spark engine\n\nspark once in a longer block of words"
    got = value(spark, excerpts.excerpts(F.lit(body), F.lit("spark engine")))
    assert [e["heading"] for e in got] == ["Two", "Two"] and got[0]["score"] > got[1]["score"]
    assert value(spark, excerpts.excerpts(F.lit(body), F.lit("!"))) == []


def test_crawl_is_breadth_first_with_a_cap(spark):
    at = lambda i: f"https://h.org/{i}"
    links = spark.createDataFrame([(at(a), p, at(b)) for a, p, b in ((0, 0, 1), (0, 1, 2), (1, 0, 3), (2, 0, 0), (2, 1, 4), (3, 0, 5))] + [(at(0), 2, "https://x.org/")], "src string, pos int, dst string")
    pages = spark.createDataFrame([(at(i),) for i in range(5)], "url string")
    seeds = spark.createDataFrame([(at(0), 0)], "url string, place int")
    assert {r["url"]: r["level"] for r in graph.crawl(seeds, links, pages, 2, 10).collect()} == {at(0): 0, at(1): 1, at(2): 1, at(3): 2, at(4): 2}
    assert [r["url"] for r in graph.crawl(seeds, links, pages, 3, 3).orderBy("level", "place").collect()] == [at(0), at(1), at(2)]


def test_crawl_jobs_can_be_taken_up_again(spark, tmp_path):
    links = spark.createDataFrame([("a", 0, "b"), ("b", 0, "c"), ("c", 0, "d")], "src string, pos int, dst string")
    pages = spark.createDataFrame([("a",), ("b",)], "url string")
    job = graph.CrawlJob(spark, f"{tmp_path}/job", depth=3, limit=10)
    assert job.steps() == []
    job.start(spark.createDataFrame([("a", 0)], "url string, place int"))
    assert {r["url"]: r["state"] for r in graph.CrawlJob(spark, f"{tmp_path}/job", 3, 10).run(links, pages).collect()} == {"a": "done", "b": "done", "c": "failed"}
    other = graph.CrawlJob(spark, f"{tmp_path}/other")
    other.start(spark.createDataFrame([("a", 0)], "url string, place int"))
    other.cancel()
    assert [r["state"] for r in other.run(links, pages).collect()] == ["cancelled"]


def test_page_chains_end_at_repeats(spark):
    following = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", None)], "url string, next string")
    start = spark.createDataFrame([(1, "a"), (2, "x")], "chain int, url string")
    got = sorted(map(tuple, graph.page_chain(start, following).collect()))
    assert got == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "x")]


def test_index_keeps_entries_without_lastmod(spark):
    old = spark.createDataFrame([("a", "1"), ("gone", "1"), ("n", None)], "url string, lastmod string")
    new = spark.createDataFrame([("a", "2", 0), ("a", None, 1), ("b", None, 2), ("n", None, 3), ("z", "1", 4)], "url string, lastmod string, pos int")
    got = {r["url"]: (r["lastmod"], r["state"]) for r in inventory.index_site(old, new, limit=3).collect()}
    assert got == {"a": ("2", "changed"), "b": (None, "new"), "n": (None, "unchanged"), "gone": (None, "removed")}


def test_sitemaps_are_expanded_once(spark):
    index = "<sitemapindex><sitemap><loc>s1</loc></sitemap><sitemap><loc>root</loc></sitemap></sitemapindex>"
    leaf = "<urlset><url><loc>p&amp;1</loc><lastmod>2024</lastmod></url><url><loc></loc></url></urlset>"
    files = spark.createDataFrame([("root", index), ("s1", leaf), ("bad", "<html>")], "url string, xml string")
    got = inventory.expand_sitemaps(spark.createDataFrame([("root",), ("bad",)], "url string"), files).collect()
    assert [tuple(r) for r in got] == [("p&1", "2024")]


def test_robots_groups_and_longest_match(spark):
    robots = spark.createDataFrame([("h", "User-agent: a\nUser-agent: *\nDisallow: /x # no\nAllow: /x/y\nDisallow:\n\nUser-agent: b\nDisallow: /")], "host string, text string")
    rules = policy.parse_robots(robots)
    assert sorted(map(tuple, rules.collect())) == [("h", False, "/x"), ("h", True, "/x/y")]
    pages = spark.createDataFrame([(1, "h", "/x/1"), (2, "h", "/x/y/2"), (3, "h", "/"), (4, "other", "/x")], "page_id int, host string, path string")
    assert {r["page_id"]: r["allowed"] for r in policy.robots_allowed(pages, rules).collect()} == {1: False, 2: True, 3: True, 4: True}


def test_budget_is_filled_greedily(spark):
    rnd = random.Random(3)
    for _ in range(20):
        sizes, budget = [rnd.randint(0, 60) for _ in range(rnd.randint(1, 8))], 100
        used, taken = 0, []
        for n in sizes:
            taken.append(used + n <= budget or used == 0)
            used += n * taken[-1]
        assert value(spark, reading.fill_budget(F.array(*[F.lit(n) for n in sizes]), F.lit(budget))) == taken


def test_snapshots_by_time(spark):
    shots = spark.createDataFrame([("k", 10.0, "a"), ("k", 30.0, "c"), ("k", 20.0, "b"), ("j", 5.0, "z")], "key string, ts double, hash string")
    moments = spark.createDataFrame([("k", 9.0), ("k", 20.0), ("k", 29.9), ("j", 100.0), ("none", 1.0)], "key string, at double")
    assert {(r["key"], r["at"]): r["hash"] for r in snapshots.as_of(shots, moments).collect()} == {("k", 9.0): None, ("k", 20.0): "b", ("k", 29.9): "b", ("j", 100.0): "z", ("none", 1.0): None}
    assert [r["hash"] for r in snapshots.resolve(shots, "prev").collect()] == ["b"]
    assert snapshots.retained(shots, F.lit(86400.0 * 100), 20, 90).count() == 0
    assert snapshots.retained(shots, F.lit(86400.0 * 100), 2, 0).count() == 3


def test_field_changes(spark):
    old, new = ({"price": 299, "tags": [{"n": 1}], "gone": True}, {"price": 249, "tags": [{"n": 1}], "come": None, "more": "x"})
    frames = [snapshots.flatten_json(spark.createDataFrame([(1, json.dumps(x))], "id int, j string"), "j", "id") for x in (old, new)]
    got = {r["path"]: r for r in snapshots.field_changes(*frames, "id").collect()}
    assert got["price"]["kind"] == "modified" and got["price"]["delta"] == -50 and got["price"]["pct"] == -16.7
    assert got["gone"]["kind"] == "removed" and got["more"]["kind"] == "added" and "tags[0].n" not in got
    line = spark.createDataFrame([got["price"]]).select(snapshots.change_line(*[F.col(c) for c in ("path", "kind", "old", "new", "pct")]).alias("x")).first()["x"]
    assert line == "price 299→249（-16.7%）"


def test_tasks_run_and_pause(spark):
    requests = spark.createDataFrame([("watch", "u", None, 60, None), ("watch", "u2", None, 5, None), ("x", "u3", None, 60, "ftp://")], "kind string, url string, selector string, interval_s int, webhook_url string")
    checked = schedule.checked(requests)
    assert sorted(str(r["problem"]) for r in checked.collect()) == ["None", "interval_s", "kind"]
    none = spark.createDataFrame([], "id string, kind string, url string, selector string, interval_s int, enabled boolean, next_run_at int, run_count int")
    tasks = schedule.merged(none, checked.where("problem is null"), F.lit(100))
    after = schedule.ran(tasks, schedule.due(tasks, F.lit(100)), F.lit(100))
    row = after.first()
    assert (row["next_run_at"], row["run_count"]) == (160, 1) and schedule.due(after, F.lit(159)).count() == 0
    off = schedule.paused(after, row["id"])
    assert schedule.due(off, F.lit(999)).count() == 0 and schedule.due(schedule.resumed(off, row["id"], F.lit(5)), F.lit(5)).count() == 1


def test_urls(spark):
    assert value(spark, web.canonical_url(F.lit("HTTPS://A.org/p?utm_a=1&b=2&GCLID=x#y"))) == "https://a.org/p?b=2"
    assert value(spark, web.redirect_target(F.lit("https://d.com/l/?uddg=https%3A%2F%2Fa.org%2F&x=1"))) == "https://a.org/"
    assert value(spark, web.host(F.lit("http://me:pw@Www.A.org:80/"))) == "www.a.org"


def test_answers_of_searches(spark):
    answers = spark.createDataFrame([(1, '{"web":{"results":[{"url":"https://a","title":"","description":"d","age":"2 days"}]}}'), (2, "no"), (3, '{"web":{"results":{}}}'), (4, None)], "id int, body string")
    assert [tuple(r) for r in searches.json_hits(answers, "brave", "body", 10, "id").collect()] == [(1, 1, "https://a", "https://a", "d", "brave", "2 days")]
    assert sorted(r["id"] for r in searches.broken_answers(answers, "brave").collect()) == [2, 3, 4]
    card = '<div class="result{}"><a class="result__a" href="{}">T  t</a><div class="result__snippet">s</div></div>'
    html = "<html><body>" + card.format("", "/l/?uddg=https%3A%2F%2Fa.org") + card.format(" result--ad", "https://ad.org") + card.format("", "https://b.org") + card.format("", "https://b.org") + "</body></html>"
    got = searches.page_hits(spark.createDataFrame([(1, "https://d.com/html", html)], "id int, url string, html string"), 5, "url", "html", "id").orderBy("rank").collect()
    assert [(r["rank"], r["title"], r["url"], r["snippet"]) for r in got] == [(1, "T t", "https://a.org", "s"), (2, "T t", "https://b.org", "s")]


def test_recipes_are_read_and_checked(spark, tmp_path):
    (tmp_path / "a.org.json").write_text('﻿{"root_selector": "main", "crawl": {"max_pages": 3}}')
    (tmp_path / "b.json").write_text('{"host": ".B.org", "extract": {"t": "h1"}, "crawl": {"max_pages": -1}, "nott": 1}')
    (tmp_path / "c.json").write_text("[1]")
    (tmp_path / "d.json").write_text("{broken")
    got = {r["host"]: (r["root_selector"], r["max_pages"], r["extract"]) for r in recipes.read_recipes(spark, str(tmp_path)).collect()}
    assert got == {"a.org": ("main", 3, None), "b.org": (None, None, '{"t":"h1"}')}
    found = recipes.check_folder(spark, str(tmp_path))
    assert {(f, level) for f, level, _ in found} == {("b.json", "warning"), ("b.json", "error"), ("c.json", "error"), ("d.json", "error")}
    assert any("perhaps note" in m for _, _, m in found)


def test_metrics_lines(spark):
    log = spark.createDataFrame([("a", "fetch", None), ("a", "fetch", "rate"), ('b"', None, None)], "tenant string, tool string, reason string")
    got = {r["tenant"]: r for r in usage.tenant_usage(log).collect()}
    assert got["a"]["requests"] == 2 and got["a"]["tool_calls"] == {"fetch": 1} and got["a"]["rejections"] == {"rate": 1} and got['b"']["tool_calls"] == {}
    lines = [r["line"] for r in usage.exposition(log.groupBy("tenant").count(), "requests_total", "count", ("tenant",)).collect()]
    assert lines[1:] == ['requests_total{tenant="a"} 2', 'requests_total{tenant="b\\""} 1']
    assert usage.fetch_counters(spark.createDataFrame([], "result_hit boolean, cached boolean, tokens int, bytes int")).first()["cache_hit_rate"] == 0


def test_hash_vectors_against_a_plain_version(spark):
    import hashlib
    import math
    import re

    from corpusloom.operators import vectors

    texts = ["one two two", "", None, "数据 a", "x" * 500, "One ONE 1_2"]
    got = {r["i"]: r["vector"] for r in vectors.hash_embedding(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", 64).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[a-z0-9_]+", (text or "").lower()) + (["数据"] if "数" in (text or "") else [])
        want = [0.0] * 64
        for w in words:
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            want[h % 64] += 1 if h >> 63 else -1
        size = math.sqrt(sum(x * x for x in want)) or 1.0
        assert got[i] == pytest.approx([x / size for x in want], abs=1e-6)
