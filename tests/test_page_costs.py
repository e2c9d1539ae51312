"""What reading pages costs for each of them: work done once, and the same results as the plain rules."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.html.elements import elements, rows_of
from corpusloom.operators import chunks, fit
from corpusloom.sources.tables import PAGE_TASKS, spread

ODD = ["", " ", "a", "\n", " \n \n ", "a  b\n\n\nc", "a \n b", "　中文、 テ　x", "\x85a\xa0b c d e f", "\r\r\n\r\n\x0b\x0c\x1c\x1d\x1e\x1fz", "​ a​​ b ​\n", "tab\t\tx \t\n\ty", "é ü — “q” 한국 ｆ😀 𠀀", "x" * 500 + " y"]


def plain_tidy(x: str) -> str:
    odd = text.BLANKS.replace("\n", "").replace(" ", "")
    x = x.translate({ord(c): " " for c in odd} | {0x200B: None})
    return re.sub("\n{2,}", "\n", re.sub(" ?\n ?", "\n", re.sub(" {2,}", " ", x))).strip(text.BLANKS)


def test_texts_equal_the_plain_rules(spark):
    frame = spark.createDataFrame(list(enumerate(ODD)), "i int, t string")
    found = frame.select("i", text.token_estimate(F.col("t")), text.lines(F.col("t")), text.tidy(F.col("t"))).orderBy("i").collect()
    assert [r[1] for r in found] == [chunks.tokens(t) for t in ODD]
    assert [r[2] for r in found] == [re.split(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", t) for t in ODD]
    assert [r[3] for r in found] == [plain_tidy(t) for t in ODD]


def test_token_estimate_scans_a_text_once_for_each_class(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(text.token_estimate(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "regexp_replace" not in plan


def test_long_lines_are_navigation_by_links_only(spark):
    long, links = "word " * 60, "[a](/a) " * 40
    rows = [long, long + "Advertisement ©", links, "Advertisement", "© all", "[a](/a) [b](/b)", "[a](/a) " + long]
    found = spark.createDataFrame([(rows,)], "t array<string>").select(F.transform("t", fit.line_kind)).first()[0]
    assert found == [None, None, "nav", "ads", "footer", "nav", None]


def test_rows_of_one_place_share_their_ancestors():
    rows = rows_of("<div><p>a<b>c</b>d</p><p>e</p></div>")
    by_text = {r[7]: r for r in rows if r[7]}
    assert by_text["a"][10] is by_text["d"][10] and by_text["a"][11] is by_text["d"][11]
    assert by_text["c"][11] == ["html", "div", "p", "b"] and by_text["e"][11] == ["html", "div", "p"]
    assert [sorted(r[12]) for r in rows if r[5] == "div"] == [["b", "p"]]


def test_pages_are_dealt_out_in_several_tasks_a_core(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10).repartition(cores), PAGE_TASKS).rdd.getNumPartitions() == PAGE_TASKS * cores
    assert spread(spark.range(10).repartition(cores + 1)).rdd.getNumPartitions() == cores + 1


def test_the_table_of_elements_takes_less_disk_than_its_pages(spark, tmp_path, monkeypatch):
    page = "<html><body><article>" + "".join(f"<p>some words of a page, with <a href='/l{i}'>a link {i}</a></p>" for i in range(200)) + "</article></body></html>"
    pages = spark.range(50).select("id", F.concat(F.lit("http://h.org/"), "id").alias("url"), F.lit(page).alias("html"))
    monkeypatch.setattr("corpusloom.html.elements.shared_folder", lambda spark, name: f"{tmp_path}/{name}")
    found = elements(pages, "id")
    size = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert 0 < size < 50 * len(page) and found.where("tag = 'a'").count() == 50 * 200
