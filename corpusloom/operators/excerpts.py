"""Passages of a document, or of a corpus, that answer a query: BM25 over blocks and over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.text import let, strip, terms, text_of, unpacked

K1, B = 1.5, 0.75
HEADING_WEIGHT, BLOCK_LEAST = 2, 4
HEADING = r"^#{1,6}\s+(.*)$"


def blocks(content: Column) -> Column:
    """array of struct(text, heading, start, end): stretches between headings and blank lines, of 4 characters or more."""
    bare = F.transform(F.split(text_of(content), "\n"), lambda x: F.struct(x.alias("line"), strip(x).alias("bare")))
    heading = lambda bare: bare.startswith("#") & bare.rlike(HEADING)
    rows = F.transform(
        bare,
        lambda x: F.struct(x["line"].alias("line"), F.length(x["line"]).alias("n"), ((x["bare"] == "") | heading(x["bare"])).alias("stop"), F.when(heading(x["bare"]), strip(F.regexp_extract(x["bare"], HEADING, 1))).alias("title")),
    )
    kind = "struct<text:string,heading:string,start:int,end:int>"
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("heading"), F.lit(0).alias("at"), none.alias("held"), F.lit(0).alias("begin"), F.array().cast(f"array<{kind}>").alias("out"))

    def flushed(s: Column) -> Column:
        def add(text: Column) -> Column:
            block = F.struct(text.alias("text"), s["heading"].alias("heading"), s["begin"].alias("start"), s["at"].alias("end")).cast(kind)
            return F.when(F.length(text) >= BLOCK_LEAST, F.array_append(s["out"], block)).otherwise(s["out"])

        return F.when(F.size(s["held"]) > 0, let(strip(F.array_join(s["held"], "\n")), add)).otherwise(s["out"])

    def step(s: Column, x: Column) -> Column:
        return F.struct(
            F.coalesce(x["title"], s["heading"]).alias("heading"),
            (s["at"] + x["n"] + 1).alias("at"),
            F.when(x["stop"], none).otherwise(F.array_append(s["held"], x["line"])).alias("held"),
            F.when((F.size(s["held"]) == 0) & ~x["stop"], s["at"]).otherwise(s["begin"]).alias("begin"),
            F.when(x["stop"], flushed(s)).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(rows, start, step, lambda s: let(s.withField("at", F.length(text_of(content))), flushed))


def bm25(tf: Column, df: Column, length: Column, total: Column, average: Column) -> Column:
    idf = F.log(1 + (total - df + 0.5) / (df + 0.5))
    return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.when(average > 0, average).otherwise(F.lit(1.0))))).otherwise(F.lit(0.0))


def excerpts(content: Column, query: Column, most: int = 3, chars: int = 600) -> Column:
    """array of struct(text, heading, start, end, score): the best `most` blocks of a document, in its order.

    Within one row, without a shuffle: blocks are the corpus of the statistics. Headings count twice; ties go to the
    earlier block; blocks without a term are left out."""
    empty = F.array().cast("array<struct<start:int,end:int,text:string,heading:string,score:double>>")

    def weighed(b: Column) -> Column:
        heading = F.when(b["heading"] != "", F.flatten(F.array_repeat(terms(b["heading"]), HEADING_WEIGHT)))
        return F.concat(terms(b["text"]), F.coalesce(heading, F.array().cast("array<string>")))

    def found(wanted: Column) -> Column:
        counted = F.transform(blocks(content), lambda b: let(weighed(b), lambda tokens: _counted(b, tokens, wanted)))
        return let(counted, lambda c: F.when((F.size(wanted) > 0) & (F.size(c) > 0), best(wanted, c)).otherwise(empty))

    def best(wanted: Column, counted: Column) -> Column:
        df = F.transform(F.sequence(F.lit(0), F.size(wanted) - 1), lambda i: F.size(F.filter(counted, lambda b: F.get(b["tf"], i) > 0)))
        known = F.struct(F.size(counted).cast("double").alias("n"), (F.aggregate(counted, F.lit(0.0), lambda a, b: a + b["length"]) / F.size(counted)).alias("average"), df.alias("df"))
        return let(known, lambda k: shown(F.transform(counted, lambda b: scored(b, k))))

    def scored(b: Column, known: Column) -> Column:
        parts = F.zip_with(b["tf"], known["df"], lambda t, d: bm25(t, d, b["length"], known["n"], known["average"]))
        return F.struct((-F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)).alias("minus"), b["start"].alias("start"), b["text"].alias("text"), b["heading"].alias("heading"))

    def shown(rows: Column) -> Column:
        top = F.filter(F.slice(F.array_sort(rows), 1, max(1, most)), lambda b: b["minus"] < 0)
        return F.array_sort(F.transform(top, lambda b: _shown(content, b, chars)))

    return let(F.array_distinct(terms(query)), found)


def _counted(block: Column, tokens: Column, wanted: Column) -> Column:
    held = F.filter(tokens, lambda t: F.array_contains(wanted, t))
    tf = let(held, lambda h: F.transform(wanted, lambda w: F.size(F.filter(h, lambda t: t == w))))
    return F.struct(block["start"].alias("start"), block["text"].alias("text"), block["heading"].alias("heading"), F.size(tokens).cast("double").alias("length"), tf.alias("tf"))


def _shown(content: Column, block: Column, chars: int) -> Column:
    text = F.substring(block["text"], 1, max(1, chars))
    found = F.call_function("locate", block["text"], content, block["start"] + 1)
    start = F.when(found > 0, found - 1).otherwise(block["start"])
    return F.struct(start.cast("int").alias("start"), (start + F.length(text)).cast("int").alias("end"), text.alias("text"), block["heading"].alias("heading"), F.round(-block["minus"], 4).alias("score"))


def _occurrences(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term))


def search(docs: DataFrame, query: str, top: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The `top` documents by BM25: (key, score, hits, rank).

    Two scans and no shuffle of texts: one sums what the statistics need, one scores; ties go to the lesser key."""
    spark = docs.sparkSession
    wanted = [r["t"] for r in spark.range(1).select(F.explode(F.array_distinct(terms(F.lit(query)))).alias("t")).collect()]
    if not wanted:
        return docs.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("hits"), F.lit(0).alias("rank")).limit(0)
    tally = let(terms(F.col(text)), lambda t: F.struct(F.size(t).alias("_n"), *[_occurrences(t, w).alias(f"_{i}") for i, w in enumerate(wanted)]))
    counted = docs.select(key, unpacked(tally))
    sums = counted.agg(F.count("*").alias("n"), F.avg("_n").alias("average"), *[F.count_if(F.col(f"_{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    joined = counted.crossJoin(F.broadcast(sums))  # one row of statistics
    score = sum((bm25(F.col(f"_{i}"), F.col(f"df{i}"), F.col("_n"), F.col("n"), F.col("average")) for i in range(len(wanted))), F.lit(0.0))
    hits = sum(((F.col(f"_{i}") > 0).cast("int") for i in range(len(wanted))), F.lit(0))
    best = joined.select(key, F.round(score, 6).alias("score"), hits.alias("hits")).where("score > 0").orderBy(F.desc("score"), key).limit(top)

    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))
