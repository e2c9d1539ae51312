"""Audit of how filters interact: what each filter removes, by the order in which filters are applied.

Each document becomes a mask of the filters it fails, and documents are counted by part and mask: a table of at most
2 ** filters rows a part, whatever the corpus holds. All orders are enumerated by a recursive query: a prefix of filters
is extended by each letter it doesn't use, carrying the bits applied so far, beside every mask a document can have; each
level says of each mask whether that step removes it. The enumeration doesn't depend on the data (10,432 rows for five
filters), so it is broadcast to the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

MOST = 6  # filters: a seventh would give the recursion more than the million rows that Spark lets it have
_WORD = r"[^\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """The conditions under which a text (null: an empty one) fails each filter but that on copies."""
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    return {
        "A": F.size(found) < 100,
        "B": F.size(F.array_distinct(found)) * 100 < F.size(found) * 80,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def prefixes(spark: SparkSession, letters: str) -> DataFrame:
    """(prefix, step, letter, bit, mask, removed, kept, redundant): what the last step of each prefix of each order of the
    letters does with documents of each mask. The n-th letter's bit is 2 ** n."""
    if not 1 <= len(letters) <= MOST or len(set(letters)) != len(letters):
        raise ValueError(f"give 1 to {MOST} different letters")
    named = ", ".join(f"('{letter}', {1 << i})" for i, letter in enumerate(letters))
    return spark.sql(f"""
        WITH RECURSIVE steps(prefix, step, letter, bit, applied, mask) AS (
            SELECT '', 0, '', 0, 0, explode(sequence(0, {(1 << len(letters)) - 1}))
            UNION ALL
            SELECT prefix || f.letter, step + 1, f.letter, f.bit, applied | f.bit, mask
            FROM steps JOIN (VALUES {named}) AS f(letter, bit) ON applied & f.bit = 0)
        SELECT prefix, step, letter, bit, mask,
               mask & bit <> 0 AND mask & (applied - bit) = 0 AS removed,
               mask & applied = 0 AS kept,
               mask & bit <> 0 AND mask & (applied - bit) <> 0 AS redundant
        FROM steps WHERE step > 0""")


def interactions(cells: DataFrame, letters: str) -> DataFrame:
    """Metrics of every step of every order, from (part, mask, n, good, toxic): documents of a part that fail the filters
    of a mask, and how many of them are good or toxic.

    (part, filter_order, step, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), a row for
    each part in cells, order and step, zeros included; no cells give no rows."""
    steps = prefixes(cells.sparkSession, letters)
    orders = steps.where(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    orders = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("_k"))
    orders = orders.select("filter_order", F.expr("substring(filter_order, 1, _k)").alias("prefix"))
    count = lambda what, of="n": F.sum(F.when(F.col(what), F.col(of)).otherwise(0)).cast("long")
    merged = cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    by_prefix = merged.join(F.broadcast(steps), "mask").groupBy("part", "prefix", "step", "letter").agg(
        count("kept").alias("kept"), count("removed").alias("removed"), count("redundant").alias("redundant"),
        F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n")).otherwise(0)).cast("long").alias("unique_fails"),
        count("removed", "good").alias("good_lost"), count("removed", "toxic").alias("toxic_lost"),
    )
    every = by_prefix.join(F.broadcast(orders), "prefix")
    # a part has as many rows here as there are orders and steps, whatever the corpus holds
    return every.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("prefix")


def mask_cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic) of the five filters A to E over (doc_id, text and the column of parts).

    E fails a text that a smaller doc_id has too, wherever in the table; equal texts are told by SHA-256. A null text is an
    empty one and a null part the empty name. Rows of one doc_id and one text are no copies of each other; a row without
    doc_id fails E never, nor makes others fail it, and has no label. Of several labels of a doc_id any that says good, or
    toxic, counts. Other columns are ignored; an empty table gives no cells.

    Copies are merged before they are shuffled: of each text a row stays for each part, mask and label, with its least
    doc_id, so a group of copies is never gathered."""
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failures(docs["text"]).values())), F.lit(0))
    digest = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256))
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), bits.alias("bits"), digest.alias("digest"))
    yes = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    rated = labels.where("doc_id is not null").groupBy("doc_id").agg(yes("quality"), yes("toxic"))
    joined = slim.join(rated, "doc_id", "left").select("digest", "part", "bits", "doc_id", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    kinds = ["digest", "part", "bits", "good", "toxic"]
    rows = joined.groupBy(*kinds, "doc_id").agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    unnamed = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    texts = rows.groupBy(*kinds).agg(F.sum("n").alias("n"), first.alias("first"), unnamed.alias("unnamed"))
    low = F.min("first.doc_id").over(Window.partitionBy("digest"))
    spared = F.col("unnamed") + F.when(F.col("first.doc_id") == low, F.col("first.n")).otherwise(0)
    split = texts.withColumn("spared", spared).select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("bits").alias("mask"), F.col("spared").alias("n")), F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - F.col("spared")).alias("n")))))
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """interactions of the five filters A to E over docs; see mask_cells for odd rows."""
    return interactions(mask_cells(docs, labels, part), "ABCDE")
