"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources get targets in proportion to their weights, cut at a number of whole passes over the source; what is cut
goes to the others. A target of r times a source's size is made of floor(r) complete epochs and one fractional
selection: documents in the order of exponential keys, scaled by their quality weight, up to the tokens that are
left. The order within a source is a prefix sum in two levels: sums of key ranges, then sums within a range, so a
source that holds a third of all rows is spread over as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.base import any_names, written

RANGES = 1024


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A number in (0, 1) that only the key decides."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights repeat over sources by code point, null last.

    Targets are min(cap * size, level * weight) with the one level at which they sum to share of all sizes; it is the
    largest of the levels that hold if the sources with the least cap per weight are cut."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    by_turn = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)
    weighed = sizes.withColumn("_w", by_turn).withColumn("_cap", F.col("source_size") * F.lit(cap))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    heavy = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    level = weighed.withColumn("_level", left / heavy)
    return level.select("source", "source_size", F.least("_cap", F.max("_level").over(every) * F.col("_w")).alias("target"))


def _part(key: Column) -> Column:
    """The range of an exponential key; keys of weight 1 are spread evenly."""
    return F.floor((F.lit(1.0) - F.exp(-key)) * RANGES).cast("int")


def mix_sources(sized: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), quality: str | None = None, key: str = "doc_id", also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, chosen) for rows (doc_id, source, size and, if named, quality).

    epochs: complete passes; chosen: whether the fractional selection takes the document once more. A document is
    chosen if at least half of it fits in what is left of the target. quality: weight over zero; null counts as 1.
    Random numbers depend on the column `key` alone, so reruns agree; rows with equal keys follow one another by doc_id
    and size. Null sources are one source. Columns named in `also` are passed on. An empty table gives an empty result."""
    weight = F.greatest(F.coalesce(F.col(quality).cast("double"), F.lit(1.0)), F.lit(1e-6)) if quality else F.lit(1.0)
    exponential = -F.log(uniform(F.col(key))) / weight
    # sources by a name that is never null, so that windows and joins deal out rows alike
    named = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source"))).alias("_name")
    rows = sized.select("doc_id", "source", F.col("size").cast("long").alias("size"), exponential.alias("_key"), named, *also)
    rows = rows.withColumn("_part", _part(F.col("_key")))
    parts = rows.groupBy("source", "_name", "_part").agg(F.sum("size").alias("_sum"))
    by_source = targets(parts.groupBy("source").agg(F.sum("_sum").alias("source_size")), share, cap, weights)
    offsets = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy("_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = F.col("p.source").eqNullSafe(F.col("s.source"))
    offsets = offsets.alias("p").join(by_source.alias("s"), same).select("_name", "_part", "_before", "source_size", "target")
    within = Window.partitionBy("_name", "_part").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_own", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(offsets, ["_name", "_part"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    left = F.col("target") - epochs * F.col("source_size")
    chosen = (F.col("size") > 0) & (F.col("_before") + F.col("_own") + F.col("size") / 2.0 <= left)
    return joined.select("doc_id", "source", "size", "source_size", "target", epochs.alias("epochs"), chosen.alias("chosen"), *also)


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, quality_weight): rated good 2, rated bad or toxic 1/2; the better of repeated ratings counts."""
    worth = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 2.0).otherwise(0.5)
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(worth).alias("quality_weight"))


def mix_documents(docs: DataFrame, labels: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """mix_sources over (doc_id, text, source), sized in words, with quality weights from labels (1 where unrated).

    Random numbers depend on doc_id and text, so rows without a doc_id, or with that of others, are spread; row_hash is a
    hash of all columns of docs that can be hashed."""
    whole = F.xxhash64(*[docs[c] for c, t in docs.dtypes if "map" not in t and "variant" not in t])
    key = F.md5(F.concat_ws("/", docs["doc_id"].cast("string"), docs["text"]))
    slim = docs.select(docs["doc_id"], docs["source"], n_words(docs["text"]).alias("size"), key.alias("key"), whole.alias("row_hash"))
    rated = written(slim.join(label_weights(labels), "doc_id", "left"))  # texts are read once
    return mix_sources(rated, share, cap, weights, quality="quality_weight", key="key", also=("row_hash",))


@any_names("doc_id", "text", "source")
def mixed_corpus(docs: DataFrame, labels: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """docs as often as the mix takes them: 0 to cap times. Columns as in docs, whatever their names; rows are told apart
    by doc_id and a hash of all columns, and rows that are equal in all share a fate, the best of theirs."""
    takes = mix_documents(docs, labels, share, cap).groupBy(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash")).agg(F.max(F.col("epochs") + F.col("chosen").cast("int")).alias("_takes"))
    whole = F.xxhash64(*[docs[c] for c, t in docs.dtypes if "map" not in t and "variant" not in t])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].alias("_d"), whole.alias("_r"))
    joined = rows.join(takes.where("_takes > 0"), F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_r") == F.col("_hash")))
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("_takes")))).select("_row.*")
