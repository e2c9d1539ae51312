"""The registered queries of this package: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import audit, decontaminate, lexical, linededup, mixing, packing, quality, separators, sharding, simhash, sketches, sstable, suffixes
from corpusloom.llm.base import table


def op1_consistent_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    slim = docs.select("doc_id", (F.octet_length("text").cast("long")).alias("_n"), F.crc32(body).alias("text_crc32"))
    slim = slim.select("doc_id", (F.coalesce("_n", F.lit(0)) + 16).alias("size"), "text_crc32")
    placed = sharding.assign_shards(slim, 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_passages(table(spark, sf_dir, "documents"))
    return found.withColumn("n_words", F.col("end_word") - F.col("start_word"))


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier selects."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.select_good(docs, table(spark, sf_dir, "labels")).select("doc_id", "expected_grade", "tail_probability")


def op5_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    taken = F.col("size") * (F.col("epochs") + F.col("chosen").cast("int"))
    return mixed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return linededup.digests(docs, linededup.keep_bitmaps(docs))


def op8_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 50256)


def op10_token_sstables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read_shards(sstable.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)


def op12_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in (op1_consistent_hash_shards, op2_suffix_repeats, op3_benchmark_leaks, op4_ordinal_quality, op5_weighted_mix, op6_simhash_components, op7_line_dedup, op8_bottom_k, op9_separator_scan, op10_token_sstables, op11_best_fit_packing, op12_ball_tree_search, op13_filter_audit)}
    return found


SQL = {
    "op12_ball_tree_search": r"""
WITH held AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
counts AS (SELECT doc_id, term, count(*) AS tf FROM held GROUP BY doc_id, term),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, totals GROUP BY term, docs),
wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term),
scores AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
           FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op13_filter_audit": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
              + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
              + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
              + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
         FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders(filter_order, applied) AS (SELECT '', 0 UNION ALL SELECT filter_order || letter, applied | bit FROM orders, f WHERE applied & bit = 0),
steps AS (SELECT filter_order, k AS step, letter, bit, (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE contains(substring(filter_order, 1, k - 1), g.letter))::INT AS before
          FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS k FROM orders WHERE applied = 31) o, f WHERE f.letter = substring(filter_order, k, 1)),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM docs GROUP BY part, mask),
found AS (SELECT part, filter_order, step, letter,
                 coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0)::BIGINT AS kept,
                 coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
                 coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
                 coalesce(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
                 coalesce(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
          FROM cells, steps GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM found""",
    "op5_weighted_mix": r"""
WITH rated AS (SELECT doc_id, max(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END) AS w
               FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (SELECT d.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                -ln((('0x' || substr(md5(md5(concat_ws('/', d.doc_id::VARCHAR, text))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / coalesce(w, 1.0) AS k
         FROM documents d LEFT JOIN rated r ON d.doc_id = r.doc_id),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM sizes),
levels AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER c, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER c, 0)) AS level
           FROM weighed WINDOW c AS (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source, source_size, least(cap, (max(level) OVER ()) * w) AS target FROM levels),
ranked AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS epochs,
                  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
           FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN size > 0 AND before + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked""",
    "op7_line_dedup": r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS best FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, pos, line, best IS NOT NULL AND best <> doc_id AS gone FROM keyed LEFT JOIN common USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
