"""The table of records: lines of JSON in, lines of JSON or Parquet out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

VERSION = 1
SCHEMA = "v int, ts string, tool string, url string, final_url string, status int, tier string, title string, tokens int, chars int, content string, error_code string, data string"


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of JSON lines, with _bad for lines that aren't objects; blank lines are passed over, a byte order mark too."""
    lines = spark.read.text(list(paths)).select(F.regexp_replace("value", "^﻿", "").alias("_line"), F.col("_metadata.file_path").alias("file")).where("trim(_line) <> ''")
    parsed = lines.withColumn("_r", F.from_json("_line", SCHEMA + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    bad = F.try_parse_json("_line").isNull() | ~F.trim("_line").startswith("{")
    content = F.when(F.get_json_object("_line", "$.content").isNotNull(), F.get_json_object("_line", "$.content"))
    fields = [c.split()[0] for c in SCHEMA.split(", ")]
    return parsed.select(*[content.alias(f) if f == "content" else F.get_json_object("_line", "$.data").alias(f) if f == "data" else F.col(f"_r.{f}").alias(f) for f in fields], "file", bad.alias("_bad"))


def chars(content: Column, parts: Column | None = None) -> Column:
    """Length of a content, or of all parts of one in parts."""
    own = F.length(F.coalesce(content, F.lit("")))
    return own if parts is None else F.coalesce(F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p)), own)


def to_records(payloads: DataFrame, tool: str, now: Column) -> DataFrame:
    """Records of the payloads that are ok; others are left out. data and what a record lacks are null."""
    have = set(payloads.columns)
    col = lambda n, t: (F.col(n) if n in have else F.lit(None)).cast(t).alias(n)
    ok = payloads.where("ok")
    size = chars(F.col("content"))
    return ok.select(F.lit(VERSION).alias("v"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.lit(tool).alias("tool"), col("url", "string"), F.coalesce(col("final_url", "string"), F.col("url")).alias("final_url"), col("status", "int"), col("tier", "string"), col("title", "string"), F.coalesce(col("token_estimate", "int"), F.lit(0)).alias("tokens"), size.alias("chars"), col("content", "string"), col("error_code", "string"), col("data", "string"))


def append_lines(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def append_by_day(records: DataFrame, path: str) -> None:
    """Under a folder for each day."""
    records.withColumn("day", F.substring("ts", 1, 10)).write.mode("append").partitionBy("day").json(path)


def to_parquet(records: DataFrame, path: str) -> None:
    """Columns by name; bad lines left out."""
    good = records.where("not _bad").drop("_bad", "file") if "_bad" in records.columns else records
    good.select(*sorted(good.columns)).write.mode("overwrite").parquet(path)
