"""All queries over the stored tables that this library registers, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import composites, pages, relational


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.corpus_profile(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return relational.QUERIES | pages.QUERIES | composites.QUERIES


def oracle_sql() -> dict[str, str]:
    return relational.SQL | pages.SQL | composites.SQL
