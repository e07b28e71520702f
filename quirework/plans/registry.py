"""All queries of the core, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirework.plans import books, containers, documents, navigation, reference, tools, training

MODULES = [training, reference, documents, books, navigation, containers, tools]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: sql for m in MODULES for k, sql in m.ORACLE.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.q_flagship(spark, sf_dir)
