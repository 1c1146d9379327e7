"""Every registered query of the library, by name, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import graph, intake, library, listings, pages, rulebook, story, texts

MODULES = (listings, library, texts, pages, rulebook, graph, story, intake)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of contents from shredded pages."""
    return pages.e21(spark, sf_dir)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
