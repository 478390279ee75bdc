"""Registry of the engine's queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import gating, graph, parsing, records, routers, routing, text, viewing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**text.QUERIES, **graph.QUERIES, **routing.QUERIES, **records.QUERIES, **parsing.QUERIES, **gating.QUERIES, **viewing.QUERIES, **routers.QUERIES}
ORACLE_SQL: dict[str, str] = {**text.ORACLE_SQL, **graph.ORACLE_SQL, **routing.ORACLE_SQL, **records.ORACLE_SQL, **parsing.ORACLE_SQL, **gating.ORACLE_SQL, **viewing.ORACLE_SQL, **routers.ORACLE_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, TF-IDF index, top hits of the held-out items and how much of each they cover, per kind."""
    return text.evidence_coverage(spark, sf_dir)
