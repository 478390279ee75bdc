"""Retrievers as plug-ins over batches of queries, and answering by a chosen or routed method."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class UnknownMethod(KeyError):
    code = "UNKNOWN_METHOD"


@dataclass(frozen=True)
class Request:
    """One retrieval request; invalid values raise at once."""

    query: str
    method_id: str
    top_k: int = 5
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not isinstance(self.query, str) or not 1 <= len(self.query.strip()) <= 4000:
            raise ValueError("query must have 1 to 4000 characters")
        if isinstance(self.top_k, bool) or not isinstance(self.top_k, int) or not 1 <= self.top_k <= 50:
            raise ValueError("top_k must be an integer from 1 to 50")
        object.__setattr__(self, "query", self.query.strip())


Retriever = Callable[[DataFrame, int], DataFrame]


class Registry:
    """Retrievers by id: each maps (query_id, text) rows to (query_id, item, score, rank)."""

    #: Hits per query of the three built-in methods.
    TOPS = {"vector": 3, "lightrag": 5, "pathrag": 7}

    def __init__(self):
        self._retrievers: dict[str, Retriever] = {}

    def register(self, method: str, retriever: Retriever) -> None:
        if method in self._retrievers:
            raise ValueError(f"method {method} is registered already")
        self._retrievers[method] = retriever

    def methods(self) -> list[str]:
        return sorted(self._retrievers)

    def retrieve(self, queries: DataFrame, method: str, k: int | None = None) -> DataFrame:
        if method not in self._retrievers:
            raise UnknownMethod(method)
        return self._retrievers[method](queries, k or self.TOPS.get(method, 5)).withColumn("method", F.lit(method))

    def routed(self, queries: DataFrame, routes: DataFrame) -> DataFrame:
        """Each query by its routed method only: queries are split before retrieval."""
        out = None
        for method in self.methods():
            mine = queries.join(routes.where(F.col("method") == method).select("query_id"), "query_id", "left_semi")
            found = self.retrieve(mine, method)
            out = found if out is None else out.unionByName(found)
        return out
