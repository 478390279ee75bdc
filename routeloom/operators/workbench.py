"""What a user of the engine holds: datasets, indexes, methods, queries, graph views and runs behind one object.

Everything it gives is a DataFrame or a small dict; there is no server here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsers as P
from ..functions import text as X
from ..sources.readers import SourceError
from ..sources.writers import RunStore
from . import gates, lifecycle, views
from .registry import Registry, Request


@dataclass(frozen=True)
class Profile:
    """A named set-up: whether its dataset may change, which methods share a graph, and which show none."""

    name: str
    read_only: bool = False
    graph_methods: tuple[str, ...] = ("lightrag", "pathrag")
    options: dict[str, dict[str, str]] = field(default_factory=dict)


class Workbench:
    """Datasets by subset, one index log each, a registry of methods, a graph and a run store. Handles are opened when first used."""

    def __init__(self, spark: SparkSession, root: str, registry: Registry, documents: DataFrame, profile: Profile | None = None, graph: Callable[[], tuple[DataFrame, DataFrame]] | None = None, settings: dict | None = None):
        self.spark, self.root, self.registry, self.documents = spark, root.rstrip("/"), registry, documents
        self.profile, self._graph, self.settings, self.subset = profile or Profile("default"), graph, settings or {}, None

    @cached_property
    def runs(self) -> RunStore:
        return RunStore(self.spark, f"{self.root}/runs")

    @cached_property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        if self._graph is None:
            raise SourceError("GRAPH_NOT_FOUND", "no graph was built")
        return self._graph()

    def health(self) -> dict:
        return {"status": "ok", "methods": self.registry.methods(), "profile": self.profile.name}

    def select(self, subset: str) -> DataFrame:
        """Makes a subset active and gives its shortest document: one row."""
        if self.profile.read_only and self.subset is not None:
            raise SourceError("READ_ONLY", "the dataset of this profile is fixed")
        found = shortest_document(self.documents.where(F.col("subset") == subset))
        if found.isEmpty():
            raise SourceError("UNKNOWN_SUBSET", subset)
        self.subset = subset
        return found

    def _identity(self) -> tuple[str, str]:
        if self.subset is None:
            raise SourceError("NO_DATASET", "select a subset first")
        doc = shortest_document(self.documents.where(F.col("subset") == self.subset))
        corpus = doc.select(X.corpus_fingerprint(F.col("subset"), F.col("corpus_name"), F.col("context"))).first()[0]
        return corpus, lifecycle.runtime_fingerprint(self.settings)

    def index_status(self) -> dict:
        return {"status": "not_built", "reusable": False} if self.subset is None else lifecycle.IndexLog(self.spark, f"{self.root}/index").status(*self._identity())

    def build(self, build: Callable[[], None], verify: Callable[[], DataFrame]) -> str:
        corpus, runtime = self._identity()
        return lifecycle.IndexLog(self.spark, f"{self.root}/index").ensure(corpus, runtime, self.subset, build, verify)

    def query(self, request: Request) -> DataFrame:
        """The hits of one request, options checked against what the method allows, and saved as a run."""
        allowed = self.profile.options.get(request.method_id, {})
        for name, value in request.options.items():
            if name not in allowed or (allowed[name] and value not in allowed[name].split("|")):
                raise SourceError("INVALID_OPTION", name)
        asked = self.spark.createDataFrame([(1, request.query)], "query_id long, text string")
        hits = self.registry.retrieve(asked, request.method_id, request.top_k)
        row = self.spark.range(1).select(F.uuid().alias("id"), F.current_timestamp().alias("created_at"), F.lit(request.query).alias("query"), F.lit(request.method_id).alias("method_id"))
        self.runs.save(row)
        return hits

    def preview(self, method: str) -> tuple[DataFrame | None, str | None]:
        """(nodes of highest degree, warning): methods without a graph have none and say so."""
        if method not in self.profile.graph_methods:
            return None, f"{method} has no graph"
        from . import graphs

        nodes, edges = self.graph
        return graphs.preview(edges, nodes), None

    def related(self, entities: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
        return views.related_view(*self.graph, entities, pairs)

    def summary(self) -> DataFrame:
        """Counts of the graph, the runs of the store when it has some."""
        return lifecycle.graph_stats(*self.graph)


def shortest_document(documents: DataFrame) -> DataFrame:
    """The document of fewest characters, ties by corpus name."""
    return documents.where(F.col("context").isNotNull()).orderBy(F.length("context"), "corpus_name").limit(1)


def frozen_rules(rows: DataFrame, key: str, split: str, ids: DataFrame, count: int, hashes: dict[str, str], expected: dict[str, str]) -> DataFrame:
    """Rules for inputs that were frozen: the stated ids and number of rows, no test split, and files of the stated hashes."""
    spark = rows.sparkSession
    changed = [(n,) for n in sorted(set(hashes) | set(expected)) if hashes.get(n) != expected.get(n)]
    mine = rows.select(key).where(F.col(key).isNotNull()).distinct()
    return gates.verdicts([
        ("stated ids", mine.subtract(ids.select(key)).unionByName(ids.select(key).subtract(mine))), ("stated rows", rows.agg(F.count("*").alias("n")).where(F.col("n") != count)),
        ("no test rows", rows.where(F.col(split) == "test")), ("files unchanged", spark.createDataFrame(changed, "name string")),
    ])


def label_changes(old: DataFrame, new: DataFrame, key: str = "question_id", label: str = "silver_label") -> DataFrame:
    """(old_label, new_label, n): how the labels of one rule or version go over into those of another; null where a side has none."""
    both = old.select(key, F.col(label).alias("old_label")).join(new.select(key, F.col(label).alias("new_label")), key, "full_outer")
    return both.groupBy("old_label", "new_label").agg(F.count("*").alias("n"))


class KeywordSession:
    """Keywords of questions from a chat, within a budget of calls; what went wrong has a code of its own."""

    def __init__(self, chat, calls: int = 4, tokens: int = 512):
        self.chat, self.left, self.tokens = chat, calls, tokens

    def keywords(self, prompt: str) -> tuple[list[str], list[str]]:
        if self.left <= 0:
            raise SourceError("KEYWORDS_BUDGET", "no calls are left")
        self.left -= 1
        text, _, used = self.chat.reply(prompt)
        if used >= self.tokens:
            raise SourceError("KEYWORDS_TRUNCATED", "the reply was cut at its limit")
        if not (text or "").strip():
            raise SourceError("KEYWORDS_BLANK", "the reply is empty")
        error, high, low = P.keyword_lists(text)
        if error:
            raise SourceError(error, "the reply has no usable keywords")
        return high, low
