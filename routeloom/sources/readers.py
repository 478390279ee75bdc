"""Scans with declared schemas."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


class SourceError(ValueError):
    """A source that can't be read; ``code`` is stable."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


QUESTION_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "source", "question", "answer", "question_type", "evidence", "evidence_relations", "split")]
)
CORPUS_SCHEMA = "corpus_name string, context string"
RESULT_SCHEMA = (
    "question_id string, method string, answer string, contexts array<string>, entities array<map<string,string>>, relations array<map<string,string>>, "
    "paths array<array<string>>, input_tokens long, output_tokens long, llm_calls long, retrieval_time_ms double, generation_time_ms double, total_time_ms double, error string"
)


def read_corpus(spark: SparkSession, path: str, subset: str | None = None) -> DataFrame:
    """Corpus documents of a JSON array or Parquet file, validated; other suffixes are refused, an empty corpus too."""
    if path.rstrip("/").endswith(".json"):
        raw = spark.read.schema(CORPUS_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    elif path.rstrip("/").endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        raise SourceError("UNSUPPORTED_FORMAT", f"neither .json nor .parquet: {path}")
    docs = to_documents(raw, subset)
    if docs.isEmpty():
        raise SourceError("INVALID_DATASET", f"no documents in {path}")
    return docs


def to_documents(rows: DataFrame, subset: str | None = None) -> DataFrame:
    """(corpus_name, context, subset, character_count, word_count); a blank name or context fails the job."""
    blank = (F.trim(F.coalesce("corpus_name", F.lit(""))) == "") | (F.trim(F.coalesce("context", F.lit(""))) == "")
    checked = F.when(blank, F.raise_error(F.lit("INVALID_DATASET: blank corpus_name or context")).cast("string")).otherwise(F.col("context"))
    return rows.select("corpus_name", checked.alias("context")).select(
        "corpus_name", "context", F.lit(subset).cast("string").alias("subset"), F.length("context").cast("long").alias("character_count"),
        X.whitespace_word_count(F.col("context")).cast("long").alias("word_count"),
    )


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON-lines file; blank lines are skipped."""
    return spark.read.schema(QUESTION_SCHEMA).json(path)


def read_benchmark(spark: SparkSession, corpus: str, questions: str, subset: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, questions) of a benchmark; a file that isn't there is named in the error."""
    from pyspark.errors import AnalysisException

    found = []
    for path, read in ((corpus, lambda p: read_corpus(spark, p, subset)), (questions, lambda p: read_questions(spark, p))):
        try:
            found.append(read(path))
        except AnalysisException as missing:
            raise SourceError("MISSING_FILE", path) from missing
    return found[0], found[1]


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).json(path)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file: ids with their keyed attributes as a map."""
    data = "array<struct<_key:string,_VALUE:string>>"
    attributes = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast(data)), lambda d: F.struct(d["_key"], d["_VALUE"])))
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, data {data}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, data {data}").load(path)
    return (
        nodes.select(F.col("_id").alias("node"), attributes.alias("attributes")),
        edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), attributes.alias("attributes")),
    )


def read_key_values(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value struct) of a JSON object keyed by id."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "v")).select("key", "v.*")


@F.pandas_udf(T.StringType())
def encode_vectors(vectors: pd.Series) -> pd.Series:
    """Unit vectors as base64 of little-endian floats; null and zero vectors stay null."""

    def one(v):
        if v is None:
            return None
        a = np.asarray(v, dtype="<f8")
        n = np.linalg.norm(a)
        return base64.b64encode((a / n).astype("<f4").tobytes()).decode() if n > 0 else None

    return vectors.map(one)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vectors(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else np.frombuffer(base64.b64decode(b), dtype="<f4").tolist())
