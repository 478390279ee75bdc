"""Sinks; every write goes through Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .readers import SourceError


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row."""
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_summary(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Each row as one nested JSON text."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def write_index(chunks: DataFrame, path: str, identity: dict[str, str], mode: str = "errorifexists") -> None:
    """A vector index: its rows and a one-row manifest of what it was built from."""
    chunks.write.mode(mode).parquet(f"{path}/rows")
    spark = chunks.sparkSession
    spark.createDataFrame(sorted(identity.items()), "name string, value string").coalesce(1).write.mode(mode).parquet(f"{path}/manifest")


def load_index(spark: SparkSession, path: str, identity: dict[str, str], vector: str | None = None, dimensions: int | None = None) -> DataFrame:
    """The index's rows if it was built from the same identity; never a silent rebuild. Vectors of another width fail the job."""
    found = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/manifest").collect()}
    if found != identity:
        raise SourceError("INDEX_MISMATCH", f"index at {path} was built from {found}, not {identity}")
    rows = spark.read.parquet(f"{path}/rows")
    if vector is None or dimensions is None:
        return rows
    wrong = F.raise_error(F.lit(f"INDEX_DIMENSION: not {dimensions}")).cast(rows.schema[vector].dataType)
    return rows.withColumn(vector, F.when(F.size(vector) == dimensions, F.col(vector)).otherwise(wrong))


def missing_embeddings(ids: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return ids.select(key).distinct().join(cache.select(key).distinct(), key, "left_anti")


class RunStore:
    """Append-only run history on Parquet: newest first, bounded on compaction."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 100):
        self.spark, self.path, self.keep = spark, path, keep

    def save(self, runs: DataFrame) -> None:
        runs.write.mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def recent(self, n: int = 20) -> DataFrame:
        return newest(self.all(), n)

    def get(self, run_id: str) -> DataFrame:
        return self.all().where(F.col("id") == run_id)

    def compacted(self) -> DataFrame:
        return newest(self.all(), self.keep)


def newest(runs: DataFrame, n: int, stamp: str = "created_at", key: str = "id") -> DataFrame:
    """The newest n rows: a sort with limit keeps n rows per partition, so nothing is gathered."""
    return runs.orderBy(F.desc(stamp), F.desc(key)).limit(n)


def newest_per(rows: DataFrame, group: str, n: int, stamp: str, key: str) -> DataFrame:
    """The newest n rows of each group; rows beyond n are dropped before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc(stamp), F.desc(key))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
