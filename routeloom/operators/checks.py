"""Constraint queries: each returns the violations, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S


def alignment_violations(results: DataFrame, key: str, method: str, methods) -> DataFrame:
    """(key, methods, rows, problem): keys that don't have each method exactly once."""
    grouped = results.groupBy(key).agg(F.count_distinct(method).alias("methods"), F.count("*").alias("rows"))
    problem = F.when(F.col("methods") < len(methods), "missing").when(F.col("rows") > F.col("methods"), "duplicate")
    return grouped.withColumn("problem", problem).where(F.col("problem").isNotNull())


def reference_conflicts(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, variants): keys whose reference fields differ between rows; a null field counts as blank."""
    same = F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields])
    return rows.groupBy(key).agg(F.count_distinct(same).alias("variants")).where(F.col("variants") > 1)


def invalid_scores(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a score that isn't a finite number between zero and one."""
    bad = ~S.valid_score(F.col(columns[0]))
    for c in columns[1:]:
        bad = bad | ~S.valid_score(F.col(c))
    return rows.where(bad)


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys on one side only."""
    left = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("left"))
    right = b.select(key).distinct().join(a.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("right"))
    return left.unionByName(right)


def unique_text_ids(texts: DataFrame, text: str, key: str) -> DataFrame:
    """(text, key): texts that stand under exactly one key."""
    return texts.groupBy(text).agg(F.count("*").alias("n"), F.min(key).alias(key)).where(F.col("n") == 1).drop("n")


def resume_plan(todo: DataFrame, written: DataFrame, key: str, failed: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pending, duplicated): keys without a good row yet, and keys with more than one; with ``strict`` those fail the job."""
    good = written.where(F.col(failed).isNull() & F.col(key).isNotNull())
    counted = good.groupBy(key).agg(F.count("*").alias("rows"))
    done = counted.select(F.when(F.lit(strict) & (F.col("rows") > 1), F.raise_error(F.lit("duplicate result")).cast("string")).otherwise(F.col(key).cast("string")).alias("_done"))
    pending = todo.select(key).distinct().join(done, F.col(key).cast("string") == F.col("_done"), "left_anti")
    return pending, counted.where(F.col("rows") > 1)


def reusable(evaluated: DataFrame, source: DataFrame, key: str, protocol: str) -> DataFrame:
    """Evaluated rows of the protocol whose fingerprint still fits the source; the last per key."""
    good = evaluated.where(F.col("protocol") == protocol).join(source.select(key, F.col("fingerprint").alias("current")), key).where(F.col("fingerprint") == F.col("current"))
    return good.groupBy(key).agg(F.max_by("score", "position").alias("score"))


def fingerprint(columns: list[str]):
    """sha256 of the JSON object of the columns under sorted names: no value can run into its neighbour."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
