"""Deterministic samples, splits and folds by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: str, seed: int) -> Column:
    """md5 of seed and key: an order that any engine reproduces."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratum_positions(rows: DataFrame, stratum: str, key: str, seed: int, buckets: int = 256) -> DataFrame:
    """Adds ``position`` (from 1) in the stratum's hash order and the stratum's size ``n``.

    Buckets by the first two hex digits of the hash are counted per stratum; rows are ranked within their bucket
    only. A stratum of any size is never sorted in one task.
    """
    hashed = rows.withColumn("h", hash_order(key, seed)).withColumn("bucket", F.substring("h", 1, 2))
    counts = hashed.groupBy(stratum, "bucket").agg(F.count("*").alias("m"))
    before = Window.partitionBy(stratum).orderBy("bucket")
    starts = counts.withColumn("start", F.sum("m").over(before) - F.col("m")).withColumn("n", F.sum("m").over(Window.partitionBy(stratum))).drop("m")
    within = Window.partitionBy(stratum, "bucket").orderBy("h", key)
    return hashed.join(starts, [stratum, "bucket"]).withColumn("position", F.col("start") + F.row_number().over(within)).drop("h", "bucket", "start")


def stratified_split(rows: DataFrame, stratum: str, key: str, seed: int = 42, shares: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """(key, stratum, split): the first shares of each stratum's hash order to train and validation, the rest to test."""
    placed = stratum_positions(rows.select(key, stratum), stratum, key, seed)
    train, valid = F.floor(F.round(F.col("n") * shares[0], 6)), F.floor(F.round(F.col("n") * shares[1], 6))
    split = F.when(F.col("position") <= train, "train").when(F.col("position") <= train + valid, "validation").otherwise("test")
    return placed.select(key, stratum, split.alias("split"))


def stratified_folds(rows: DataFrame, stratum: str, key: str, seed: int = 42, folds: int = 5) -> DataFrame:
    placed = stratum_positions(rows.select(key, stratum), stratum, key, seed)
    return placed.select(key, stratum, F.pmod(F.col("position") - 1, F.lit(folds)).cast("int").alias("fold"))


def expansion_sample(rows: DataFrame, used: DataFrame, stratum: str, key: str, per_stratum: int = 90, train: int = 72, seed: int = 42) -> DataFrame:
    """(key, stratum, split): so many unused keys per stratum, the first part to train, the rest to validation."""
    free = rows.select(key, stratum).join(used.select(key).distinct(), key, "left_anti")
    placed = stratum_positions(free, stratum, key, seed).where(F.col("position") <= per_stratum)
    return placed.select(key, stratum, F.when(F.col("position") <= train, "train").otherwise("validation").alias("split"))


def first_per_group(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group in the given order."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
