"""Scores of predicted labels over a fixed label list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spine(spark, labels) -> DataFrame:
    return spark.createDataFrame([(x,) for x in labels], "label string")


def confusion(pairs: DataFrame, labels, weight: str | None = None) -> DataFrame:
    """(truth, prediction, n): every cell of the fixed labels, zeros kept."""
    grid = spine(pairs.sparkSession, labels)
    cells = grid.select(F.col("label").alias("truth")).join(F.broadcast(grid.select(F.col("label").alias("prediction"))))  # fixed labels
    w = F.sum(weight) if weight else F.count("*").cast("double")
    counts = pairs.groupBy("truth", "prediction").agg(w.alias("n"))
    return cells.join(counts, ["truth", "prediction"], "left").select("truth", "prediction", F.round(F.coalesce("n", F.lit(0.0)), 6).alias("n"))


def accuracy(pairs: DataFrame, weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    return pairs.agg(F.round(F.sum(w * (F.col("truth") == F.col("prediction")).cast("double")) / F.sum(w), 6).alias("accuracy"))


def macro_f1(pairs: DataFrame, labels, weight: str | None = None) -> DataFrame:
    """Mean F1 of the fixed labels; a label that never occurs counts zero. One pass over the pairs."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = []
    for i, x in enumerate(labels):
        t, p = F.col("truth") == x, F.col("prediction") == x
        sums += [F.sum(F.when(t & p, w).otherwise(0.0)).alias(f"tp{i}"), F.sum(F.when(t, w).otherwise(0.0)).alias(f"t{i}"), F.sum(F.when(p, w).otherwise(0.0)).alias(f"p{i}")]
    one = pairs.agg(*sums)
    f1 = [F.coalesce(2 * F.col(f"tp{i}") / F.nullif(F.col(f"t{i}") + F.col(f"p{i}"), F.lit(0.0)), F.lit(0.0)) for i in range(len(labels))]
    return one.select(F.round(sum(f1, F.lit(0.0)) / len(labels), 6).alias("macro_f1"))


def majority(rows: DataFrame, label: str, position: str) -> DataFrame:
    """The most frequent label, ties to the one met first, and its share."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return counts.agg(F.max_by(label, F.struct("n", (-F.col("first")).alias("f"))).alias("majority"), F.round(F.max("n") / F.sum("n"), 6).alias("accuracy"))


def macro_f1_seen(pairs: DataFrame) -> DataFrame:
    """(macro_f1, labels): mean F1 of the labels that occur on either side; one count per label and role, no fixed list."""
    roles = pairs.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label"), (F.col("truth") == F.col("prediction")).cast("long").alias("tp")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("long").alias("tp")),
    )).alias("r"))
    per = roles.groupBy("r.label").agg(F.sum("r.tp").alias("tp"), F.count("*").alias("n"))
    return per.agg(F.round(F.avg(2 * F.col("tp") / F.col("n")), 6).alias("macro_f1"), F.count("*").alias("labels"))
