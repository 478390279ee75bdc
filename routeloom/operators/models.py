"""Routers: ridge over exact Gram sums, and multinomial logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram_sums(rows: DataFrame, features: str, targets: list[str], fold: str | None = None) -> dict[int, tuple[np.ndarray, int]]:
    """Per fold, the sums of outer products of (1, features, targets): a matrix whose size depends on the width only.

    Partial sums are made in each partition by one Arrow pass; the shuffle carries one matrix per partition.
    """
    import pandas as pd

    cols = [features, *targets] + ([fold] if fold else [])

    def part(batches):
        sums: dict[int, list] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            z = np.hstack([np.ones((len(pdf), 1)), np.stack(pdf[features].to_numpy()).astype(float), pdf[targets].to_numpy(dtype=float)])
            folds = pdf[fold].to_numpy() if fold else np.zeros(len(pdf), dtype=int)
            for f in np.unique(folds):
                zf = z[folds == f]
                s = sums.setdefault(int(f), [np.zeros((z.shape[1], z.shape[1])), 0])
                s[0] += zf.T @ zf
                s[1] += len(zf)
        yield pd.DataFrame([(f, m.ravel().tolist(), n) for f, (m, n) in sums.items()], columns=["fold", "m", "n"])

    parts = rows.select(*cols).mapInPandas(part, "fold int, m array<double>, n long")
    total = parts.select("fold", F.posexplode("m").alias("i", "x"), "n").groupBy("fold", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    width = int((max((r["i"] for r in total), default=-1) + 1) ** 0.5 + 0.5)
    out = {}
    for r in total:
        m = out.setdefault(r["fold"], [np.zeros(width * width), 0])
        m[0][r["i"]] = r["x"]
        m[1] = r["n"]
    return {f: (m.reshape(width, width), n) for f, (m, n) in out.items()}


def ridge_from_sums(m: np.ndarray, width: int, alpha: float) -> np.ndarray:
    """Coefficients (1 + features) x targets; the intercept is not penalised."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    x, y = slice(1, 1 + width), slice(1 + width, None)
    sxx = m[x, x] - n * np.outer(mean[:width], mean[:width])
    sxy = m[x, y] - n * np.outer(mean[:width], mean[width:])
    w = np.linalg.solve(sxx + alpha * np.eye(width), sxy)
    return np.vstack([mean[width:] - mean[:width] @ w, w])


def ridge_oof(rows: DataFrame, key: str, features: str, targets: list[str], fold: str, alpha: float = 1.0) -> DataFrame:
    """(key, fold, one prediction per target): each fold predicted by the ridge of the others, all from one pass of sums."""
    sums = gram_sums(rows, features, targets, fold)
    if not sums:
        return rows.sparkSession.createDataFrame([], f"{key} long, {fold} int, " + ", ".join(f"pred_{t} double" for t in targets))
    total = sum(m for m, _ in sums.values())
    width = total.shape[0] - 1 - len(targets)
    models = {f: ridge_from_sums(total - m if len(sums) > 1 else total, width, alpha) for f, (m, _) in sums.items()}
    out = rows
    for j, t in enumerate(targets):
        expr = F.lit(None).cast("double")
        for f, w in models.items():
            coef = F.array(*[F.lit(float(c)) for c in w[1:, j]])
            value = F.aggregate(F.zip_with(F.transform(features, lambda x: x.cast("double")), coef, lambda a, b: a * b), F.lit(float(w[0, j])), lambda s, x: s + x)
            expr = F.when(F.col(fold) == f, value).otherwise(expr)
        out = out.withColumn(f"pred_{t}", F.round(expr, 6))
    return out.select(key, fold, *[f"pred_{t}" for t in targets])


def train_router(rows: DataFrame, features: str, label: str, weight: str | None = None, strength: float = 0.5):
    """Multinomial logistic regression; ``strength`` is the inverse penalty of a sum of losses."""
    from pyspark.ml.classification import LogisticRegression

    total = rows.agg(F.sum(weight) if weight else F.count("*").cast("double")).first()[0]
    model = LogisticRegression(featuresCol=features, labelCol=label, family="multinomial", regParam=1.0 / (strength * max(total, 1.0)), standardization=False, maxIter=50)
    return (model.setWeightCol(weight) if weight else model).fit(rows)


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """Adds ``weight`` = n / (classes x n of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("nc"))
    whole = counts.agg(F.sum("nc").alias("n"), F.count("*").alias("k"))
    table = counts.join(F.broadcast(whole)).select(label, (F.col("n") / (F.col("k") * F.col("nc"))).alias("weight"))  # one row
    return rows.join(F.broadcast(table), label)  # one row per class
