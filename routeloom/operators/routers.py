"""Routers: text features, out-of-fold grids, tuning, prediction rows, online routes and a store of models."""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import METHODS
from ..session import cut_lineage
from ..sources.readers import SourceError
from . import classification as K
from . import lexical, models

#: (least texts with a term, most terms) of the two blocks.
WORDS, CHARACTERS = (2, 30_000), (3, 20_000)


def character_counts(texts: DataFrame, key: str, text: str, least: int = 3, most: int = 5) -> DataFrame:
    """(key, term, tf): runs of ``least`` to ``most`` characters inside blank-padded words; a word too short for a length
    gives itself once and no longer runs."""
    words = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != "")
    padded = texts.select(key, F.explode(words).alias("w")).select(key, F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))
    n = F.length("w")

    def runs_of(size: int):
        places = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
        return F.when(n > size, F.transform(places, lambda i: F.substring(F.col("w"), i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    runs = [runs_of(size) for size in range(least, most + 1)]
    whole = F.when(n <= most, F.array("w")).otherwise(F.array().cast("array<string>"))
    return padded.select(key, F.explode(F.concat(*runs, whole)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _block(counts: DataFrame, texts: DataFrame, key: str, limits: tuple[int, int], name: str) -> DataFrame:
    """(key, term, weight) of one block at unit length over the terms of enough texts, the most frequent ones at most."""
    n = texts.agg(F.count("*").cast("double").alias("n"))
    usual = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= limits[0])
    vocab = usual.orderBy(F.desc("cf"), "term").limit(limits[1]).join(F.broadcast(n)).select("term", "df", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))  # one row
    return lexical.tfidf(counts, vocab, key).select(key, F.concat(F.lit(name + ":"), "term").alias("term"), "weight")


def router_postings(texts: DataFrame, key: str, text: str, characters: bool = True) -> DataFrame:
    """(key, term, weight): one- and two-word terms, stopwords kept, and character runs, each block by itself at unit length."""
    words = _block(lexical.term_counts(texts, key, text, bigrams=True, stopwords=[]), texts, key, WORDS, "w")
    if not characters:
        return words
    return words.unionByName(_block(character_counts(texts, key, text), texts, key, CHARACTERS, "c"))


def to_vectors(postings: DataFrame, key: str) -> DataFrame:
    """(key, features): sparse vectors over the sorted terms; at most some 50,000 of them."""
    terms = sorted(r["term"] for r in postings.select("term").distinct().collect())
    place = {t: i for i, t in enumerate(terms)}
    shared = postings.sparkSession.sparkContext.broadcast(place)

    @F.udf(VectorUDT())
    def vector(rows):
        pairs = sorted((shared.value[r["term"]], r["weight"]) for r in rows)
        return Vectors.sparse(len(shared.value), [i for i, _ in pairs], [w for _, w in pairs])

    return postings.groupBy(key).agg(F.collect_list(F.struct("term", "weight")).alias("p")).select(key, vector("p").alias("features"))


def dense(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.transform(column, lambda x: x.cast("double"))))


def _indexed(rows: DataFrame, label: str) -> DataFrame:
    names = F.array(*[F.lit(m) for m in METHODS])
    return rows.withColumn("_y", (F.array_position(names, F.col(label)) - 1).cast("double")).where(F.col("_y") >= 0)


def fit(rows: DataFrame, label: str, strength: float, balanced: bool, weight: str | None = None):
    """The router of ``features`` and a label that names a method; sample weights and class balance multiply."""
    y = _indexed(rows, label).withColumn("_w", F.col(weight) if weight else F.lit(1.0))
    if balanced:
        y = models.balanced_weights(y.drop("weight") if "weight" in y.columns else y, "_y").withColumn("_w", F.col("_w") * F.col("weight"))
    return models.train_router(y, "features", "_y", "_w", strength)


def predicted(model, rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, prediction, probabilities): the method and a map of all methods' probabilities in cost order."""
    names = F.array(*[F.lit(m) for m in METHODS[: model.numClasses]])
    out = model.transform(rows)
    p = F.transform(vector_to_array("probability"), lambda x: F.round(x, 6))
    return out.select(*keep, F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("prediction"), F.map_from_arrays(names, p).alias("probabilities"))


def out_of_fold(rows: DataFrame, key: str, label: str, fold: str, candidates: list[tuple[float, bool]], folds: int, weight: str | None = None) -> DataFrame:
    """(candidate, key, fold, truth, prediction, probabilities): each row predicted by the router of the other folds, per candidate."""
    rows = cut_lineage(rows)
    out = None
    for c, (strength, balanced) in enumerate(candidates):
        for f in range(folds):
            model = fit(rows.where(F.col(fold) != f), label, strength, balanced, weight)
            part = predicted(model, rows.where(F.col(fold) == f), [key, F.col(fold).alias("fold"), F.col(label).alias("truth")]).withColumn("candidate", F.lit(c))
            out = part if out is None else out.unionByName(part)
    return out


def candidate_scores(predictions: DataFrame, candidates: int) -> DataFrame:
    """(candidate, macro_f1, accuracy) over the pooled predictions of all folds."""
    out = None
    for c in range(candidates):
        mine = predictions.where(F.col("candidate") == c)
        row = K.macro_f1(mine, METHODS).join(K.accuracy(mine)).select(F.lit(c).alias("candidate"), "macro_f1", "accuracy")  # single rows
        out = row if out is None else out.unionByName(row)
    return out


def tuned(scores: DataFrame) -> int:
    """The first candidate of greatest macro F1, then accuracy."""
    return int(scores.orderBy(F.desc("macro_f1"), F.desc("accuracy"), "candidate").first()["candidate"])


def tune_on_validation(train: DataFrame, validation: DataFrame, key: str, label: str, candidates: list[tuple[float, bool]]) -> tuple[int, DataFrame]:
    """The candidate best on the validation rows with and without failed train rows, and all scores (candidate, with_failed, macro_f1, accuracy)."""
    train, validation = cut_lineage(train), cut_lineage(validation)
    rows = None
    for c, (strength, balanced) in enumerate(candidates):
        for with_failed in (True, False) if "all_failed" in train.columns else (True,):
            model = fit(train if with_failed else train.where(~F.col("all_failed")), label, strength, balanced)
            p = predicted(model, validation, [key, F.col(label).alias("truth")])
            row = K.macro_f1(p, METHODS).join(K.accuracy(p)).select(F.lit(c).alias("candidate"), F.lit(with_failed).alias("with_failed"), "macro_f1", "accuracy")  # single rows
            rows = row if rows is None else rows.unionByName(row)
    rows = cut_lineage(rows)
    best = rows.orderBy(F.desc("macro_f1"), F.desc("accuracy"), "candidate", F.desc("with_failed")).first()
    return int(best["candidate"]), rows


def prediction_rows(predictions: DataFrame, categories: DataFrame, key: str) -> DataFrame:
    """Predictions with the weight class and weight of their question."""
    return predictions.join(categories.select(F.col("question_id").alias(key), F.col("category").alias("weight_category"), F.col("weight").alias("sample_weight")), key)


def label_rules(outcomes: DataFrame, rules: list[tuple[float, float]]) -> DataFrame:
    """(threshold, margin, question_id, silver_label, all_failed) under each label rule, in one pass over the outcomes a rule."""
    from .outcomes import silver_cheapest

    out = None
    for threshold, margin in rules:
        part = silver_cheapest(outcomes, threshold, margin).select(F.lit(threshold).alias("threshold"), F.lit(margin).alias("margin"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def rule_grid_routers(labels: DataFrame, features: DataFrame, rules: list[tuple[float, float]], folds: int = 5, strength: float = 0.5, balanced: bool = True) -> DataFrame:
    """(threshold, margin, macro_f1, accuracy): the out-of-fold score of a router for each label rule. ``features`` has question_id, features, fold."""
    out = None
    for threshold, margin in rules:
        mine = labels.where((F.col("threshold") == threshold) & (F.col("margin") == margin)).join(features, "question_id")
        p = out_of_fold(mine, "question_id", "silver_label", "fold", [(strength, balanced)], folds)
        row = candidate_scores(p, 1).select(F.lit(threshold).alias("threshold"), F.lit(margin).alias("margin"), "macro_f1", "accuracy")
        out = row if out is None else out.unionByName(row)
    return out


def size_ablation(small: DataFrame, large: DataFrame, test: DataFrame, key: str, label: str, strength: float = 0.5) -> DataFrame:
    """(macro_f1, accuracy): score on the test rows of a router from the large set less that of one from the small set."""
    scored = []
    for rows in (small, large):
        p = predicted(fit(rows, label, strength, True), test, [key, F.col(label).alias("truth")])
        scored.append(K.macro_f1(p, METHODS).join(K.accuracy(p)))  # single rows
    old = scored[0].select(F.col("macro_f1").alias("f0"), F.col("accuracy").alias("a0"))
    return scored[1].join(old).select(F.round(F.col("macro_f1") - F.col("f0"), 6).alias("macro_f1"), F.round(F.col("accuracy") - F.col("a0"), 6).alias("accuracy"))


def reproduced(rows: DataFrame, stored: DataFrame, key: str, metrics: list[str], eps: float = 1e-12) -> DataFrame:
    """(key, metric): numbers that differ from the stored ones by more than ``eps``: none may, before a result is built upon."""
    both = rows.select(key, *metrics).join(stored.select(key, *[F.col(m).alias(f"_{m}") for m in metrics]), key, "full_outer")
    flags = F.array_compact(F.array(*[F.when(~F.coalesce(F.abs(F.col(m) - F.col(f"_{m}")) <= eps, F.lit(False)), F.lit(m)) for m in metrics]))
    return both.select(key, F.explode(flags).alias("metric"))


def adaptive_routes(model, queries: DataFrame, key: str, options: dict | None = None) -> DataFrame:
    """(key, method, probabilities): each query's method by the router. The router sets its methods' options, so none may be given."""
    if options:
        raise SourceError("OPTIONS_NOT_ALLOWED", "a routed query takes no options of its own")
    return predicted(model, queries, [key]).withColumnRenamed("prediction", "method")


class RouterStore:
    """Fitted routers under the hash of their description; one is current. A router of other classes or width is refused."""

    def __init__(self, spark: SparkSession, path: str, features: int):
        self.spark, self.path, self.features = spark, path.rstrip("/"), features

    def _check(self, model) -> None:
        if model.numClasses != len(METHODS):
            raise SourceError("ROUTER_CLASSES", f"{model.numClasses} classes in place of {len(METHODS)}")
        if model.numFeatures != self.features:
            raise SourceError("ROUTER_FEATURES", f"{model.numFeatures} features in place of {self.features}")

    def install(self, model, config: dict) -> str:
        """Saves a model under the hash of its settings and coefficients and makes it current; the same one is saved once."""
        self._check(model)
        body = json.dumps({"config": config, "coefficients": [round(float(x), 12) for x in model.coefficientMatrix.toArray().ravel()]}, sort_keys=True)
        name = sha256(body.encode()).hexdigest()
        try:
            self.load(name)
        except SourceError:
            model.save(f"{self.path}/models/{name}")
        self.spark.createDataFrame([(name, json.dumps(config, sort_keys=True))], "name string, config string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.path}/current")
        return name

    def current(self) -> str:
        return self.spark.read.parquet(f"{self.path}/current").orderBy(F.desc("at")).first()["name"]

    def load(self, name: str | None = None):
        from pyspark.ml.classification import LogisticRegressionModel

        name = name or self.current()
        if not name.isalnum():
            raise SourceError("ROUTER_PATH", "a router's name is a hash")
        try:
            model = LogisticRegressionModel.load(f"{self.path}/models/{name}")
        except Exception as missing:
            raise SourceError("ROUTER_MISSING", name) from missing
        self._check(model)
        return model
