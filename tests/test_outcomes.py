"""Golden label rules, policies and classification scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.operators import classification as K
from routeloom.operators import outcomes as O
from routeloom.operators import splits
from routeloom.plans import catalog, tables

METHODS = ("vector", "lightrag", "pathrag")


def facts(spark, *questions):
    rows = [
        (q, m, ac, er, float(tok), 0.0, 1.0)
        for q, (acs, toks) in enumerate(questions)
        for m, ac, er, tok in zip(METHODS, acs, (0.5, 0.5, 0.5), toks)
    ]
    return spark.createDataFrame(rows, "question_id long, method string, answer_correctness double, evidence_recall double, input_tokens double, output_tokens double, total_time_ms double")


def test_fixed_order_takes_the_cheaper_of_a_near_tie(spark):
    df = facts(spark, ((0.79, 0.80, 0.81), (1, 1, 1)), ((0.5, 0.6, 0.9), (1, 1, 1)))
    assert [r["silver_label"] for r in O.silver_fixed_order(df).orderBy("question_id").collect()] == ["vector", "pathrag"]


def test_cheapest_near_best_and_all_failed(spark):
    df = facts(spark, ((0.60, 0.62, 0.64), (110, 130, 210)), ((0.60, 0.66, 0.70), (110, 130, 210)), ((0.40, 0.45, 0.50), (1, 2, 3)))
    rows = O.silver_cheapest(df).orderBy("question_id").collect()
    assert [(r["silver_label"], r["all_failed"]) for r in rows] == [("vector", False), ("lightrag", False), ("pathrag", True)]


def test_weight_classes(spark):
    df = facts(spark, ((0.80, 0.65, 0.50), (1, 1, 1)), ((0.80, 0.75, 0.61), (1, 1, 1)), ((0.59, 0.58, 0.40), (1, 1, 1)))
    rows = O.weight_categories(df).orderBy("question_id").collect()
    assert [(r["category"], r["weight"]) for r in rows] == [("stable", 1.0), ("ambiguous", 0.5), ("all_failed", 0.3)]


def test_gap_and_bootstrap(spark):
    df = facts(spark, *[((0.5, 0.7, 0.1), (1, 1, 1))] * 20)
    assert O.gap_weights(df, F.col("answer_correctness")).first()["weight"] == 1.0
    row = O.bootstrap_ci(df, "lightrag", "vector", samples=20).first()
    assert row["low"] == row["high"] == pytest.approx(0.2)
    assert O.win_tie_loss(df, "lightrag", "vector").first().asDict() == {"wins": 20, "ties": 0, "losses": 0}


def resampled(d, samples=20_000):
    """Mean and 95 % interval as in the reference: questions drawn with replacement."""
    rng = np.random.default_rng(42)
    m = np.array([d[rng.integers(0, len(d), len(d))].mean() for _ in range(samples)])
    return d.mean(), *np.quantile(m, [0.025, 0.975])


def test_grouped_bootstrap_matches_resampling_on_every_layout(spark):
    rng = np.random.default_rng(1)
    x, y = np.round(rng.random(300), 6), np.round(rng.choice([0.1, 0.4, 0.5], 300), 6)
    df = facts(spark, *[((float(b), float(a), 0.1), (1, 1, 1)) for a, b in zip(x, y)])
    row = tuple(O.bootstrap_ci_grouped(df, "lightrag", "vector").first())
    assert row == pytest.approx(resampled(x - y), abs=0.0015)
    assert row == pytest.approx(tuple(O.bootstrap_ci_grouped(df.repartition(7), "lightrag", "vector").first()), abs=1.1e-6)
    assert tuple(O.bootstrap_ci_grouped(df.limit(0), "lightrag", "vector").first()) == (None, None, None)
    assert O.bootstrap_ci_grouped(facts(spark, ((0.5, 0.7, 0.1), (1, 1, 1))), "lightrag", "vector").first()["low"] == pytest.approx(0.2)


def test_registered_bootstrap_has_the_interval_of_twenty_thousand_replicates(spark, data):
    rows = tables.outcomes(spark, data).toPandas().pivot(index="question_id", columns="method", values="answer_correctness").dropna(subset=["lightrag", "vector"])
    d = (rows["lightrag"] - rows["vector"]).to_numpy()
    row = tuple(catalog.QUERIES["bootstrap_ci_20000"](spark, data).first())
    assert row == pytest.approx(resampled(d), abs=0.05 * d.std() / len(d) ** 0.5)


def test_classification_counts_absent_labels(spark):
    df = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 3.0), ("b", "b", 1.0)], "truth string, prediction string, w double")
    assert K.macro_f1(df, ("a", "b", "c")).first()[0] == pytest.approx(round((2 / 3 + 2 / 3 + 0) / 3, 6))
    assert K.accuracy(df).first()[0] == pytest.approx(0.666667) and K.accuracy(df, "w").first()[0] == 0.4
    assert K.confusion(df, ("a", "b", "c")).count() == 9


def test_splits_are_stable_and_proportional(spark):
    rows = spark.createDataFrame([(f"q{i}", "even" if i % 2 else "odd") for i in range(200)], "id string, kind string")
    a = {r["id"]: r["split"] for r in splits.stratified_split(rows, "kind", "id").collect()}
    b = {r["id"]: r["split"] for r in splits.stratified_split(rows.repartition(7), "kind", "id").collect()}
    assert a == b and sum(v == "train" for v in a.values()) == 120 and sum(v == "test" for v in a.values()) == 40
    folds = splits.stratified_folds(rows, "kind", "id").groupBy("kind", "fold").count().collect()
    assert len(folds) == 10 and all(r["count"] == 20 for r in folds)
