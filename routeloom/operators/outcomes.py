"""Outcome facts (question, method, scores, cost), labels from them, and policies over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S

SCORES = ("answer_correctness", "evidence_recall")


def tokens() -> Column:
    return F.col("input_tokens") + F.col("output_tokens")


def silver_fixed_order(outcomes: DataFrame, score: str = "answer_correctness", tolerance: float = 0.02) -> DataFrame:
    """(question_id, silver_label): the first method in cost order within the tolerance of the best score."""
    ranked = outcomes.select("question_id", "method", F.round(score, 6).alias("s"), S.method_rank(F.col("method")).alias("o"))
    best = ranked.groupBy("question_id").agg(F.max("s").alias("best"))
    near = ranked.join(best, "question_id").where(F.col("s") >= F.round(F.col("best") - tolerance, 6))
    return near.groupBy("question_id").agg(F.min_by("method", "o").alias("silver_label"))


def silver_cheapest(outcomes: DataFrame, threshold: float = 0.60, margin: float = 0.05) -> DataFrame:
    """(question_id, silver_label, all_failed): the cheapest method that is good enough and near the best.

    Good enough: correctness at the threshold and within the margin of the best. Cheapest: tokens, then time, then
    cost order. With none, the best by correctness, overlap with the reference (rouge_l, where there is such a
    column), recall and fewest tokens, and all_failed.
    One aggregation per question: no window, no second shuffle.
    """
    rouge = F.round("rouge_l", 6) if "rouge_l" in outcomes.columns else F.lit(0.0)
    facts = outcomes.select(
        "question_id",
        F.struct(
            F.round("answer_correctness", 6).alias("ac"), F.round("evidence_recall", 6).alias("er"), rouge.alias("rouge"), tokens().alias("tok"), F.col("total_time_ms").alias("ms"),
            S.method_rank(F.col("method")).alias("o"), "method",
        ).alias("f"),
    )
    # One struct per method of a question: three elements.
    return facts.groupBy("question_id").agg(F.collect_list("f").alias("fs"), F.max("f.ac").alias("best")).select(
        "question_id", F.filter("fs", lambda f: (f["ac"] >= threshold) & (f["ac"] >= F.round(F.col("best") - margin, 6))).alias("ok"), "fs"
    ).select(
        "question_id",
        F.when(
            F.size("ok") > 0,
            F.array_min(F.transform("ok", lambda f: F.struct(f["tok"], f["ms"], f["o"], f["method"].alias("m"))))["m"],
        ).otherwise(F.array_max(F.transform("fs", lambda f: F.struct(f["ac"], f["rouge"], f["er"], (-f["tok"]).alias("t"), (-f["o"]).alias("o"), f["method"].alias("m"))))["m"]).alias("silver_label"),
        (F.size("ok") == 0).alias("all_failed"),
    )


def weight_categories(outcomes: DataFrame, threshold: float = 0.60, margin: float = 0.10) -> DataFrame:
    """(question_id, category, weight) by the number of methods good enough and near the best."""
    facts = outcomes.select("question_id", F.round("answer_correctness", 6).alias("s"))
    grouped = facts.groupBy("question_id").agg(F.collect_list("s").alias("ss"), F.max("s").alias("best"))
    eligible = F.size(F.filter("ss", lambda s: (s >= threshold) & (s >= F.round(F.col("best") - margin, 6))))
    named = grouped.select("question_id", S.weight_class(eligible).alias("category"))
    return named.withColumn("weight", S.class_weight(F.col("category")))


def utility_scores(outcomes: DataFrame) -> DataFrame:
    """(question_id, method, one column per utility), rounded."""
    ac, er = S.clip(F.col("answer_correctness")), S.clip(F.col("evidence_recall"))
    return outcomes.select("question_id", "method", *[F.round(f(ac, er), 6).alias(name) for name, f in S.UTILITIES.items()])


def utility_route(outcomes: DataFrame, recall_weight: float = 0.15) -> DataFrame:
    """(question_id, method): the greatest correctness plus weighted recall, ties in cost order."""
    u = F.round(S.clip(F.col("answer_correctness")) + recall_weight * S.clip(F.col("evidence_recall")), 6)
    return outcomes.groupBy("question_id").agg(F.max_by("method", F.struct(u.alias("u"), (-S.method_rank(F.col("method"))).alias("o"))).alias("method"))


def cheapest_within(outcomes: DataFrame, score: Column, tolerance: float = 0.02) -> DataFrame:
    """(question_id, method): the first in cost order within the tolerance of the best of any score."""
    ranked = outcomes.select("question_id", F.struct(S.method_rank(F.col("method")).alias("o"), F.col("method").alias("m"), F.round(score, 6).alias("s")).alias("f"))
    grouped = ranked.groupBy("question_id").agg(F.sort_array(F.collect_list("f")).alias("fs"), F.max("f.s").alias("best"))
    return grouped.select("question_id", F.filter("fs", lambda f: f["s"] >= F.round(F.col("best") - tolerance, 6))[0]["m"].alias("method"))


def gap_weights(outcomes: DataFrame, score: Column, scale: float = 0.2, least: float = 0.3) -> DataFrame:
    """(question_id, gap, weight): the lead of the best score over the second as a confidence between least and one."""
    grouped = outcomes.select("question_id", F.round(score, 6).alias("s")).groupBy("question_id").agg(F.sort_array(F.collect_list("s"), asc=False).alias("ss"))
    gap = F.round(F.col("ss")[0] - F.coalesce(F.try_element_at("ss", F.lit(2)), F.lit(0.0)), 6)
    return grouped.select("question_id", gap.alias("gap")).withColumn("weight", F.round(least + (1 - least) * S.clip(F.col("gap") / scale), 6))


def fixed_choices(outcomes: DataFrame) -> DataFrame:
    """(question_id, policy, method): each method as a policy of its own."""
    return outcomes.select("question_id", F.col("method").alias("policy"), "method")


def policy_summary(outcomes: DataFrame, choices: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means per policy of the outcomes it chose; with ``by``, per group and in total (null group) by grouping sets."""
    joined = choices.join(outcomes, ["question_id", "method"])
    measures = [
        F.count("*").alias("n"),
        F.round(F.avg("answer_correctness"), 6).alias("answer_correctness"),
        F.round(F.avg("evidence_recall"), 6).alias("evidence_recall"),
        *([F.round(F.avg("rouge_l"), 6).alias("rouge_l")] if "rouge_l" in outcomes.columns else []),
        F.round(F.avg("input_tokens"), 4).alias("input_tokens"),
        F.round(F.avg("output_tokens"), 4).alias("output_tokens"),
        F.round(F.avg("total_time_ms"), 4).alias("total_time_ms"),
    ]
    if by:
        sets = [["policy", *by], ["policy"]]
        return joined.groupingSets([[F.col(c) for c in s] for s in sets], "policy", *by).agg(*measures)
    return joined.groupBy("policy").agg(*measures)


def with_joint(summary: DataFrame) -> DataFrame:
    """Adds the harmonic mean of the two average scores."""
    return summary.withColumn("joint", F.round(S.harmonic(F.col("answer_correctness"), F.col("evidence_recall")), 6))


def route_distribution(choices: DataFrame) -> DataFrame:
    return choices.groupBy("policy", "method").agg(F.count("*").alias("questions"))


def cost_reduction(outcomes: DataFrame, choices: DataFrame, against: str, quality_of: str) -> DataFrame:
    """Token saving of a policy against one fixed method, and its quality gain over another."""
    chosen = choices.join(outcomes, ["question_id", "method"]).agg(F.sum(tokens()).alias("spent"), F.avg("answer_correctness").alias("quality"))
    fixed = outcomes.agg(
        F.sum(F.when(F.col("method") == against, tokens())).alias("fixed_spent"), F.avg(F.when(F.col("method") == quality_of, F.col("answer_correctness"))).alias("fixed_quality")
    )
    return chosen.join(F.broadcast(fixed)).select(  # two single rows
        F.round(1 - F.col("spent") / F.greatest(F.col("fixed_spent"), F.lit(1e-12)), 6).alias("token_reduction"), F.round(F.col("quality") - F.col("fixed_quality"), 6).alias("quality_gain")
    )


def win_tie_loss(outcomes: DataFrame, a: str, b: str, score: str = "answer_correctness") -> DataFrame:
    pair = outcomes.where(F.col("method").isin(a, b)).groupBy("question_id").agg(
        F.max(F.when(F.col("method") == a, F.col(score))).alias("x"), F.max(F.when(F.col("method") == b, F.col(score))).alias("y")
    ).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    d = F.col("x") - F.col("y")
    return pair.agg(F.count_if(d > 1e-12).alias("wins"), F.count_if(F.abs(d) <= 1e-12).alias("ties"), F.count_if(d < -1e-12).alias("losses"))


def bootstrap_ci(outcomes: DataFrame, a: str, b: str, score: str = "answer_correctness", samples: int = 200, seed: int = 42) -> DataFrame:
    """(mean, low, high) of the paired difference by a Poisson-weight bootstrap.

    Each replicate weighs every question by a count drawn from a hash of (seed, replicate, question): the same on
    every layout, one pass over the pairs, and map-side sums of two numbers per replicate; no row is replicated
    through a shuffle.
    """
    pair = outcomes.where(F.col("method").isin(a, b)).groupBy("question_id").agg(
        F.max(F.when(F.col("method") == a, F.col(score))).alias("x"), F.max(F.when(F.col("method") == b, F.col(score))).alias("y")
    ).where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("question_id", (F.col("x") - F.col("y")).alias("d"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("r"), F.col("question_id"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    cumulative, weight, p, total = 0, F.lit(0), 2.718281828459045**-1, 0.0
    for k in range(8):  # Poisson(1) by inversion
        total += p
        weight = weight + F.when(u >= total, 1).otherwise(0)
        p /= k + 1
    draws = pair.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("w", weight)
    means = draws.groupBy("r").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("m"))
    return means.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"))


def bootstrap_ci_grouped(outcomes: DataFrame, a: str, b: str, score: str = "answer_correctness", samples: int = 20_000, seed: int = 42) -> DataFrame:
    """(mean, low, high) of the paired difference by a Poisson-weight bootstrap, for many replicates.

    The Poisson(1) weights of all questions with one and the same difference add up to a Poisson(count) weight, so one
    draw per replicate and distinct difference has the distribution of one per replicate and question. Draws are
    seeded by (seed, difference), the same on every layout; each partition gives two sums per replicate.
    """
    pair = outcomes.where(F.col("method").isin(a, b)).groupBy("question_id").agg(
        F.max(F.when(F.col("method") == a, F.col(score))).alias("x"), F.max(F.when(F.col("method") == b, F.col(score))).alias("y")
    ).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    groups = pair.groupBy((F.col("x") - F.col("y")).cast("double").alias("d")).agg(F.count("*").alias("n"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weighted, weights, seen = np.zeros(samples), np.zeros(samples), False
        for pdf in batches:
            for d, n in zip(pdf["d"].to_numpy(np.float64), pdf["n"].to_numpy()):
                w = np.random.default_rng([seed, int(d.view(np.uint64))]).poisson(n, samples)
                weighted += w * d
                weights += w
                seen = True
        if seen:
            yield pd.DataFrame({"r": np.arange(samples), "wd": weighted, "w": weights})

    sums = groups.mapInPandas(draw, "r int, wd double, w double")
    means = sums.groupBy("r").agg(F.try_divide(F.sum("wd"), F.sum("w")).alias("m"))
    return means.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"))


def latency_percentiles(outcomes: DataFrame, column: str = "total_time_ms") -> DataFrame:
    return outcomes.groupBy("method").agg(
        F.round(F.avg(column), 4).alias("mean_ms"), F.round(F.percentile(column, 0.5), 4).alias("p50_ms"), F.round(F.percentile(column, 0.95), 4).alias("p95_ms")
    )


def target_tensor(outcomes: DataFrame) -> DataFrame:
    """One row per question with both scores of each method, in cost order, as columns."""
    return outcomes.groupBy("question_id").pivot("method", list(S.METHODS)).agg(F.round(F.max("answer_correctness"), 6).alias("ac"), F.round(F.max("evidence_recall"), 6).alias("er"))


def selection(candidates: DataFrame) -> DataFrame:
    """The candidate with both gains at least zero: greatest lesser gain, then total gain, then smallest alpha and lambda."""
    feasible = candidates.where((F.col("ac_gain") >= 0) & (F.col("er_gain") >= 0))
    least = F.least("ac_gain", "er_gain")
    return feasible.orderBy(F.desc(F.round(least, 9)), F.desc(F.round(F.col("ac_gain") + F.col("er_gain"), 9)), "alpha", "lam").limit(1)
