"""Queries over method outcomes: labels, policies, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import METHODS
from ..operators import classification as K
from ..operators import outcomes as O
from .tables import OUTCOMES_SQL, SILVER_SQL, outcomes, table


def silver_fixed_order(spark, d):
    return O.silver_fixed_order(outcomes(spark, d))


def silver_cheapest(spark, d):
    return O.silver_cheapest(outcomes(spark, d), 0.60, 0.10)


def weight_category(spark, d):
    return O.weight_categories(outcomes(spark, d))


def weight_counts(spark, d):
    """Questions per weight class for each order status and in total."""
    status = table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderstatus").alias("split"))
    rows = O.weight_categories(outcomes(spark, d)).join(status, "question_id")
    return rows.groupingSets([[F.col("split"), F.col("category")], [F.col("category")]], "split", "category").agg(F.count("*").alias("n")).select(
        F.coalesce("split", F.lit("all")).alias("split"), "category", "n"
    )


def utility_scores(spark, d):
    return O.utility_scores(outcomes(spark, d))


def utility_route(spark, d):
    return O.utility_route(outcomes(spark, d))


def cheapest_within_tol(spark, d):
    return O.cheapest_within(outcomes(spark, d), F.col("answer_correctness") * 0.5 + F.col("evidence_recall") * 0.5)


def gap_weights(spark, d):
    return O.gap_weights(outcomes(spark, d), F.col("answer_correctness"))


def target_tensor(spark, d):
    return O.target_tensor(outcomes(spark, d))


def _choices(facts):
    """Fixed policies, the oracle (silver labels) and an adaptive one (the fixed-order label)."""
    oracle = O.silver_cheapest(facts, 0.60, 0.10).select("question_id", F.lit("oracle").alias("policy"), F.col("silver_label").alias("method"))
    adaptive = O.silver_fixed_order(facts).select("question_id", F.lit("adaptive").alias("policy"), F.col("silver_label").alias("method"))
    return O.fixed_choices(facts).unionByName(oracle).unionByName(adaptive)


def policy_summary(spark, d):
    facts = outcomes(spark, d)
    return O.with_joint(O.policy_summary(facts, _choices(facts)))


def policy_by_type(spark, d):
    facts = outcomes(spark, d)
    kinds = table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("question_type"))
    return O.policy_summary(facts, _choices(facts).join(kinds, "question_id"), ["question_type"])


def route_distribution(spark, d):
    return O.route_distribution(_choices(outcomes(spark, d)))


def oracle_gap(spark, d):
    """Each policy's averages less the oracle's."""
    facts = outcomes(spark, d)
    s = O.policy_summary(facts, _choices(facts)).select("policy", "answer_correctness", "evidence_recall")
    o = s.where(F.col("policy") == "oracle").select(F.col("answer_correctness").alias("oa"), F.col("evidence_recall").alias("oe"))
    return s.join(F.broadcast(o)).select(  # one row
        "policy", F.round(F.col("answer_correctness") - F.col("oa"), 6).alias("ac_gap"), F.round(F.col("evidence_recall") - F.col("oe"), 6).alias("er_gap")
    )


def cost_reduction(spark, d):
    facts = outcomes(spark, d)
    adaptive = O.silver_cheapest(facts, 0.60, 0.10).select("question_id", F.col("silver_label").alias("method"))
    return O.cost_reduction(facts, adaptive, "pathrag", "vector")


def win_tie_loss(spark, d):
    return O.win_tie_loss(outcomes(spark, d), "lightrag", "vector")


def bootstrap_ci(spark, d):
    return O.bootstrap_ci(outcomes(spark, d), "lightrag", "vector", samples=50)


def bootstrap_ci_20000(spark, d):
    """The interval from the reference's 20,000 replicates; bootstrap_ci stays at the 50 its SQL draws."""
    return O.bootstrap_ci_grouped(outcomes(spark, d), "lightrag", "vector", samples=20_000)


def latency_percentiles(spark, d):
    r = table(spark, d, "backend_results").where(F.col("total_time_ms").isNotNull())
    return O.latency_percentiles(r)


def usage_deltas(spark, d):
    """Tokens of a question's results over time, and the growth since the result before."""
    from pyspark.sql import Window

    order = Window.partitionBy("question_id", "method").orderBy("created_at", "result_id")
    r = table(spark, d, "backend_results").where(F.col("question_id").isNotNull() & F.col("created_at").isNotNull())
    total = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return r.select("result_id", (total - F.lag(total).over(order)).alias("delta"))


def _labels(spark, d):
    facts = outcomes(spark, d)
    truth = O.silver_cheapest(facts, 0.60, 0.10).select("question_id", F.col("silver_label").alias("truth"))
    guess = O.silver_fixed_order(facts).select("question_id", F.col("silver_label").alias("prediction"))
    return truth.join(guess, "question_id").join(O.weight_categories(facts).select("question_id", "weight"), "question_id")


def confusion_matrix(spark, d):
    return K.confusion(_labels(spark, d), METHODS)


def weighted_confusion(spark, d):
    return K.confusion(_labels(spark, d), METHODS, "weight")


def router_accuracy(spark, d):
    return K.accuracy(_labels(spark, d))


def weighted_accuracy(spark, d):
    return K.accuracy(_labels(spark, d), "weight")


def macro_f1(spark, d):
    return K.macro_f1(_labels(spark, d), METHODS)


def majority_baseline(spark, d):
    return K.majority(_labels(spark, d), "truth", "question_id")


def rule_grid(spark, d):
    """Label counts for a grid of thresholds and margins in one pass over the outcomes."""
    facts = outcomes(spark, d).select(
        "question_id", "method", "answer_correctness", (F.col("input_tokens") + F.col("output_tokens")).alias("tok")
    )
    grid = spark.createDataFrame([(t, m) for t in (0.5, 0.6, 0.7) for m in (0.05, 0.1)], "threshold double, margin double")
    per = facts.groupBy("question_id").agg(F.collect_list(F.struct("tok", "method", F.col("answer_correctness").alias("s"))).alias("fs"), F.max("answer_correctness").alias("best"))
    ok = F.array_sort(F.filter("fs", lambda f: (f["s"] >= F.col("threshold")) & (f["s"] >= F.round(F.col("best") - F.col("margin"), 6))))
    return per.join(F.broadcast(grid)).select(  # six rows
        "threshold", "margin", F.coalesce(F.try_element_at(ok, F.lit(1))["method"], F.lit("none")).alias("label")
    ).groupBy("threshold", "margin", "label").agg(F.count("*").alias("n"))


def candidate_selection(spark, d):
    """The recall weight whose route gains most over the vector method in both scores, of a grid."""
    facts = outcomes(spark, d)
    base = facts.where(F.col("method") == "vector").agg(F.avg("answer_correctness").alias("ba"), F.avg("evidence_recall").alias("be"))
    rows = None
    for lam in (0.0, 0.15, 0.5, 1.0):
        routed = O.utility_route(facts, lam).join(facts, ["question_id", "method"]).agg(F.avg("answer_correctness").alias("a"), F.avg("evidence_recall").alias("e")).withColumn("lam", F.lit(lam))
        rows = routed if rows is None else rows.unionByName(routed)
    gains = rows.join(F.broadcast(base)).select(  # one row
        F.lit(1.0).alias("alpha"), "lam", F.round(F.col("a") - F.col("ba"), 6).alias("ac_gain"), F.round(F.col("e") - F.col("be"), 6).alias("er_gain")
    )
    return O.selection(gains)


QUERIES = {
    f.__name__: f
    for f in (
        silver_fixed_order, silver_cheapest, weight_category, weight_counts, utility_scores, utility_route, cheapest_within_tol, gap_weights, target_tensor, policy_summary,
        policy_by_type, route_distribution, oracle_gap, cost_reduction, win_tie_loss, bootstrap_ci, bootstrap_ci_20000, latency_percentiles, usage_deltas, confusion_matrix, weighted_confusion,
        router_accuracy, weighted_accuracy, macro_f1, majority_baseline, rule_grid, candidate_selection,
    )
}

_S = SILVER_SQL.format(threshold=0.60, margin=0.10)
_FIXED = """
fixed AS (
  SELECT question_id, method AS silver_label FROM (SELECT o.*, b.best FROM outcomes o JOIN best b USING (question_id)) WHERE answer_correctness >= round(best - 0.02, 6)
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY o) = 1
)"""
_CLASSES = """
counts AS (SELECT b.question_id, count(e.method) AS n FROM best b LEFT JOIN eligible e USING (question_id) GROUP BY b.question_id),
classes AS (SELECT question_id, CASE n WHEN 0 THEN 'all_failed' WHEN 1 THEN 'stable' ELSE 'ambiguous' END AS category, CASE n WHEN 0 THEN 0.3::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM counts)"""
_CHOICES = """
choices AS (
  SELECT question_id, method AS policy, method FROM outcomes
  UNION ALL SELECT question_id, 'oracle', silver_label FROM silver UNION ALL SELECT question_id, 'adaptive', silver_label FROM fixed
)"""
_ALL = f"WITH {OUTCOMES_SQL}, {_S}, {_FIXED}, {_CLASSES}, {_CHOICES}"
_LABELS = f"{_ALL}, labels AS (SELECT s.question_id, s.silver_label AS truth, f.silver_label AS prediction, c.weight FROM silver s JOIN fixed f USING (question_id) JOIN classes c USING (question_id)), names AS (SELECT unnest(['vector','lightrag','pathrag']) AS label)"
_MEANS = "count(*) AS n, round(avg(answer_correctness), 6) AS answer_correctness, round(avg(evidence_recall), 6) AS evidence_recall, round(avg(rouge_l), 6) AS rouge_l, round(avg(input_tokens), 4) AS input_tokens, round(avg(output_tokens), 4) AS output_tokens, round(avg(total_time_ms), 4) AS total_time_ms"
_PAIR = "pair AS (SELECT question_id, max(CASE WHEN method = 'lightrag' THEN answer_correctness END) - max(CASE WHEN method = 'vector' THEN answer_correctness END) AS d FROM outcomes GROUP BY question_id)"
_CLIP = "least(greatest({}, 0.0), 1.0)"
_UTIL = f"round({_CLIP.format('answer_correctness')} + {{lam}} * {_CLIP.format('evidence_recall')}, 6)"


def _poisson() -> str:
    out, p, total = [], 2.718281828459045**-1, 0.0
    for k in range(8):
        total += p
        out.append(f"CASE WHEN u >= {total!r}::DOUBLE THEN 1 ELSE 0 END")
        p /= k + 1
    return " + ".join(out)


def _selection() -> str:
    rows = " UNION ALL ".join(
        f"SELECT {lam!r}::DOUBLE AS lam, avg(answer_correctness) AS a, avg(evidence_recall) AS e FROM (SELECT * FROM outcomes QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY {_UTIL.format(lam=lam)} DESC, o) = 1)"
        for lam in (0.0, 0.15, 0.5, 1.0)
    )
    return f"""WITH {OUTCOMES_SQL}, base AS (SELECT avg(answer_correctness) AS ba, avg(evidence_recall) AS be FROM outcomes WHERE method = 'vector'),
gains AS (SELECT 1.0::DOUBLE AS alpha, lam, round(a - ba, 6) AS ac_gain, round(e - be, 6) AS er_gain FROM ({rows}), base)
SELECT * FROM gains WHERE ac_gain >= 0 AND er_gain >= 0 ORDER BY round(least(ac_gain, er_gain), 9) DESC, round(ac_gain + er_gain, 9) DESC, alpha, lam LIMIT 1"""


ORACLE_SQL = {
    "silver_fixed_order": f"{_ALL} SELECT question_id, silver_label FROM fixed",
    "silver_cheapest": f"{_ALL} SELECT question_id, silver_label, all_failed FROM silver",
    "weight_category": f"{_ALL} SELECT question_id, category, weight FROM classes",
    "weight_counts": f"{_ALL} SELECT coalesce(o_orderstatus, 'all') AS split, category, count(*) AS n FROM classes JOIN orders ON o_orderkey = question_id GROUP BY GROUPING SETS ((o_orderstatus, category), (category))",
    "utility_scores": f"""WITH {OUTCOMES_SQL}, x AS (SELECT question_id, method, {_CLIP.format('answer_correctness')} AS a, {_CLIP.format('evidence_recall')} AS e FROM outcomes)
SELECT question_id, method, round(CASE WHEN a + e > 0 THEN 2 * a * e / (a + e) ELSE 0 END, 6) AS harmonic, round(sqrt(a * e), 6) AS geometric, round(least(a, e), 6) AS minimum, round((a + e) / 2, 6) AS mean,
  round(0.75::DOUBLE * a + 0.25::DOUBLE * e, 6) AS ac75_er25, round(0.60::DOUBLE * a + 0.40::DOUBLE * e, 6) AS ac60_er40 FROM x""",
    "utility_route": f"WITH {OUTCOMES_SQL} SELECT question_id, method FROM outcomes QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY {_UTIL.format(lam='0.15::DOUBLE')} DESC, o) = 1",
    "cheapest_within_tol": f"""WITH {OUTCOMES_SQL}, s AS (SELECT question_id, method, o, round(answer_correctness * 0.5 + evidence_recall * 0.5, 6) AS s FROM outcomes), b AS (SELECT *, max(s) OVER (PARTITION BY question_id) AS best FROM s)
SELECT question_id, method FROM b WHERE s >= round(best - 0.02::DOUBLE, 6) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY o) = 1""",
    "gap_weights": f"""WITH {OUTCOMES_SQL}, r AS (SELECT question_id, answer_correctness AS s, row_number() OVER (PARTITION BY question_id ORDER BY answer_correctness DESC, o) AS r FROM outcomes),
g AS (SELECT question_id, round(max(CASE WHEN r = 1 THEN s END) - max(CASE WHEN r = 2 THEN s END), 6) AS gap FROM r GROUP BY question_id)
SELECT question_id, gap, round(0.3::DOUBLE + 0.7::DOUBLE * least(greatest(gap / 0.2::DOUBLE, 0.0), 1.0), 6) AS weight FROM g""",
    "target_tensor": f"WITH {OUTCOMES_SQL} SELECT question_id, " + ", ".join(
        f"max(CASE WHEN method = '{m}' THEN {c} END) AS {m}_{a}" for m in METHODS for a, c in (("ac", "answer_correctness"), ("er", "evidence_recall"))
    ) + " FROM outcomes GROUP BY question_id",
    "policy_summary": f"{_ALL}, s AS (SELECT policy, {_MEANS} FROM choices JOIN outcomes USING (question_id, method) GROUP BY policy) SELECT *, round(CASE WHEN answer_correctness + evidence_recall > 0 THEN 2 * answer_correctness * evidence_recall / (answer_correctness + evidence_recall) ELSE 0 END, 6) AS joint FROM s",
    "policy_by_type": f"{_ALL} SELECT policy, o_orderpriority AS question_type, {_MEANS} FROM choices JOIN outcomes USING (question_id, method) JOIN orders ON o_orderkey = question_id GROUP BY GROUPING SETS ((policy, o_orderpriority), (policy))",
    "route_distribution": f"{_ALL} SELECT policy, method, count(*) AS questions FROM choices GROUP BY ALL",
    "oracle_gap": f"{_ALL}, s AS (SELECT policy, {_MEANS} FROM choices JOIN outcomes USING (question_id, method) GROUP BY policy) SELECT a.policy, round(a.answer_correctness - o.answer_correctness, 6) AS ac_gap, round(a.evidence_recall - o.evidence_recall, 6) AS er_gap FROM s a, s o WHERE o.policy = 'oracle'",
    "cost_reduction": f"""{_ALL}, c AS (SELECT sum(input_tokens + output_tokens) AS spent, avg(answer_correctness) AS q FROM silver JOIN outcomes ON outcomes.question_id = silver.question_id AND method = silver_label),
f AS (SELECT sum(CASE WHEN method = 'pathrag' THEN input_tokens + output_tokens END) AS fs, avg(CASE WHEN method = 'vector' THEN answer_correctness END) AS fq FROM outcomes)
SELECT round(1 - spent / greatest(fs, 1e-12), 6) AS token_reduction, round(q - fq, 6) AS quality_gain FROM c, f""",
    "win_tie_loss": f"WITH {OUTCOMES_SQL}, {_PAIR} SELECT count(*) FILTER (d > 1e-12) AS wins, count(*) FILTER (abs(d) <= 1e-12) AS ties, count(*) FILTER (d < -1e-12) AS losses FROM pair",
    "bootstrap_ci": f"""WITH {OUTCOMES_SQL}, {_PAIR}, reps AS (SELECT unnest(generate_series(0, 49)) AS r),
u AS (SELECT r, d, CAST(('0x' || substr(md5(concat('42:', r, ':', question_id)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM pair, reps),
m AS (SELECT r, sum(w * d) / sum(w) AS m FROM (SELECT r, d, {_poisson()} AS w FROM u) GROUP BY r)
SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""",
    "latency_percentiles": "SELECT method, round(avg(total_time_ms), 4) AS mean_ms, round(quantile_cont(total_time_ms, 0.5), 4) AS p50_ms, round(quantile_cont(total_time_ms, 0.95), 4) AS p95_ms FROM backend_results WHERE total_time_ms IS NOT NULL GROUP BY method",
    "usage_deltas": "SELECT result_id, t - lag(t) OVER (PARTITION BY question_id, method ORDER BY created_at, result_id) AS delta FROM (SELECT *, coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS t FROM backend_results WHERE question_id IS NOT NULL AND created_at IS NOT NULL)",
    "confusion_matrix": f"{_LABELS} SELECT a.label AS truth, b.label AS prediction, CAST(count(l.truth) AS DOUBLE) AS n FROM names a CROSS JOIN names b LEFT JOIN labels l ON l.truth = a.label AND l.prediction = b.label GROUP BY ALL",
    "weighted_confusion": f"{_LABELS} SELECT a.label AS truth, b.label AS prediction, round(coalesce(sum(l.weight), 0.0), 6) AS n FROM names a CROSS JOIN names b LEFT JOIN labels l ON l.truth = a.label AND l.prediction = b.label GROUP BY ALL",
    "router_accuracy": f"{_LABELS} SELECT round(avg(CASE WHEN truth = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels",
    "weighted_accuracy": f"{_LABELS} SELECT round(sum(CASE WHEN truth = prediction THEN weight ELSE 0 END) / sum(weight), 6) AS accuracy FROM labels",
    "macro_f1": f"""{_LABELS}, f AS (SELECT label, count(*) FILTER (truth = label AND prediction = label) AS tp, count(*) FILTER (truth = label) AS t, count(*) FILTER (prediction = label) AS p FROM names CROSS JOIN labels GROUP BY label)
SELECT round(avg(coalesce(2.0 * tp / nullif(t + p, 0), 0.0)), 6) AS macro_f1 FROM f""",
    "majority_baseline": f"{_LABELS}, c AS (SELECT truth, count(*) AS n, min(question_id) AS f FROM labels GROUP BY truth) SELECT first(truth ORDER BY n DESC, f) AS majority, round(max(n) / sum(n), 6) AS accuracy FROM c",
    "rule_grid": f"""WITH {OUTCOMES_SQL}, grid AS (SELECT t AS threshold, m AS margin FROM (SELECT unnest([0.5, 0.6, 0.7]::DOUBLE[]) AS t), (SELECT unnest([0.05, 0.1]::DOUBLE[]) AS m)),
b AS (SELECT *, max(answer_correctness) OVER (PARTITION BY question_id) AS best FROM outcomes),
e AS (SELECT threshold, margin, question_id, method FROM b, grid WHERE answer_correctness >= threshold AND answer_correctness >= round(best - margin, 6) QUALIFY row_number() OVER (PARTITION BY threshold, margin, question_id ORDER BY input_tokens + output_tokens, method) = 1),
q AS (SELECT DISTINCT question_id FROM outcomes)
SELECT g.threshold, g.margin, coalesce(e.method, 'none') AS label, count(*) AS n FROM grid g CROSS JOIN q LEFT JOIN e ON e.threshold = g.threshold AND e.margin = g.margin AND e.question_id = q.question_id GROUP BY ALL""",
    "candidate_selection": _selection(),
}
