"""Queries over routers and the model boundary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.scores import METHODS
from ..operators import clients as C
from ..operators import models
from ..operators import outcomes as O
from ..operators import routers as R
from . import graph
from .tables import OUTCOMES_SQL, SILVER_SQL, outcomes, table
from .text import _CUT

RULES = ((0.6, 0.1), (0.7, 0.05))
GRID = [(0.5, True), (2.0, False)]


def _asked(spark, d):
    q = table(spark, d, "p0_questions").where(F.col("id").isNotNull() & F.col("question").isNotNull())
    return q.groupBy("id").agg(F.max("question").alias("question"))


def router_features(spark, d):
    """Features of the router's texts: terms and greatest weight of each block."""
    p = R.router_postings(_asked(spark, d), "id", "question")
    words = F.col("term").startswith("w:")
    return p.groupBy("id").agg(
        F.count_if(words).alias("words"), F.count_if(~words).alias("runs"), F.round(F.max(F.when(words, F.col("weight"))), 6).alias("top_word"), F.round(F.max(F.when(~words, F.col("weight"))), 6).alias("top_run")
    )


def _rows(spark, d):
    """Vectors with a method as label (by the greatest of the first three numbers) and a fold."""
    x = [F.col("embedding")[i] for i in range(3)]
    label = F.when((x[0] >= x[1]) & (x[0] >= x[2]), METHODS[0]).when(x[1] >= x[2], METHODS[1]).otherwise(METHODS[2])
    v = table(spark, d, "embeddings").select("vec_id", "embedding", label.alias("truth"), (F.col("vec_id") % 5).cast("int").alias("fold"))
    return R.dense(v, "embedding").drop("embedding")


def router_calibration(spark, d):
    """Mean probability of each method over the rows a router was fitted on: with a free intercept, the method's share."""
    rows = _rows(spark, d)
    p = R.predicted(R.fit(rows, "truth", 0.5, False), rows, ["vec_id"])
    each = p.select(F.explode("probabilities").alias("method", "p"))
    return each.groupBy("method").agg(F.round(F.avg("p"), 3).alias("share"))


def router_oof_checks(spark, d):
    """Per candidate: out-of-fold rows, distinct ids, folds, and whether probabilities add up to one and name the prediction."""
    p = R.out_of_fold(_rows(spark, d), "vec_id", "truth", "fold", GRID, 5)
    values = F.map_values("probabilities")
    top = F.array_max(values) <= F.element_at("probabilities", F.col("prediction")) + 1e-6
    one = F.abs(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-4
    return p.groupBy("candidate").agg(F.count("*").alias("rows"), F.count_distinct("vec_id").alias("ids"), F.count_distinct("fold").alias("folds"), F.bool_and(one & top).alias("sound"))


def router_oof_grid(spark, d):
    """Candidates that learn out of fold what the vectors carry: far above chance in macro F1 and accuracy."""
    p = R.out_of_fold(_rows(spark, d), "vec_id", "truth", "fold", GRID, 5)
    return R.candidate_scores(p, len(GRID)).select("candidate", ((F.col("macro_f1") > 0.6) & (F.col("accuracy") > 0.6)).alias("learns"))


def router_predictions(spark, d):
    """Rows that a prediction file has, by weight class: count, and whether each has all methods' probabilities in cost order."""
    rows = _rows(spark, d)
    p = R.predicted(R.fit(rows.where("fold <> 0"), "truth", 0.5, True), rows, ["vec_id", "truth"])
    marked = R.prediction_rows(p, O.weight_categories(outcomes(spark, d)), "vec_id")
    ordered = F.array_join(F.map_keys("probabilities"), ",") == ",".join(METHODS)
    return marked.groupBy("weight_category").agg(F.count("*").alias("rows"), F.round(F.avg("sample_weight"), 6).alias("weight"), F.bool_and(ordered).alias("ordered"))


def router_ridge_pair(spark, d):
    """Out-of-fold ridge on two numbers, small enough to be solved in closed form."""
    v = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 2).alias("x"), (F.col("label") / 10.0).alias("a"), (F.col("vec_id") % 5).cast("int").alias("fold"))
    return models.ridge_oof(v, "vec_id", "x", ["a"], "fold", alpha=1.0)


def label_rule_counts(spark, d):
    """Labels under each rule of a grid of thresholds and margins, and the majority's share."""
    labels = R.label_rules(outcomes(spark, d), list(RULES))
    per = labels.groupBy("threshold", "margin", "silver_label").agg(F.count("*").alias("n"))
    return per.groupBy("threshold", "margin").agg(F.sum("n").alias("n"), F.round(F.max("n") / F.sum("n"), 6).alias("majority"))


def embeddings_merged(spark, d):
    """Vectors of all questions: from the cache where it is of use, made anew where not."""
    texts = _asked(spark, d).select(F.col("id").alias("question_id"), "question")
    cache = table(spark, d, "question_embeddings")
    have = cache.where(F.col("embedding").isNotNull() & (F.size("embedding") == 64)).select("question_id").distinct().withColumn("cached", F.lit(True))
    merged = C.load_or_embed(cache, texts, "question_id", "question", C.client_factory("hash", dimensions=64), 64)
    return merged.join(have, "question_id", "left").groupBy(F.coalesce("cached", F.lit(False)).alias("cached")).agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("width"))


def generated_answers(spark, d):
    """Answers of a model that repeats the first sentence of its last line, over rendered contexts."""
    items = table(spark, d, "heldout_items").select("item_id", F.concat(F.lit("About "), "kind").alias("question"), F.array("text").alias("contexts"))
    made = C.generate_answers(C.prompts(items), "item_id", C.client_factory("echo"))
    return made.select("item_id", F.md5("answer").alias("answer_md5"), "error")


def legacy_rows(spark, d):
    """Results in the old shape: missing lists empty with a warning each, time rounded."""
    r = table(spark, d, "backend_results")
    lists = ("contexts", "entities", "relations", "paths")
    warnings = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in lists]))
    return r.select("result_id", *[F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).alias(c) for c in lists], F.size(warnings).alias("warnings"), F.round("total_time_ms", 3).alias("latency_ms"))


def generation_contexts(spark, d):
    """What a graph method generates from: its non-blank contexts, or the graph rows as JSON where it has none."""
    r = table(spark, d, "backend_results").where(F.col("method") == "lightrag")
    kept = X.non_empty(F.coalesce("contexts", F.array().cast("array<string>")))
    rows = F.to_json(F.transform("entities", lambda e: F.struct(e["entity_name"].alias("name"))))
    text = F.when(F.size(kept) > 0, F.array_join(kept, "\n\n")).otherwise(rows)
    return r.select("result_id", F.size(kept).alias("contexts"), (F.size(kept) == 0).alias("fallback"), F.length(text).alias("characters"))


def demo_preview(spark, d):
    """One question end to end: routed to the vector method, its chunks with previews of 350 characters."""
    from . import text as T

    asked = table(spark, d, "heldout_items").where(F.col("item_id") == 50).select(F.col("item_id").alias("query_id"), "text")
    hits = graph.retrieve(graph.TextParts(spark, d), asked, "vector")
    chunks = T._chunks(spark, d).select(F.col("chunk_id").alias("node"), "chunk")
    return hits.join(chunks, "node").select("rank", F.col("node").alias("chunk_id"), "score", F.length(F.substring("chunk", 1, 350)).alias("preview"))


def shortest_per_subset(spark, d):
    """The shortest context of each subset, the one that is shown first; ties by corpus name and id."""
    docs = table(spark, d, "corpus_documents").where(F.col("context").isNotNull() & F.col("subset").isNotNull())
    return docs.groupBy("subset").agg(F.min(F.struct(F.length("context").alias("characters"), "corpus_name", "corpus_doc_id")).alias("x")).select("subset", "x.*")


QUERIES = {
    f.__name__: f
    for f in (
        router_features, router_calibration, router_oof_checks, router_oof_grid, router_predictions, router_ridge_pair, label_rule_counts, embeddings_merged, generated_answers, legacy_rows,
        generation_contexts, demo_preview, shortest_per_subset,
    )
}

_METHOD = "CASE WHEN embedding[1] >= embedding[2] AND embedding[1] >= embedding[3] THEN 'vector' WHEN embedding[2] >= embedding[3] THEN 'lightrag' ELSE 'pathrag' END"


def _rule_counts() -> str:
    parts = []
    for i, (t, m) in enumerate(RULES):
        parts.append(f"SELECT {t!r}::DOUBLE AS threshold, {m!r}::DOUBLE AS margin, silver_label, count(*) AS n FROM (WITH {OUTCOMES_SQL}, {SILVER_SQL.format(threshold=t, margin=m)} SELECT silver_label FROM silver) GROUP BY ALL")
    return f"SELECT threshold, margin, sum(n) AS n, round(max(n) / sum(n), 6) AS majority FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


def _block_sql(name: str, source: str, least: int, most: int) -> str:
    return f"""{name}tf AS (SELECT id, term, count(*) AS tf FROM {source} GROUP BY ALL),
{name}v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM asked)) / (1.0 + count(*))) + 1.0 AS idf FROM {name}tf GROUP BY term HAVING count(*) >= {least} ORDER BY sum(tf) DESC, term LIMIT {most}),
{name}r AS (SELECT id, (1.0 + ln(tf)) * idf AS w FROM {name}tf JOIN {name}v USING (term)),
{name} AS (SELECT id, count(*) AS n, round(max(w) / sqrt(sum(w * w)), 6) AS top FROM {name}r GROUP BY id)"""


def _fold_sums() -> str:
    sums = ", ".join(f"sum({e}) AS {n}" for n, e in (("n", "1.0"), ("sx1", "x1"), ("sx2", "x2"), ("sy", "y"), ("s11", "x1 * x1"), ("s12", "x1 * x2"), ("s22", "x2 * x2"), ("s1y", "x1 * y"), ("s2y", "x2 * y")))
    return f"""WITH v AS (SELECT vec_id, CAST(vec_id % 5 AS INTEGER) AS fold, CAST(embedding[1] AS DOUBLE) AS x1, CAST(embedding[2] AS DOUBLE) AS x2, label / 10.0::DOUBLE AS y FROM embeddings),
s AS (SELECT f.fold, {sums} FROM (SELECT DISTINCT fold FROM v) f JOIN v ON v.fold <> f.fold GROUP BY f.fold),
c AS (SELECT *, s11 - sx1 * sx1 / n + 1.0 AS a, s12 - sx1 * sx2 / n AS b, s22 - sx2 * sx2 / n + 1.0 AS d, s1y - sx1 * sy / n AS p, s2y - sx2 * sy / n AS q FROM s),
w AS (SELECT *, (d * p - b * q) / (a * d - b * b) AS w1, (a * q - b * p) / (a * d - b * b) AS w2 FROM c)
SELECT vec_id, fold, round(sy / n - w1 * sx1 / n - w2 * sx2 / n + w1 * x1 + w2 * x2, 6) AS pred_a FROM v JOIN w USING (fold)"""


ORACLE_SQL = {
    "router_features": f"""
WITH asked AS (SELECT id, max(question) AS question FROM p0_questions WHERE id IS NOT NULL AND question IS NOT NULL GROUP BY id),
t AS (SELECT id, regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM asked),
wt AS (SELECT id, unnest(list_concat(t, list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM t),
p AS (SELECT id, ' ' || unnest(list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda x: x <> '')) || ' ' AS w FROM asked),
ct AS (SELECT id, unnest(list_concat(CASE WHEN length(w) <= 5 THEN [w] ELSE [] END, flatten(list_transform([3, 4, 5], lambda n: CASE WHEN length(w) > n THEN list_transform(generate_series(1, length(w) - n + 1), lambda i: substr(w, i, n)) ELSE [] END)))) AS term FROM p),
{_block_sql('wb', 'wt', *R.WORDS)},
{_block_sql('cb', 'ct', *R.CHARACTERS)}
SELECT coalesce(wb.id, cb.id) AS id, coalesce(wb.n, 0) AS words, coalesce(cb.n, 0) AS runs, wb.top AS top_word, cb.top AS top_run FROM wb FULL JOIN cb ON wb.id = cb.id""",
    "router_calibration": f"SELECT {_METHOD} AS method, round(count(*) / sum(count(*)) OVER (), 3) AS share FROM embeddings GROUP BY 1",
    "router_oof_checks": f"SELECT c AS candidate, count(*) AS rows, count(DISTINCT vec_id) AS ids, count(DISTINCT vec_id % 5) AS folds, TRUE AS sound FROM embeddings, (SELECT unnest({list(range(len(GRID)))}) AS c) GROUP BY c",
    "router_oof_grid": f"SELECT unnest({list(range(len(GRID)))}) AS candidate, TRUE AS learns",
    "router_predictions": f"""WITH {OUTCOMES_SQL}, {SILVER_SQL.format(threshold=0.60, margin=0.10)}, counts AS (SELECT b.question_id, count(e.method) AS n FROM best b LEFT JOIN eligible e USING (question_id) GROUP BY b.question_id)
SELECT CASE n WHEN 0 THEN 'all_failed' WHEN 1 THEN 'stable' ELSE 'ambiguous' END AS weight_category, count(*) AS rows, round(avg(CASE n WHEN 0 THEN 0.3 WHEN 1 THEN 1.0 ELSE 0.5 END), 6) AS weight, TRUE AS ordered
FROM counts JOIN embeddings ON vec_id = question_id GROUP BY 1""",
    "router_ridge_pair": _fold_sums(),
    "label_rule_counts": _rule_counts(),
    "embeddings_merged": """WITH t AS (SELECT DISTINCT id FROM p0_questions WHERE id IS NOT NULL AND question IS NOT NULL), h AS (SELECT DISTINCT question_id FROM question_embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND question_id IS NOT NULL)
SELECT id IN (SELECT question_id FROM h) AS cached, count(*) AS n, 64 AS width FROM t GROUP BY 1""",
    "generated_answers": "SELECT item_id, md5(string_split(list_extract(string_split(text, chr(10)), -1), '. ')[1]) AS answer_md5, CASE WHEN trim(string_split(list_extract(string_split(text, chr(10)), -1), '. ')[1]) = '' THEN 'EMPTY_ANSWER' END AS error FROM heldout_items",
    "legacy_rows": """SELECT result_id, coalesce(len(contexts), 0) AS contexts, coalesce(len(entities), 0) AS entities, coalesce(len(relations), 0) AS relations, coalesce(len(paths), 0) AS paths,
CAST(contexts IS NULL AS INTEGER) + CAST(entities IS NULL AS INTEGER) + CAST(relations IS NULL AS INTEGER) + CAST(paths IS NULL AS INTEGER) AS warnings, round(total_time_ms, 3) AS latency_ms FROM backend_results""",
    "generation_contexts": """WITH k AS (SELECT result_id, entities, list_filter(list_transform(coalesce(contexts, []), lambda x: trim(x)), lambda x: x <> '') AS k FROM backend_results WHERE method = 'lightrag')
SELECT result_id, len(k) AS contexts, len(k) = 0 AS fallback, CASE WHEN len(k) > 0 THEN length(array_to_string(k, chr(10) || chr(10)))
  ELSE length(concat('[', array_to_string(list_transform(entities, lambda e: CASE WHEN e['entity_name'] IS NULL THEN '{}' ELSE concat('{"name":', to_json(e['entity_name']), '}') END), ','), ']')) END AS characters FROM k""",
    "demo_preview": f"WITH {graph._TEXT.replace('WHERE item_id % 50 = 0', 'WHERE item_id = 50')}, {_CUT} SELECT rank, node AS chunk_id, score, least(350, length(t)) AS preview FROM hits JOIN cut ON chunk_id = node WHERE rank <= 3",
    "shortest_per_subset": "SELECT subset, length(context) AS characters, corpus_name, corpus_doc_id FROM corpus_documents WHERE context IS NOT NULL AND subset IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subset ORDER BY length(context), corpus_name, corpus_doc_id) = 1",
}
