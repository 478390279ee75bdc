"""Queries over gates, splits, candidates and the life of an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.scores import METHODS
from ..operators import classification as K
from ..operators import gates as G
from ..operators import lifecycle as L
from ..operators import outcomes as O
from . import graph, routing
from .records import _CLEAN, _Q, _questions, _used
from .tables import OUTCOMES_SQL, outcomes, table
from .text import _parts, _terms_sql


def _evaluated(spark, d):
    """Results with scores, version, status and protocol made from their ids: some unusable in each way."""
    r = table(spark, d, "backend_results").select("result_id", "question_id", "method", "answer")
    i = F.col("result_id")
    ac = F.when(i % 13 == 0, None).when(i % 37 == 0, 1.5).otherwise(F.round((i % 101) / F.lit(100.0), 6))
    return r.select(
        "*", ac.alias("answer_correctness"), F.round(((i * 7) % 101) / F.lit(100.0), 6).alias("evidence_recall"), F.when(i % 11 == 0, 1).otherwise(2).alias("version"),
        F.when(i % 19 == 0, "failed").otherwise("ok").alias("status"), F.when(i % 5 == 0, "p0").otherwise("p1").alias("protocol"),
        F.when(i % 17 == 0, F.array(F.lit("judge"))).otherwise(F.array().cast("array<string>")).alias("errors"),
    )


def valid_evaluations(spark, d):
    e = _evaluated(spark, d)
    good = G.valid_evaluation(F.col("version"), F.col("status"), [F.col("answer_correctness"), F.col("evidence_recall")])
    return e.groupBy("method").agg(F.count("*").alias("rows"), F.count_if(good).alias("valid"))


def sanitised_scores(spark, d):
    s = G.sanitised(_evaluated(spark, d).drop("status"), ["answer_correctness", "evidence_recall"], "errors")
    return s.groupBy("status").agg(F.count("*").alias("rows"), F.count("answer_correctness").alias("ac"), F.count("evidence_recall").alias("er"))


def alignment_rules(spark, d):
    e = _evaluated(spark, d).where(F.col("question_id").isNotNull())
    return G.alignment_rules(e, "question_id", "method", METHODS, "protocol", ["status", "version"])


def merge_rules(spark, d):
    q = table(spark, d, "p0_questions").select("id", F.lower(F.trim("split")).alias("split"), "selection_source")
    frozen = table(spark, d, "expansion_manifest").where(F.col("round") == 1).select(F.explode("baseline.test_ids").alias("id"))
    return G.merge_rules(q.where(F.col("selection_source").isNull()), q.where(F.col("selection_source").isNotNull()), "id", "split", frozen)


def stale_evaluations(spark, d):
    source = table(spark, d, "backend_results").select("result_id", "question_id", "answer")
    stored = source.where(F.col("result_id") % 7 != 0).select("result_id", F.when(F.col("result_id") % 10 == 0, "old").otherwise(G.canonical(["question_id", "answer"])).alias("stored"))
    return G.stale(stored, source.where(F.col("result_id") % 9 != 0), "result_id", "stored", ["question_id", "answer"])


def reusable_evaluations(spark, d):
    source = table(spark, d, "p0_questions").where(F.col("id").isNotNull()).groupBy(F.col("id").alias("question_id")).agg(F.max("question").alias("question"))
    marks = source.select("question_id", G.canonical(["question"]).alias("fingerprint"))
    e = _evaluated(spark, d).join(marks, "question_id").withColumn("fingerprint", F.when(F.col("result_id") % 10 == 0, "old").otherwise(F.col("fingerprint")))
    return G.reusable(e, source, "question_id", "p1", ["question"], "result_id")


def order_differences(spark, d):
    r = table(spark, d, "backend_results").where(F.col("question_id").isNotNull())
    return G.order_differences(r, "method", "question_id", ["result_id"], "vector").groupBy("method").agg(F.count("*").alias("places"))


def merged_maps(spark, d):
    r = table(spark, d, "backend_results")
    left = F.create_map(F.lit("route"), F.lit("none"), F.lit("origin"), F.lit("manual"))
    m = G.merged_map(left, F.create_map(F.lit("route"), F.col("method")))
    return r.select("result_id", m["route"].alias("route"), m["origin"].alias("origin"), F.size(m).alias("keys"))


def route_decisions(spark, d):
    e = _evaluated(spark, d).withColumn("route", F.when(F.col("result_id") % 6 == 0, "unknown").otherwise(F.col("method")))
    x = G.decision(F.col("route"), F.col("answer_correctness"))
    return e.select("result_id", x["method"].alias("method"), x["probability"].alias("probability"))


def type_split_counts(spark, d):
    """Counts of questions by type and split that differ from a table that expects ten of each cell."""
    q = table(spark, d, "p0_questions").where(F.col("question_type").isNotNull() & F.col("split").isNotNull()).select(F.lower(F.trim("question_type")).alias("kind"), F.lower(F.trim("split")).alias("split"))
    expected = q.distinct().withColumn("n", F.lit(10))
    return G.expected_counts(q, ["kind", "split"], expected).groupBy("side").agg(F.count("*").alias("cells"), F.sum("n").alias("n"))


def evidence_multiset(spark, d):
    """Statements that the train side has more often than the test side, or the other way, once normalised."""
    q = table(spark, d, "p0_questions").where(F.col("evidence").isNotNull()).select(F.lower(F.trim("split")).alias("split"), X.normal_evidence(F.col("evidence")).alias("e"))
    return G.multiset_difference(q.where("split = 'train'"), q.where("split = 'test'"), "e").groupBy("side").agg(F.count("*").alias("surplus"))


def development_ids(spark, d):
    """Ids selected once without those of the test split, and those added in any round."""
    m = table(spark, d, "expansion_manifest")
    base = table(spark, d, "p0_questions").where(F.col("id").isNotNull()).select("id")
    test = table(spark, d, "p0_questions").where((F.lower(F.trim("split")) == "test") & F.col("id").isNotNull()).select("id")
    added = m.select(F.explode("expansion.question_ids").alias("id")).where(F.col("id").isNotNull())
    return base.subtract(test).union(added).distinct()


def replicated_rows(spark, d):
    """Train rows once and rows of the other splits twice, as a bag."""
    q = table(spark, d, "p0_questions").select("id", F.lower(F.trim("split")).alias("split"))
    other = q.where(F.col("split") != "train")
    return q.where(F.col("split") == "train").unionByName(other).unionByName(other).groupBy("split").agg(F.count("*").alias("rows"))


def warning_union(spark, d):
    """Distinct warnings of a result from three places."""
    r = table(spark, d, "backend_results")
    w = lambda c, t: F.when(c, F.array(F.lit(t))).otherwise(F.array().cast("array<string>"))
    a = F.array_union(F.array_union(w(F.coalesce(F.size("contexts"), F.lit(0)) < 1, "no context"), w(F.col("answer").isNull(), "no answer")), w(F.col("answer").isNull() | F.col("entities").isNull(), "no answer"))
    return r.select("result_id", F.size(a).alias("warnings"))


def questions_by_type(spark, d):
    q = _questions(spark, d)
    return G.select_questions(q, "kind", ["fact retrieval", "complex reasoning"], ["id"], 60).select("id", "kind", "position")


def low_signal(spark, d):
    return G.low_signal(outcomes(spark, d), "question_id", "answer_correctness")


def labels_kept(spark, d):
    s = O.silver_cheapest(outcomes(spark, d), 0.60, 0.10)
    return G.without_failed(s).groupBy("silver_label").agg(F.count("*").alias("n"))


def vector_index_rules(spark, d):
    ids = table(spark, d, "p0_questions").select(F.col("id").alias("question_id"))
    return G.vector_index_rules(ids, table(spark, d, "question_embeddings"), "question_id", "embedding", 64)


def persisted_status(spark, d):
    """Whether all documents of a source are processed and none of its chunks is empty."""
    docs = table(spark, d, "documents").select("source", (F.col("n_chars") >= 20).alias("processed"), (F.length(F.trim("text")) > 0).alias("filled"))
    return docs.groupBy("source").agg(F.bool_and("processed").alias("processed"), F.bool_and("filled").alias("filled"), F.count("*").alias("documents"))


def two_stage_split(spark, d):
    q = _questions(spark, d).withColumn("label", F.substring(F.md5("id"), 1, 1))
    return G.split_two_stage(q, "id", ["kind", "label"]).groupBy("split").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("id")), ",")).alias("ids_md5"))


def _cases(spark, d):
    kinds = table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("kind"))
    return routing._labels(spark, d).join(kinds, "question_id")


def representative_cases(spark, d):
    return G.representative_cases(_cases(spark, d), "question_id", METHODS, ["1-URGENT", "2-HIGH", "3-MEDIUM"])


def macro_f1_union(spark, d):
    """Macro F1 over the labels that occur, in place of a fixed list; truth without one method, predictions whole."""
    pairs = routing._labels(spark, d).where(F.col("truth") != "lightrag")
    return K.macro_f1_seen(pairs)


def metric_deltas(spark, d):
    """Policy averages of the late half of the questions less those of the early half."""
    facts = outcomes(spark, d)
    one = lambda df: O.policy_summary(df, O.fixed_choices(df))
    return G.metric_deltas(one(facts.where(F.col("question_id") % 2 == 0)), one(facts.where(F.col("question_id") % 2 == 1)), "policy", ["answer_correctness", "evidence_recall"])


def corpus_hashes(spark, d):
    """Corpora and how many hashes of their whole text stand for one name."""
    docs = table(spark, d, "corpus_documents").where(F.col("context").isNotNull())
    return docs.groupBy("corpus_name").agg(F.count_distinct(F.sha2("context", 256)).alias("hashes"), F.count("*").alias("rows"))


_GRID = [(f, u, p, t) for f in ("logistic_utility_labels", "ridge_utilities") for u in ("harmonic", "minimum") for p in (0.1, 1.0) for t in (0.0, 0.02)]


def _candidates(spark, d):
    """A candidate per family, utility, parameter and tolerance with scores of a policy: mean outcomes over a share of the questions."""
    facts = outcomes(spark, d)
    means = facts.groupBy(F.col("method")).agg(F.round(F.avg("answer_correctness"), 3).alias("ac"), F.round(F.avg("evidence_recall"), 3).alias("er"))
    grid = spark.createDataFrame([(*g, METHODS[i % 3]) for i, g in enumerate(_GRID)], "family string, utility string, parameter double, tolerance double, method string")
    joint = F.when(F.col("ac") + F.col("er") > 0, 2 * F.col("ac") * F.col("er") / (F.col("ac") + F.col("er"))).otherwise(0.0)
    return grid.join(F.broadcast(means), "method").withColumn("joint", F.round(joint, 6))  # three rows


def candidate_selection_7key(spark, d):
    """The candidate of greatest joint mean; ties by correctness, recall, family, least parameter and tolerance, utility name."""
    keys = [F.desc("joint"), F.desc("ac"), F.desc("er"), F.desc(F.col("family") == "logistic_utility_labels"), F.asc("parameter"), F.asc("tolerance"), F.desc("utility")]
    return G.best_candidate(_candidates(spark, d), keys).select("family", "utility", "parameter", "tolerance", "joint")


def best_lexicographic(spark, d):
    """The first candidate of greatest macro F1, then accuracy, over the constant routers of each method."""
    labels = routing._labels(spark, d)
    rows = None
    for i, m in enumerate(METHODS):
        fixed = labels.withColumn("prediction", F.lit(m))
        one = K.macro_f1(fixed, METHODS).join(F.broadcast(K.accuracy(fixed))).select(F.lit(i).alias("candidate"), "macro_f1", "accuracy")  # single rows
        rows = one if rows is None else rows.unionByName(one)
    return G.best_candidate(rows, [F.desc("macro_f1"), F.desc("accuracy"), F.asc("candidate")])


def proxy_metric_block(spark, d):
    """Per method: evidence coverage, hit rate, words of context and latency."""
    from .text import _asked

    r = table(spark, d, "backend_results").where(F.col("contexts").isNotNull())
    r = r.select("result_id", "question_id", "method", "total_time_ms", F.array_join("contexts", " ").alias("t"))
    e = _asked(spark, d).where(F.col("evidence").isNotNull()).select("question_id", X.split_evidence(F.col("evidence")).alias("statements"))
    rows = r.join(e, "question_id").withColumn("have", X.content_terms(F.col("t")))
    recalls = F.transform("statements", lambda s: F.round(F.size(F.array_intersect(X.content_terms(s), F.col("have"))) / F.greatest(F.size(X.content_terms(s)), F.lit(1)), 6))
    per = rows.select("method", "total_time_ms", X.whitespace_word_count(F.col("t")).alias("words"), recalls.alias("r"))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    scored = per.where(F.size("r") > 0).select("method", "total_time_ms", "words", mean(F.col("r")).alias("coverage"), mean(F.transform("r", lambda x: (x >= 0.75).cast("double"))).alias("hits"))
    return scored.groupBy("method").agg(
        F.count("*").alias("n"), F.round(F.avg("coverage"), 6).alias("coverage"), F.round(F.avg("hits"), 6).alias("hit_rate"), F.round(F.avg("words"), 4).alias("context_words"), F.round(F.avg("total_time_ms"), 4).alias("latency_ms")
    )


def index_states(spark, d):
    """State of an index per source from its log: here the results of each method as log rows."""
    r = table(spark, d, "backend_results").where(F.col("question_id").isNotNull())
    status = F.element_at(F.array(*[F.lit(x) for x in ("building", "ready", "failed", "odd")]), (F.pmod("result_id", F.lit(4)) + 1).cast("int"))
    rows = r.select("question_id", F.col("result_id").alias("id"), status.alias("status"), F.col("method").alias("corpus"), F.lit("s1").alias("runtime"))
    corpus = table(spark, d, "p0_questions").where(F.col("id").isNotNull()).select(F.col("id").alias("question_id")).distinct().select("question_id", F.lit("vector").alias("corpus"), F.lit("s1").alias("runtime"))
    return L.index_states(rows, "question_id", corpus)


def graph_stats(spark, d):
    return L.graph_stats(graph._entities(spark, d).select("node").distinct(), graph._edges(spark, d))


def rebuilt_entities(spark, d):
    """Entity rows of a store rebuilt from the graph: md5 ids over bare names, split sources."""
    e = table(spark, d, "backend_results").select("result_id", F.explode("entities").alias("e")).where(F.col("e")["entity_name"].isNotNull())
    nodes = e.groupBy(F.concat(F.lit('"'), F.col("e")["entity_name"], F.lit('"')).alias("node")).agg(F.min(F.col("e")["entity_type"]).alias("description"), F.array_join(F.array_sort(F.collect_set(F.col("result_id").cast("string"))), "<SEP>").alias("source_id"))
    edges = graph._edges(spark, d).select("src", "dst", F.lit("k").alias("keywords"), F.lit("d").alias("description"), F.lit("a<SEP>b").alias("source_id"))
    _, entities, _ = L.rebuilt_stores(nodes, edges, nodes.select(F.col("description").alias("content")))
    return entities.select("id", "name", F.size("sources").alias("sources"))


QUERIES = {
    f.__name__: f
    for f in (
        valid_evaluations, sanitised_scores, alignment_rules, merge_rules, stale_evaluations, reusable_evaluations, order_differences, merged_maps, route_decisions, type_split_counts,
        evidence_multiset, development_ids, replicated_rows, warning_union, questions_by_type, low_signal, labels_kept, vector_index_rules, persisted_status, two_stage_split,
        representative_cases, macro_f1_union, metric_deltas, corpus_hashes, candidate_selection_7key, best_lexicographic, proxy_metric_block, index_states, graph_stats, rebuilt_entities,
    )
}

_E = """e AS (SELECT result_id, question_id, method, answer, CASE WHEN result_id % 13 = 0 THEN NULL WHEN result_id % 37 = 0 THEN 1.5::DOUBLE ELSE round((result_id % 101) / 100.0::DOUBLE, 6) END AS ac,
  round(((result_id * 7) % 101) / 100.0::DOUBLE, 6) AS er, CASE WHEN result_id % 11 = 0 THEN 1 ELSE 2 END AS version, CASE WHEN result_id % 19 = 0 THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN result_id % 5 = 0 THEN 'p0' ELSE 'p1' END AS protocol FROM backend_results)"""
_OK = "version = 2 AND status = 'ok' AND ac IS NOT NULL AND ac BETWEEN 0 AND 1 AND er BETWEEN 0 AND 1"
_RULES = "SELECT rule, count(k) AS violations FROM (SELECT unnest([{names}]) AS rule) LEFT JOIN bad USING (rule) GROUP BY rule"
_SPLIT = "lower(trim(split))"
_L = routing._LABELS
_PLACE = "row_number() OVER (PARTITION BY {s} ORDER BY md5('{seed}:' || id), id) AS position, count(*) OVER (PARTITION BY {s}) AS n"


def _rules(bad: str, names: list[str]) -> str:
    return bad + " " + _RULES.format(names=", ".join(f"'{n}'" for n in names))


ORACLE_SQL = {
    "valid_evaluations": f"WITH {_E} SELECT method, count(*) AS rows, count(*) FILTER ({_OK}) AS valid FROM e GROUP BY method",
    "sanitised_scores": f"WITH {_E}, s AS (SELECT (result_id % 17 = 0 OR ac IS NULL OR ac > 1) AS bad FROM e) SELECT CASE WHEN bad THEN 'failed' ELSE 'ok' END AS status, count(*) AS rows, count(*) FILTER (NOT bad) AS ac, count(*) FILTER (NOT bad) AS er FROM s GROUP BY bad",
    "alignment_rules": _rules(
        f"""WITH {_E}, per AS (SELECT question_id, count(*) AS r, count(DISTINCT method) AS m, count(DISTINCT concat(status, version)) AS refs FROM e WHERE question_id IS NOT NULL GROUP BY 1),
bad AS (SELECT 'each method once' AS rule, question_id AS k FROM per WHERE r > m UNION ALL SELECT 'all methods present', question_id FROM per WHERE m < 3 UNION ALL SELECT 'equal references', question_id FROM per WHERE refs > 1
 UNION ALL SELECT 'one protocol', 'x' FROM e WHERE question_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT protocol) > 1)""",
        ["each method once", "all methods present", "equal references", "protocol named", "one protocol"],
    ),
    "merge_rules": _rules(
        f"""WITH q AS (SELECT id, {_SPLIT} AS split, selection_source IS NULL AS base FROM p0_questions), frozen AS (SELECT DISTINCT id FROM (SELECT unnest(baseline.test_ids) AS id FROM expansion_manifest WHERE round = 1) WHERE id IS NOT NULL),
held AS (SELECT DISTINCT id FROM q WHERE base AND split = 'test' AND id IS NOT NULL),
bad AS (SELECT 'disjoint ids' AS rule, id AS k FROM (SELECT id FROM q WHERE base AND id IS NOT NULL INTERSECT SELECT id FROM q WHERE NOT base) UNION ALL SELECT 'no test rows added', coalesce(id, '') FROM q WHERE NOT base AND split = 'test'
 UNION ALL SELECT 'no frozen id missing', id FROM (SELECT id FROM frozen EXCEPT SELECT id FROM held) UNION ALL SELECT 'no new test id', id FROM (SELECT id FROM held EXCEPT SELECT id FROM frozen))""",
        ["disjoint ids", "no test rows added", "no frozen id missing", "no new test id"],
    ),
    "stale_evaluations": """SELECT result_id, CASE WHEN result_id % 9 = 0 THEN 'source gone' WHEN result_id % 7 = 0 THEN 'not evaluated' ELSE 'changed' END AS problem FROM backend_results
WHERE (result_id % 9 = 0 AND result_id % 7 <> 0) OR (result_id % 9 <> 0 AND (result_id % 7 = 0 OR result_id % 10 = 0))""",
    "reusable_evaluations": f"WITH {_E} SELECT question_id, max(result_id) AS result_id FROM e WHERE {_OK} AND protocol = 'p1' AND result_id % 10 <> 0 AND question_id IN (SELECT id FROM p0_questions WHERE id IS NOT NULL) GROUP BY 1",
    "order_differences": "WITH p AS (SELECT method, question_id, row_number() OVER (PARTITION BY method ORDER BY result_id) AS place FROM backend_results WHERE question_id IS NOT NULL) SELECT o.method, count(*) AS places FROM p o LEFT JOIN p v ON v.place = o.place AND v.method = 'vector' WHERE o.method <> 'vector' AND v.question_id IS DISTINCT FROM o.question_id GROUP BY 1",
    "merged_maps": "SELECT result_id, method AS route, 'manual' AS origin, 2 AS keys FROM backend_results",
    "route_decisions": f"WITH {_E} SELECT result_id, CASE WHEN result_id % 6 <> 0 AND method IN ('vector', 'lightrag', 'pathrag') THEN method END AS method, CASE WHEN result_id % 6 <> 0 AND ac BETWEEN 0 AND 1 THEN ac END AS probability FROM e",
    "type_split_counts": f"""WITH c AS (SELECT lower(trim(question_type)) AS kind, {_SPLIT} AS split, count(*) AS n FROM p0_questions WHERE question_type IS NOT NULL AND p0_questions.split IS NOT NULL GROUP BY 1, 2)
SELECT side, count(*) AS cells, sum(n) AS n FROM (SELECT 'found' AS side, n FROM c WHERE n <> 10 UNION ALL SELECT 'expected', 10 FROM c WHERE n <> 10) GROUP BY side""",
    "evidence_multiset": rf"""WITH q AS (SELECT {_SPLIT} AS split, lower(replace(regexp_replace(evidence, '\s+', '', 'g'), ';', ',')) AS e FROM p0_questions WHERE evidence IS NOT NULL),
c AS (SELECT e, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b FROM q GROUP BY e)
SELECT 'left' AS side, sum(a - b) AS surplus FROM c WHERE a > b HAVING count(*) > 0 UNION ALL SELECT 'right', sum(b - a) FROM c WHERE b > a HAVING count(*) > 0""",
    "development_ids": f"SELECT id FROM (SELECT id FROM p0_questions WHERE id IS NOT NULL EXCEPT SELECT id FROM p0_questions WHERE {_SPLIT} = 'test') UNION SELECT id FROM (SELECT unnest(expansion.question_ids) AS id FROM expansion_manifest) WHERE id IS NOT NULL",
    "replicated_rows": f"SELECT s AS split, CASE WHEN s = 'train' THEN count(*) ELSE 2 * count(*) END AS rows FROM (SELECT {_SPLIT} AS s FROM p0_questions) WHERE s IS NOT NULL GROUP BY s",
    "warning_union": "SELECT result_id, CASE WHEN coalesce(len(contexts), 0) < 1 THEN 1 ELSE 0 END + CASE WHEN answer IS NULL OR entities IS NULL THEN 1 ELSE 0 END AS warnings FROM backend_results",
    "questions_by_type": f"WITH {_Q} SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY id) AS position FROM q WHERE kind IN ('fact retrieval', 'complex reasoning') QUALIFY position <= 60",
    "low_signal": f"WITH {OUTCOMES_SQL} SELECT question_id, max(answer_correctness) AS best, max(answer_correctness) < 0.25 AS low_signal FROM outcomes GROUP BY 1",
    "labels_kept": f"{routing._ALL} SELECT silver_label, count(*) AS n FROM silver WHERE NOT all_failed GROUP BY 1",
    "vector_index_rules": _rules(
        """WITH v AS (SELECT * FROM question_embeddings), ids AS (SELECT DISTINCT id FROM p0_questions WHERE id IS NOT NULL),
bad AS (SELECT 'vector for every chunk' AS rule, id AS k FROM (SELECT id FROM ids EXCEPT SELECT question_id FROM v) UNION ALL SELECT 'chunk for every vector', question_id FROM (SELECT question_id FROM v WHERE question_id IS NOT NULL EXCEPT SELECT id FROM ids)
 UNION ALL SELECT 'no null vector', 'x' FROM v WHERE embedding IS NULL UNION ALL SELECT 'dimension', 'x' FROM v WHERE embedding IS NOT NULL AND len(embedding) <> 64
 UNION ALL SELECT 'finite', 'x' FROM v WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0)""",
        ["not empty", "vector for every chunk", "chunk for every vector", "no null vector", "dimension", "finite"],
    ),
    "persisted_status": "SELECT source, bool_and(n_chars >= 20) AS processed, bool_and(length(trim(text)) > 0) AS filled, count(*) AS documents FROM documents GROUP BY source",
    "two_stage_split": f"""WITH {_Q}, s AS (SELECT id, kind || '::' || substr(md5(id), 1, 1) AS s FROM q), s1 AS (SELECT id, s, CASE WHEN (SELECT min(n) FROM (SELECT count(*) AS n FROM s GROUP BY s)) >= 2 THEN s ELSE 'all' END AS k FROM s),
p1 AS (SELECT *, {_PLACE.format(s='k', seed=42)} FROM s1), rest AS (SELECT id, s FROM p1 WHERE position > ceil(round(n * 0.2::DOUBLE, 6))),
s2 AS (SELECT id, CASE WHEN (SELECT min(n) FROM (SELECT count(*) AS n FROM rest GROUP BY s)) >= 2 THEN s ELSE 'all' END AS k FROM rest), p2 AS (SELECT *, {_PLACE.format(s='k', seed=43)} FROM s2),
r AS (SELECT id, 'test' AS split FROM p1 WHERE position <= ceil(round(n * 0.2::DOUBLE, 6)) UNION ALL SELECT id, CASE WHEN position <= ceil(round(n * 0.25::DOUBLE, 6)) THEN 'dev' ELSE 'train' END FROM p2)
SELECT split, count(*) AS n, md5(string_agg(id, ',' ORDER BY id)) AS ids_md5 FROM r GROUP BY split""",
    "representative_cases": f"""{_L}, c AS (SELECT l.*, o_orderpriority AS kind FROM labels l JOIN orders ON o_orderkey = question_id),
x AS (SELECT list_position(['vector', 'lightrag', 'pathrag'], truth) AS o, question_id, truth, prediction FROM c WHERE truth = prediction QUALIFY row_number() OVER (PARTITION BY truth ORDER BY question_id) = 1
 UNION ALL (SELECT list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], kind) + 3, question_id, truth, prediction FROM c WHERE truth <> prediction AND kind IN ('1-URGENT', '2-HIGH', '3-MEDIUM') QUALIFY row_number() OVER (PARTITION BY kind ORDER BY question_id) = 1))
SELECT row_number() OVER (ORDER BY o) AS place, question_id, truth, prediction FROM x QUALIFY place <= 5""",
    "macro_f1_union": f"""{_L}, p AS (SELECT truth, prediction FROM labels WHERE truth <> 'lightrag'), n AS (SELECT DISTINCT x FROM (SELECT truth AS x FROM p UNION SELECT prediction FROM p)),
f AS (SELECT x, count(*) FILTER (truth = x AND prediction = x) AS tp, count(*) FILTER (truth = x) AS t, count(*) FILTER (prediction = x) AS q FROM n, p GROUP BY x)
SELECT round(avg(coalesce(2.0 * tp / nullif(t + q, 0), 0.0)), 6) AS macro_f1, count(*) AS labels FROM f""",
    "metric_deltas": f"""WITH {OUTCOMES_SQL}, m AS (SELECT method, question_id % 2 AS h, round(avg(answer_correctness), 6) AS a, round(avg(evidence_recall), 6) AS e FROM outcomes GROUP BY 1, 2)
SELECT x.method AS policy, round(y.a - x.a, 6) AS answer_correctness, round(y.e - x.e, 6) AS evidence_recall FROM m x JOIN m y ON x.method = y.method AND x.h = 0 AND y.h = 1""",
    "corpus_hashes": "SELECT corpus_name, count(DISTINCT sha256(context)) AS hashes, count(*) AS rows FROM corpus_documents WHERE context IS NOT NULL GROUP BY 1",
    "candidate_selection_7key": f"""WITH {OUTCOMES_SQL}, m AS (SELECT method, round(avg(answer_correctness), 3) AS ac, round(avg(evidence_recall), 3) AS er FROM outcomes GROUP BY 1),
g AS (SELECT * FROM (VALUES {", ".join(f"('{f}', '{u}', {p!r}::DOUBLE, {t!r}::DOUBLE, '{METHODS[i % 3]}')" for i, (f, u, p, t) in enumerate(_GRID))}) v(family, utility, parameter, tolerance, method)),
c AS (SELECT *, round(CASE WHEN ac + er > 0 THEN 2 * ac * er / (ac + er) ELSE 0 END, 6) AS joint FROM g JOIN m USING (method))
SELECT family, utility, parameter, tolerance, joint FROM c ORDER BY joint DESC, ac DESC, er DESC, (family = 'logistic_utility_labels') DESC, parameter, tolerance, utility DESC LIMIT 1""",
    "best_lexicographic": f"""{_L}, t AS (SELECT list_position(['vector', 'lightrag', 'pathrag'], truth) - 1 AS candidate, count(*) AS n FROM labels GROUP BY 1), a AS (SELECT count(*) AS n FROM labels)
SELECT candidate, round(2.0 * t.n / (t.n + a.n) / 3, 6) AS macro_f1, round(t.n / a.n::DOUBLE, 6) AS accuracy FROM t, a ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1""",
    "proxy_metric_block": f"""
WITH e AS (SELECT id AS question_id, max(evidence) AS evidence FROM p0_questions WHERE evidence IS NOT NULL GROUP BY id),
r AS (SELECT result_id, question_id, method, total_time_ms, coalesce(array_to_string(contexts, ' '), '') AS t FROM backend_results WHERE contexts IS NOT NULL),
p AS (SELECT result_id, method, total_time_ms, t, {_terms_sql('t')} AS have, unnest({_parts('evidence')}) AS s FROM r JOIN e USING (question_id)),
x AS (SELECT result_id, method, total_time_ms, t, have, {_terms_sql('s')} AS want FROM p),
y AS (SELECT result_id, method, any_value(total_time_ms) AS ms, any_value(len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> ''))) AS words,
  avg(round(len(list_intersect(want, have)) / greatest(len(want), 1), 6)) AS c, avg(CASE WHEN round(len(list_intersect(want, have)) / greatest(len(want), 1), 6) >= 0.75 THEN 1.0 ELSE 0.0 END) AS h FROM x GROUP BY result_id, method)
SELECT method, count(*) AS n, round(avg(c), 6) AS coverage, round(avg(h), 6) AS hit_rate, round(avg(words), 4) AS context_words, round(avg(ms), 4) AS latency_ms FROM y GROUP BY method""",
    "index_states": """WITH l AS (SELECT question_id, max(result_id) AS id FROM backend_results WHERE question_id IS NOT NULL GROUP BY 1), m AS (SELECT b.question_id, ['building', 'ready', 'failed', 'odd'][b.result_id % 4 + 1] AS status, method FROM backend_results b JOIN l ON l.id = b.result_id),
q AS (SELECT DISTINCT id AS question_id FROM p0_questions WHERE id IS NOT NULL)
SELECT question_id, CASE WHEN status IS NULL THEN 'not_built' WHEN status = 'odd' THEN 'failed' ELSE status END AS status, coalesce(status = 'ready' AND method = 'vector', FALSE) AS reusable FROM q LEFT JOIN m USING (question_id)""",
    "graph_stats": f"WITH {graph._KG} SELECT (SELECT count(DISTINCT node) FROM ents) AS nodes, (SELECT count(*) FROM merged) AS edges, (SELECT count(*) FROM ents) = 0 OR (SELECT count(*) FROM merged) = 0 AS empty",
    "rebuilt_entities": "SELECT concat('ent-', md5(trim(n, '\"'))) AS id, trim(n, '\"') AS name, count(DISTINCT result_id) AS sources FROM (SELECT result_id, e['entity_name'] AS n FROM (SELECT result_id, unnest(entities) AS e FROM backend_results)) WHERE n IS NOT NULL GROUP BY n",
}
