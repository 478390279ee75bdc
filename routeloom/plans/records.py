"""Queries over records: splits, constraints, history, windows, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, models, splits
from ..sources import writers
from ..streaming import events as E
from .tables import table

_CLEAN = "lower(regexp_replace(trim({}), '[-_ ]+', ' ', 'g'))"


def _questions(spark, d):
    """(id, kind): each id once with the least spelling-normalised type."""
    q = table(spark, d, "p0_questions").where(F.col("id").isNotNull())
    kind = F.lower(F.regexp_replace(F.trim(F.col("question_type")), "[-_ ]+", " "))
    return q.groupBy("id").agg(F.coalesce(F.min(kind), F.lit("none")).alias("kind"))


def stratified_split(spark, d):
    return splits.stratified_split(_questions(spark, d), "kind", "id")


def stratified_folds(spark, d):
    return splits.stratified_folds(_questions(spark, d), "kind", "id")


def _used(spark, d):
    m = table(spark, d, "expansion_manifest")
    return m.select(F.explode("baseline.test_ids").alias("id")).where(F.col("id").isNotNull())


def expansion_sample(spark, d):
    return splits.expansion_sample(_questions(spark, d), _used(spark, d), "kind", "id")


def first_per_type(spark, d):
    return splits.first_per_group(_questions(spark, d), "kind", ["id"], 5).select("id", "kind", "position")


def manifest_summary(spark, d):
    """Ids per round and source with a hash of their sorted list."""
    m = table(spark, d, "expansion_manifest").select("round", "source", F.explode("baseline.test_ids").alias("id")).where(F.col("id").isNotNull())
    return m.groupBy("round", "source").agg(F.count_distinct("id").alias("ids"), F.sha2(F.array_join(F.array_sort(F.collect_set("id")), ","), 256).alias("sha256"))


def alignment_violations(spark, d):
    return checks.alignment_violations(table(spark, d, "backend_results").where(F.col("question_id").isNotNull()), "question_id", "method", ("vector", "lightrag", "pathrag"))


def reference_conflicts(spark, d):
    return checks.reference_conflicts(table(spark, d, "p0_questions").where(F.col("id").isNotNull()), "id", ["question", "answer"])


def invalid_times(spark, d):
    r = table(spark, d, "backend_results")
    bad = F.col("total_time_ms").isNull() | (F.col("total_time_ms") < 0) | (F.col("total_time_ms") + 1e-6 < F.col("retrieval_time_ms"))
    return r.where(bad).select("result_id")


def rejected_answers(spark, d):
    """Results a fail-fast runner would turn into error rows."""
    r = table(spark, d, "backend_results")
    code = F.when(F.trim(F.coalesce("answer", F.lit(""))) == "", "EMPTY_ANSWER").when(F.coalesce(F.size("contexts"), F.lit(0)) < 1, "NO_CONTEXT")
    return r.select("result_id", code.alias("error")).where(F.col("error").isNotNull())


def id_set_difference(spark, d):
    q = table(spark, d, "p0_questions").select(F.col("id").alias("question_id"))
    return checks.set_difference(q, table(spark, d, "question_embeddings"), "question_id").where(F.col("question_id").isNotNull())


def split_leaks(spark, d):
    """Ids that have rows in more than one split as spelled."""
    q = table(spark, d, "p0_questions").where(F.col("split").isNotNull()).select("id", F.lower(F.trim(F.col("split"))).alias("split")).distinct()
    a = q.where(F.col("split") == "train").select("id").intersect(q.where(F.col("split") == "test").select("id"))
    return a


def resume_pending(spark, d):
    written = table(spark, d, "backend_results").select("question_id", F.when(F.col("answer").isNull(), F.lit("failed")).alias("error"))
    pending, _ = checks.resume_plan(table(spark, d, "p0_questions").select(F.col("id").alias("question_id")).where(F.col("id").isNotNull()), written, "question_id", "error")
    return pending


def missing_embeddings(spark, d):
    ids = table(spark, d, "p0_questions").select(F.col("id").alias("question_id")).where(F.col("id").isNotNull())
    return writers.missing_embeddings(ids, table(spark, d, "question_embeddings").where(F.col("embedding").isNotNull()), "question_id")


def fingerprint_reuse(spark, d):
    """Results whose fingerprint another result of the question shares: the later ones can reuse the first."""
    r = table(spark, d, "backend_results").where(F.col("answer").isNotNull() & F.col("question_id").isNotNull())
    marked = r.select("result_id", checks.fingerprint(["question_id", "method", "answer"]).alias("fingerprint"))
    return marked.groupBy("fingerprint").agg(F.min("result_id").alias("first"), F.count("*").alias("results")).where(F.col("results") > 1)


def run_history_top100(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    return writers.newest(e, 100, "ts", "event_id").select("event_id", "user_id", "event_type")


def newest_per_user(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id")
    return writers.newest_per(e, "user_id", 20, "ts", "event_id").select("user_id", "event_id", "place")


def keyword_json(spark, d):
    """A number out of each event's JSON properties; broken ones count under null."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _epoch(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.unix_micros(c))
    return df


def events_hourly(spark, d):
    return _epoch(E.tumbling(_events(spark, d)), "start")


def events_sliding(spark, d):
    return _epoch(E.sliding(_events(spark, d)), "start")


def events_sessions(spark, d):
    return _epoch(E.sessions(_events(spark, d)), "start", "stop")


def router_ridge_oof(spark, d):
    """Out-of-fold ridge predictions of two targets from the vectors."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") / 10.0).alias("a"), (F.col("label") % 3).cast("double").alias("b"), (F.col("vec_id") % 5).cast("int").alias("fold"))
    return models.ridge_oof(v, "vec_id", "embedding", ["a", "b"], "fold", alpha=1.0)


def router_logreg(spark, d):
    """Accuracy per fold side of a balanced multinomial router on the vectors."""
    from pyspark.ml.functions import array_to_vector

    v = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("x"), F.col("label").cast("double").alias("label"))
    rows = models.balanced_weights(v, "label")
    model = models.train_router(rows.where(F.col("vec_id") % 5 != 0), "x", "label", "weight")
    return model.transform(rows).groupBy((F.col("vec_id") % 5 == 0).alias("held_out")).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 6).alias("accuracy")
    )


QUERIES = {
    f.__name__: f
    for f in (
        stratified_split, stratified_folds, expansion_sample, first_per_type, manifest_summary, alignment_violations, reference_conflicts, invalid_times, rejected_answers,
        id_set_difference, split_leaks, resume_pending, missing_embeddings, fingerprint_reuse, run_history_top100, newest_per_user, keyword_json, events_hourly, events_sliding,
        events_sessions, router_ridge_oof, router_logreg,
    )
}

_Q = f"q AS (SELECT id, coalesce(min({_CLEAN.format('question_type')}), 'none') AS kind FROM p0_questions WHERE id IS NOT NULL GROUP BY id)"
_PLACED = f"{_Q}, placed AS (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY md5('42:' || id), id) AS position, count(*) OVER (PARTITION BY kind) AS n FROM q)"

ORACLE_SQL = {
    "stratified_split": f"WITH {_PLACED} SELECT id, kind, CASE WHEN position <= floor(round(n * 0.6::DOUBLE, 6)) THEN 'train' WHEN position <= floor(round(n * 0.6::DOUBLE, 6)) + floor(round(n * 0.2::DOUBLE, 6)) THEN 'validation' ELSE 'test' END AS split FROM placed",
    "stratified_folds": f"WITH {_PLACED} SELECT id, kind, CAST((position - 1) % 5 AS INTEGER) AS fold FROM placed",
    "expansion_sample": f"""WITH {_Q}, used AS (SELECT unnest(baseline.test_ids) AS id FROM expansion_manifest),
placed AS (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY md5('42:' || id), id) AS position FROM q WHERE id NOT IN (SELECT id FROM used WHERE id IS NOT NULL))
SELECT id, kind, CASE WHEN position <= 72 THEN 'train' ELSE 'validation' END AS split FROM placed WHERE position <= 90""",
    "first_per_type": f"WITH {_Q} SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY id) AS position FROM q QUALIFY position <= 5",
    "manifest_summary": "SELECT round, source, count(DISTINCT id) AS ids, sha256(array_to_string(list_sort(list(DISTINCT id)), ',')) AS sha256 FROM (SELECT round, source, unnest(baseline.test_ids) AS id FROM expansion_manifest) WHERE id IS NOT NULL GROUP BY ALL",
    "alignment_violations": "SELECT question_id, count(DISTINCT method) AS methods, count(*) AS rows, CASE WHEN count(DISTINCT method) < 3 THEN 'missing' ELSE 'duplicate' END AS problem FROM backend_results WHERE question_id IS NOT NULL GROUP BY question_id HAVING count(DISTINCT method) < 3 OR count(*) > count(DISTINCT method)",
    "reference_conflicts": "SELECT id, count(DISTINCT concat(coalesce(question, ''), chr(31), coalesce(answer, ''))) AS variants FROM p0_questions WHERE id IS NOT NULL GROUP BY id HAVING variants > 1",
    "invalid_times": "SELECT result_id FROM backend_results WHERE total_time_ms IS NULL OR total_time_ms < 0 OR total_time_ms + 1e-6 < retrieval_time_ms",
    "rejected_answers": "SELECT result_id, CASE WHEN trim(coalesce(answer, '')) = '' THEN 'EMPTY_ANSWER' ELSE 'NO_CONTEXT' END AS error FROM backend_results WHERE trim(coalesce(answer, '')) = '' OR coalesce(len(contexts), 0) < 1",
    "id_set_difference": """SELECT id AS question_id, 'left' AS side FROM (SELECT DISTINCT id FROM p0_questions WHERE id IS NOT NULL EXCEPT SELECT question_id FROM question_embeddings)
UNION ALL SELECT question_id, 'right' FROM (SELECT DISTINCT question_id FROM question_embeddings WHERE question_id IS NOT NULL EXCEPT SELECT id FROM p0_questions)""",
    "split_leaks": "SELECT id FROM p0_questions WHERE lower(trim(split)) = 'train' INTERSECT SELECT id FROM p0_questions WHERE lower(trim(split)) = 'test'",
    "resume_pending": "SELECT DISTINCT id AS question_id FROM p0_questions WHERE id IS NOT NULL AND id NOT IN (SELECT question_id FROM backend_results WHERE answer IS NOT NULL AND question_id IS NOT NULL)",
    "missing_embeddings": "SELECT DISTINCT id AS question_id FROM p0_questions WHERE id IS NOT NULL AND id NOT IN (SELECT question_id FROM question_embeddings WHERE embedding IS NOT NULL AND question_id IS NOT NULL)",
    "fingerprint_reuse": "SELECT sha256(to_json({'answer': answer, 'method': method, 'question_id': question_id})) AS fingerprint, min(result_id) AS first, count(*) AS results FROM backend_results WHERE answer IS NOT NULL AND question_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "run_history_top100": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
    "newest_per_user": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 20",
    "keyword_json": "SELECT CAST(props->>'$.k' AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1",
    "router_ridge_oof": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(vec_id % 5 AS INTEGER) AS fold, CAST(embedding AS DOUBLE[]) AS x, [label / 10.0::DOUBLE, CAST(label % 3 AS DOUBLE)] AS y FROM embeddings),
dim AS (SELECT unnest(generate_series(1, 64)) AS i),
n AS (SELECT fold, count(*)::DOUBLE AS n FROM v GROUP BY fold), sx AS (SELECT fold, i, sum(x[i]) AS s FROM v, dim GROUP BY ALL), sy AS (SELECT fold, t, sum(y[t]) AS s FROM v, (SELECT unnest([1, 2]) AS t) GROUP BY ALL),
sxx AS (SELECT fold, a.i, b.i AS j, sum(x[a.i] * x[b.i]) AS s FROM v, dim a, dim b GROUP BY ALL), sxy AS (SELECT fold, i, t, sum(x[i] * y[t]) AS s FROM v, dim, (SELECT unnest([1, 2]) AS t) GROUP BY ALL),
on_ AS (SELECT f.fold, sum(n.n) AS n FROM n f JOIN n ON n.fold <> f.fold GROUP BY f.fold), ox AS (SELECT f.fold, i, sum(s) AS s FROM n f JOIN sx ON sx.fold <> f.fold GROUP BY ALL), oy AS (SELECT f.fold, t, sum(s) AS s FROM n f JOIN sy ON sy.fold <> f.fold GROUP BY ALL),
oxx AS (SELECT f.fold, i, j, sum(s) AS s FROM n f JOIN sxx ON sxx.fold <> f.fold GROUP BY ALL), oxy AS (SELECT f.fold, i, t, sum(s) AS s FROM n f JOIN sxy ON sxy.fold <> f.fold GROUP BY ALL),
a AS (SELECT fold, list(line ORDER BY i) AS a FROM (SELECT m.fold, m.i, list(m.s - p.s * q.s / o.n + CASE WHEN m.i = m.j THEN 1.0 ELSE 0.0 END ORDER BY m.j) AS line FROM oxx m JOIN on_ o USING (fold) JOIN ox p ON p.fold = m.fold AND p.i = m.i JOIN ox q ON q.fold = m.fold AND q.i = m.j GROUP BY ALL) GROUP BY fold),
b AS (SELECT m.fold, m.t, list(m.s - p.s * q.s / o.n ORDER BY m.i) AS b FROM oxy m JOIN on_ o USING (fold) JOIN ox p ON p.fold = m.fold AND p.i = m.i JOIN oy q ON q.fold = m.fold AND q.t = m.t GROUP BY ALL),
it(fold, t, k, w, r, p) AS (
  SELECT fold, t, 0, list_transform(b, lambda x: 0.0::DOUBLE), b, b FROM b
  UNION ALL
  SELECT fold, t, k + 1, list_transform(generate_series(1, 64), lambda i: w[i] + alpha * p[i]), r2, list_transform(generate_series(1, 64), lambda i: r2[i] + list_inner_product(r2, r2) / greatest(list_inner_product(r, r), 1e-300) * p[i])
  FROM (SELECT *, list_transform(generate_series(1, 64), lambda i: r[i] - alpha * ap[i]) AS r2 FROM (SELECT *, list_inner_product(r, r) / greatest(list_inner_product(p, ap), 1e-300) AS alpha FROM (
    SELECT it.*, list_transform(a, lambda line: list_inner_product(line, p)) AS ap FROM it JOIN a USING (fold) WHERE k < 60)))
), w AS (SELECT fold, t, w FROM it WHERE k = 60), mx AS (SELECT fold, list(s / n ORDER BY i) AS m FROM ox JOIN on_ USING (fold) GROUP BY fold),
h AS (SELECT v.vec_id, v.fold, w.t, s / n - list_inner_product(m, w.w) + list_inner_product(v.x, w.w) AS h FROM v JOIN w ON w.fold = v.fold JOIN mx ON mx.fold = v.fold JOIN on_ o ON o.fold = v.fold JOIN oy ON oy.fold = v.fold AND oy.t = w.t)
SELECT vec_id, fold, round(max(CASE WHEN t = 1 THEN h END), 6) AS pred_a, round(max(CASE WHEN t = 2 THEN h END), 6) AS pred_b FROM h GROUP BY vec_id, fold""",
    "events_hourly": "SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_sliding": "SELECT epoch_us(s) AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 minutes, ts), time_bucket(INTERVAL 30 minutes, ts) - INTERVAL 30 minutes]) AS s FROM events) GROUP BY ALL",
    "events_sessions": """
WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 minutes THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 30 minutes) AS stop, count(*) AS n FROM s GROUP BY user_id, k""",
}
