"""The pN_ queries: each operator over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boundaries, cutoff, defects, language, leakage, neighbours, overlap, packing, quota, steady


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _limit(spark: SparkSession, sf_dir: str, kind: str) -> tuple[int, int]:
    row = _table(spark, sf_dir, "size_limits").where(F.col("item_kind") == kind).select("max_size", "overlap_size").first()
    return int(row["max_size"]), int(row["overlap_size"] or 0)


def p1_found(spark, d):
    return quota.unfilled_cells(_table(spark, d, "p0_questions"), _table(spark, d, "sampling_targets")).select("question_type", "split")


def p1_report(spark, d):
    return quota.allocation_report(_table(spark, d, "p0_questions"), _table(spark, d, "sampling_targets"))


def p1_allocation(spark, d):
    """The tree's allocation: what each cell gives of its own, takes from siblings and cousins, and lacks."""
    return quota.allocation_table(_table(spark, d, "p0_questions"), _table(spark, d, "sampling_targets"))


def p1_sample(spark, d):
    return quota.quota_sample(_table(spark, d, "p0_questions"), _table(spark, d, "sampling_targets"))


def p1_checks(spark, d):
    """One row: drawn rows, their distinct ids, and rows whose id has no row in its cell."""
    questions, targets = _table(spark, d, "p0_questions"), _table(spark, d, "sampling_targets")
    drawn = quota.quota_sample(questions, targets)
    members = quota.category_members(questions, targets).withColumn("member", F.lit(1))
    return drawn.join(members, ["id", "question_type", "split"], "left").agg(
        F.count("*").alias("drawn"), F.count_distinct("id").alias("ids"), F.count_if(F.col("member").isNull()).alias("outside")
    )


def p2_found(spark, d):
    pairs = overlap.split_overlaps(_table(spark, d, "p0_questions"))
    return pairs.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def p2_counts(spark, d):
    return overlap.overlap_counts(overlap.split_overlaps(_table(spark, d, "p0_questions")))


def p3_found(spark, d):
    size, shared = _limit(spark, d, "corpus_context")
    pieces = boundaries.split_oversized(_table(spark, d, "corpus_documents"), size, shared)
    return pieces.where((F.col("pieces") > 1) & (F.col("piece") == 0)).select("corpus_doc_id")


def p3_pieces(spark, d):
    size, shared = _limit(spark, d, "corpus_context")
    return boundaries.split_oversized(_table(spark, d, "corpus_documents"), size, shared)


def p3_checks(spark, d):
    """Per document: its words, whether the pieces cover them in order with the stated overlap, and the largest piece within the limit."""
    size, shared = _limit(spark, d, "corpus_context")
    pieces = p3_pieces(spark, d).withColumn("stop", F.col("first_word") + F.col("words"))
    per = pieces.groupBy("corpus_doc_id").agg(F.max("words").alias("longest"), F.array_sort(F.collect_list(F.struct("piece", "first_word", "stop"))).alias("ps"))
    follows = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("ps") - 1, F.lit(1))),
        lambda k: (F.size("ps") == 1) | (F.element_at("ps", k)["stop"] - F.try_element_at("ps", k + 1)["first_word"] == F.least(F.lit(shared), F.element_at("ps", k)["stop"])),
    )
    return per.select(
        "corpus_doc_id", F.element_at("ps", -1)["stop"].cast("long").alias("words"),
        (F.forall(follows, lambda x: x) & (F.element_at("ps", 1)["first_word"] == 0)).alias("overlaps"), (F.col("longest") <= size).alias("fits"),
    )


def p4_found(spark, d):
    judged = defects.answer_defects(_table(spark, d, "backend_results"), _table(spark, d, "p0_questions"))
    return judged.where(F.col("defect").isNotNull()).select("result_id", "defect")


def p4_rates(spark, d):
    return defects.defect_rates(defects.answer_defects(_table(spark, d, "backend_results"), _table(spark, d, "p0_questions")))


def p5_found(spark, d):
    return steady.lost_ids(_table(spark, d, "p0_questions"), _table(spark, d, "expansion_manifest")).select(F.col("id").alias("question_id"))


def p5_sample(spark, d):
    return steady.steady_sample(_table(spark, d, "p0_questions"), _table(spark, d, "expansion_manifest"))


def p6_found(spark, d):
    return cutoff.truncated_texts(_table(spark, d, "generations")).where("truncated").select("generation_id")


def p6_rates(spark, d):
    return cutoff.truncation_rates(cutoff.truncated_texts(_table(spark, d, "generations")))


def p7_found(spark, d):
    near = neighbours.nearest_neighbours(_table(spark, d, "question_embeddings"), k=5)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p8_containers(spark, d):
    capacity, _ = _limit(spark, d, "document_container")
    return packing.fill_containers(_table(spark, d, "documents"), capacity)


def p8_fill(spark, d):
    capacity, _ = _limit(spark, d, "document_container")
    return packing.container_fill(packing.fill_containers(_table(spark, d, "documents"), capacity), capacity)


def p8_checks(spark, d):
    """One row: documents placed, documents whose pieces are not all there, and containers over the capacity."""
    capacity, _ = _limit(spark, d, "document_container")
    placed = packing.fill_containers(_table(spark, d, "documents"), capacity)
    ids = placed.groupBy("doc_id").agg(F.count_distinct("piece").alias("pieces"), F.max("piece").alias("last"), F.sum((F.col("piece") > 0).cast("int")).alias("cut"))
    full = placed.groupBy("container").agg(F.sum("tokens").alias("used"))
    over = full.agg(F.count_if(F.col("used") > capacity).alias("over"))
    return ids.agg(F.count("*").alias("documents"), F.count_if(F.col("pieces") != F.col("last") + 1).alias("broken")).join(F.broadcast(over))  # one row each


def p9_found(spark, d):
    return leakage.leaked_passages(_table(spark, d, "documents"), _table(spark, d, "heldout_items")).select("doc_id", "item_id").distinct()


def p9_items(spark, d):
    return leakage.leak_report(leakage.leaked_passages(_table(spark, d, "documents"), _table(spark, d, "heldout_items")))


def p10_found(spark, d):
    return language.label_problems(language.identify_languages(_table(spark, d, "documents"), with_segments=False)).select("doc_id", "lang")


def p10_languages(spark, d):
    found = language.identify_languages(_table(spark, d, "documents"))
    return found.select("doc_id", "declared", "lang", F.round("confidence", 6).alias("confidence"), F.size("languages").alias("held"), F.size("segments").alias("segments"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_report, p1_allocation, p1_sample, p1_checks, p2_found, p2_counts, p3_found, p3_pieces, p3_checks, p4_found, p4_rates, p5_found, p5_sample,
        p6_found, p6_rates, p7_found, p8_containers, p8_fill, p8_checks, p9_found, p9_items, p10_found, p10_languages,
    )
}

_PLAIN = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"
_SPLIT = (
    "CASE WHEN {0} IN ('train','training','trainset','tr') THEN 'train' "
    "WHEN {0} IN ('validation','valid','val','dev','development','validate') THEN 'validation' "
    "WHEN {0} IN ('test','testing','tst','testset') THEN 'test' ELSE {0} END"
).format(_PLAIN.format("split"))

_REPORT = f"""
WITH members AS (
  SELECT DISTINCT t.question_type, t.split, q.id
  FROM (SELECT id, {_PLAIN.format('question_type')} AS kind, {_SPLIT} AS side FROM p0_questions WHERE id IS NOT NULL) q
  JOIN sampling_targets t ON {_PLAIN.format('t.question_type')} = q.kind AND t.split = q.side
), total AS (SELECT count(DISTINCT id) AS ids FROM p0_questions)
SELECT t.question_type, t.split, t.target_share, t.min_rows,
       CAST(floor(round(t.sample_fraction * total.ids, 6)) AS BIGINT) AS sample_size,
       count(m.id) AS available,
       greatest(CAST(t.min_rows AS BIGINT), CAST(ceil(round(t.target_share * floor(round(t.sample_fraction * total.ids, 6)), 6)) AS BIGINT)) AS needed,
       greatest(greatest(CAST(t.min_rows AS BIGINT), CAST(ceil(round(t.target_share * floor(round(t.sample_fraction * total.ids, 6)), 6)) AS BIGINT)) - count(m.id), 0) AS shortfall
FROM sampling_targets t CROSS JOIN total
LEFT JOIN members m ON m.question_type = t.question_type AND m.split = t.split
GROUP BY t.question_type, t.split, t.target_share, t.min_rows, t.sample_fraction, total.ids
"""

_KIND, _SOURCE = (f"coalesce({_PLAIN.format(c)}, '')" for c in ("question_type", "source"))

_SAMPLE = f"""
WITH listed AS (
  SELECT unnest(baseline.test_ids) AS id, 5.0::DOUBLE AS weight FROM expansion_manifest WHERE round IS NOT NULL
  UNION ALL SELECT unnest(expansion.question_ids), 1.0::DOUBLE FROM expansion_manifest WHERE round IS NOT NULL
), held AS (
  SELECT id, 0.5::DOUBLE + 0.5::DOUBLE * count(DISTINCT concat({_KIND}, chr(31), {_SOURCE})) AS weight FROM p0_questions WHERE id IS NOT NULL AND {_SPLIT} = 'test' GROUP BY id
), state AS (SELECT id, max(weight) AS weight FROM (SELECT * FROM listed UNION ALL SELECT * FROM held) WHERE id IS NOT NULL GROUP BY id),
units AS (SELECT id, weight, CAST(('0x' || substr(md5('42:' || id), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS unit FROM state WHERE id IN (SELECT id FROM held))
SELECT id, weight * 0.2::DOUBLE >= 1.0 AS kept, round(weight, 6) AS weight, round(unit, 9) AS unit FROM units WHERE unit < weight * 0.2::DOUBLE
"""

_NEAREST = """
WITH vectors AS (
  SELECT question_id AS id, arg_max(embedding, cached_at) AS e FROM question_embeddings
  WHERE question_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY question_id
), units AS (SELECT id, list_transform(e, lambda x: CAST(x AS DOUBLE) / sqrt(list_inner_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[])))) AS u FROM vectors),
near AS (
  SELECT a.id, b.id AS neighbour FROM units a JOIN units b ON a.id <> b.id
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_inner_product(a.u, b.u), 9) DESC, b.id) <= 5
)
SELECT DISTINCT least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM near
"""

ORACLE_SQL: dict[str, str] = {
    "p1_report": _REPORT,
    "p1_found": f"SELECT question_type, split FROM ({_REPORT}) WHERE shortfall > 0",
    "p1_checks": "SELECT n AS drawn, n AS ids, 0 AS outside FROM (SELECT CAST(floor(round(max(t.sample_fraction) * (SELECT count(DISTINCT id) FROM p0_questions), 6)) AS BIGINT) AS n FROM sampling_targets t)",
    "p3_checks": "SELECT corpus_doc_id, len(regexp_extract_all(context, '[^ \\t\\r\\n]+')) AS words, TRUE AS overlaps, TRUE AS fits FROM corpus_documents WHERE len(regexp_extract_all(context, '[^ \\t\\r\\n]+')) > 0",
    "p5_sample": _SAMPLE,
    "p7_found": _NEAREST,
    "p8_checks": "SELECT count(DISTINCT doc_id) AS documents, 0 AS broken, 0 AS over FROM documents",
    "p3_found": "SELECT corpus_doc_id FROM corpus_documents WHERE len(regexp_extract_all(context, '[^ \\t\\r\\n]+')) > 400",
    "p5_found": f"""
WITH listed AS (
  SELECT round, unnest(baseline.test_ids) AS id, TRUE AS selected FROM expansion_manifest
  UNION ALL SELECT round, unnest(expansion.question_ids), FALSE FROM expansion_manifest
), rounds AS (SELECT DISTINCT round, id FROM listed WHERE id IS NOT NULL AND round <= 4),
firsts AS (SELECT id, min(round) AS first FROM listed WHERE selected AND id IS NOT NULL AND round <= 4 GROUP BY id),
held AS (SELECT DISTINCT id FROM p0_questions WHERE {_SPLIT} = 'test'),
gone AS (
  SELECT f.id FROM firsts f JOIN (SELECT DISTINCT round FROM rounds) r ON r.round > f.first
  LEFT JOIN rounds s ON s.id = f.id AND s.round = r.round WHERE s.id IS NULL
)
SELECT id AS question_id FROM firsts WHERE id IN (SELECT id FROM gone) OR id NOT IN (SELECT id FROM held WHERE id IS NOT NULL)
""",
}
