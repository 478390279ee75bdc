"""Views that several plans start from, in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import METHODS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """(question_id, method, scores, tokens, time): an order's first three lines as the three methods' outcomes."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"
    )
    ranked = lines.withColumn("rn", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey")))
    return ranked.where((F.col("n") >= 3) & (F.col("rn") <= 3)).select(
        F.col("l_orderkey").alias("question_id"),
        F.element_at(F.array(*[F.lit(m) for m in METHODS]), F.col("rn")).alias("method"),
        F.round(F.col("l_discount") * 10, 6).alias("answer_correctness"),
        F.round(F.col("l_tax") * 12.5, 6).alias("evidence_recall"),
        F.round((F.col("l_partkey") % 101) / F.lit(100.0), 6).alias("rouge_l"),
        F.col("l_extendedprice").alias("input_tokens"),
        F.col("l_quantity").alias("output_tokens"),
        F.col("l_partkey").alias("total_time_ms"),
    )


OUTCOMES_SQL = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn,
         count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem
), outcomes AS (
  SELECT l_orderkey AS question_id, CASE rn WHEN 1 THEN 'vector' WHEN 2 THEN 'lightrag' ELSE 'pathrag' END AS method, rn - 1 AS o,
         round(l_discount * 10, 6) AS answer_correctness, round(l_tax * 12.5, 6) AS evidence_recall, round((l_partkey % 101) / 100.0::DOUBLE, 6) AS rouge_l,
         l_extendedprice AS input_tokens, l_quantity AS output_tokens, l_partkey AS total_time_ms
  FROM ranked WHERE n >= 3 AND rn <= 3
)"""

SILVER_SQL = """
best AS (SELECT question_id, max(answer_correctness) AS best FROM outcomes GROUP BY question_id),
eligible AS (
  SELECT o.* FROM outcomes o JOIN best b USING (question_id)
  WHERE answer_correctness >= {threshold} AND answer_correctness >= round(b.best - {margin}, 6)
),
silver AS (
  SELECT q.question_id,
    coalesce((SELECT method FROM (SELECT question_id, method, row_number() OVER (PARTITION BY question_id ORDER BY input_tokens + output_tokens, total_time_ms, o) AS r FROM eligible) e WHERE e.question_id = q.question_id AND r = 1),
      (SELECT method FROM (SELECT question_id, method, row_number() OVER (PARTITION BY question_id ORDER BY answer_correctness DESC, rouge_l DESC, evidence_recall DESC, input_tokens + output_tokens, o) AS r FROM outcomes) f WHERE f.question_id = q.question_id AND r = 1)) AS silver_label,
    NOT EXISTS (SELECT 1 FROM eligible e WHERE e.question_id = q.question_id) AS all_failed
  FROM best q
)"""
