"""Gates: what has to hold before rows are merged, reused or analysed. Each gives the violations or one verdict per rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S


def select_questions(rows: DataFrame, kind: str, kinds: list[str], order: list[str], most: int) -> DataFrame:
    """Rows of the wanted kinds, the first ``most`` of each in the given order."""
    place = Window.partitionBy(kind).orderBy(*order)
    return rows.where(F.col(kind).isin(kinds)).withColumn("position", F.row_number().over(place)).where(F.col("position") <= most)


def low_signal(rows: DataFrame, key: str, coverage: str, least: float = 0.25) -> DataFrame:
    """(key, best, low_signal): whether no method reached the least coverage."""
    return rows.groupBy(key).agg(F.round(F.max(coverage), 6).alias("best")).withColumn("low_signal", F.col("best") < least)


def without_failed(labels: DataFrame, keep_failed: bool = False) -> DataFrame:
    return labels if keep_failed else labels.where(~F.col("all_failed"))


def valid_evaluation(version: Column, status: Column, metrics: list[Column]) -> Column:
    """Current version, status ok, and every metric a finite number between zero and one."""
    good = reduce(lambda a, b: a & b, [S.valid_score(m) for m in metrics])
    return (version.eqNullSafe(F.lit(2))) & (status.eqNullSafe(F.lit("ok"))) & F.coalesce(good, F.lit(False))


def sanitised(rows: DataFrame, metrics: list[str], errors: str) -> DataFrame:
    """``rows`` with all metrics null and status failed where one of them is unusable or the judge reported an error."""
    bad = F.coalesce(F.size(errors) > 0, F.lit(False)) | ~reduce(lambda a, b: a & b, [S.valid_score(F.col(m)) for m in metrics])
    marked = rows.withColumn("_bad", F.coalesce(bad, F.lit(True)))
    for m in metrics:
        marked = marked.withColumn(m, F.when(~F.col("_bad"), F.col(m)))
    return marked.withColumn("status", F.when(F.col("_bad"), "failed").otherwise("ok")).drop("_bad")


def verdicts(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """(rule, violations): how many rows each list of violations has; all rules are reported, held or not."""
    parts = [df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations") for rule, df in checks]
    return reduce(DataFrame.unionByName, parts)


def alignment_rules(results: DataFrame, key: str, method: str, methods, protocol: str, references: list[str]) -> DataFrame:
    """Rules for results of several methods over one question set: each method once per question, all methods present,
    one protocol in all, equal reference fields. One aggregation per question serves all but the protocol."""
    per = results.groupBy(key).agg(
        F.count("*").alias("rows"), F.count_distinct(method).alias("methods"), F.count_distinct(F.to_json(F.struct(*references), {"ignoreNullFields": "false"})).alias("references")
    )
    protocols = results.select(protocol).distinct()
    return verdicts([
        ("each method once", per.where(F.col("rows") > F.col("methods"))),
        ("all methods present", per.where(F.col("methods") < len(methods))),
        ("equal references", per.where(F.col("references") > 1)),
        ("protocol named", protocols.where(F.col(protocol).isNull())),
        ("one protocol", protocols.where(F.col(protocol).isNotNull()).agg(F.count("*").alias("n")).where(F.col("n") > 1)),
    ])


def merge_rules(baseline: DataFrame, expansion: DataFrame, key: str, split: str, frozen: DataFrame) -> DataFrame:
    """Rules for adding an expansion to a baseline: no shared ids, no test rows in the expansion, the frozen test ids unchanged."""
    ids = lambda df: df.select(key).where(F.col(key).isNotNull()).distinct()
    held = ids(baseline.where(F.col(split) == "test"))
    return verdicts([
        ("disjoint ids", ids(baseline).intersect(ids(expansion))),
        ("no test rows added", expansion.where(F.col(split) == "test")),
        ("no frozen id missing", ids(frozen).subtract(held)),
        ("no new test id", held.subtract(ids(frozen))),
    ])


def canonical(columns: list[str]) -> Column:
    """sha256 of the JSON object of the columns under sorted names, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def stale(evaluated: DataFrame, source: DataFrame, key: str, stored: str, columns: list[str]) -> DataFrame:
    """(key, problem): evaluated rows whose source changed or is gone, and sources that were not evaluated."""
    now = source.select(key, canonical(columns).alias("_now"))
    both = evaluated.select(key, F.col(stored).alias("_then")).join(now, key, "full_outer")
    problem = F.when(F.col("_now").isNull(), "source gone").when(F.col("_then").isNull(), "not evaluated").when(F.col("_now") != F.col("_then"), "changed")
    return both.select(key, problem.alias("problem")).where(F.col("problem").isNotNull())


def reusable(evaluated: DataFrame, source: DataFrame, key: str, protocol: str, columns: list[str], position: str) -> DataFrame:
    """(key, position): valid evaluated rows of the protocol whose fingerprint fits the source; the last of each key.

    A key that stands twice in the source fails the job. Needs version, status, the metrics and ``fingerprint``.
    """
    counted = source.groupBy(key).agg(F.count("*").alias("n"), F.first(canonical(columns)).alias("current"))
    once = counted.withColumn("current", F.when(F.col("n") > 1, F.raise_error(F.lit("duplicate source id")).cast("string")).otherwise(F.col("current")))
    good = evaluated.where(valid_evaluation(F.col("version"), F.col("status"), [F.col("answer_correctness"), F.col("evidence_recall")]) & (F.col("protocol") == protocol))
    return good.join(once, key).where(F.col("fingerprint") == F.col("current")).groupBy(key).agg(F.max(position).alias(position))


def order_differences(results: DataFrame, method: str, key: str, order: list[str], against: str) -> DataFrame:
    """(method, place): places at which a method's sequence of keys is another than that of ``against``."""
    placed = results.withColumn("place", F.row_number().over(Window.partitionBy(method).orderBy(*order)))
    first = placed.where(F.col(method) == against).select("place", F.col(key).alias("_key"))
    others = placed.where(F.col(method) != against).select(method, "place", key)
    return others.join(first, "place", "left").where(~F.col(key).eqNullSafe(F.col("_key"))).select(method, "place")


def merged_map(left: Column, right: Column) -> Column:
    """Both maps in one; the right one wins."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def display_filter(nodes: DataFrame, edges: DataFrame, search: str = "", only_hits: bool = False, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """Visible nodes (hits only where asked) and edges with both ends visible; with a search text the first labels that hold it."""
    seen = nodes.where("hit") if only_hits else nodes
    if search:
        seen = seen.where(F.contains(F.lower("node"), F.lit(search.lower()))).orderBy("node").limit(most)
    ends = seen.select("node")
    kept = edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return seen, kept


def decision(method: Column, probability: Column) -> Column:
    """(method, probability) of a route: null for an unknown method, and a probability only where it is one."""
    known = method.isin(*S.METHODS)
    return F.when(known, F.struct(method.alias("method"), F.when(S.valid_score(probability), probability).alias("probability")))


def expected_counts(rows: DataFrame, keys: list[str], expected: DataFrame) -> DataFrame:
    """(keys, n, side): counts that differ from the expected table, on whichever side they stand."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    wanted = expected.select(*keys, F.col("n").cast("long").alias("n"))
    return found.exceptAll(wanted).withColumn("side", F.lit("found")).unionByName(wanted.exceptAll(found).withColumn("side", F.lit("expected")))


def multiset_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(column, side): values that one bag has more often than the other, once per surplus."""
    left, right = a.select(column), b.select(column)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def vector_index_rules(chunks: DataFrame, vectors: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """Rules of a vector index: not empty, a vector for every chunk and no other, right dimension, finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ids = lambda df: df.select(key).where(F.col(key).isNotNull()).distinct()
    return verdicts([
        ("not empty", vectors.agg(F.count("*").alias("n")).where(F.col("n") == 0)),
        ("vector for every chunk", ids(chunks).subtract(ids(vectors))),
        ("chunk for every vector", ids(vectors).subtract(ids(chunks))),
        ("no null vector", vectors.where(F.col(vector).isNull())),
        ("dimension", vectors.where(F.col(vector).isNotNull() & (F.size(vector) != dimensions))),
        ("finite", vectors.where(F.col(vector).isNotNull() & odd)),
    ])


def split_two_stage(rows: DataFrame, key: str, strata: list[str], seed: int = 42, test: float = 0.2, dev: float = 0.25) -> DataFrame:
    """(key, split): a test share of each joint stratum, then a dev share of the rest; unstratified where a stratum has one row.

    Order is by md5 of seed and key, so any engine gives the same split. Parts are rounded up.
    """
    from .splits import stratum_positions

    named = rows.select(key, F.concat_ws("::", *strata).alias("_stratum"))

    def safe(df: DataFrame) -> DataFrame:
        least = df.groupBy("_stratum").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
        return df.join(F.broadcast(least)).withColumn("_stratum", F.when(F.col("least") >= 2, F.col("_stratum")).otherwise(F.lit("all"))).drop("least")  # one row

    def first(df: DataFrame, share: float, stage: int) -> DataFrame:
        placed = stratum_positions(safe(df), "_stratum", key, seed + stage)
        return placed.select(key, (F.col("position") <= F.ceil(F.round(F.col("n") * share, 6))).alias("_first"))

    held = first(named, test, 0)
    rest = named.join(held.where(~F.col("_first")).select(key), key, "left_semi")
    return held.where("_first").select(key, F.lit("test").alias("split")).unionByName(first(rest, dev, 1).select(key, F.when(F.col("_first"), "dev").otherwise("train").alias("split")))


def representative_cases(rows: DataFrame, key: str, methods, kinds: list[str], most: int = 5) -> DataFrame:
    """(place, key, truth, prediction): the first right case of each method, then the first miss of each kind, at most so many."""
    names = F.array(*[F.lit(m) for m in methods])
    types = F.array(*[F.lit(k) for k in kinds])
    right = rows.where((F.col("truth") == F.col("prediction")) & F.col("truth").isin(*methods)).groupBy(F.array_position(names, F.col("truth")).alias("o")).agg(F.min_by(F.struct(key, "truth", "prediction"), key).alias("c"))
    wrong = rows.where((F.col("truth") != F.col("prediction")) & F.col("kind").isin(*kinds)).groupBy((F.array_position(types, F.col("kind")) + len(methods)).alias("o")).agg(F.min_by(F.struct(key, "truth", "prediction"), key).alias("c"))
    order = Window.partitionBy(F.lit(0)).orderBy("o")  # at most one row per method and kind
    return right.unionByName(wrong).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("place", "c.*")


def metric_deltas(before: DataFrame, after: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, one difference per metric): after less before, for keys in both."""
    old = before.select(key, *[F.col(m).alias(f"_{m}") for m in metrics])
    return after.join(old, key).select(key, *[F.round(F.col(m) - F.col(f"_{m}"), 6).alias(m) for m in metrics])


def best_candidate(candidates: DataFrame, keys: list[Column]) -> DataFrame:
    """The first candidate under several keys: a sort with limit, nothing is gathered."""
    return candidates.orderBy(*keys).limit(1)
