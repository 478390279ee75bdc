"""A reproducible sample that stays put as data grows.

Consistent weighted Poisson sampling: an id is selected when the hash of the id
lies below its weight times a constant. The weight an id is judged by is the
largest it ever had, kept in a state table that every round reads and writes, so
its inclusion probability never falls and a selected id stays selected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..session import cut_lineage
from .labels import plain, split_name

#: A unit is the first 52 bits of an md5: exact in a double, and any engine reproduces it.
_UNIT = 1 << 52


def hash_unit(column: str, seed: int):
    """The id's place in [0, 1): the same on every run and layout."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(column))), 1, 13), 16, 10).cast("long") / float(_UNIT)


def advance_state(state: DataFrame | None, weights: DataFrame) -> DataFrame:
    """(id, weight): the running maximum of every id's weight over the state and a new round of weights.

    Null ids are left out, null and negative weights count as 0, repeated ids by their largest weight.
    """
    clean = weights.select(F.col("id").cast("string").alias("id"), F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight"))
    both = clean if state is None else clean.unionByName(state.select("id", "weight"))
    return both.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("weight").alias("weight"))


def select_ids(state: DataFrame, constant: float, seed: int = 42) -> DataFrame:
    """(id, weight, unit) of the ids whose hash lies below weight times constant; a weight of 1 / constant is certain."""
    return state.withColumn("unit", hash_unit("id", seed)).where(F.col("unit") < F.col("weight") * F.lit(float(constant)))


class StateStore:
    """Running-maximum weights by round under one folder: a round is a folder of its own, written once and never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, number: int) -> DataFrame | None:
        try:
            return self.spark.read.schema("id string, weight double").parquet(f"{self.path}/round={number}")
        except AnalysisException:
            return None

    def advance(self, number: int, weights: DataFrame) -> DataFrame:
        """The state of a round from the state of the round before it and new weights; a round already stored is read, so a rerun changes nothing."""
        stored = self.read(number)
        if stored is not None:
            return stored
        before = next((s for k in range(number - 1, 0, -1) if (s := self.read(k)) is not None), None)
        advance_state(before, weights).write.mode("errorifexists").parquet(f"{self.path}/round={number}")
        return self.read(number)


def manifest_rounds(manifest: DataFrame) -> DataFrame:
    """(id, round, selected): each id of the manifest per round; selected where it stands in test_ids.

    Null rounds, arrays and ids are skipped, repeats and late copies count once, the stored counts are not trusted.
    """
    both = F.concat(
        F.transform(F.coalesce("baseline.test_ids", F.array().cast("array<string>")), lambda x: F.struct(x.alias("id"), F.lit(True).alias("selected"))),
        F.transform(F.coalesce("expansion.question_ids", F.array().cast("array<string>")), lambda x: F.struct(x.alias("id"), F.lit(False).alias("selected"))),
    )
    rows = manifest.where(F.col("round").isNotNull()).select("round", F.explode(both).alias("x"))
    return rows.select(F.col("x.id").alias("id"), "round", F.col("x.selected").alias("selected")).where(F.col("id").isNotNull()).groupBy("id", "round").agg(F.max("selected").alias("selected"))


def question_weights(questions: DataFrame, split: str = "test") -> DataFrame:
    """(id, weight) of the ids with a row in ``split``: 1, and half as much again for each further question type or source.

    An id that stands in several strata would otherwise count in each with the share of one.
    """
    have = {c.lower() for c in questions.columns}
    strata = [plain(F.col(c).cast("string")) for c in ("question_type", "source") if c in have]
    rows = questions.where((split_name(F.col("split").cast("string")) == split) & F.col("id").isNotNull())
    kinds = F.count_distinct(F.concat_ws("\x1f", *[F.coalesce(s, F.lit("")) for s in strata])) if strata else F.lit(1)
    return rows.groupBy(F.col("id").cast("string").alias("id")).agg((0.5 + 0.5 * kinds).alias("weight"))


def manifest_state(manifest: DataFrame, constant: float, base_weight: float = 1.0, store: StateStore | None = None, last_round: int | None = None) -> DataFrame:
    """The state after the manifest's rounds, advanced round by round: ids once selected carry the weight of certain
    inclusion, added ones the base weight. With a ``store`` each round's state is written to it and read back."""
    rounds = manifest_rounds(manifest)
    if last_round is not None:
        rounds = rounds.where(F.col("round") <= last_round)
    certain = max(1.0 / constant, base_weight)
    weights = rounds.select("id", "round", F.when(F.col("selected"), F.lit(certain)).otherwise(F.lit(base_weight)).alias("weight"))
    if store is None:
        return advance_state(None, weights)
    weights = cut_lineage(weights)
    state = advance_state(None, weights.limit(0))
    # One step per recorded round: a handful, whatever the size of the manifest.
    for number in sorted(r["round"] for r in weights.select("round").distinct().collect()):
        state = store.advance(int(number), weights.where(F.col("round") == number))
    return state


def steady_sample(questions: DataFrame, manifest: DataFrame, rate: float = 0.2, seed: int = 42, split: str = "test", store: StateStore | None = None) -> DataFrame:
    """(id, kept, weight, unit): the sample of the ids with a row in ``split``; ids selected in a round are always in it.

    An id's weight is the largest of its question weight and of all it had in the state. Ids without a row in the
    split can't be drawn and are reported by ``lost_ids``. Null ids and splits take no part; repeated rows count once.
    The result depends only on ids, labels, the manifest and the seed.
    """
    held = question_weights(questions, split)
    state = advance_state(manifest_state(manifest, rate, store=store), held)
    chosen = select_ids(state, rate, seed).join(held.select("id"), "id", "left_semi")
    return chosen.select("id", (F.col("weight") * F.lit(float(rate)) >= 1.0).alias("kept"), F.round("weight", 6).alias("weight"), F.round("unit", 9).alias("unit"))


def lost_ids(questions: DataFrame, manifest: DataFrame, rate: float = 0.2, last_round: int = 4, seed: int = 42) -> DataFrame:
    """(id, first_selected, missing_rounds, in_split): ids once selected that were not kept.

    The sampler's selection of every round is set against the manifest: after a round that lists an id as selected its
    weight is that of certain inclusion, so ``select_ids`` selects it in every later round, whatever its hash. An
    id is lost when some later round up to the last one recorded (at most ``last_round``) has it in no row, or when no
    row of the questions puts it in the test split, so that the sample of the split can't hold it.
    """
    rounds = cut_lineage(manifest_rounds(manifest).where(F.col("round") <= last_round))
    certain = max(1.0 / rate, 1.0)
    # The running maximum of an id after each round, over the rounds that are recorded (at most last_round).
    recorded = rounds.select(F.col("round").alias("at")).distinct()
    marks = rounds.select("id", F.col("round").alias("since"), F.when(F.col("selected"), F.lit(certain)).otherwise(F.lit(1.0)).alias("weight"))
    state = marks.join(F.broadcast(recorded), F.col("since") <= F.col("at")).groupBy("id", "at").agg(F.max("weight").alias("weight"))
    selected = select_ids(state, rate, seed).where(F.col("weight") * F.lit(float(rate)) >= 1.0)
    held = question_weights(questions).select("id", F.lit(True).alias("in_split"))
    seen = rounds.select("id", F.col("round").alias("at"), F.lit(True).alias("listed"))
    # At most last_round rows for an id.
    kept = selected.select("id", "at").join(seen, ["id", "at"], "left").groupBy("id").agg(
        F.min("at").alias("first_selected"), F.array_sort(F.collect_list(F.when(F.col("listed").isNull(), F.col("at")))).alias("missing_rounds")
    )
    return (
        kept.join(held, "id", "left")
        .withColumn("in_split", F.coalesce("in_split", F.lit(False)))
        .where((F.size("missing_rounds") > 0) | ~F.col("in_split"))
        .select("id", "first_selected", "missing_rounds", "in_split")
    )
