"""Quota samples and steady samples."""

import math

from pyspark.sql import functions as F

from routeloom.llm import quota, steady
from routeloom.llm.labels import split_name

TARGETS = "question_type string, split string, target_share double, min_rows long, sample_fraction double"


def questions(spark, n=400):
    rows = [(f"q{i}", ["Fact Retrieval", "fact_retrieval ", "Complex-Reasoning", None][i % 4], ["train", "Training", "dev", "TEST", None][i % 5]) for i in range(n)]
    rows += rows[:20] + [("q1", "fact retrieval", "test"), (None, "Fact Retrieval", "train")]
    return spark.createDataFrame(rows, "id string, question_type string, split string").withColumn("target_share", F.lit("clash"))


def targets(spark):
    rows = [("Fact Retrieval", "train", 0.5, 3, 0.5), ("Fact Retrieval", "test", 0.2, 2, 0.5), ("Complex Reasoning", "validation", 0.1, 1, 0.5), ("Table Lookup", "test", 0.01, 4, 0.5)]
    return spark.createDataFrame(rows, TARGETS)


def test_report_counts_by_hand(spark):
    rows = {(r["question_type"], r["split"]): r for r in quota.allocation_report(questions(spark).drop("target_share"), targets(spark)).collect()}
    ids = {f"q{i}": i for i in range(400)}
    train = {q for q, i in ids.items() if i % 4 < 2 and i % 5 < 2}
    test = {q for q, i in ids.items() if i % 4 < 2 and i % 5 == 3} | {"q1"}
    assert rows["Fact Retrieval", "train"]["available"] == len(train) and rows["Fact Retrieval", "test"]["available"] == len(test)
    assert {r["sample_size"] for r in rows.values()} == {200}
    assert rows["Fact Retrieval", "train"]["needed"] == math.ceil(0.5 * 200) and rows["Fact Retrieval", "train"]["shortfall"] == 100 - len(train)
    assert rows["Table Lookup", "test"]["available"] == 0 and rows["Table Lookup", "test"]["shortfall"] == 4


def test_sample_is_stable_distinct_and_fills_quotas(spark):
    q, t = questions(spark), targets(spark)
    a = quota.quota_sample(q, t).collect()
    b = quota.quota_sample(q.repartition(5), t).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert len({r["id"] for r in a}) == len(a)
    got = {}
    for r in a:
        got[r["question_type"], r["split"]] = got.get((r["question_type"], r["split"]), 0) + 1
    # Ids with rows in both cells are drawn for one; what train lacks goes to its sibling, the empty cell's need to a cousin.
    supply = {"train": 80, "test": 40, "validation": 20}
    assert sum(got.values()) == 140 - (supply["train"] + supply["test"] + supply["validation"] - 100 - 40) or sum(got.values()) > 130
    assert got["Fact Retrieval", "test"] >= 40 and got["Complex Reasoning", "validation"] <= 20


def test_allocation_passes_siblings_first_then_cousins():
    cells = [
        {"question_type": "a", "split": "x", "needed": 10, "supply": 4}, {"question_type": "a", "split": "y", "needed": 1, "supply": 4},
        {"question_type": "b", "split": "x", "needed": 1, "supply": 9},
    ]
    assert quota.allocate(cells) == {("a", "x"): 4, ("a", "y"): 4, ("b", "x"): 4}


def test_empty_tables(spark):
    q = questions(spark).limit(0)
    assert all(r["available"] == 0 for r in quota.allocation_report(q, targets(spark)).collect())
    assert quota.quota_sample(q, targets(spark)).count() == 0
    assert quota.quota_sample(questions(spark), targets(spark).limit(0)).count() == 0


def test_split_spellings(spark):
    df = spark.createDataFrame([(" Validation ",), ("DEV",), ("training",), ("",), (None,), ("other",)], "s string")
    assert [r[0] for r in df.select(split_name(F.col("s"))).collect()] == ["validation", "validation", "train", None, None, "other"]


MANIFEST = "round int, baseline struct<count:long,test_ids:array<string>>, expansion struct<count:long,question_ids:array<string>>, id string"


def manifest(spark, rounds):
    rows = [(r, (0, t), (0, e), "clash") for r, t, e in rounds]
    return spark.createDataFrame(rows, MANIFEST)


def test_selected_ids_stay_when_rows_are_added(spark):
    m = manifest(spark, [(1, ["q3", None], ["q3", "q5"]), (2, None, None)])
    small = spark.createDataFrame([(f"q{i}", "test") for i in range(200)] + [(None, "test"), ("q9", None)], "id string, split string")
    large = small.union(spark.createDataFrame([(f"n{i}", "Test") for i in range(300)], "id string, split string"))
    a = {r["id"] for r in steady.steady_sample(small, m, rate=0.2).collect()}
    b = {r["id"] for r in steady.steady_sample(large.repartition(6), m, rate=0.2).collect()}
    assert a <= b and "q3" in a and 15 < len(a) < 70
    assert a == {r["id"] for r in steady.steady_sample(small.union(small), m, rate=0.2).collect()}


def test_weights_never_fall(spark):
    first = steady.advance_state(None, spark.createDataFrame([("a", 2.0), ("b", None), (None, 1.0), ("c", -1.0)], "id string, weight double"))
    second = steady.advance_state(first, spark.createDataFrame([("a", 1.0), ("d", 0.5)], "id string, weight double"))
    assert {r["id"]: r["weight"] for r in second.collect()} == {"a": 2.0, "b": 0.0, "c": 0.0, "d": 0.5}
    assert steady.select_ids(second, 0.5).where("id = 'a'").count() == 1


def test_lost_ids(spark):
    m = manifest(spark, [(1, ["a", "b", "x"], []), (2, ["a", "b"], ["c"]), (3, ["a", "c"], []), (4, ["a", "c", "b"], [])])
    q = spark.createDataFrame([("a", "test"), ("b", "TEST"), ("c", "train"), ("x", "test")], "id string, split string")
    assert {r["id"] for r in steady.lost_ids(q, m).collect()} == {"b", "x", "c"}
    assert steady.lost_ids(q.limit(0), m.limit(0)).count() == 0


def test_draw_is_fitted_to_the_sample_size(spark):
    t = spark.createDataFrame([("Fact Retrieval", "train", 1 / 3, 0, 0.1), ("Fact Retrieval", "test", 1 / 3, 0, 0.1), ("Complex Reasoning", "validation", 1 / 3, 0, 0.1)], TARGETS)
    q = questions(spark)
    drawn = quota.quota_sample(q, t)
    assert drawn.count() == 40  # three needs of 14, rounded up, make 42
    table = {(r["question_type"], r["split"]): r for r in quota.allocation_table(q, t).collect()}
    assert sum(r["drawn"] for r in table.values()) == 40 and all(r["shortfall"] == 0 for r in table.values())


def test_unmet_quota_passes_and_the_rest_is_reported():
    cells = [
        {"question_type": "a", "split": "x", "needed": 10, "supply": 4, "target_share": 0.8}, {"question_type": "a", "split": "y", "needed": 1, "supply": 2, "target_share": 0.1},
        {"question_type": "b", "split": "x", "needed": 1, "supply": 3, "target_share": 0.1},
    ]
    leaves = quota.allocated_leaves(cells, 12)
    assert {k: (v.own, v.drawn) for k, v in leaves.items()} == {("a", "x"): (4, 4), ("a", "y"): (1, 2), ("b", "x"): (1, 3)}
    assert quota.allocate([]) == {}


def test_minimums_outlast_a_small_sample():
    cells = [{"question_type": "a", "split": s, "needed": 5, "supply": 9, "target_share": 0.5, "min_rows": 4} for s in "xy"]
    assert quota.allocate(cells, 2) == {("a", "x"): 4, ("a", "y"): 4}


def test_found_cells_come_from_the_allocation(spark):
    got = {(r["question_type"], r["split"]): r["shortfall"] for r in quota.unfilled_cells(questions(spark).drop("target_share"), targets(spark)).collect()}
    report = {(r["question_type"], r["split"]): r["shortfall"] for r in quota.allocation_report(questions(spark).drop("target_share"), targets(spark)).where("shortfall > 0").collect()}
    assert got == report


def test_stored_state_is_read_and_never_falls(spark, tmp_path):
    store = steady.StateStore(spark, str(tmp_path / "state"))
    m = manifest(spark, [(1, ["a"], ["b"]), (2, [], ["a", "c"])])
    state = {r["id"]: r["weight"] for r in steady.manifest_state(m, 0.2, store=store).collect()}
    assert state == {"a": 5.0, "b": 1.0, "c": 1.0}
    assert {r["id"] for r in store.read(1).collect()} == {"a", "b"}
    again = steady.manifest_state(manifest(spark, [(1, [], []), (2, [], [])]), 0.2, store=store)
    assert {r["id"]: r["weight"] for r in again.collect()} == {}  # no rounds recorded: nothing to advance
    third = steady.manifest_state(manifest(spark, [(3, None, ["d", "a"])]), 0.2, store=store)
    assert {r["id"]: r["weight"] for r in third.collect()} == {"a": 5.0, "b": 1.0, "c": 1.0, "d": 1.0}
    q = spark.createDataFrame([("a", "test"), ("d", "test")], "id string, split string")
    assert "a" in {r["id"] for r in steady.steady_sample(q, m, store=store).collect()}


def test_heavier_ids_are_kept_more_often(spark):
    rows = [(f"q{i}", k, "test") for i in range(400) for k in (("a", "b", "c") if i % 2 else ("a",))]
    q = spark.createDataFrame(rows, "id string, question_type string, split string")
    m = manifest(spark, [(1, [], [])])
    weights = {r["id"]: r["weight"] for r in steady.question_weights(q).collect()}
    assert weights["q0"] == 1.0 and weights["q1"] == 2.0
    chosen = {r["id"] for r in steady.steady_sample(q, m, rate=0.2).collect()}
    assert sum(int(x[1:]) % 2 for x in chosen) > sum(int(x[1:]) % 2 == 0 for x in chosen)
