"""The workbench end to end on a small corpus."""

import pytest
from pyspark.sql import functions as F

from routeloom.operators import workbench as W
from routeloom.operators.registry import Registry, Request, UnknownMethod
from routeloom.sources.readers import SourceError


@pytest.fixture()
def bench(spark, tmp_path):
    docs = spark.createDataFrame([("b", "long text of a corpus", "medical"), ("a", "short text", "medical"), ("c", None, "medical"), ("d", "x", "other")], "corpus_name string, context string, subset string")
    reg = Registry()
    reg.register("vector", lambda q, k: q.select("query_id", F.lit(7).alias("item"), F.lit(1.0).alias("score"), F.lit(k).alias("rank")))
    nodes, edges = spark.createDataFrame([("A",), ("B",)], "node string"), spark.createDataFrame([("A", "B")], "src string, dst string")
    return W.Workbench(spark, str(tmp_path), reg, docs, W.Profile("p", read_only=True, options={"vector": {"mode": "local|global"}}), lambda: (nodes, edges), {"model": "m"})


def test_dataset_index_query_and_graph(spark, bench):
    assert bench.health()["methods"] == ["vector"] and bench.index_status()["status"] == "not_built"
    with pytest.raises(SourceError) as err:
        bench.build(lambda: None, lambda: None)
    assert err.value.code == "NO_DATASET"
    assert bench.select("medical").first()["corpus_name"] == "a"
    with pytest.raises(SourceError) as err:
        bench.select("other")
    assert err.value.code == "READ_ONLY"
    rules = lambda: spark.createDataFrame([("fine", 0)], "rule string, violations long")
    assert bench.build(lambda: None, rules) == "built" and bench.build(lambda: None, rules) == "reused"
    assert bench.index_status() == {"status": "ready", "reusable": True}
    assert bench.query(Request("  what? ", "vector", 3, {"mode": "local"})).first()["rank"] == 3
    assert bench.runs.recent().count() == 1
    with pytest.raises(SourceError) as err:
        bench.query(Request("what?", "vector", 3, {"mode": "odd"}))
    assert err.value.code == "INVALID_OPTION"
    with pytest.raises(UnknownMethod):
        bench.query(Request("what?", "other"))
    assert bench.preview("vector") == (None, "vector has no graph") and bench.preview("lightrag")[0].count() == 2
    hits = bench.related(spark.createDataFrame([("A",), ("Z",)], "node string"), spark.createDataFrame([], "a string, b string"))
    assert hits["counts"].first()["missing"] == 1 and bench.summary().first()["edges"] == 1


def test_frozen_inputs(spark):
    rows = spark.createDataFrame([("a", "train"), ("b", "test")], "id string, split string")
    ids = spark.createDataFrame([("a",), ("c",)], "id string")
    got = {r["rule"]: r["violations"] for r in W.frozen_rules(rows, "id", "split", ids, 2, {"f": "1", "g": "2"}, {"f": "1", "g": "3"}).collect()}
    assert got == {"stated ids": 2, "stated rows": 0, "no test rows": 1, "files unchanged": 1}


def test_label_changes(spark):
    schema = "question_id long, silver_label string"
    old, new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], schema), spark.createDataFrame([(1, "a"), (2, "b"), (4, "b")], schema)
    assert {tuple(r) for r in W.label_changes(old, new).collect()} == {("a", "a", 1), ("a", "b", 1), ("b", None, 1), (None, "b", 1)}


def test_keyword_session_names_what_went_wrong():
    class Fixed:
        def __init__(self, *replies):
            self.replies = list(replies)

        def reply(self, prompt):
            return self.replies.pop(0)

    good = '{"high_level_keywords": ["a"], "low_level_keywords": ["b"]}'
    session = W.KeywordSession(Fixed((good, 1, 5), (good, 1, 512), (" ", 1, 1), ("no", 1, 1)))
    assert session.keywords("q") == (["a"], ["b"])
    for code in ("KEYWORDS_TRUNCATED", "KEYWORDS_BLANK", "KEYWORDS_INVALID", "KEYWORDS_BUDGET"):
        with pytest.raises(SourceError) as err:
            session.keywords("q")
        assert err.value.code == code
