"""Readers, writers, registry, models and streaming on small inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.operators import checks, lexical, models
from routeloom.operators.registry import Registry, Request, UnknownMethod
from routeloom.sources import readers, writers
from routeloom.streaming import events as E


def test_corpus_readers(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps([{"corpus_name": "a", "context": "two words"}]))
    row = readers.read_corpus(spark, str(p), "medical").first()
    assert (row["character_count"], row["word_count"], row["subset"]) == (9, 2, "medical")
    with pytest.raises(readers.SourceError) as e:
        readers.read_corpus(spark, "x.csv")
    assert e.value.code == "UNSUPPORTED_FORMAT"
    empty = tmp_path / "e.json"
    empty.write_text("[]")
    with pytest.raises(readers.SourceError) as e:
        readers.read_corpus(spark, str(empty))
    assert e.value.code == "INVALID_DATASET"
    with pytest.raises(Exception, match="INVALID_DATASET"):
        readers.to_documents(spark.createDataFrame([("", "x")], "corpus_name string, context string")).collect()


def test_json_lines_and_key_values(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('{"id":"1","question":"a"}\n\n{"id":"2","question":"b"}\n')
    assert readers.read_questions(spark, str(p)).where(F.col("id").isNotNull()).count() == 2
    kv = tmp_path / "kv.json"
    kv.write_text(json.dumps({"chunk-1": {"tokens": 3, "content": "x"}}))
    assert readers.read_key_values(spark, str(kv), "struct<tokens:int,content:string>").first()["tokens"] == 3


def test_graphml(spark, tmp_path):
    p = tmp_path / "g.graphml"
    p.write_text('<graphml><graph><node id="A"><data key="d0">drug</data></node><node id="B"/><edge source="A" target="B"><data key="w">1.5</data></edge></graph></graphml>')
    nodes, edges = readers.read_graphml(spark, str(p))
    assert {r["node"] for r in nodes.collect()} == {"A", "B"}
    assert edges.first()["attributes"] == {"w": "1.5"}


def test_vector_codec_round_trip(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    rows = df.select(readers.decode_vectors(readers.encode_vectors("v")).alias("v")).collect()
    assert np.allclose(rows[0]["v"], [0.6, 0.8]) and rows[1]["v"] is None and rows[2]["v"] is None


def test_index_identity_and_run_store(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "a")], "chunk_id long, text string")
    writers.write_index(chunks, str(tmp_path / "i"), {"model": "m", "dim": "2"})
    assert writers.load_index(spark, str(tmp_path / "i"), {"model": "m", "dim": "2"}).count() == 1
    with pytest.raises(readers.SourceError):
        writers.load_index(spark, str(tmp_path / "i"), {"model": "other", "dim": "2"})
    store = writers.RunStore(spark, str(tmp_path / "runs"), keep=3)
    for k in range(5):
        store.save(spark.createDataFrame([(f"r{k}", f"2024-01-0{k + 1}")], "id string, created_at string"))
    assert [r["id"] for r in store.recent(2).collect()] == ["r4", "r3"] and store.compacted().count() == 3 and store.get("r0").count() == 1


def test_resume_and_reuse(spark):
    todo = spark.createDataFrame([("a",), ("b",)], "id string")
    written = spark.createDataFrame([("a", None), ("b", "boom")], "id string, error string")
    pending, twice = checks.resume_plan(todo, written, "id", "error")
    assert [r["id"] for r in pending.collect()] == ["b"] and twice.count() == 0
    assert checks.resume_plan(todo, written.union(written), "id", "error")[1].count() == 1
    evaluated = spark.createDataFrame([("a", "p1", "f", 1, 0.5), ("a", "p1", "f", 2, 0.7), ("b", "p2", "g", 1, 0.1)], "id string, protocol string, fingerprint string, position int, score double")
    source = spark.createDataFrame([("a", "f"), ("b", "g")], "id string, fingerprint string")
    assert {r["id"]: r["score"] for r in checks.reusable(evaluated, source, "id", "p1").collect()} == {"a": 0.7}


def test_registry(spark):
    reg = Registry()
    reg.register("vector", lambda q, k: q.select("query_id", F.lit(k).alias("item")))
    with pytest.raises(ValueError):
        reg.register("vector", lambda q, k: q)
    with pytest.raises(UnknownMethod):
        reg.retrieve(spark.range(1), "nope")
    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, text string")
    routes = spark.createDataFrame([(1, "vector")], "query_id long, method string")
    assert [(r["query_id"], r["item"]) for r in reg.routed(q, routes).collect()] == [(1, 3)]
    for bad in (dict(query=" ", method_id="v"), dict(query="x", method_id="v", top_k=0), dict(query="x", method_id="v", top_k=True)):
        with pytest.raises(ValueError):
            Request(**bad)


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x, fold = rng.normal(size=(60, 3)), np.arange(60) % 3
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=60) * 0.1
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), int(fold[i])) for i in range(60)], "k long, x array<double>, y double, fold int")
    got = {r["k"]: r["pred_y"] for r in models.ridge_oof(df, "k", "x", ["y"], "fold", alpha=0.7).collect()}
    for f in range(3):
        a, b = x[fold != f], y[fold != f]
        m, n = a.mean(0), b.mean()
        w = np.linalg.solve((a - m).T @ (a - m) + 0.7 * np.eye(3), (a - m).T @ (b - n))
        for i in np.flatnonzero(fold == f):
            assert abs(got[i] - (n + (x[i] - m) @ w)) < 1e-5


def test_tfidf_unit_length_and_self_hit(spark):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma delta"), (3, "alpha gamma")], "k long, t string")
    postings, vocab = lexical.index_texts(df, "k", "t")
    assert all(abs(r["s"] - 1) < 1e-9 for r in postings.groupBy("k").agg(F.sum(F.col("weight") ** 2).alias("s")).collect())
    q = lexical.query_vectors(df.select(F.col("k").alias("q"), "t"), vocab, "q", "t")
    top = lexical.top_k(lexical.similarities(q, postings, "q", "k"), "q", "k", 1).collect()
    assert all(r["q"] == r["k"] and r["score"] == 1.0 for r in top)


def test_streamed_windows_equal_batch(spark, data, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.parquet").symlink_to(f"{data}/events.parquet")
    stream = E.tumbling(E.event_stream(spark, str(tmp_path / "in")))
    got = E.run_once(stream, "hourly_test", str(tmp_path / "cp"), "complete")
    batch = E.tumbling(spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_stages_come_in_order_and_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"type": t, "run_id": r, "payload": p} for r, t, p in (("a", "result", "3"), ("a", "routing", "1"), ("a", "retrieval", "2"), ("a", "result", "late"), ("b", "routing", "1"), ("b", "error", "x"))]
    (tmp_path / "in" / "x.txt").write_text("\n".join(map(json.dumps, lines)) + "\n")
    stream = E.ordered_stages(E.parse_lines(spark.readStream.text(str(tmp_path / "in"))), quiet_ms=None)
    got = E.run_once(stream, "stages_test", str(tmp_path / "cp")).orderBy("run_id", "seq").collect()
    assert [(r["run_id"], r["type"]) for r in got if r["type"] != "heartbeat"] == [("a", "routing"), ("a", "retrieval"), ("a", "result"), ("b", "routing"), ("b", "error")]
