"""Gates, index life, snapshots, model boundary and routers on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.functions import parsers as P
from routeloom.functions import text as X
from routeloom.functions import vectors as V
from routeloom.operators import chunking, clients, gates, knn, lexical, lifecycle, registry, routers, views
from routeloom.plans import graph as graph_plans
from routeloom.sources import readers, writers
from routeloom.sources.readers import SourceError
from routeloom.streaming import events as E


def test_chunks_are_slices_of_the_text(spark):
    df = spark.createDataFrame([(1, "  Hello, world. It works; (yes)!"), (2, ""), (3, None), (4, "!?")], "doc_id long, text string")
    got = [(r["doc_id"], r["chunk"]) for r in chunking.word_chunks(df, size=3, overlap=1).orderBy("doc_id", "chunk_no").collect()]
    assert got == [(1, "Hello, world. It"), (1, "It works; (yes")]


def test_brackets_of_each_kind_are_counted_by_themselves():
    assert X.nested_statements("a (x] ; b; c) tail; last") == ["a (x] ; b; c) tail", "last"]
    assert X.nested_statements("a) ; b") == ["a)", "b"]
    assert X.nested_statements("((a; b); c); d") == ["((a; b); c)", "d"]


def test_rendered_contexts_keep_their_layout(spark):
    df = spark.createDataFrame([(["a\n\tb", "c d"],)], "c array<string>")
    assert df.select(X.render_contexts(F.col("c"), 5)).first()[0] == "[Context 1]\na\n\tb\n\n[Context"


def test_sections_fold_surplus_commas_and_quotes():
    text = '-----Sources-----\n```csv\nid, content\n0,a,b\n1,"""q"""\n\n```\n-----low-level relationship information-----\n```csv\nid,context\n0,The entity A is a x. The entity B is a y\n1,The entity C is a z\n```'
    contexts, entities, relations, paths = P.sectioned_context(text)
    assert contexts == ["a,b", "q"] and entities == [] and len(relations) == 2 and paths == [["A", "B"]]
    assert P.sectioned_context(None) == ([], [], [], [])


def test_numbered_records_need_their_head(spark):
    rows = [("id,\tcontent\n0,\ta\nb\n1,\tc",), ("id,\tcontent",), ("0,\ta",), ("id,\tcontent\nno number",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(P.numbered_records(F.col("t"))).collect()]
    assert got == [["a\nb", "c"], [], None, None, None]


def test_zero_vectors_fail(spark):
    df = spark.createDataFrame([([0.0, 0.0],)], "v array<double>")
    with pytest.raises(Exception, match="zero vector"):
        df.select(V.strict_unit(F.col("v"))).collect()


def test_sanitised_scores_are_all_or_none(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5, []), (2, 1.5, 0.5, []), (3, 0.5, None, []), (4, 0.5, 0.5, ["x"]), (5, float("nan"), 0.5, None)], "id int, a double, b double, errors array<string>")
    got = {r["id"]: (r["a"], r["status"]) for r in gates.sanitised(df, ["a", "b"], "errors").collect()}
    assert got == {1: (0.5, "ok"), 2: (None, "failed"), 3: (None, "failed"), 4: (None, "failed"), 5: (None, "failed")}


def test_reuse_refuses_duplicate_sources(spark):
    source = spark.createDataFrame([("a", "x"), ("a", "x")], "id string, q string")
    row = spark.createDataFrame([("a", 2, "ok", 0.5, 0.5, "p", "f", 1)], "id string, version int, status string, answer_correctness double, evidence_recall double, protocol string, fingerprint string, position int")
    with pytest.raises(Exception, match="duplicate source"):
        gates.reusable(row, source, "id", "p", ["q"], "position").collect()


def test_split_falls_back_without_strata(spark):
    rows = spark.createDataFrame([(f"q{i}", "a" if i else "b") for i in range(20)], "id string, kind string")
    got = {r["split"]: r["count"] for r in gates.split_two_stage(rows, "id", ["kind"]).groupBy("split").count().collect()}
    assert got == {"test": 4, "dev": 4, "train": 12}


def test_index_log_states(spark, tmp_path):
    log = lifecycle.IndexLog(spark, str(tmp_path / "log"))
    rules = lambda n: spark.createDataFrame([("not empty", n)], "rule string, violations long")
    built = []
    assert log.status("c", "r") == {"status": "not_built", "reusable": False}
    assert log.ensure("c", "r", "n", lambda: built.append(1), lambda: rules(0)) == "built"
    assert log.ensure("c", "r", "n", lambda: built.append(1), lambda: rules(0)) == "reused" and built == [1]
    assert log.status("c", "r") == {"status": "ready", "reusable": True} and not log.status("d", "r")["reusable"]
    with pytest.raises(SourceError) as err:
        log.ensure("d", "r", "n", lambda: None, lambda: rules(0))
    assert err.value.code == "INDEX_CONFIG_MISMATCH"
    other = lifecycle.IndexLog(spark, str(tmp_path / "other"))
    with pytest.raises(SourceError):
        other.ensure("c", "r", "n", lambda: None, lambda: rules(1))
    assert other.status("c", "r")["status"] == "failed"
    other.write(corpus="c", runtime="r", name="n", status="building")
    other.interrupt()
    assert other.status("c", "r")["status"] == "interrupted"


def test_fingerprint_of_settings_ignores_order():
    assert lifecycle.runtime_fingerprint({"a": 1, "b": 2}) == lifecycle.runtime_fingerprint({"b": 2, "a": 1}) != lifecycle.runtime_fingerprint({"a": 1, "b": 3})


def test_snapshots_by_content(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("x")
    files = lifecycle.folder_hashes(spark, str(folder))
    rows = spark.createDataFrame([(1,)], "x int")
    path = lifecycle.snapshot(rows, spark, files, str(tmp_path / "out"))
    assert lifecycle.snapshot(rows, spark, files, str(tmp_path / "out")) == path
    (folder / "a.txt").write_text("version https://git-lfs.github.com/spec/v1")
    with pytest.raises(Exception, match="LFS_POINTER"):
        lifecycle.folder_hashes(spark, str(folder)).collect()


def test_graph_export_needs_edges_and_manifest(spark):
    nodes, edges = spark.createDataFrame([("a",), ("b",)], "node string"), spark.createDataFrame([("a", "b")], "src string, dst string")
    row = lifecycle.graph_export(nodes, edges, {"directed": True}).first()
    assert (row["nodes"], row["edges"], row["directed"], len(row["sha256"])) == (2, 1, True, 64)
    with pytest.raises(SourceError):
        lifecycle.graph_export(nodes, edges, None)
    with pytest.raises(Exception, match="EMPTY_GRAPH"):
        lifecycle.graph_export(nodes, edges.limit(0), {"directed": False}).collect()


def test_embedder_is_called_only_for_what_is_missing(spark):
    texts = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", None)], "id string, text string")
    cache = spark.createDataFrame([("a", [1.0] + [0.0] * 7), ("b", [1.0])], "id string, embedding array<float>")
    got = {r["id"]: r["embedding"] for r in clients.load_or_embed(cache, texts, "id", "text", clients.client_factory("hash", dimensions=8), 8).collect()}
    assert set(got) == {"a", "b"} and got["a"][0] == 1.0 and abs(sum(x * x for x in got["b"]) - 1) < 1e-5
    with pytest.raises(Exception, match="another count or width"):
        clients.embed_texts(texts, "id", "text", clients.client_factory("hash", dimensions=4), 8).collect()
    with pytest.raises(SourceError):
        clients.client_factory("nothing")


def test_retries_stop_at_lasting_errors():
    calls, waits = [], []

    def flaky(status):
        def call():
            calls.append(1)
            if len(calls) < 3:
                raise clients.CallFailed(status)
            return "ok"

        return call

    assert clients.with_retries(flaky(503), sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    calls.clear()
    with pytest.raises(clients.CallFailed):
        clients.with_retries(flaky(400), sleep=waits.append)
    assert calls == [1]


def test_judge_failures_null_all_metrics(spark):
    class _Judge:
        def reply(self, prompt):
            one = '{"statement": "s", "reason": "r", "attributed": 1}'
            return (f'{{"TP": [{one}], "FP": [], "FN": []}}' if prompt.startswith("correctness") else f'{{"classifications": [{one}]}}'), 1, 1

    rows = spark.createDataFrame([("a", "x", "x", ["s"]), ("b", "x", "y", ["other"])], "id string, answer string, ground_truth string, evidence array<string>")
    got = {r["id"]: (r["rouge_l"], r["answer_correctness"], r["evidence_recall"], r["status"]) for r in clients.judge_rows(rows, "id", _Judge).collect()}
    assert got == {"a": (1.0, 1.0, 1.0, "ok"), "b": (None, None, None, "failed")}


def test_pending_runs_once_and_refuses_duplicates(spark):
    todo = spark.createDataFrame([("a",), ("b",)], "id string")
    written = spark.createDataFrame([("a", None), ("b", "failed")], "id string, error string")
    assert [r["id"] for r in clients.run_pending(todo, written, "id", lambda df: df).collect()] == ["b"]
    with pytest.raises(Exception, match="DUPLICATE_RESULT"):
        clients.run_pending(todo, written.unionByName(written), "id", lambda df: df).collect()


def test_router_learns_stores_and_refuses(spark, tmp_path):
    rows = routers.dense(spark.createDataFrame([(i, [float(i % 3 == 0), float(i % 3 == 1)], ("vector", "lightrag", "pathrag")[i % 3], i % 5) for i in range(60)], "id long, v array<double>, label string, fold int"), "v")
    oof = routers.out_of_fold(rows, "id", "label", "fold", [(0.01, False), (5.0, True)], 5)
    scores = routers.candidate_scores(oof, 2)
    assert oof.count() == 120 and routers.tuned(scores) in (0, 1) and scores.agg(F.max("accuracy")).first()[0] == 1.0
    best, table = routers.tune_on_validation(rows.where("fold < 4").withColumn("all_failed", F.lit(False)), rows.where("fold = 4"), "id", "label", [(0.01, False), (5.0, True)])
    assert best in (0, 1) and table.count() == 4
    model = routers.fit(rows, "label", 5.0, True)
    store = routers.RouterStore(spark, str(tmp_path / "store"), 2)
    name = store.install(model, {"C": 5.0})
    assert store.install(model, {"C": 5.0}) == name == store.current()
    assert routers.adaptive_routes(store.load(), rows, "id").where("id = 0").first()["method"] == "vector"
    with pytest.raises(SourceError):
        routers.adaptive_routes(model, rows, "id", {"top_k": 3})
    with pytest.raises(SourceError):
        routers.RouterStore(spark, str(tmp_path / "store"), 3).load(name)
    with pytest.raises(SourceError):
        store.load("../other")
    delta = routers.size_ablation(rows.where("id < 30"), rows, rows, "id", "label").first()
    assert delta["macro_f1"] >= 0


def test_reproduction_gate(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "k string, m double")
    b = spark.createDataFrame([("x", 0.5), ("y", 0.6)], "k string, m double")
    assert [(r["k"], r["metric"]) for r in routers.reproduced(a, b, "k", ["m"]).collect()] == [("y", "m")]


def test_rule_grid_routers(spark):
    rules = [(0.6, 0.1)]
    labels = spark.createDataFrame([(0.6, 0.1, i, ("vector", "lightrag", "pathrag")[i % 3], False) for i in range(30)], "threshold double, margin double, question_id long, silver_label string, all_failed boolean")
    features = routers.dense(spark.createDataFrame([(i, [float(i % 3 == 0), float(i % 3 == 1)], i % 2) for i in range(30)], "question_id long, v array<double>, fold int"), "v")
    row = routers.rule_grid_routers(labels, features, rules, folds=2, strength=5.0).first()
    assert row["accuracy"] == 1.0


def test_text_features_as_vectors(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta", "alpha beta gamma", "alpha a", "delta"])], "id long, t string")
    p = routers.router_postings(texts, "id", "t")
    words = {r["term"] for r in p.where(F.col("term").startswith("w:")).collect()}
    assert words == {"w:alpha", "w:beta", "w:alpha beta"}
    v = routers.to_vectors(p, "id").where("id = 0").first()["features"]
    assert v.size == p.select("term").distinct().count()
    short = routers.character_counts(spark.createDataFrame([(1, "a ab")], "id long, t string"), "id", "t")
    assert {r["term"]: r["tf"] for r in short.collect()} == {" a ": 1, " ab": 1, "ab ": 1, " ab ": 1}


def test_routed_queries_meet_one_method_only(spark):
    reg = registry.Registry()
    for m in registry.Registry.TOPS:
        reg.register(m, lambda q, k: q.select("query_id", F.lit(k).alias("rank")))
    queries = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, text string")
    routes = spark.createDataFrame([(1, "vector"), (2, "pathrag")], "query_id long, method string")
    assert {(r["query_id"], r["method"], r["rank"]) for r in reg.routed(queries, routes).collect()} == {(1, "vector", 3), (2, "pathrag", 7)}


def test_sparse_search_equals_brute_force(spark):
    texts = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 11}" for k in range(1, 6))) for i in range(40)] + [(99, None), (98, "")], "id long, t string")
    vocab = lexical.build_vocabulary(texts, "id", "t")
    vectors = lexical.sparse_vectors(texts, vocab, "id", "t")
    rows = {r["id"]: dict(zip(r["places"], r["weights"])) for r in vectors.collect()}
    dot = lambda a, b: round(sum(w * rows[b].get(p, 0.0) for p, w in rows[a].items()), 6)
    queries = vectors.where("id % 10 = 0").withColumnRenamed("id", "q")
    for blocks in (4096, 2):
        got = {}
        for r in lexical.sparse_top_k(vectors, queries, "id", "q", 3, block_queries=blocks).collect():
            got.setdefault(r["q"], []).append((r["rank"], r["id"], round(r["score"], 6)))
        for q, found in got.items():
            want = sorted(((-dot(q, i), i) for i in rows if dot(q, i) > 0))[:3]
            assert [(i, s) for _, i, s in sorted(found)] == [(i, -s) for s, i in want]
    near = lexical.term_neighbours(vectors, "id", k=2, section_texts=15)
    for src, in {(r["src"],) for r in near.collect()}:
        want = sorted(((-dot(src, i), i) for i in rows if i != src and dot(src, i) > 0.05))[:2]
        assert [(r["dst"], r["sim"]) for r in near.where(F.col("src") == src).orderBy(F.desc("sim"), "dst").collect()] == [(i, -s) for s, i in want]
    assert lexical.term_neighbours(vectors.limit(0), "id").count() == 0


def test_term_neighbours_multiply_few_pairs_and_miss_none(monkeypatch):
    monkeypatch.setattr(lexical, "TILE_FIRST", 64)
    monkeypatch.setattr(lexical, "TILE_COLUMNS", 256)
    monkeypatch.setattr(lexical, "ENTRIES", 500)
    draw = np.random.default_rng(5)
    n, terms, k = 1500, 900, 4
    texts = []
    for i in range(n):  # frequent words and two rare ones of a topic; some texts twice, some without a term
        places = np.unique(np.concatenate([(draw.pareto(1.0, 12) * 8).astype(int) % 500, 500 + (i % 200) * 2 + np.arange(2)])) if i % 97 else np.empty(0, int)
        weights = 1.0 + np.log(1.0 + places)
        texts.append((places, weights / np.sqrt((weights**2).sum()) if len(places) else weights))
    texts[700:720] = texts[:20]
    dense = np.zeros((n, terms))
    for row, (p, w) in zip(dense, texts):
        row[p] = w
    buckets = lexical.bucket_terms(dense.sum(0))
    keys = np.arange(n) * 3
    whole = lexical.Section(keys, *map(list, zip(*texts)), buckets)
    assert (whole.norms @ whole.norms.T + 1e-5 >= dense @ dense.T).all()
    for lo in (0, 600):
        tile = lexical.Section(keys[lo : lo + 200], *map(list, zip(*texts[lo : lo + 200])), buckets)
        r, c, s = whole.nearest(tile, k, 0.05, np.zeros(200))
        got = {}
        for a, b, x in zip(r.tolist(), c.tolist(), s.tolist()):
            got.setdefault(a, []).append((-x, b))
        for i in range(200):
            sims = np.round(dense[lo + i] @ dense.T, 6)
            assert got.get(i, []) == sorted((-float(x), j) for j, x in enumerate(sims) if x > 0.05 and j != lo + i)[:k]
    assert whole.multiplied < 0.25 * 400 * n


def test_routed_methods_share_one_index_and_graph(spark, data, monkeypatch):
    calls = []
    for name in ("build_vocabulary", "term_neighbours"):
        monkeypatch.setattr(lexical, name, lambda *a, name=name, made=getattr(lexical, name), **kw: calls.append(name) or made(*a, **kw))
    rows = graph_plans.routed_retrieval(spark, data).collect()
    assert {(r["method"], r["hits"]) for r in rows} <= {("vector", 3), ("lightrag", 5), ("pathrag", 7)} and len(rows) > 0
    assert sorted(calls) == ["build_vocabulary", "term_neighbours"]


def test_views_are_capped_and_count_what_is_missing(spark):
    names = [f"n{i:02d}" for i in range(30)]
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    edges = spark.createDataFrame([(a, b) for i, a in enumerate(names) for b in names[i + 1 :]], "src string, dst string")
    v = views.related_view(nodes, edges, spark.createDataFrame([(n,) for n in [*names, "gone"]], "node string"), spark.createDataFrame([("n01", "n00")], "a string, b string"), most=5)
    assert v["nodes"].count() == 5 and v["hits"].count() == 30 and v["hit_pairs"].count() == 1
    assert v["counts"].first().asDict() == {"missing": 1, "truncated": True}
    drawn, total = views.capped_edges(edges.withColumn("hit", F.col("dst") == "n29"), 3)
    assert [r["dst"] for r in drawn.orderBy("i").collect()] == ["n29"] * 3 and total.first()["truncated"]


def test_layout_keeps_nodes_apart_and_isolates_outside(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefgh"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "src string, dst string")
    assert {r["node"] for r in views.isolates(nodes, edges).collect()} == {"f", "g", "h"}
    labels = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "2"), ("e", "2")], "node string, label string")
    placed = {r["node"]: (r["x"], r["y"]) for r in views.layout(labels, edges).collect()}
    assert len(placed) == 5 and all((x - u) ** 2 + (y - v) ** 2 >= 65.9**2 for n, (x, y) in placed.items() for m, (u, v) in placed.items() if n < m)
    ring = views.ring(views.isolates(nodes, edges), 100.0).collect()
    assert len({round(r["x"] ** 2 + r["y"] ** 2) for r in ring}) == 1
    assert views.layout_key("1", "h") != views.layout_key("2", "h")
    with pytest.raises(ValueError):
        views.dual_level("other", None, None, None, edges.withColumn("edge_id", F.lit("x"))) if False else views.dual_level("other", *[nodes.select(F.lit(1).alias("query_id"), F.col("node").alias("item"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))] * 3, edges.withColumn("edge_id", F.concat("src", "dst")))


def test_runs_without_result_are_errors(spark):
    rows = spark.createDataFrame([("a", 0, "routing", None), ("a", 1, "result", "x"), ("b", 0, "routing", None)], "run_id string, seq int, type string, payload string")
    lost = [r for r in E.require_results(rows).collect() if r["payload"] == "MISSING_RESULT"]
    assert [(r["run_id"], r["seq"], r["type"]) for r in lost] == [("b", 1, "error")]


def test_history_keeps_the_newest_of_a_stream(spark, tmp_path):
    source, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    schema = "id long, created_at timestamp"
    for lo in (0, 10):
        spark.range(lo, lo + 10).select("id", F.timestamp_seconds("id").alias("created_at")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        with E.Run(E.keep_newest(stream, kept, str(tmp_path / "cp"), keep=5).trigger(availableNow=True)) as query:
            query.awaitTermination()
        assert not query.isActive
        assert sorted(r["id"] for r in E.newest_version(spark, kept).collect()) == list(range(lo + 5, lo + 10))


def test_missing_files_and_widths_are_named(spark, tmp_path):
    with pytest.raises(SourceError) as err:
        readers.read_benchmark(spark, str(tmp_path / "no.json"), str(tmp_path / "no.jsonl"))
    assert err.value.code == "MISSING_FILE"
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    writers.write_index(rows, str(tmp_path / "index"), {"model": "m"})
    assert writers.load_index(spark, str(tmp_path / "index"), {"model": "m"}, "v", 2).count() == 1
    with pytest.raises(Exception, match="INDEX_DIMENSION"):
        writers.load_index(spark, str(tmp_path / "index"), {"model": "m"}, "v", 3).collect()


def test_exact_graph_at_several_sections(spark):
    rows = spark.createDataFrame([(i, [float((i * 7) % 5), float((i * 3) % 4), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    whole = {tuple(r) for r in knn.knn_graph(rows, k=3).collect()}
    assert whole == {tuple(r) for r in knn.knn_graph(rows, k=3, section_rows=7).collect()}
