"""Graph operators against plain loops."""

import heapq

import numpy as np
from pyspark.sql import functions as F

from routeloom.operators import graphs, knn


def random_graph(spark, n=14, seed=2):
    rng = np.random.default_rng(seed)
    edges = [(i, j, float(np.round(rng.uniform(0.1, 1), 3))) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.3]
    return edges, graphs.transition(graphs.assemble(spark.createDataFrame(edges, "src long, dst long, w double")))


def test_assemble_sums_then_takes_the_greater(spark):
    df = spark.createDataFrame([(1, 2, 0.2), (1, 2, 0.3), (2, 1, 0.4), (3, 3, 1.0)], "src long, dst long, w double")
    assert {(r["src"], r["dst"]): round(r["w"], 6) for r in graphs.assemble(df).collect()} == {(1, 2): 0.5, (2, 1): 0.5}


def test_personalized_rank_matches_dense_iteration(spark):
    _, steps = random_graph(spark)
    rows = steps.collect()
    n = 1 + max(max(r["src"], r["dst"]) for r in rows)
    p = np.zeros((n, n))
    for r in rows:
        p[r["src"], r["dst"]] = r["p"]
    start = np.zeros(n)
    start[[0, 3]] = 0.75, 0.25
    rank = start.copy()
    for _ in range(12):
        rank = 0.35 * start + 0.65 * p.T @ rank
    seeds = spark.createDataFrame([(1, 0, 0.3), (1, 3, 0.1)], "query_id long, node long, score double")
    got = {r["node"]: r["rank"] for r in graphs.personalized_rank(steps, seeds).collect()}
    for node, value in got.items():
        assert abs(value - rank[node] / rank.max()) < 1e-5


def test_shortest_paths_match_dijkstra(spark):
    edges, steps = random_graph(spark, seed=5)
    cost = {(r["src"], r["dst"]): round(r["cost"], 9) for r in steps.collect()}
    dist, heap = {0: 0.0}, [(0.0, 0)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > dist[u]:
            continue
        for (a, b), c in cost.items():
            if a == u and d + c <= 12 and d + c < dist.get(b, 1e9) - 1e-12:
                dist[b] = d + c
                heapq.heappush(heap, (d + c, b))
    got = {r["node"]: r for r in graphs.shortest_paths(steps, spark.createDataFrame([(0,)], "source long"), rounds=14).collect()}
    assert set(got) == set(dist)
    for node, r in got.items():
        assert abs(r["dist"] - dist[node]) < 1e-6
        assert abs(sum(cost[a, b] for a, b in zip(r["path"], r["path"][1:])) - r["dist"]) < 1e-6


def test_related_caps_nodes_and_marks_hits(spark):
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("C", "D")], "src string, dst string")
    seeds = spark.createDataFrame([("A",)], "node string")
    assert {r["node"] for r in graphs.related(edges, seeds).collect()} == {"A", "B", "C"}
    hits = spark.createDataFrame([("B", "A")], "a string, b string")
    assert graphs.mark_hits(edges, hits, directed=False).where("hit").count() == 1
    assert graphs.mark_hits(edges, hits, directed=True).where("hit").count() == 0
    assert graphs.related(edges, seeds, most=2).count() == 2
    assert graphs.induced(edges, graphs.related(edges, seeds)).count() == 2


def test_path_edges_and_degrees(spark):
    edges = spark.createDataFrame([("A", "B"), ("C", "B"), ("D", "D")], "src string, dst string")
    paths = spark.createDataFrame([("p", ["A", "B", "C", "A"])], "path_id string, path array<string>")
    assert {(r["src"], r["dst"]) for r in graphs.path_edges(paths, edges).collect()} == {("A", "B"), ("B", "C")}
    assert {r["node"]: r["degree"] for r in graphs.degrees(edges).collect()} == {"A": 1, "B": 2, "C": 1, "D": 2}


def test_knn_and_search_match_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    sims = np.round(x @ x.T, 6)
    np.fill_diagonal(sims, -9)
    expected = {(i, int(j)) for i in range(300) for j in np.lexsort((np.arange(300), -sims[i]))[:8] if sims[i][j] > 0.05}
    assert {(r["src"], r["dst"]) for r in knn.knn_graph(df).collect()} == expected
    queries = df.where(F.col("vec_id") < 5).withColumnRenamed("vec_id", "query_id")
    got = {(r["query_id"], r["vec_id"]) for r in knn.search(df, queries, 3).collect()}
    assert got == {(i, int(j)) for i in range(5) for j in np.lexsort((np.arange(300), -sims[i]))[:3]}


def test_knn_graph_is_exact_beyond_sixteen_thousand_vectors(spark):
    rng = np.random.default_rng(7)
    n = 20_000
    x = rng.normal(size=(n, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[19_000] = x[18_000] = x[17_000]
    asked = np.unique(np.r_[17_000, 18_000, 19_000, rng.choice(n, 200, replace=False)])
    sims = np.round(x[asked] @ x.T, 6)
    sims[np.arange(len(asked)), asked] = -9
    expected = {(int(q), int(j)) for i, q in enumerate(asked) for j in np.lexsort((np.arange(n), -sims[i]))[:8]}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert {(r["src"], r["dst"]) for r in knn.knn_graph(df).where(F.col("src").isin(asked.tolist())).collect()} == expected


def test_knn_graph_is_the_same_in_sections(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(np.round(rng.normal(size=(700, 6)), 1).tolist())] + [(5, [0.3] * 6), (700, [float("nan")] * 6), (701, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = sorted(tuple(r) for r in knn.knn_graph(df, k=3).collect())
    assert whole == sorted(tuple(r) for r in knn.knn_graph(df.repartition(5), k=3, section_rows=90).collect())
    assert not any(r[0] == r[1] or 700 in r[:2] for r in whole) and len(whole) >= 3 * 690
    assert knn.knn_graph(df.limit(0)).count() == 0


def test_relational_paths_decay_and_never_revisit(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "A"), ("B", "C"), ("C", "B")], "src string, dst string")
    seeds = spark.createDataFrame([("q", "A")], "query_id string, node string")
    got = {tuple(r["path"]): r["resource"] for r in graphs.relational_paths(edges, seeds, threshold=0.3).collect()}
    assert got == {("A", "B"): 0.8, ("A", "B", "C"): 0.32}
