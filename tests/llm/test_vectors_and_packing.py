"""Neighbours against brute force, containers by their rules."""

import numpy as np
import pytest

from routeloom.llm import neighbours, packing


def clustered(n, d=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    return (centres[rng.integers(0, 12, n)] + 0.5 * rng.normal(size=(n, d))).astype(np.float32)


def truth(x, ids, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    return {ids[i]: [ids[j] for j in sorted(order, key=lambda j: (-s[i, j], ids[j]))[:k]] for i in range(len(ids))}


SCHEMA = "question_id string, embedding array<float>, cached_at long, id string"


def test_recall_against_brute_force(spark):
    x = clustered(1500)
    ids = [f"v{i:04d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), 1, "clash") for i, v in zip(ids, x)], SCHEMA)
    rows = neighbours.nearest_neighbours(df, k=5, dimensions=16, cell_size=100, probes=8).collect()
    got = {}
    for r in rows:
        got.setdefault(r["id"], []).append(r["neighbour"])
    t = truth(x, ids, 5)
    assert all(len(v) == 5 for v in got.values()) and len(got) == 1500
    assert sum(len(set(t[i]) & set(got[i])) for i in ids) / (5 * 1500) >= 0.95


def test_copies_ties_and_unusable_vectors(spark):
    x = clustered(40)
    rows = [(f"v{i:02d}", v.tolist(), 1, "") for i, v in enumerate(x)]
    rows += [(f"c{i}", x[0].tolist(), 1, "") for i in range(9)] + [("s", (4 * x[0]).tolist(), 1, "")]
    bad = [("null", None, 1, ""), ("short", [1.0], 1, ""), ("zero", [0.0] * 16, 1, ""), ("nan", [float("nan")] * 16, 1, ""), ("inf", [float("inf")] * 16, 1, ""), (None, x[0].tolist(), 1, "")]
    df = spark.createDataFrame(rows + rows[:3] + bad, SCHEMA)
    out = neighbours.nearest_neighbours(df, k=5, dimensions=16).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert set(got) == {r[0] for r in rows}
    t = truth(np.array([r[1] for r in rows], dtype=np.float32), [r[0] for r in rows], 5)
    assert got == t and got["v00"] == ["c0", "c1", "c2", "c3", "c4"] and got["c0"] == ["c1", "c2", "c3", "c4", "c5"]
    assert neighbours.nearest_neighbours(df.limit(0), dimensions=16).count() == 0
    assert neighbours.nearest_neighbours(df.where("question_id = 'v01'"), dimensions=16).count() == 0


def test_codes_round_trip_and_parallel_error_counts_more():
    x = clustered(400).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    base = np.zeros_like(x)
    codes = np.random.default_rng(0).integers(0, 16, (5, 8)).astype(np.uint8)
    assert (neighbours.unpack(neighbours.pack(codes)) == codes).all()
    plain = neighbours.Quantiser(16, width=2, threshold=1e-9).fit(x, base)
    aware = neighbours.Quantiser(16, width=2, threshold=0.8).fit(x, base)
    along = lambda q: np.mean(((x - q.decode(q.encode(x, base))) * x).sum(1) ** 2)
    assert along(aware) < along(plain)


def test_differencing_splits_evenly():
    groups = packing.difference([8, 7, 6, 5, 4], 2)
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in g) for g in groups)
    assert sums == [14, 16] and sorted(i for g in groups for i in g) == list(range(5))
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 500, 300).tolist()
    windows = packing.pack(sizes, 1000)
    used = np.bincount(windows, weights=sizes)
    assert used.max() <= 1000 and len(used) <= 1.04 * sum(sizes) / 1000 + 1
    assert packing.pack([0, 0, 0], 10) == [0, 0, 0] and packing.pack([10, 10], 10) in ([0, 1], [1, 0])


def test_containers(spark):
    pytest.importorskip("public_tokenizers")
    rows = [(1, "one two three", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 300, "x"), (1, "one two three", "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, container string")
    out = packing.fill_containers(df, 64).collect()
    used = {}
    for r in out:
        used[r["container"]] = used.get(r["container"], 0) + r["tokens"]
    assert max(used.values()) <= 64
    tokens = {}
    for r in out:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["tokens"]
    one = packing.count_tokens(["one two three", "word " * 300])
    assert tokens[1] == 2 * one[0] and tokens[4] == one[1] and tokens[2] == tokens[3] == 0 and None in tokens
    assert [r["tokens"] for r in out if r["doc_id"] == 4 and r["tokens"] == 64] == [64] * (one[1] // 64)
    assert packing.fill_containers(df.limit(0), 64).count() == 0
    with pytest.raises(ValueError):
        packing.fill_containers(df, 0)


def test_tokenizer_kinds_agree_with_their_files():
    pytest.importorskip("public_tokenizers")
    texts = ["Hello there", "", "naïve 中文"]
    assert packing.count_tokens(texts) == packing.count_tokens(texts, "byte_bpe_50k.json")
    assert all(n >= 0 for n in packing.count_tokens(texts, "piece_bpe_32k.model"))


def test_table_scan_ranks_as_the_decoded_product():
    x = clustered(600).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = neighbours.Quantiser(16).fit(x, np.zeros_like(x))
    codes = q.encode(x, np.zeros_like(x))
    tables = np.einsum("qpw,pcw->qpc", x[:20].reshape(20, q.parts, q.width), q.centres)
    scanned = neighbours.table_scan(tables.astype(np.float32), neighbours.pack(codes))
    decoded = q.decode(codes) @ x[:20].T
    assert scanned.shape == (600, 20)
    for k in range(20):
        best = set(np.argsort(-decoded[:, k])[:10])
        assert len(best & set(np.argsort(-scanned[:, k].astype(int), kind="stable")[:14])) >= 9


def test_two_levels_of_cells_find_the_nearest_centres():
    x = clustered(4000, seed=5).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = neighbours.Cells(x, 1100)
    assert cells.upper is not None
    found, near = cells.nearest(x[:200], 4)
    truth_ = (x[:200].astype(np.float32) @ cells.centres.T).argmax(1)
    assert (found[:, 0] == truth_).mean() > 0.95 and (np.diff(near, axis=1) <= 1e-6).all()


def test_shards_are_packed_in_several_tasks(spark):
    from pyspark.sql import functions as F

    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some words of text").alias("text"))
    packed = packing.fill_containers(df, 50, shard_items=20)
    assert packed.count() == 400
    assert packed.select(F.spark_partition_id().alias("p")).distinct().count() > 1
