"""Graphs as edge tables: assembly, ranks, paths, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def neighbour_edges(nodes: DataFrame, node: str, group: str | None = None, weight: float = 0.18) -> DataFrame:
    """(src, dst, w) between consecutive nodes, within ``group`` where given."""
    if group:
        order = Window.partitionBy(group).orderBy(node)
        pairs = nodes.withColumn("dst", F.lead(node).over(order))
        return pairs.where(F.col("dst").isNotNull()).select(F.col(node).alias("src"), "dst", F.lit(weight).alias("w"))
    # Dense numbering: the successor is found by an equi-join, no global window.
    after = nodes.select((F.col(node) - 1).alias("src"), F.col(node).alias("dst"))
    return nodes.select(F.col(node).alias("src")).join(after, "src").select("src", "dst", F.lit(weight).alias("w"))


def assemble(edges: DataFrame) -> DataFrame:
    """Symmetric weights: duplicates summed, then the greater of both directions; no loops or non-positive weights."""
    summed = edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    both = summed.unionByName(summed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.max("w").alias("w")).where((F.col("src") != F.col("dst")) & (F.col("w") > 0))


def transition(edges: DataFrame) -> DataFrame:
    """(src, dst, w, p, cost): the share of the source's weight, and the cost 1 / w.

    Out-weights are aggregated and joined back, so a hub's edges are never gathered in one task.
    """
    out = edges.groupBy("src").agg(F.sum("w").alias("total"))
    return edges.join(out, "src").select(
        "src", "dst", "w", (F.col("w") / F.greatest(F.col("total"), F.lit(1e-12))).alias("p"), (1.0 / F.greatest(F.col("w"), F.lit(1e-6))).alias("cost")
    )


def personalized_rank(steps: DataFrame, seeds: DataFrame, iterations: int = 12, restart: float = 0.35, cut_every: int = 4) -> DataFrame:
    """(query_id, node, rank): ranks of all queries at once, scaled to a maximum of one per query.

    ``seeds`` has (query_id, node, score); start mass is in proportion to max(score, 1e-9).
    """
    mass = seeds.select("query_id", "node", F.greatest("score", F.lit(1e-9)).alias("m"))
    totals = mass.groupBy("query_id").agg(F.sum("m").alias("t"))
    start = mass.join(totals, "query_id").select("query_id", "node", (F.col("m") / F.col("t")).alias("s"))
    start = cut_lineage(start)
    rank = start.select("query_id", "node", F.col("s").alias("r"))
    moves = cut_lineage(steps.select(F.col("src").alias("node"), "dst", "p"))
    for i in range(iterations):
        spread = rank.join(moves, "node").select("query_id", F.col("dst").alias("node"), ((1 - restart) * F.col("r") * F.col("p")).alias("r"))
        rank = spread.unionByName(start.select("query_id", "node", (restart * F.col("s")).alias("r"))).groupBy("query_id", "node").agg(F.sum("r").alias("r"))
        if (i + 1) % cut_every == 0:
            rank = cut_lineage(rank)
    top = rank.groupBy("query_id").agg(F.max("r").alias("top"))
    return rank.join(top, "query_id").select("query_id", "node", F.round(F.col("r") / (F.col("top") + 1e-12), 6).alias("rank"))


def distances(steps: DataFrame, sources: DataFrame, limit: float = 12.0, rounds: int = 12) -> DataFrame:
    """(source, node, dist, pred): least cost from each source within the limit, and the node before.

    Rounds of frontier relaxation: only nodes whose distance fell in the last round go on, and only what they reach is
    compared with what is known. A tie goes to the smaller predecessor; a source has the predecessor null. Costs and
    distances are rounded to nine digits, so ties don't depend on summation order. No path is carried along.
    """
    costs = cut_lineage(steps.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.round("cost", 9).alias("cost")))
    kind = costs.schema["next"].dataType
    best = sources.select("source").distinct().select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast(kind).alias("pred"))
    best = frontier = cut_lineage(best)
    for _ in range(rounds):
        grown = (
            frontier.select("source", "node", "dist")
            .join(costs, "node")
            .select("source", F.col("next").alias("node"), F.round(F.col("dist") + F.col("cost"), 9).alias("dist"), F.col("node").alias("pred"))
            .where(F.col("dist") <= limit)
        )
        # One small row per offer; partial minima are taken before the shuffle.
        pool = best.withColumn("old", F.col("dist")).unionByName(grown.withColumn("old", F.lit(None).cast("double")))
        chosen = pool.groupBy("source", "node").agg(F.min(F.struct("dist", "pred")).alias("x"), F.min("old").alias("old"))
        chosen = cut_lineage(chosen.select("source", "node", "x.dist", "x.pred", (F.col("old").isNull() | (F.col("x.dist") < F.col("old"))).alias("nearer")))
        best, frontier = chosen.drop("nearer"), chosen.where("nearer")
        if frontier.isEmpty():
            break
    return best


def trace(found: DataFrame, pairs: DataFrame, steps: int = 12) -> DataFrame:
    """(source, node, dist, path) of the wanted (source, node) pairs: predecessors followed back, at most so many steps."""
    before = found.select("source", F.col("node").alias("at"), "pred")
    walk = pairs.select("source", "node").distinct().join(found.select("source", "node", "dist"), ["source", "node"]).withColumn("at", F.col("node")).withColumn("path", F.array("node"))
    for i in range(steps):
        goes_on = F.col("at") != F.col("source")
        walk = walk.join(before, ["source", "at"], "left").select(
            "source", "node", "dist", F.when(goes_on, F.col("pred")).otherwise(F.col("at")).alias("at"), F.when(goes_on, F.concat(F.array("pred"), "path")).otherwise(F.col("path")).alias("path")
        )
        if i % 3 == 2:
            walk = cut_lineage(walk)
            if i + 1 < steps and walk.where(F.col("at") != F.col("source")).isEmpty():
                break
    return walk.where(F.col("at") == F.col("source")).drop("at")


def shortest_paths(steps: DataFrame, sources: DataFrame, limit: float = 12.0, rounds: int = 12) -> DataFrame:
    """(source, node, dist, path): cheapest paths from each source to every node within the limit, of at most ``rounds`` steps."""
    found = distances(steps, sources, limit, rounds)
    return trace(found, found, rounds)


def path_flow(found: DataFrame, seeds: DataFrame, steps: int = 12) -> DataFrame:
    """(query_id, node, flow): one for each seed and for each node on a path between two of the query's seeds, over the greatest.

    ``found`` has distances and predecessors from the seeds; a pair's path goes from the seed of lesser ``place`` to the
    other (of lesser node where there is no place). Only these pairs are traced.
    """
    place = F.col("place") if "place" in seeds.columns else F.col("node")
    own = seeds.select("query_id", "node", place.alias("place"))
    pairs = (
        own.select("query_id", F.col("node").alias("source"), F.col("place").alias("first"))
        .join(own.select("query_id", F.col("node").alias("target"), F.col("place").alias("second")), "query_id")  # at most a handful of seeds per query
        .where(F.col("first") < F.col("second"))
    )
    paths = trace(found, pairs.select("source", F.col("target").alias("node")), steps)
    on_path = pairs.join(paths.select("source", F.col("node").alias("target"), "path"), ["source", "target"]).select("query_id", F.explode("path").alias("node"))
    counted = on_path.unionByName(seeds.select("query_id", "node")).groupBy("query_id", "node").agg(F.count("*").cast("double").alias("flow"))
    top = counted.groupBy("query_id").agg(F.max("flow").alias("top"))
    return counted.join(top, "query_id").select("query_id", "node", (F.col("flow") / F.col("top")).alias("flow"))


def path_seeds(clause_hits: DataFrame, hits: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, node, place): the best node of each clause in clause order, once each, then the best hits until there are ``most``.

    ``clause_hits`` has (query_id, clause, node), ``hits`` (query_id, node, rank).
    """
    pool = clause_hits.select("query_id", "node", F.struct(F.lit(0).alias("kind"), F.col("clause").cast("int").alias("at")).alias("o")).unionByName(
        hits.where(F.col("rank") <= most).select("query_id", "node", F.struct(F.lit(1).alias("kind"), F.col("rank").cast("int").alias("at")).alias("o"))
    )
    firsts = pool.groupBy("query_id", "node").agg(F.min("o").alias("o"))  # at most 2 * most rows a query
    order = Window.partitionBy("query_id").orderBy("o")
    return firsts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query_id", "node", "place")


def fuse(parts: list[tuple[DataFrame, str, float]], k: int) -> DataFrame:
    """(query_id, node, score, rank): weighted sums of scores, absent ones as zero, and the k best per query."""
    stacked = None
    for frame, column, weight in parts:
        one = frame.select("query_id", "node", (F.col(column) * weight).alias("s"))
        stacked = one if stacked is None else stacked.unionByName(one)
    scored = stacked.groupBy("query_id", "node").agg(F.round(F.sum("s"), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) of an undirected edge list; a loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def preview(edges: DataFrame, nodes: DataFrame, most: int = 60) -> DataFrame:
    """The nodes of highest degree, ties by name."""
    return nodes.join(degrees(edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).orderBy(F.desc("degree"), "node").limit(most)


def related(edges: DataFrame, seeds: DataFrame, most: int = 80) -> DataFrame:
    """(node, is_seed, place): seeds by name, then their neighbours by name, up to the cap.

    The cap is a display limit: the best are taken by a sort with limit, not a window over all nodes.
    """
    hits = seeds.select("node").distinct()
    around = (
        edges.join(hits.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
        .unionByName(edges.join(hits.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")))
        .distinct()
        .join(hits, "node", "left_anti")
    )
    pool = hits.withColumn("is_seed", F.lit(True)).unionByName(around.withColumn("is_seed", F.lit(False)))
    capped = pool.orderBy(F.desc("is_seed"), "node").limit(most)
    place = Window.partitionBy(F.lit(0)).orderBy(F.desc("is_seed"), "node")  # at most ``most`` rows
    return capped.withColumn("place", F.row_number().over(place))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    keep = nodes.select("node").distinct()
    return edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi")


def mark_hits(edges: DataFrame, hits: DataFrame, directed: bool) -> DataFrame:
    """Edges with a flag for the pairs among ``hits`` (a, b), in either order unless directed."""
    if directed:
        wanted = hits.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct().withColumn("hit", F.lit(True))
        return edges.join(wanted, ["src", "dst"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    wanted = hits.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct().withColumn("hit", F.lit(True))
    both = edges.withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))
    return both.join(wanted, ["lo", "hi"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))).drop("lo", "hi")


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Consecutive pairs of each path that are edges: (path_id, pos, src, dst)."""
    nodes = paths.select("path_id", F.posexplode("path").alias("pos", "src"), "path")
    steps = nodes.withColumn("dst", F.try_element_at("path", F.col("pos") + 2)).where(F.col("dst").isNotNull()).drop("path")
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return steps.join(both, ["src", "dst"], "left_semi").select("path_id", "pos", "src", "dst")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label): communities by synchronous label propagation, ties to the smaller label."""
    both = cut_lineage(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels, both["dst"] == labels["node"]).groupBy("src", "label").agg(F.count("*").alias("n"))
        labels = cut_lineage(votes.groupBy(F.col("src").alias("node")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label")))
    return labels


def relational_paths(edges: DataFrame, seeds: DataFrame, hops: int = 3, decay: float = 0.8, threshold: float = 0.3, k: int = 40) -> DataFrame:
    """(query_id, path, resource): paths from seeds without revisits whose passed-on resource stays above the threshold.

    A node shares its resource, times the decay, evenly among its edges. Branches below the threshold end, which
    bounds the width: at most decay^h / threshold paths of h hops go on from one seed.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("n"))
    moves = cut_lineage(edges.join(out, "src").select("src", "dst", (F.lit(decay) / F.col("n")).alias("share")))
    frontier = seeds.select("query_id", F.array("node").alias("path"), F.col("node").alias("at"), F.lit(1.0).alias("resource"))
    found = None
    for _ in range(hops):
        frontier = (
            frontier.join(moves, frontier["at"] == moves["src"])
            .where(~F.array_contains("path", F.col("dst")))
            .select("query_id", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"), (F.col("resource") * F.col("share")).alias("resource"))
            .where(F.col("resource") >= threshold)
        )
        frontier = cut_lineage(frontier)
        found = frontier if found is None else found.unionByName(frontier)
    order = Window.partitionBy("query_id").orderBy(F.desc("resource"), "path")
    return found.withColumn("resource", F.round("resource", 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("at")
