"""Bounded views of a graph, what is drawn of it, and its layout. Views are for display: their caps are the feature."""

from __future__ import annotations

import math
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import graphs

#: Angle between neighbours of a spiral.
GOLDEN = 2.399963
#: Most nodes that a view may lay out; a layout is one small task.
MOST_DRAWN = 5_000


def capped_edges(edges: DataFrame, most: int | None = 200) -> tuple[DataFrame, DataFrame]:
    """Edges with ``hit``, hits first, then by name, up to the cap, each with its id; and a row (edges, truncated)."""
    total = edges.agg(F.count("*").alias("edges")).select("edges", (F.lit(most).isNotNull() & (F.col("edges") > (most or 0))).alias("truncated"))
    kept = edges.orderBy(F.desc("hit"), "src", "dst").limit(most) if most is not None else edges
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("hit"), "src", "dst")  # at most ``most`` rows, or the whole of a drawn graph
    return kept.withColumn("i", F.row_number().over(order) - 1).withColumn("edge_id", F.concat(F.lit("edge:"), T.edge_id(F.col("src"), F.col("dst"), F.col("i")))), total


def related_view(nodes: DataFrame, edges: DataFrame, entities: DataFrame, pairs: DataFrame, most: int = 80) -> dict[str, DataFrame]:
    """What is shown around hits: ``nodes`` (node, retrieved, place), ``edges`` (with hit and id), ``hits`` (all hit nodes that
    exist), ``hit_pairs`` (all hit pairs that exist) and ``counts`` (missing, truncated).

    ``entities`` has node, ``pairs`` a and b. Identifiers must be equal; nothing is matched loosely.
    """
    seeds = entities.select("node").unionByName(pairs.select(F.col("a").alias("node"))).unionByName(pairs.select(F.col("b").alias("node"))).where(F.col("node").isNotNull()).distinct()
    present = seeds.join(nodes.select("node"), "node", "left_semi")
    missing = seeds.join(nodes.select("node"), "node", "left_anti").agg(F.count("*").alias("missing"))
    shown = graphs.related(edges, present, most)
    around = graphs.related(edges, present, 1 << 30).agg(F.count("*").alias("pool"))
    marked = graphs.mark_hits(edges, pairs, directed=False)
    drawn, total = capped_edges(graphs.induced(marked, shown))
    counts = missing.join(around).join(total).select("missing", ((F.col("pool") > most) | F.col("truncated")).alias("truncated"))  # single rows
    return {
        "nodes": shown.select("node", F.col("is_seed").alias("retrieved"), "place"), "edges": drawn, "hits": present,
        "hit_pairs": marked.where("hit").select("src", "dst"), "counts": counts,
    }


def full_view(nodes: DataFrame, edges: DataFrame, hits: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """All nodes and edges with marks for what was retrieved, and how many hits the graph doesn't have."""
    wanted = hits.select("node").distinct()
    marked = nodes.join(wanted.withColumn("retrieved", F.lit(True)), "node", "left").withColumn("retrieved", F.coalesce("retrieved", F.lit(False)))
    known = edges.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
    asked = pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    missing = wanted.join(nodes, "node", "left_anti").agg(F.count("*").alias("nodes")).join(asked.join(known, ["lo", "hi"], "left_anti").agg(F.count("*").alias("pairs")))  # single rows
    return {"nodes": marked, "edges": graphs.mark_hits(edges, pairs, directed=False), "missing": missing}


def motion_candidates(nodes: DataFrame, extent: tuple[float, float, float, float], most: int = 40, budget: int = 400, degree: int = 40) -> DataFrame:
    """The first nodes in view, in order of ``position``, whose degrees fit one after the other into the budget.

    A node that doesn't fit is passed over and later smaller ones may follow, so this is a fold, not a running sum. Only
    nodes of at most ``degree`` in view reach it. Needs node, x, y, degree, position.
    """
    x1, y1, x2, y2 = extent
    seen = nodes.where(F.col("x").between(x1, x2) & F.col("y").between(y1, y2) & (F.col("degree") <= degree))
    listed = seen.agg(F.array_sort(F.collect_list(F.struct("position", "degree", "node"))).alias("ns"))
    start = F.struct(F.array().cast(listed.schema["ns"].dataType).alias("kept"), F.lit(0).cast("long").alias("sum"))

    def step(acc, x):
        fits = (F.size(acc["kept"]) < most) & (acc["sum"] + x["degree"] <= budget)
        return F.struct(F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"), (acc["sum"] + F.when(fits, x["degree"]).otherwise(0)).cast("long").alias("sum"))

    return listed.select(F.explode(F.aggregate("ns", start, step)["kept"]).alias("n")).select("n.position", "n.node", "n.degree")


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge to another node."""
    tied = edges.where(F.col("src") != F.col("dst")).select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.select("node").join(tied, "node", "left_anti")


def ring(isolated: DataFrame, reach: float, cx: float = 0.0, cy: float = 0.0) -> DataFrame:
    """(node, x, y): isolated nodes by name at equal angles on a circle outside of everything else."""
    order = Window.partitionBy(F.lit(0)).orderBy("node")  # the isolates of a drawn graph
    n = isolated.agg(F.count("*").cast("double").alias("n"))
    placed = isolated.withColumn("i", F.row_number().over(order) - 1).join(F.broadcast(n))  # one row
    radius = F.greatest(F.lit(reach + 220.0), F.col("n") * 76 / (2 * math.pi), F.lit(180.0))
    angle = F.col("i") * (2 * math.pi) / F.col("n") - math.pi / 2
    return placed.select("node", F.round(cx + radius * F.cos(angle), 3).alias("x"), F.round(cy + radius * F.sin(angle), 3).alias("y"))


def layout(communities: DataFrame, edges: DataFrame, gap: float = 66.0) -> DataFrame:
    """(node, x, y) of a graph's tied nodes: communities by size on disks that don't overlap, nodes by degree on a spiral in
    theirs, moved apart where two are too close. ``communities`` has node and label.

    A display has at most ``MOST_DRAWN`` nodes, which one task places; a larger graph is an error.
    """
    degree = graphs.degrees(edges.where(F.col("src") != F.col("dst")))
    rows = communities.join(degree, "node").select(F.lit(0).alias("one"), F.col("node").cast("string").alias("node"), F.col("label").cast("string").alias("label"), "degree")
    if rows.limit(MOST_DRAWN + 1).count() > MOST_DRAWN:
        raise ValueError(f"more than {MOST_DRAWN} nodes can't be drawn")

    def spiral(k: int, scale: float) -> tuple[float, float]:
        return math.cos(k * GOLDEN) * scale * math.sqrt(k), math.sin(k * GOLDEN) * scale * math.sqrt(k)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = sorted((sorted(zip(-g["degree"], g["node"])) for _, g in pdf.groupby("label")), key=lambda g: (-len(g), min(n for _, n in g)))
        disks: list[tuple[float, float, float]] = []
        cells: dict[tuple[int, int], list[tuple[float, float]]] = {}
        out = []
        for g in groups:
            radius, k = max(100.0, math.sqrt(len(g)) * 72), 0
            while any(math.hypot(a - x, b - y) < radius + r + 100 for x, y, r in disks for a, b in [spiral(k, 90)]):
                k += 1
            cx, cy = spiral(k, 90)
            disks.append((cx, cy, radius))
            for i, (_, node) in enumerate(g):
                dx, dy = spiral(i, 100)
                for step in range(10_000):
                    ox, oy = spiral(step, 8)
                    x, y = cx + dx + ox, cy + dy + oy
                    cell = (math.floor(x / gap), math.floor(y / gap))
                    if all((x - a) ** 2 + (y - b) ** 2 >= gap**2 for i_ in (-1, 0, 1) for j_ in (-1, 0, 1) for a, b in cells.get((cell[0] + i_, cell[1] + j_), ())):
                        break
                cells.setdefault(cell, []).append((x, y))
                out.append((node, round(x, 3), round(y, 3)))
        return pd.DataFrame(out, columns=["node", "x", "y"])

    return rows.groupBy("one").applyInPandas(place, "node string, x double, y double")


def layout_key(version: str, graph_hash: str) -> str:
    """The name under which a layout is kept: another version or graph makes another one."""
    return sha256(f"{version}\0{graph_hash}".encode()).hexdigest()


def usable_layout(positions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rules for a kept layout: a place for each node and for no other, and finite numbers."""
    from .gates import verdicts

    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return verdicts([
        ("every node placed", nodes.select("node").subtract(positions.select("node"))), ("no other node", positions.select("node").subtract(nodes.select("node"))),
        ("finite", positions.where(odd("x") | odd("y"))),
    ])


# Dual-level queries of a knowledge graph.


def _best(hits: DataFrame, k: int) -> DataFrame:
    return hits.where(F.col("rank") <= k)


def dual_level(mode: str, entity_hits: DataFrame, relation_hits: DataFrame, chunk_hits: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, kind, item, score): what a query sees of the graph in a mode.

    ``local`` takes the nearest entities and the relations at them, ``global`` the nearest relations and their entities,
    ``hybrid`` both, ``naive`` the nearest chunks, ``mix`` all. Hits have query_id, item, score, rank; relation items are
    edge ids, ``edges`` has edge_id, src, dst. An item found twice counts with its greatest score.
    """
    parts: list[DataFrame] = []
    near = _best(entity_hits, k).select("query_id", F.col("item").alias("node"), "score")
    far = _best(relation_hits, k).select("query_id", F.col("item").alias("edge_id"), "score")
    ends = edges.select("edge_id", F.explode(F.array("src", "dst")).alias("node"))
    if mode not in ("local", "global", "hybrid", "naive", "mix"):
        raise ValueError(f"unknown mode {mode}")
    if mode in ("local", "hybrid", "mix"):
        parts += [near.select("query_id", F.lit("entity").alias("kind"), F.col("node").alias("item"), "score"), near.join(ends, "node").select("query_id", F.lit("relation").alias("kind"), F.col("edge_id").alias("item"), "score")]
    if mode in ("global", "hybrid", "mix"):
        parts += [far.select("query_id", F.lit("relation").alias("kind"), F.col("edge_id").alias("item"), "score"), far.join(ends, "edge_id").select("query_id", F.lit("entity").alias("kind"), F.col("node").alias("item"), "score")]
    if mode in ("naive", "mix"):
        parts.append(_best(chunk_hits, k).select("query_id", F.lit("chunk").alias("kind"), F.col("item").cast("string").alias("item"), "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", "kind", "item").agg(F.max("score").alias("score"))


def within_budget(found: DataFrame, sizes: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """The best items of each query and kind whose sizes add up to no more than the kind's budget. ``sizes`` has kind, item, size."""
    table = F.create_map(*[F.lit(x) for pair in budgets.items() for x in pair])
    running = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "item").rowsBetween(Window.unboundedPreceding, 0)
    return found.join(sizes, ["kind", "item"]).withColumn("used", F.sum("size").over(running)).where(F.col("used") <= F.coalesce(F.element_at(table, F.col("kind")), F.lit(0)))


def source_chunks(found: DataFrame, sources: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, chunk, n, rank): the chunks named most often by a query's entities and relations. ``sources`` has kind, item, chunk."""
    named = found.join(sources, ["kind", "item"]).groupBy("query_id", "chunk").agg(F.count("*").alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), "chunk")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
