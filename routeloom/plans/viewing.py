"""Queries over views and layouts of the knowledge graph and dual-level retrieval from it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import graphs
from ..operators import views as V
from ..session import cut_lineage
from . import graph
from .tables import table

CAP = 40  # nodes shown around hits


def _nodes(spark, d):
    return graph._entities(spark, d).select("node").distinct()


def _hit_pairs(spark, d):
    """Relations of the first results, one name made unknown."""
    r = table(spark, d, "backend_results").where(F.col("result_id") <= 40).select(F.explode("relations").alias("r"))
    return r.select(F.col("r")["src_id"].alias("a"), F.when(F.length(F.col("r")["tgt_id"]) % 7 == 0, F.lit("nowhere")).otherwise(F.col("r")["tgt_id"]).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct()


def _view(spark, d):
    return V.related_view(_nodes(spark, d), graph._edges(spark, d), graph._hit_seeds(spark, d), _hit_pairs(spark, d), CAP)


def related_view(spark, d):
    """Counts of what is shown around hits: nodes, edges, all hits, all hit pairs, what is missing, and whether it was cut."""
    v = _view(spark, d)
    one = lambda name, df: df.agg(F.count("*").alias(name))
    return one("nodes", v["nodes"]).join(one("edges", v["edges"])).join(one("hits", v["hits"])).join(one("hit_pairs", v["hit_pairs"])).join(v["counts"])  # single rows


def related_edges(spark, d):
    return _view(spark, d)["edges"].select("src", "dst", "hit", "edge_id")


def full_view(spark, d):
    """The whole graph with marks: nodes and edges by whether they were retrieved, and hits that it doesn't have."""
    pairs = _hit_pairs(spark, d)
    hits = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    v = V.full_view(_nodes(spark, d), graph._edges(spark, d), hits, pairs)
    nodes = v["nodes"].agg(F.count("*").alias("nodes"), F.count_if("retrieved").alias("hit_nodes"))
    edges = v["edges"].agg(F.count("*").alias("edges"), F.count_if("hit").alias("hit_edges"))
    return nodes.join(edges).join(v["missing"].select(F.col("nodes").alias("missing_nodes"), F.col("pairs").alias("missing_pairs")))  # single rows


def display_search(spark, d):
    """The first labels that hold a text."""
    from ..operators.gates import display_filter

    nodes, _ = display_filter(_nodes(spark, d), graph._edges(spark, d), search="RA")
    return nodes.select("node")


def motion_candidates(spark, d):
    """Nodes that may move: a spiral by name, degrees of the graph, a budget that some don't fit."""
    deg = graphs.degrees(graph._edges(spark, d))
    n = F.col("position")
    placed = deg.select("node", F.col("degree"), F.pmod(F.conv(F.substring(F.md5("node"), 1, 8), 16, 10).cast("long"), F.lit(1000)).alias("position"))
    placed = placed.select("*", (n % 100).cast("double").alias("x"), F.floor(n / 100).cast("double").alias("y"))
    return V.motion_candidates(placed, (5.0, 0.0, 95.0, 8.0), most=12, budget=60)


def isolate_ring(spark, d):
    """Isolated nodes on a ring: countries without customers of their name, as nodes of a graph of two ties."""
    names = table(spark, d, "nation").select(F.col("n_name").alias("node"))
    edges = names.where(F.col("node").isin("FRANCE", "GERMANY")).agg(F.min("node").alias("src"), F.max("node").alias("dst")).where(F.col("src") != F.col("dst"))
    return V.ring(V.isolates(names, edges), 100.0)


def layout_rules(spark, d):
    """A layout of the first communities of the graph: every node placed, and no two nodes closer than the gap."""
    edges = graph._edges(spark, d)
    top = graphs.preview(edges, _nodes(spark, d), 60).where("degree > 0")
    inner = cut_lineage(graphs.induced(edges, top))
    seen = inner.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    labels = seen.withColumn("label", F.substring("node", 1, 1))
    placed = cut_lineage(V.layout(labels, inner))
    a, b = placed.alias("a"), placed.alias("b")
    close = a.join(b, F.col("a.node") < F.col("b.node")).where(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2) < 65.9**2)  # sixty nodes at most
    return V.usable_layout(placed, seen).unionByName(close.agg(F.count("*").alias("violations")).select(F.lit("apart").alias("rule"), "violations"))


def _dual_hits(spark, d):
    """Entities, relations and results that share letters with the queries: the three most named entities."""
    queries = graph._hit_seeds(spark, d).select(F.col("node").alias("query_id"))
    score = lambda a, b: F.round(1.0 / (1 + F.levenshtein(a, b)), 6)
    rank = lambda df: graphs_rank(df)
    ents = _nodes(spark, d).join(F.broadcast(queries)).select("query_id", F.col("node").alias("item"), score(F.col("node"), F.col("query_id")).alias("score"))  # three queries
    edges = graph._edges(spark, d).select(F.concat_ws("|", "src", "dst").alias("edge_id"), "src", "dst")
    rels = edges.join(F.broadcast(queries)).select("query_id", F.col("edge_id").alias("item"), score(F.col("edge_id"), F.col("query_id")).alias("score"))
    chunks = table(spark, d, "heldout_items").join(F.broadcast(queries)).select("query_id", F.col("item_id").cast("string").alias("item"), score(F.regexp_replace(F.substring("text", 1, 20), "[^ -~]", "?"), F.col("query_id")).alias("score"))
    return rank(ents), rank(rels), rank(chunks), edges


def graphs_rank(df):
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item"))).where(F.col("rank") <= 10)


def dual_level_modes(spark, d):
    """Entities, relations and chunks that each mode gives to the three queries."""
    parts = _dual_hits(spark, d)
    out = None
    for mode in ("local", "global", "hybrid", "naive", "mix"):
        found = V.dual_level(mode, *parts).groupBy("kind").agg(F.count("*").alias("items"), F.round(F.sum("score"), 4).alias("score")).withColumn("mode", F.lit(mode))
        out = found if out is None else out.unionByName(found)
    return out


def dual_level_budget(spark, d):
    """What of the hybrid mode fits budgets of characters."""
    found = V.dual_level("hybrid", *_dual_hits(spark, d))
    sizes = found.select("kind", "item").distinct().withColumn("size", F.length("item"))
    return V.within_budget(found, sizes, {"entity": 60, "relation": 120}).select("query_id", "kind", "item", "used")


QUERIES = {
    f.__name__: f for f in (related_view, related_edges, full_view, display_search, motion_candidates, isolate_ring, layout_rules, dual_level_modes, dual_level_budget)
}

_V = f"""{graph._KG},
hp AS (SELECT DISTINCT r['src_id'] AS a, CASE WHEN length(r['tgt_id']) % 7 = 0 THEN 'nowhere' ELSE r['tgt_id'] END AS b FROM (SELECT unnest(relations) AS r FROM backend_results WHERE result_id <= 40) WHERE r['src_id'] IS NOT NULL AND r['tgt_id'] IS NOT NULL),
allseeds AS (SELECT node FROM seeds UNION SELECT a FROM hp UNION SELECT b FROM hp), names AS (SELECT DISTINCT node FROM ents), present AS (SELECT node FROM allseeds WHERE node IN (SELECT node FROM names)),
about AS (SELECT b AS node FROM merged WHERE a IN (SELECT node FROM present) UNION SELECT a FROM merged WHERE b IN (SELECT node FROM present)),
bag AS (SELECT node, TRUE AS is_seed FROM present UNION ALL SELECT node, FALSE FROM about WHERE node NOT IN (SELECT node FROM present)),
shown AS (SELECT node FROM bag ORDER BY is_seed DESC, node LIMIT {CAP}),
marked AS (SELECT a AS src, b AS dst, EXISTS (SELECT 1 FROM hp WHERE least(hp.a, hp.b) = m.a AND greatest(hp.a, hp.b) = m.b) AS hit FROM merged m),
inner_edges AS (SELECT * FROM marked WHERE src IN (SELECT node FROM shown) AND dst IN (SELECT node FROM shown)),
drawn AS (SELECT *, row_number() OVER (ORDER BY hit DESC, src, dst) - 1 AS i FROM inner_edges QUALIFY i < 200)"""
_D = f"""{graph._KG}, names AS (SELECT DISTINCT node FROM ents), ed AS (SELECT concat(a, '|', b) AS edge_id, a, b FROM merged),
eh AS (SELECT s.node AS query_id, n.node AS item, round(1.0 / (1 + levenshtein(n.node, s.node)), 6) AS score FROM seeds s, names n QUALIFY row_number() OVER (PARTITION BY s.node ORDER BY round(1.0 / (1 + levenshtein(n.node, s.node)), 6) DESC, n.node) <= 10),
rh AS (SELECT s.node AS query_id, edge_id AS item, round(1.0 / (1 + levenshtein(edge_id, s.node)), 6) AS score FROM seeds s, ed QUALIFY row_number() OVER (PARTITION BY s.node ORDER BY round(1.0 / (1 + levenshtein(edge_id, s.node)), 6) DESC, edge_id) <= 10),
ch AS (SELECT s.node AS query_id, CAST(item_id AS VARCHAR) AS item, round(1.0 / (1 + levenshtein(regexp_replace(substr(text, 1, 20), '[^ -~]', '?', 'g'), s.node)), 6) AS score FROM seeds s, heldout_items QUALIFY row_number() OVER (PARTITION BY s.node ORDER BY round(1.0 / (1 + levenshtein(regexp_replace(substr(text, 1, 20), '[^ -~]', '?', 'g'), s.node)), 6) DESC, CAST(item_id AS VARCHAR)) <= 10),
ends AS (SELECT edge_id, a AS node FROM ed UNION ALL SELECT edge_id, b FROM ed),
loc AS (SELECT query_id, 'entity' AS kind, item, score FROM eh UNION ALL SELECT query_id, 'relation', edge_id, score FROM eh JOIN ends ON node = item),
glo AS (SELECT query_id, 'relation' AS kind, item, score FROM rh UNION ALL SELECT query_id, 'entity', node, score FROM rh JOIN ends ON edge_id = item),
chu AS (SELECT query_id, 'chunk' AS kind, item, score FROM ch),
modes AS (SELECT 'local' AS mode, * FROM loc UNION ALL SELECT 'global', * FROM glo UNION ALL SELECT 'hybrid', * FROM loc UNION ALL SELECT 'hybrid', * FROM glo UNION ALL SELECT 'naive', * FROM chu UNION ALL SELECT 'mix', * FROM loc UNION ALL SELECT 'mix', * FROM glo UNION ALL SELECT 'mix', * FROM chu),
merged_modes AS (SELECT mode, query_id, kind, item, max(score) AS score FROM modes GROUP BY ALL)"""
ORACLE_SQL = {
    "related_view": f"""WITH {_V} SELECT (SELECT count(*) FROM shown) AS nodes, (SELECT count(*) FROM drawn) AS edges, (SELECT count(*) FROM present) AS hits, (SELECT count(*) FROM marked WHERE hit) AS hit_pairs,
(SELECT count(*) FROM allseeds WHERE node NOT IN (SELECT node FROM names)) AS missing, (SELECT count(*) FROM bag) > {CAP} OR (SELECT count(*) FROM inner_edges) > 200 AS truncated""",
    "related_edges": f"WITH {_V} SELECT src, dst, hit, concat('edge:', substr(sha256(concat(src, chr(0), dst, chr(0), i)), 1, 20)) AS edge_id FROM drawn",
    "full_view": f"""WITH {_V}, h AS (SELECT a AS node FROM hp UNION SELECT b FROM hp), ap AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM hp)
SELECT (SELECT count(*) FROM names) AS nodes, (SELECT count(*) FROM names WHERE node IN (SELECT node FROM h)) AS hit_nodes, (SELECT count(*) FROM marked) AS edges, (SELECT count(*) FROM marked WHERE hit) AS hit_edges,
(SELECT count(*) FROM h WHERE node NOT IN (SELECT node FROM names)) AS missing_nodes, (SELECT count(*) FROM ap WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.a = ap.a AND m.b = ap.b)) AS missing_pairs""",
    "display_search": f"WITH {graph._KG} SELECT DISTINCT node FROM ents WHERE contains(lower(node), 'ra') ORDER BY node LIMIT 20",
    "motion_candidates": f"""WITH RECURSIVE {graph._KG}, p AS (SELECT node, degree, CAST(('0x' || substr(md5(node), 1, 8)) AS BIGINT) % 1000 AS position FROM deg),
s AS (SELECT *, row_number() OVER (ORDER BY position, degree, node) AS r FROM p WHERE position % 100 BETWEEN 5 AND 95 AND position // 100 BETWEEN 0 AND 8 AND degree <= 40),
f AS (SELECT 0::BIGINT AS r, 0::BIGINT AS kept, 0::BIGINT AS total, FALSE AS taken UNION ALL
 SELECT s.r, CASE WHEN kept < 12 AND total + degree <= 60 THEN kept + 1 ELSE kept END, CASE WHEN kept < 12 AND total + degree <= 60 THEN total + degree ELSE total END, kept < 12 AND total + degree <= 60 FROM f JOIN s ON s.r = f.r + 1)
SELECT position, node, degree FROM f JOIN s USING (r) WHERE taken""",
    "isolate_ring": f"""WITH i AS (SELECT n_name AS node, row_number() OVER (ORDER BY n_name) - 1 AS i, count(*) OVER () AS n FROM nation WHERE n_name NOT IN ('FRANCE', 'GERMANY') OR (SELECT count(*) FROM nation WHERE n_name IN ('FRANCE', 'GERMANY')) < 2)
SELECT node, round(greatest(320.0, n * 76 / {2 * math.pi!r}, 180.0) * cos(i * {2 * math.pi!r} / n - {math.pi / 2!r}), 3) AS x, round(greatest(320.0, n * 76 / {2 * math.pi!r}, 180.0) * sin(i * {2 * math.pi!r} / n - {math.pi / 2!r}), 3) AS y FROM i""",
    "layout_rules": "SELECT * FROM (VALUES ('every node placed', 0), ('no other node', 0), ('finite', 0), ('apart', 0)) v(rule, violations)",
    "dual_level_modes": f"WITH {_D} SELECT mode, kind, count(*) AS items, round(sum(score), 4) AS score FROM merged_modes GROUP BY ALL",
    "dual_level_budget": f"""WITH {_D}, u AS (SELECT query_id, kind, item, sum(length(item)) OVER (PARTITION BY query_id, kind ORDER BY score DESC, item ROWS UNBOUNDED PRECEDING) AS used FROM merged_modes WHERE mode = 'hybrid')
SELECT query_id, kind, item, used FROM u WHERE used <= CASE kind WHEN 'entity' THEN 60 ELSE 120 END""",
}
