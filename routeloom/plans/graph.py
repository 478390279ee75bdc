"""Queries over vectors and graphs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions import text as X
from ..operators import graphs, knn, lexical
from ..operators.registry import Registry
from ..session import cut_lineage
from . import text
from .tables import table

EVERY = 50  # the query set of searches: rows whose id is divisible by it


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def _queries(spark, d):
    return _vectors(spark, d).where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def unit_vectors(spark, d):
    v = _vectors(spark, d)
    return v.select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("length"), F.round(F.element_at(V.unit(F.col("embedding")), 1), 5).alias("first"))


def vector_topk(spark, d):
    return knn.search(_vectors(spark, d), _queries(spark, d), 5).select("query_id", "vec_id", "score", "rank")


def vector_threshold_sweep(spark, d):
    """Hits per threshold and depth over the best 40 of each query."""
    hits = knn.search(_vectors(spark, d), _queries(spark, d), 40)
    grid = spark.createDataFrame([(k, t) for k in (5, 10, 20, 40) for t in (0.2, 0.3, 0.4, 0.5)], "top_k int, threshold double")
    return hits.join(F.broadcast(grid), (hits["rank"] <= grid["top_k"]) & (hits["score"] >= grid["threshold"])).groupBy("top_k", "threshold").agg(  # 16 rows
        F.count("*").alias("hits"), F.countDistinct("query_id").alias("queries")
    )


def vector_knn_graph(spark, d):
    return knn.knn_graph(_vectors(spark, d))


def _chunk_graph(spark, d):
    near = vector_knn_graph(spark, d).select("src", "dst", F.col("sim").alias("w"))
    return graphs.assemble(near.unionByName(graphs.neighbour_edges(_vectors(spark, d), "vec_id")))


def chunk_graph(spark, d):
    return _chunk_graph(spark, d).select("src", "dst", F.round("w", 6).alias("w"))


def _steps(spark, d):
    """The graph's steps, built once for all that a query does with them."""
    return cut_lineage(graphs.transition(_chunk_graph(spark, d)))


def graph_transition(spark, d):
    return _steps(spark, d).select("src", "dst", F.round("p", 6).alias("p"), F.round("cost", 6).alias("cost"))


def _seeds(spark, d, k=8):
    return knn.search(_vectors(spark, d), _queries(spark, d), k).select("query_id", F.col("vec_id").alias("node"), "score", "rank")


def personalized_rank(spark, d):
    return graphs.personalized_rank(_steps(spark, d), _seeds(spark, d))


def light_topk(spark, d):
    sims = cut_lineage(_seeds(spark, d, 40))
    rank = graphs.personalized_rank(_steps(spark, d), sims.where(F.col("rank") <= 8))
    return graphs.fuse([(sims, "score", 0.55), (rank, "rank", 0.45)], 5)


def _path_parts(spark, d):
    steps = _steps(spark, d)
    sims = cut_lineage(_seeds(spark, d, 40))
    seeds = sims.where(F.col("rank") <= 4).select("query_id", "node")
    return steps, sims, seeds


def shortest_paths(spark, d):
    steps, _, seeds = _path_parts(spark, d)
    found = graphs.shortest_paths(steps, seeds.select(F.col("node").alias("source")))
    return found.select("source", "node", F.round("dist", 6).alias("dist"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def path_topk(spark, d):
    """Vectors have no clauses: the seeds are the four most similar ones. See ``text_path_topk`` for questions."""
    steps, sims, seeds = _path_parts(spark, d)
    found = graphs.distances(steps, seeds.select(F.col("node").alias("source")))
    rank = graphs.personalized_rank(steps, sims.where(F.col("rank") <= 8))
    return graphs.fuse([(sims, "score", 0.45), (rank, "rank", 0.25), (graphs.path_flow(found, seeds), "flow", 0.30)], 7)


# The same methods over chunks of texts, by terms.


def _asked(spark, d):
    """The query set of the text searches: every fiftieth held-out item."""
    return table(spark, d, "heldout_items").where(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), "text")


def _text_parts(spark, d):
    vocab, vectors = text._index(spark, d)
    return vocab, cut_lineage(vectors)


def term_knn(spark, d):
    """Each chunk's eight most similar others by terms."""
    _, vectors = _text_parts(spark, d)
    return lexical.term_neighbours(vectors, "chunk_id")


def _text_hits(vocab, vectors, asked, k):
    queries = lexical.sparse_vectors(asked, vocab, "query_id", "text")
    return lexical.sparse_top_k(vectors, queries, "chunk_id", "query_id", k).withColumnRenamed("chunk_id", "node")


def _clause_seeds(vocab, vectors, asked, hits):
    clauses = asked.select("query_id", F.posexplode(X.clauses(F.col("text"))).alias("clause", "text"))
    keyed = clauses.select((F.col("query_id") * 4 + F.col("clause")).alias("clause_id"), "text")  # at most four clauses a query
    best = lexical.sparse_top_k(vectors, lexical.sparse_vectors(keyed, vocab, "clause_id", "text"), "chunk_id", "clause_id", 1)
    first = best.select(F.floor(F.col("clause_id") / 4).alias("query_id"), F.pmod("clause_id", F.lit(4)).alias("clause"), F.col("chunk_id").alias("node"))
    return graphs.path_seeds(first, hits)


def clause_seeds(spark, d):
    """Seeds of the path method: each clause's best chunk, then the question's best until there are four."""
    vocab, vectors = _text_parts(spark, d)
    asked = _asked(spark, d)
    return _clause_seeds(vocab, vectors, asked, _text_hits(vocab, vectors, asked, 4)).select("query_id", F.col("node").alias("chunk_id"), "place")


def _text_steps(vectors):
    near = lexical.term_neighbours(vectors, "chunk_id").select("src", "dst", F.col("sim").alias("w"))
    chunks = vectors.select("chunk_id")
    return cut_lineage(graphs.transition(graphs.assemble(near.unionByName(graphs.neighbour_edges(chunks, "chunk_id")))))


def text_graph(spark, d):
    """The chunk graph by terms: near chunks and those next to each other in a document."""
    _, vectors = _text_parts(spark, d)
    return _text_steps(vectors).select("src", "dst", F.round("p", 6).alias("p"), F.round("cost", 6).alias("cost"))


class TextParts:
    """Vocabulary, vectors and graph steps of the chunks, each built when first asked for and once for all methods."""

    def __init__(self, spark, d):
        self._spark, self._d = spark, d

    @cached_property
    def index(self):
        return _text_parts(self._spark, self._d)

    @cached_property
    def steps(self):
        return _text_steps(self.index[1])


def retrieve(parts, asked, method, k=None):
    """(query_id, node, score, rank): the method's best chunks of each question; its own depth unless ``k`` is given."""
    depth = k or Registry.TOPS[method]
    vocab, vectors = parts.index
    sims = cut_lineage(_text_hits(vocab, vectors, asked, depth if method == "vector" else max(40, depth)))
    if method == "vector":
        return sims.where(F.col("rank") <= depth)
    steps = parts.steps
    rank = graphs.personalized_rank(steps, sims.where(F.col("rank") <= 8))
    if method == "lightrag":
        return graphs.fuse([(sims, "score", 0.55), (rank, "rank", 0.45)], depth)
    seeds = cut_lineage(_clause_seeds(vocab, vectors, asked, sims))
    found = graphs.distances(steps, seeds.select(F.col("node").alias("source")))
    return graphs.fuse([(sims, "score", 0.45), (rank, "rank", 0.25), (graphs.path_flow(found, seeds), "flow", 0.30)], depth)


def builtin_registry(spark, d) -> Registry:
    """The three built-in retrievers over the chunks of ``documents``, under their method names."""
    registry, parts = Registry(), TextParts(spark, d)
    for method in Registry.TOPS:
        registry.register(method, lambda queries, k, method=method: retrieve(parts, queries, method, k).withColumnRenamed("node", "item"))
    return registry


def text_light_topk(spark, d):
    return retrieve(TextParts(spark, d), _asked(spark, d), "lightrag")


def text_path_topk(spark, d):
    return retrieve(TextParts(spark, d), _asked(spark, d), "pathrag")


def routed_retrieval(spark, d):
    """Each question by the one method it is routed to: questions before the rest go by vector, then light, then path."""
    asked = _asked(spark, d)
    routes = asked.select("query_id", F.element_at(F.array(*[F.lit(m) for m in Registry.TOPS]), (F.pmod(F.floor(F.col("query_id") / EVERY), F.lit(3)) + 1).cast("int")).alias("method"))
    found = builtin_registry(spark, d).routed(asked, routes)
    return found.groupBy("query_id", "method").agg(F.count("*").alias("hits"), F.max("rank").alias("deepest"))


def label_propagation(spark, d):
    return graphs.label_propagation(_chunk_graph(spark, d).select("src", "dst").where(F.col("src") < F.col("dst")))


# The knowledge graph recorded in the results: entities, relations, paths.


def _entities(spark, d):
    e = table(spark, d, "backend_results").select(F.explode("entities").alias("e"))
    return e.select(F.col("e")["entity_name"].alias("node"), F.col("e")["entity_type"].alias("kind")).where(F.col("node").isNotNull())


def _relations(spark, d):
    r = table(spark, d, "backend_results").select(F.explode("relations").alias("r"))
    return r.select(F.col("r")["src_id"].alias("src"), F.col("r")["tgt_id"].alias("dst"), F.col("r")["description"].alias("description")).where(F.col("src").isNotNull() & F.col("dst").isNotNull())


def entity_merge(spark, d):
    """Entities merged by name: kinds seen, mentions."""
    return _entities(spark, d).groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("kind")), "<SEP>").alias("kinds"), F.count("*").alias("mentions"))


def relation_merge(spark, d):
    """Relations merged by unordered pair: weight and descriptions seen."""
    r = _relations(spark, d).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "description")
    return r.groupBy("a", "b").agg(F.count("*").alias("weight"), F.count_distinct("description").alias("descriptions"))


def _edges(spark, d):
    return relation_merge(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def graph_preview(spark, d):
    nodes = _entities(spark, d).select("node").distinct()
    return graphs.preview(_edges(spark, d), nodes)


def graph_display(spark, d):
    """Nodes with degree, size and the palette place of their kind."""
    kinds = _entities(spark, d).groupBy("node").agg(F.min("kind").alias("kind"))
    palette = kinds.select("kind").distinct()
    place = palette.join(palette.withColumnRenamed("kind", "other"), F.col("other") <= F.col("kind")).groupBy("kind").agg(F.count("*").alias("palette"))  # one row per kind
    deg = graphs.degrees(_edges(spark, d))
    out = kinds.join(deg, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).join(F.broadcast(place), "kind")
    return out.select("node", "kind", "palette", "degree", F.round(5 + F.least(F.lit(22.0), 1.8 * F.sqrt("degree")), 6).alias("size"))


def _hit_seeds(spark, d):
    """The drug named most often (ties by name) as the hit."""
    top = _entities(spark, d).groupBy("node").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(3)
    return top.select("node")


def graph_related(spark, d):
    return graphs.related(_edges(spark, d), _hit_seeds(spark, d))


def induced_edges(spark, d):
    edges = _edges(spark, d)
    return graphs.induced(edges, graphs.related(edges, _hit_seeds(spark, d)))


def hit_merge(spark, d):
    """Edges of the whole graph by whether results of one method mention them, in either direction."""
    some = table(spark, d, "backend_results").where(F.col("method") == "lightrag")
    pairs = some.select(F.explode("relations").alias("r")).select(F.col("r")["tgt_id"].alias("a"), F.col("r")["src_id"].alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct()
    return graphs.mark_hits(_edges(spark, d), pairs, directed=False).groupBy("hit").agg(F.count("*").alias("edges"))


def _paths(spark, d):
    p = table(spark, d, "backend_results").select("result_id", F.posexplode("paths").alias("no", "path"))
    return p.select(F.concat_ws("/", "result_id", "no").alias("path_id"), "path")


def verified_path_edges(spark, d):
    return graphs.path_edges(_paths(spark, d), _edges(spark, d))


def identifier_resolution(spark, d):
    """Path nodes resolved to entities as written, quoted, or without quotes."""
    names = _entities(spark, d).select("node").distinct()
    raw = _paths(spark, d).select(F.explode("path").alias("raw")).distinct()
    forms = raw.select("raw", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("raw").alias("node")), F.struct(F.lit(1).alias("o"), F.concat(F.lit('"'), "raw", F.lit('"')).alias("node")), F.struct(F.lit(2).alias("o"), F.trim(F.col("raw"), F.lit('"')).alias("node")))).alias("f"))
    found = forms.select("raw", "f.o", "f.node").join(names, "node").groupBy("raw").agg(F.min_by("node", "o").alias("node"))
    return raw.join(found, "raw", "left").groupBy(F.col("node").isNotNull().alias("resolved")).agg(F.count("*").alias("names"))


def neighbour_list(spark, d):
    """Each node's neighbours with the distinct descriptions that join them."""
    r = _relations(spark, d)
    both = r.select(F.col("src").alias("node"), F.col("dst").alias("other"), "description").unionByName(r.select(F.col("dst").alias("node"), F.col("src").alias("other"), "description"))
    return both.groupBy("node", "other").agg(F.md5(F.array_join(F.array_sort(F.collect_set("description")), " | ")).alias("labels_md5"))


def relational_paths(spark, d):
    edges = _edges(spark, d)
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seeds = _hit_seeds(spark, d).select(F.col("node").alias("query_id"), "node")
    found = graphs.relational_paths(both, seeds, threshold=0.02)
    return found.select("query_id", F.array_join("path", ">").alias("path"), "resource", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        unit_vectors, vector_topk, vector_threshold_sweep, vector_knn_graph, chunk_graph, graph_transition, personalized_rank, light_topk, shortest_paths, path_topk, term_knn, clause_seeds, text_graph, text_light_topk, text_path_topk, routed_retrieval,
        label_propagation, entity_merge, relation_merge, graph_preview, graph_display, graph_related, induced_edges, hit_merge, verified_path_edges, identifier_resolution,
        neighbour_list, relational_paths,
    )
}

_SIM = "round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6)"
_SEARCH = f"""
sims AS (SELECT q.vec_id AS query_id, e.vec_id, {_SIM} AS score FROM embeddings q, embeddings e WHERE q.vec_id % {EVERY} = 0 AND q.vec_id <> e.vec_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sims)"""
_KNN = f"""
pairs AS (SELECT q.vec_id AS src, e.vec_id AS dst, {_SIM} AS sim FROM embeddings q, embeddings e WHERE q.vec_id <> e.vec_id),
knn AS (SELECT src, dst, sim FROM pairs WHERE sim > 0.05 QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 8)"""
_GRAPH = f"""{_KNN},
adj AS (SELECT a.vec_id AS src, b.vec_id AS dst, 0.18 AS w FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
summed AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, sim AS w FROM knn UNION ALL SELECT src, dst, CAST(w AS DOUBLE) FROM adj) GROUP BY ALL),
graph AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, w FROM summed UNION ALL SELECT dst, src, w FROM summed) WHERE src <> dst GROUP BY src, dst HAVING max(w) > 0),
steps AS (SELECT src, dst, w / greatest(sum(w) OVER (PARTITION BY src), 1e-12) AS p, 1.0 / greatest(w, 1e-6) AS cost FROM graph)"""


def _rank_sql() -> str:
    out = f"{_GRAPH}, {_SEARCH},\nmass AS (SELECT query_id, vec_id AS node, greatest(score, 1e-9) AS m FROM hits WHERE rank <= 8),\nr0 AS MATERIALIZED (SELECT query_id, node, m / sum(m) OVER (PARTITION BY query_id) AS r FROM mass)"
    for i in range(1, 13):
        out += f""",
r{i} AS MATERIALIZED (SELECT query_id, node, sum(r) AS r FROM (SELECT query_id, dst AS node, 0.65 * r * p AS r FROM r{i - 1} JOIN steps ON src = node UNION ALL SELECT query_id, node, 0.35 * r FROM r0) GROUP BY ALL)"""
    return out + ",\nranks AS (SELECT query_id, node, round(r / (max(r) OVER (PARTITION BY query_id) + 1e-12), 6) AS rank FROM r12)"


def _ranks(steps: str, hits: str, prefix: str = "") -> str:
    """Twelve rounds of personalised rank over ``steps`` from the eight best of ``hits``."""
    p = prefix
    out = f"{p}mass AS (SELECT query_id, node, greatest(score, 1e-9) AS m FROM {hits} WHERE rank <= 8),\n{p}r0 AS MATERIALIZED (SELECT query_id, node, m / sum(m) OVER (PARTITION BY query_id) AS r FROM {p}mass)"
    for i in range(1, 13):
        out += f""",
{p}r{i} AS MATERIALIZED (SELECT query_id, node, sum(r) AS r FROM (SELECT query_id, dst AS node, 0.65 * r * p AS r FROM {p}r{i - 1} JOIN {steps} ON src = node UNION ALL SELECT query_id, node, 0.35 * r FROM {p}r0) GROUP BY ALL)"""
    return out + f",\n{p}ranks AS (SELECT query_id, node, round(r / (max(r) OVER (PARTITION BY query_id) + 1e-12), 6) AS rank FROM {p}r12)"


def _paths_sql(steps: str, seeds: str) -> str:
    """Least distances from ``seeds`` by full relaxation, predecessors of least name, and the paths they make."""
    out = f"""costs AS MATERIALIZED (SELECT src, dst, round(cost, 9) AS cost FROM {steps}),
d0 AS MATERIALIZED (SELECT DISTINCT node AS source, node, 0.0::DOUBLE AS dist, CAST(-1 AS BIGINT) AS pred FROM {seeds})"""
    for i in range(1, 13):
        out += f""",
d{i} AS MATERIALIZED (SELECT * FROM (SELECT * FROM d{i - 1} UNION ALL SELECT source, dst, round(dist + cost, 9), node FROM d{i - 1} JOIN costs ON src = node WHERE round(dist + cost, 9) <= 12)
  QUALIFY row_number() OVER (PARTITION BY source, node ORDER BY dist, pred) = 1)"""
    return out + """,
walk AS (SELECT source, node, dist, node AS spot, CAST(node AS VARCHAR) AS path, [node] AS nodes, 0 AS n FROM d12
  UNION ALL SELECT w.source, w.node, w.dist, d.pred, d.pred || '>' || w.path, list_prepend(d.pred, w.nodes), n + 1 FROM walk w JOIN d12 d ON d.source = w.source AND d.node = w.spot WHERE w.spot <> w.source AND n < 12),
paths AS (SELECT source, node, dist, path, nodes FROM walk WHERE spot = source)"""


def _flow_sql(seeds: str) -> str:
    return f"""seed_pairs AS (SELECT a.query_id, a.node AS source, b.node AS target FROM {seeds} a JOIN {seeds} b ON a.query_id = b.query_id AND a.place < b.place),
counted AS (SELECT query_id, node, count(*)::DOUBLE AS flow FROM (SELECT query_id, unnest(nodes) AS node FROM seed_pairs JOIN paths ON paths.source = seed_pairs.source AND paths.node = seed_pairs.target UNION ALL SELECT query_id, node FROM {seeds}) GROUP BY ALL),
flows AS (SELECT query_id, node, flow / max(flow) OVER (PARTITION BY query_id) AS flow FROM counted)"""


def _fused(parts: str, k: int) -> str:
    return f"""fused AS (SELECT query_id, node, round(sum(s), 6) AS score FROM ({parts}) GROUP BY ALL)
SELECT query_id, node, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS rank FROM fused QUALIFY rank <= {k}"""


_VECTOR_SEEDS = "seeds4 AS (SELECT query_id, vec_id AS node, vec_id AS place FROM hits WHERE rank <= 4)"
_TEXT = f"""{text._POSTINGS},
asked AS (SELECT item_id AS query_id, text FROM heldout_items WHERE item_id % {EVERY} = 0),
qtf AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({text._STOP}, x))) AS term FROM asked) GROUP BY ALL),
qraw AS (SELECT query_id, term, (1.0 + ln(tf)) * idf AS w FROM qtf JOIN vocab USING (term)),
q AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS qw FROM qraw),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS rank FROM (SELECT query_id, chunk_id AS node, round(sum(qw * weight), 6) AS score FROM q JOIN postings USING (term) GROUP BY ALL) WHERE score > 0)"""
_CLAUSES = f"""{_TEXT},
cl AS (SELECT query_id, list_slice(list_filter(list_filter(list_transform(regexp_split_to_array(lower(text), '\\b(?:and|with|while|versus|compared to|because|if)\\b|[,;?]'), lambda x: trim(x)), lambda x: x <> ''),
  lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> '')) >= 2), 1, 4) AS s FROM asked),
clause AS (SELECT query_id, unnest(generate_series(0, len(s) - 1)) AS clause, unnest(s) AS c FROM cl),
ctf AS (SELECT query_id, clause, term, count(*) AS tf FROM (SELECT query_id, clause, unnest(list_filter(regexp_extract_all(c, '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({text._STOP}, x))) AS term FROM clause) GROUP BY ALL),
craw AS (SELECT query_id, clause, term, (1.0 + ln(tf)) * idf AS w FROM ctf JOIN vocab USING (term)),
cw AS (SELECT query_id, clause, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id, clause)) AS qw FROM craw),
chits AS (SELECT * FROM (SELECT query_id, clause, chunk_id AS node, round(sum(qw * weight), 6) AS score FROM cw JOIN postings USING (term) GROUP BY ALL) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, clause ORDER BY score DESC, node) = 1),
pool AS (SELECT query_id, node, 0 AS kind, clause AS spot FROM chits UNION ALL SELECT query_id, node, 1, rank FROM hits WHERE rank <= 4),
once AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY query_id, node ORDER BY kind, spot) = 1),
seeds4 AS (SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY kind, spot) AS place FROM once QUALIFY place <= 4)"""
_TERM_GRAPH = """
tknn AS (SELECT * FROM (SELECT a.chunk_id AS src, b.chunk_id AS dst, round(sum(a.weight * b.weight), 6) AS sim FROM postings a JOIN postings b ON a.term = b.term AND a.chunk_id <> b.chunk_id GROUP BY ALL) WHERE sim > 0.05
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 8),
tadj AS (SELECT a.chunk_id AS src, b.chunk_id AS dst, 0.18::DOUBLE AS w FROM chunks a JOIN chunks b ON b.chunk_id = a.chunk_id + 1),
tsum AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, sim AS w FROM tknn UNION ALL SELECT src, dst, w FROM tadj) GROUP BY ALL),
tgraph AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, w FROM tsum UNION ALL SELECT dst, src, w FROM tsum) WHERE src <> dst GROUP BY src, dst HAVING max(w) > 0),
tsteps AS MATERIALIZED (SELECT src, dst, w / greatest(sum(w) OVER (PARTITION BY src), 1e-12) AS p, 1.0 / greatest(w, 1e-6) AS cost FROM tgraph)"""


def _propagation() -> str:
    out = "l0 AS (SELECT DISTINCT src AS node, src AS label FROM both_ways)"
    for i in range(1, 6):
        out += f""",
l{i} AS MATERIALIZED (SELECT src AS node, label FROM (SELECT src, label, count(*) AS n FROM both_ways JOIN l{i - 1} ON node = dst GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, label) = 1)"""
    return out


_KG = """
ent AS (SELECT e['entity_name'] AS node, e['entity_type'] AS kind FROM (SELECT unnest(entities) AS e FROM backend_results)),
ents AS (SELECT * FROM ent WHERE node IS NOT NULL),
rel AS (SELECT r['src_id'] AS src, r['tgt_id'] AS dst, r['description'] AS description FROM (SELECT unnest(relations) AS r FROM backend_results)),
rels AS (SELECT * FROM rel WHERE src IS NOT NULL AND dst IS NOT NULL),
merged AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS weight, count(DISTINCT description) AS descriptions FROM rels GROUP BY 1, 2),
deg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM merged UNION ALL SELECT b FROM merged) GROUP BY node),
seeds AS (SELECT node FROM ents GROUP BY node ORDER BY count(*) DESC, node LIMIT 3)"""
_RELATED = f"""{_KG},
around AS (SELECT DISTINCT node FROM (SELECT b AS node FROM merged WHERE a IN (SELECT node FROM seeds) UNION ALL SELECT a FROM merged WHERE b IN (SELECT node FROM seeds)) WHERE node NOT IN (SELECT node FROM seeds)),
pool AS (SELECT node, TRUE AS is_seed FROM seeds UNION ALL SELECT node, FALSE FROM around),
related AS (SELECT node, is_seed, row_number() OVER (ORDER BY is_seed DESC, node) AS place FROM pool QUALIFY place <= 80)"""
_PATHS = """
raw_paths AS (SELECT result_id, unnest(paths) AS path, unnest(generate_series(0, len(paths) - 1)) AS no FROM backend_results WHERE len(paths) > 0),
path_nodes AS (SELECT concat(result_id, '/', no) AS path_id, path, unnest(path) AS src, unnest(generate_series(0, len(path) - 1)) AS pos FROM raw_paths)"""

ORACLE_SQL = {
    "unit_vectors": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)
SELECT vec_id, round(n, 5) AS length, round(e[1] / n, 5) AS first FROM v""",
    "vector_topk": f"WITH {_SEARCH} SELECT query_id, vec_id, score, rank FROM hits WHERE rank <= 5",
    "vector_threshold_sweep": f"""
WITH {_SEARCH}, grid AS (SELECT k AS top_k, CAST(t AS DOUBLE) AS threshold FROM (SELECT unnest([5, 10, 20, 40]) AS k), (SELECT unnest([0.2, 0.3, 0.4, 0.5]) AS t))
SELECT top_k, threshold, count(*) AS hits, count(DISTINCT query_id) AS queries FROM hits JOIN grid ON rank <= top_k AND score >= threshold WHERE rank <= 40 GROUP BY ALL""",
    "vector_knn_graph": f"WITH {_KNN} SELECT src, dst, sim FROM knn",
    "chunk_graph": f"WITH {_GRAPH} SELECT src, dst, round(w, 6) AS w FROM graph",
    "graph_transition": f"WITH {_GRAPH} SELECT src, dst, round(p, 6) AS p, round(cost, 6) AS cost FROM steps",
    "personalized_rank": f"WITH {_rank_sql()} SELECT query_id, node, rank FROM ranks",
    "light_topk": f"""
WITH {_rank_sql()},
fused AS (SELECT query_id, node, round(sum(s), 6) AS score FROM (SELECT query_id, vec_id AS node, score * 0.55 AS s FROM hits WHERE rank <= 40 UNION ALL SELECT query_id, node, rank * 0.45 FROM ranks) GROUP BY ALL)
SELECT query_id, node, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS rank FROM fused QUALIFY rank <= 5""",
    "shortest_paths": f"WITH RECURSIVE {_GRAPH}, {_SEARCH}, {_VECTOR_SEEDS}, {_paths_sql('steps', 'seeds4')} SELECT source, node, round(dist, 6) AS dist, path FROM paths",
    "path_topk": f"WITH RECURSIVE {_GRAPH}, {_SEARCH}, {_VECTOR_SEEDS}, {_paths_sql('steps', 'seeds4')}, vhits AS (SELECT query_id, vec_id AS node, score, rank FROM hits), {_ranks('steps', 'vhits')}, {_flow_sql('seeds4')}, "
    + _fused("SELECT query_id, node, score * 0.45 AS s FROM vhits WHERE rank <= 40 UNION ALL SELECT query_id, node, rank * 0.25 FROM ranks UNION ALL SELECT query_id, node, flow * 0.30 FROM flows", 7),
    "term_knn": f"WITH {text._POSTINGS}, {_TERM_GRAPH} SELECT src, dst, sim FROM tknn",
    "text_graph": f"WITH {text._POSTINGS}, {_TERM_GRAPH} SELECT src, dst, round(p, 6) AS p, round(cost, 6) AS cost FROM tsteps",
    "clause_seeds": f"WITH {_CLAUSES} SELECT query_id, node AS chunk_id, place FROM seeds4",
    "text_light_topk": f"WITH {_TEXT}, {_TERM_GRAPH}, {_ranks('tsteps', 'hits')}, " + _fused("SELECT query_id, node, score * 0.55 AS s FROM hits WHERE rank <= 40 UNION ALL SELECT query_id, node, rank * 0.45 FROM ranks", 5),
    "text_path_topk": f"WITH RECURSIVE {_CLAUSES}, {_TERM_GRAPH}, {_paths_sql('tsteps', 'seeds4')}, {_ranks('tsteps', 'hits')}, {_flow_sql('seeds4')}, "
    + _fused("SELECT query_id, node, score * 0.45 AS s FROM hits WHERE rank <= 40 UNION ALL SELECT query_id, node, rank * 0.25 FROM ranks UNION ALL SELECT query_id, node, flow * 0.30 FROM flows", 7),
    "routed_retrieval": f"SELECT item_id AS query_id, ['vector', 'lightrag', 'pathrag'][item_id // {EVERY} % 3 + 1] AS method, [3, 5, 7][item_id // {EVERY} % 3 + 1] AS hits, [3, 5, 7][item_id // {EVERY} % 3 + 1] AS deepest FROM heldout_items WHERE item_id % {EVERY} = 0",
    "label_propagation": f"WITH {_GRAPH}, both_ways AS (SELECT DISTINCT src, dst FROM graph), {_propagation()} SELECT node, label FROM l5",
    "relational_paths": """WITH {kg}, both_ways AS (SELECT a AS src, b AS dst FROM merged UNION ALL SELECT b, a FROM merged), moves AS (SELECT src, dst, 0.8::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM both_ways),
h1 AS (SELECT s.node AS query_id, [s.node, m.dst] AS path, m.dst AS spot, share AS resource FROM seeds s JOIN moves m ON m.src = s.node WHERE m.dst <> s.node AND share >= 0.02),
h2 AS (SELECT query_id, list_append(path, m.dst) AS path, m.dst AS spot, resource * share AS resource FROM h1 JOIN moves m ON m.src = spot WHERE NOT list_contains(path, m.dst) AND resource * share >= 0.02),
h3 AS (SELECT query_id, list_append(path, m.dst) AS path, m.dst AS spot, resource * share AS resource FROM h2 JOIN moves m ON m.src = spot WHERE NOT list_contains(path, m.dst) AND resource * share >= 0.02)
SELECT query_id, array_to_string(path, '>') AS path, round(resource, 6) AS resource, row_number() OVER (PARTITION BY query_id ORDER BY resource DESC, path) AS rank
FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) QUALIFY rank <= 40""".replace("{kg}", _KG),
    "entity_merge": f"WITH {_KG} SELECT node, array_to_string(list_sort(list(DISTINCT kind)), '<SEP>') AS kinds, count(*) AS mentions FROM ents GROUP BY node",
    "relation_merge": f"WITH {_KG} SELECT * FROM merged",
    "graph_preview": f"WITH {_KG} SELECT node, coalesce(degree, 0) AS degree FROM (SELECT DISTINCT node FROM ents) LEFT JOIN deg USING (node) ORDER BY degree DESC, node LIMIT 60",
    "graph_display": f"""
WITH {_KG}, kinds AS (SELECT node, min(kind) AS kind FROM ents GROUP BY node)
SELECT node, kind, dense_rank() OVER (ORDER BY kind) AS palette, coalesce(degree, 0) AS degree, round(5 + least(22.0, 1.8 * sqrt(coalesce(degree, 0))), 6) AS size FROM kinds LEFT JOIN deg USING (node)""",
    "graph_related": f"WITH {_RELATED} SELECT node, is_seed, place FROM related",
    "induced_edges": f"WITH {_RELATED} SELECT a AS src, b AS dst FROM merged WHERE a IN (SELECT node FROM related) AND b IN (SELECT node FROM related)",
    "hit_merge": f"""
WITH {_KG}, h AS (SELECT unnest(relations) AS r FROM backend_results WHERE method = 'lightrag'), hits AS (SELECT DISTINCT least(r['src_id'], r['tgt_id']) AS a, greatest(r['src_id'], r['tgt_id']) AS b FROM h)
SELECT m.a IN (SELECT a FROM hits) AND EXISTS (SELECT 1 FROM hits h WHERE h.a = m.a AND h.b = m.b) AS hit, count(*) AS edges FROM merged m GROUP BY 1""",
    "verified_path_edges": f"""
WITH {_KG}, {_PATHS}
SELECT path_id, pos, src, path[pos + 2] AS dst FROM path_nodes WHERE pos + 1 < len(path) AND EXISTS (SELECT 1 FROM merged m WHERE (m.a = src AND m.b = path[pos + 2]) OR (m.b = src AND m.a = path[pos + 2]))""",
    "identifier_resolution": f"""
WITH {_KG}, {_PATHS}, raw AS (SELECT DISTINCT src AS raw FROM path_nodes), names AS (SELECT DISTINCT node FROM ents)
SELECT (raw IN (SELECT node FROM names) OR concat('"', raw, '"') IN (SELECT node FROM names) OR trim(raw, '"') IN (SELECT node FROM names)) AS resolved, count(*) AS names FROM raw GROUP BY 1""",
    "neighbour_list": f"""
WITH {_KG} SELECT node, other, md5(array_to_string(list_sort(list(DISTINCT description)), ' | ')) AS labels_md5
FROM (SELECT src AS node, dst AS other, description FROM rels UNION ALL SELECT dst, src, description FROM rels) GROUP BY ALL""",
}
