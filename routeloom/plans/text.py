"""Queries over texts: windows, terms, sentences, evidence, lexical retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences
from ..functions import text as X
from ..operators import checks, chunking, lexical
from .tables import table

SIZE, OVERLAP, TOP = 180, 40, 3
#: Chunk ids of a document: no text that fits a string has so many chunks.
CHUNKS = 1 << 24


def word_chunks(spark, d):
    c = chunking.word_chunks(table(spark, d, "documents"), size=SIZE, overlap=OVERLAP)
    return c.select("doc_id", "chunk_no", "start_word", "n_words", F.md5("chunk").alias("chunk_md5"))


def tail_windows(spark, d):
    c = chunking.word_chunks(table(spark, d, "corpus_documents"), "corpus_doc_id", "context", 120, 10, tail=True)
    return c.groupBy("corpus_doc_id").agg(F.count("*").alias("windows"), F.min("n_words").alias("shortest"), F.sum("n_words").alias("words"))


def content_terms(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.array_sort(X.content_terms(F.col("text"))).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("terms_md5"))


def sentence_split(spark, d):
    s = table(spark, d, "documents").select("doc_id", X.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


def clause_split(spark, d):
    return table(spark, d, "heldout_items").select("item_id", F.posexplode(X.clauses(F.col("text"))).alias("pos", "clause"))


def doc_stats(spark, d):
    docs = table(spark, d, "corpus_documents").where(F.col("context").isNotNull())
    return docs.select(
        "corpus_doc_id", F.length("context").cast("long").alias("characters"), X.whitespace_word_count(F.col("context")).cast("long").alias("words"),
        F.coalesce(F.col("character_count") == F.length("context"), F.lit(False)).alias("count_right"),
    )


def shortest_doc(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").alias("characters")).orderBy("characters", "doc_id").limit(1)


def evidence_statements(spark, d):
    q = table(spark, d, "p0_questions").where(F.col("evidence").isNotNull())
    return q.select(F.explode(X.split_evidence(F.col("evidence"))).alias("statement")).groupBy("statement").agg(F.count("*").alias("n"))


def evidence_nested(spark, d):
    q = table(spark, d, "p0_questions").where(F.col("evidence").isNotNull()).groupBy("id").agg(F.max("evidence").alias("evidence"))
    return q.select("id", F.size(X.split_evidence_nested(F.col("evidence"))).alias("statements"))


#: Texts whose semicolons stand in and outside brackets of three kinds, closed, unclosed and without partner.
NESTED = (
    "t(11;22) translocation.; A second statement.", "a; b ;; c", "a (x; y) b; c [d; e]; f", "a (x] ; b; c) tail; last", "{a; b; c", "a) ; b] ; c } ; d", "((a; b); c); d", "( [ ; ) ; ] ; x", "",
)


def evidence_nested_cases(spark, d):
    """Statements of inline texts with brackets of all kinds."""
    cases = spark.createDataFrame(list(enumerate(NESTED)), "id int, evidence string")
    return cases.select("id", F.posexplode(X.split_evidence_nested(F.col("evidence"))).alias("pos", "statement"))


def evidence_normal(spark, d):
    q = table(spark, d, "p0_questions").where(F.col("evidence").isNotNull())
    return q.select(F.md5(X.normal_evidence(F.col("evidence"))).alias("normal_md5")).groupBy("normal_md5").agg(F.count("*").alias("n"))


def corpus_fingerprints(spark, d):
    docs = table(spark, d, "corpus_documents").where(F.col("context").isNotNull())
    return docs.select("corpus_doc_id", X.corpus_fingerprint(F.col("subset"), F.col("corpus_name"), F.col("context")).alias("fingerprint"))


def document_ids(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(X.prefixed_id("doc-", F.col("text")).alias("text_id"), "doc_id").groupBy("text_id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


def context_render(spark, d):
    r = table(spark, d, "backend_results").where(F.size("contexts") > 0)
    return r.select("result_id", F.md5(X.render_contexts(F.col("contexts"), 200)).alias("rendered_md5"))


def context_cap(spark, d):
    r = table(spark, d, "backend_results").where(F.col("contexts").isNotNull())
    capped = X.capped(F.array_join("contexts", "\n\n"), 300)
    return r.select("result_id", capped.alias("c")).select("result_id", F.length("c.text").alias("characters"), F.col("c.truncated").alias("truncated"))


def _chunks(spark, d):
    c = chunking.word_chunks(table(spark, d, "documents"), size=SIZE, overlap=OVERLAP)
    return c.select((F.col("doc_id") * CHUNKS + F.col("chunk_no")).alias("chunk_id"), "chunk")


def _index(spark, d):
    """(vocabulary, vectors) of the chunks."""
    chunks = _chunks(spark, d)
    vocab = lexical.build_vocabulary(chunks, "chunk_id", "chunk")
    return vocab, lexical.sparse_vectors(chunks, vocab, "chunk_id", "chunk")


def tfidf_profile(spark, d):
    _, vectors = _index(spark, d)
    squares = F.aggregate("weights", F.lit(0.0), lambda s, x: s + x * x)
    return vectors.where(F.size("places") > 0).select("chunk_id", F.size("places").cast("long").alias("n_terms"), F.round(F.array_max("weights"), 6).alias("top_weight"), F.round(squares, 6).alias("length"))


def tfidf_postings(spark, d):
    """The same index as postings, with bigrams: terms per length and the greatest weight of a text."""
    docs = table(spark, d, "heldout_items")
    postings, _ = lexical.index_texts(docs, "item_id", "text", bigrams=True)
    return postings.groupBy("item_id").agg(F.count("*").alias("n_terms"), F.count_if(F.col("term").contains(" ")).alias("n_bigrams"), F.round(F.max("weight"), 6).alias("top_weight"))


def _topk(spark, d, k=TOP):
    vocab, vectors = _index(spark, d)
    queries = lexical.sparse_vectors(table(spark, d, "heldout_items"), vocab, "item_id", "text")
    return lexical.sparse_top_k(vectors, queries, "chunk_id", "item_id", k)


def lexical_topk(spark, d):
    return _topk(spark, d).select("item_id", "chunk_id", "score", "rank")


def evidence_coverage(spark, d):
    """Mean share of the held-out items' content terms that their top chunks hold, and the hit rate, per kind."""
    hits = _topk(spark, d).join(_chunks(spark, d), "chunk_id").groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list(X.content_terms(F.col("chunk"))))).alias("have"))
    items = table(spark, d, "heldout_items").select("item_id", "kind", X.content_terms(F.col("text")).alias("want"))
    scored = items.join(hits, "item_id", "left").withColumn(
        "coverage", F.round(F.coalesce(F.size(F.array_intersect("want", "have")), F.lit(0)) / F.greatest(F.size("want"), F.lit(1)), 6)
    )
    return scored.groupBy("kind").agg(F.count("*").alias("items"), F.round(F.avg("coverage"), 6).alias("coverage"), F.round(F.avg((F.col("coverage") >= 0.75).cast("double")), 6).alias("hit_rate"))


def extractive_answer(spark, d):
    """The two sentences of an item's top chunks' documents closest to it, joined by score; ties to the earlier sentence."""
    vocab, vectors = _index(spark, d)
    items = table(spark, d, "heldout_items")
    queries = lexical.sparse_vectors(items, vocab, "item_id", "text")
    top = lexical.sparse_top_k(vectors, queries, "chunk_id", "item_id", TOP)
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))
    near = top.select("item_id", F.shiftright("chunk_id", 24).alias("doc_id")).distinct().join(docs, "doc_id")
    near = near.withColumn("sid", F.col("doc_id") * CHUNKS + F.col("pos"))
    weights = lexical.sparse_vectors(near.select("sid", "sentence").distinct(), vocab, "sid", "sentence")
    both = near.select("item_id", "sid", "sentence").join(weights, "sid").join(queries.select("item_id", F.map_from_arrays("places", "weights").alias("q")), "item_id")
    dot = F.aggregate(F.zip_with("places", "weights", lambda p, w: F.coalesce(F.try_element_at("q", p), F.lit(0.0)) * w), F.lit(0.0), lambda s, x: s + x)
    scored = both.select("item_id", "sid", "sentence", F.round(dot, 6).alias("score")).where(F.col("score") > 0)
    best = lexical.top_k(scored, "item_id", "sid", 2)
    return best.groupBy("item_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("rank", "sentence"))), lambda x: x["sentence"])).alias("answer"))


def _asked(spark, d):
    q = table(spark, d, "p0_questions").where(F.col("id").isNotNull())
    return q.groupBy(F.col("id").alias("question_id")).agg(F.max("answer").alias("truth"), F.max("evidence").alias("evidence"))


def evidence_scores(spark, d):
    """Per method: mean recall of the question's evidence statements in the result's contexts, and the hit rate."""
    r = table(spark, d, "backend_results").select("result_id", "question_id", "method", X.content_terms(F.array_join("contexts", " ")).alias("have"))
    e = _asked(spark, d).where(F.col("evidence").isNotNull()).select("question_id", X.split_evidence(F.col("evidence")).alias("statements"))
    per = r.join(e, "question_id").select("result_id", "method", "have", F.explode("statements").alias("s")).withColumn("want", X.content_terms(F.col("s")))
    recall = F.size(F.array_intersect("want", "have")) / F.greatest(F.size("want"), F.lit(1))
    per = per.withColumn("recall", F.round(recall, 6))
    rows = per.groupBy("result_id", "method").agg(F.avg("recall").alias("coverage"), F.avg((F.col("recall") >= 0.75).cast("double")).alias("hits"))
    return rows.groupBy("method").agg(F.count("*").alias("results"), F.round(F.avg("coverage"), 6).alias("coverage"), F.round(F.avg("hits"), 6).alias("hit_rate"))


def rouge_l(spark, d):
    r = table(spark, d, "backend_results").select("question_id", "method", "answer").where(F.col("answer").isNotNull())
    scored = r.join(_asked(spark, d).where(F.col("truth").isNotNull()), "question_id").withColumn("rouge_l", sequences.rouge_l_score("answer", "truth"))
    return scored.groupBy("method").agg(F.count("*").alias("results"), F.round(F.avg("rouge_l"), 6).alias("rouge_l"))


def exact_text_match(spark, d):
    """Contexts of results that are the whole text of exactly one document."""
    docs = checks.unique_text_ids(table(spark, d, "documents"), "text", "doc_id")
    r = table(spark, d, "backend_results").select("result_id", F.posexplode("contexts").alias("pos", "text"))
    return r.join(docs, "text", "left").groupBy(F.col("doc_id").isNotNull().alias("matched")).agg(F.count("*").alias("contexts"))


QUERIES = {
    f.__name__: f
    for f in (
        word_chunks, tail_windows, content_terms, sentence_split, clause_split, doc_stats, shortest_doc, evidence_statements, evidence_nested, evidence_nested_cases, evidence_normal,
        corpus_fingerprints, document_ids, context_render, context_cap, tfidf_profile, tfidf_postings, lexical_topk, evidence_coverage, extractive_answer, evidence_scores, rouge_l, exact_text_match,
    )
}

_W = r"'[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*'"
_STOP = "[" + ",".join(f"'{w}'" for w in X.STOPWORDS) + "]"


def _terms_sql(column: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({column}), '[a-z0-9]+')), lambda x: length(x) > 1 AND NOT list_contains({_STOP}, x))"


def _parts(column: str) -> str:
    return f"list_filter(list_transform(string_split({column}, ';'), lambda x: trim(x)), lambda x: x <> '')"


_CHUNKS = f"""
w AS (SELECT doc_id, regexp_extract_all(text, {_W}) AS w FROM documents),
c AS (SELECT doc_id, w, unnest(generate_series(0, CAST(CASE WHEN len(w) <= {SIZE} THEN 0 ELSE ceil((len(w) - {SIZE}) / {SIZE - OVERLAP}.0) END AS BIGINT))) AS chunk_no FROM w WHERE len(w) > 0),
chunks AS (SELECT doc_id, chunk_no, chunk_no * {SIZE - OVERLAP} AS start_word, list_slice(w, chunk_no * {SIZE - OVERLAP} + 1, chunk_no * {SIZE - OVERLAP} + {SIZE}) AS p,
  doc_id * {CHUNKS} + chunk_no AS chunk_id FROM c)"""
#: The chunks' own text, by marks set before each word.
_CUT = f"""marked AS (SELECT doc_id, list_slice(string_split(regexp_replace(text, '(' || {_W} || ')', chr(1) || '\\1', 'g'), chr(1)), 2, 1000000000) AS s FROM documents),
cut AS (SELECT doc_id, chunk_no, chunk_id, start_word, len(p) AS n_words, regexp_replace(array_to_string(list_slice(s, start_word + 1, start_word + len(p)), ''), '[^\\p{{L}}\\p{{N}}_]+$', '') AS t FROM chunks JOIN marked USING (doc_id))"""
_POSTINGS = f"""{_CHUNKS},
tok AS (SELECT chunk_id, unnest(list_filter(regexp_extract_all(lower(array_to_string(p, ' ')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({_STOP}, x))) AS term FROM chunks),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
nn AS (SELECT count(*) AS n FROM chunks),
vocab AS (SELECT term, ln((1.0 + (SELECT n FROM nn)) / (1.0 + count(*))) + 1.0 AS idf FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {lexical.MAX_FEATURES}),
raw AS (SELECT chunk_id, term, (1.0 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (term)),
postings AS (SELECT chunk_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS weight FROM raw)"""
_TOPK = f"""{_POSTINGS},
qtok AS (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({_STOP}, x))) AS term FROM heldout_items),
qtf AS (SELECT item_id, term, count(*) AS tf FROM qtok GROUP BY ALL),
qraw AS (SELECT item_id, term, (1.0 + ln(tf)) * idf AS w FROM qtf JOIN vocab USING (term)),
q AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS qw FROM qraw),
sims AS (SELECT item_id, chunk_id, round(sum(qw * weight), 6) AS score FROM q JOIN postings USING (term) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM sims QUALIFY rank <= {TOP})"""

ORACLE_SQL = {
    "word_chunks": f"WITH {_CHUNKS}, {_CUT} SELECT doc_id, chunk_no, start_word, n_words, md5(t) AS chunk_md5 FROM cut",
    "tail_windows": f"""
WITH w AS (SELECT corpus_doc_id, len(regexp_extract_all(context, {_W})) AS n FROM corpus_documents),
c AS (SELECT corpus_doc_id, n, unnest(generate_series(0, CAST(floor((n - 1) / 110.0) AS BIGINT))) AS k FROM w WHERE n > 0)
SELECT corpus_doc_id, count(*) AS windows, min(least(120, n - k * 110)) AS shortest, sum(least(120, n - k * 110)) AS words FROM c GROUP BY corpus_doc_id""",
    "content_terms": f"WITH t AS (SELECT doc_id, list_sort({_terms_sql('text')}) AS t FROM documents) SELECT doc_id, len(t) AS n_terms, md5(array_to_string(t, ' ')) AS terms_md5 FROM t",
    "sentence_split": r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)),
  lambda x: x <> '' AND len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')) >= 5) AS s FROM documents)
SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM s""",
    "clause_split": r"""
WITH s AS (SELECT item_id, list_slice(list_filter(list_filter(list_transform(regexp_split_to_array(lower(text), '\b(?:and|with|while|versus|compared to|because|if)\b|[,;?]'), lambda x: trim(x)), lambda x: x <> ''),
  lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')) >= 2), 1, 4) AS s FROM heldout_items)
SELECT item_id, unnest(generate_series(0, len(s) - 1)) AS pos, unnest(s) AS clause FROM s""",
    "doc_stats": r"SELECT corpus_doc_id, length(context) AS characters, len(list_filter(regexp_split_to_array(context, '\s+'), lambda x: x <> '')) AS words, coalesce(character_count = length(context), FALSE) AS count_right FROM corpus_documents WHERE context IS NOT NULL",
    "shortest_doc": "SELECT doc_id, length(text) AS characters FROM documents WHERE text IS NOT NULL ORDER BY characters, doc_id LIMIT 1",
    "evidence_statements": f"SELECT statement, count(*) AS n FROM (SELECT unnest({_parts('evidence')}) AS statement FROM p0_questions) GROUP BY statement",
    "evidence_nested": f"SELECT id, len({_parts('evidence')}) AS statements FROM (SELECT id, max(evidence) AS evidence FROM p0_questions WHERE evidence IS NOT NULL GROUP BY id)",
    "evidence_nested_cases": f"""
WITH RECURSIVE cases AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(NESTED))}) v(id, t)),
walk(id, t, i, a, b, c, part, parts) AS (
  SELECT id, t, 0, 0, 0, 0, '', CAST([] AS VARCHAR[]) FROM cases
  UNION ALL
  SELECT id, t, i + 1,
    CASE t[i + 1] WHEN '(' THEN a + 1 WHEN ')' THEN greatest(a - 1, 0) ELSE a END, CASE t[i + 1] WHEN '[' THEN b + 1 WHEN ']' THEN greatest(b - 1, 0) ELSE b END,
    CASE t[i + 1] WHEN '{{' THEN c + 1 WHEN '}}' THEN greatest(c - 1, 0) ELSE c END,
    CASE WHEN t[i + 1] = ';' AND a + b + c = 0 THEN '' ELSE part || t[i + 1] END, CASE WHEN t[i + 1] = ';' AND a + b + c = 0 THEN list_append(parts, part) ELSE parts END
  FROM walk WHERE i < length(t)
), done AS (SELECT id, list_filter(list_transform(list_append(parts, part), lambda x: trim(x)), lambda x: x <> '') AS s FROM walk WHERE i = length(t))
SELECT id, unnest(generate_series(0, len(s) - 1)) AS pos, unnest(s) AS statement FROM done""",
    "evidence_normal": r"SELECT md5(lower(replace(regexp_replace(evidence, '\s+', '', 'g'), ';', ','))) AS normal_md5, count(*) AS n FROM p0_questions WHERE evidence IS NOT NULL GROUP BY 1",
    "corpus_fingerprints": "SELECT corpus_doc_id, sha256(concat(coalesce(subset, ''), chr(0), corpus_name, chr(0), context, chr(0))) AS fingerprint FROM corpus_documents WHERE context IS NOT NULL",
    "document_ids": "SELECT concat('doc-', md5(text)) AS text_id, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "context_render": r"""
WITH r AS (SELECT result_id, array_to_string(list_transform(contexts, lambda x, i: concat('[Context ', i, ']', chr(10), x)), chr(10) || chr(10)) AS t FROM backend_results WHERE len(contexts) > 0)
SELECT result_id, md5(regexp_extract(t, '^(?:\s*\S+){1,200}')) AS rendered_md5 FROM r""",
    "context_cap": "SELECT result_id, least(length(t), 300) AS characters, length(t) > 300 AS truncated FROM (SELECT result_id, coalesce(array_to_string(contexts, chr(10) || chr(10)), '') AS t FROM backend_results WHERE contexts IS NOT NULL)",
    "tfidf_profile": f"WITH {_POSTINGS} SELECT chunk_id, count(*) AS n_terms, round(max(weight), 6) AS top_weight, round(sum(weight * weight), 6) AS length FROM postings GROUP BY chunk_id",
    "tfidf_postings": f"""
WITH w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({_STOP}, x)) AS w FROM heldout_items),
tok AS (SELECT item_id, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
tf AS (SELECT item_id, term, count(*) AS tf FROM tok GROUP BY ALL),
vocab AS (SELECT term, ln((1.0 + (SELECT count(*) FROM heldout_items)) / (1.0 + count(*))) + 1.0 AS idf FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {lexical.MAX_FEATURES}),
raw AS (SELECT item_id, term, (1.0 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (term)),
postings AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM raw)
SELECT item_id, count(*) AS n_terms, count(*) FILTER (contains(term, ' ')) AS n_bigrams, round(max(weight), 6) AS top_weight FROM postings GROUP BY item_id""",
    "extractive_answer": f"""
WITH {_TOPK},
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)),
  lambda x: x <> '' AND len(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> '')) >= 5) AS s FROM documents),
sent AS (SELECT doc_id, unnest(generate_series(0, len(s) - 1)) AS pos, unnest(s) AS sentence FROM s WHERE len(s) > 0),
near AS (SELECT DISTINCT item_id, chunk_id // {CHUNKS} AS doc_id FROM top),
stok AS (SELECT doc_id, pos, unnest(list_filter(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({_STOP}, x))) AS term FROM sent WHERE doc_id IN (SELECT doc_id FROM near)),
stf AS (SELECT doc_id, pos, term, count(*) AS tf FROM stok GROUP BY ALL),
sraw AS (SELECT doc_id, pos, term, (1.0 + ln(tf)) * idf AS w FROM stf JOIN vocab USING (term)),
sw AS (SELECT doc_id, pos, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, pos)) AS weight FROM sraw),
dots AS (SELECT item_id, doc_id, pos, round(sum(weight * qw), 6) AS score FROM near JOIN sw USING (doc_id) JOIN q USING (item_id, term) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, pos) AS rank FROM dots WHERE score > 0 QUALIFY rank <= 2)
SELECT item_id, string_agg(sentence, ' ' ORDER BY rank) AS answer FROM best JOIN sent USING (doc_id, pos) GROUP BY item_id""",
    "lexical_topk": f"WITH {_TOPK} SELECT item_id, chunk_id, score, rank FROM top",
    "evidence_coverage": f"""
WITH {_TOPK},
have AS (SELECT item_id, list_distinct(flatten(list({_terms_sql("array_to_string(p, ' ')")}))) AS have FROM top JOIN chunks USING (chunk_id) GROUP BY item_id),
s AS (SELECT kind, round(coalesce(len(list_intersect(want, have)), 0) / greatest(len(want), 1), 6) AS coverage FROM (SELECT item_id, kind, {_terms_sql('text')} AS want FROM heldout_items) LEFT JOIN have USING (item_id))
SELECT kind, count(*) AS items, round(avg(coverage), 6) AS coverage, round(avg(CASE WHEN coverage >= 0.75 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM s GROUP BY kind""",
    "evidence_scores": f"""
WITH e AS (SELECT id AS question_id, max(evidence) AS evidence FROM p0_questions WHERE evidence IS NOT NULL GROUP BY id),
r AS (SELECT result_id, question_id, method, {_terms_sql("coalesce(array_to_string(contexts, ' '), '')")} AS have FROM backend_results WHERE contexts IS NOT NULL),
p AS (SELECT result_id, method, have, unnest({_parts('evidence')}) AS s FROM r JOIN e USING (question_id)),
q AS (SELECT result_id, method, have, {_terms_sql('s')} AS want FROM p),
x AS (SELECT result_id, method, round(len(list_intersect(want, have)) / greatest(len(want), 1), 6) AS recall FROM q),
y AS (SELECT result_id, method, avg(recall) AS coverage, avg(CASE WHEN recall >= 0.75 THEN 1.0 ELSE 0.0 END) AS hits FROM x GROUP BY ALL)
SELECT method, count(*) AS results, round(avg(coverage), 6) AS coverage, round(avg(hits), 6) AS hit_rate FROM y GROUP BY method""",
    "rouge_l": """
WITH RECURSIVE truth AS (SELECT id AS question_id, max(answer) AS truth FROM p0_questions WHERE id IS NOT NULL GROUP BY id),
base AS (SELECT result_id, method, regexp_extract_all(lower(b.answer), '[a-z0-9]+') AS p, regexp_extract_all(lower(truth), '[a-z0-9]+') AS r FROM backend_results b JOIN truth USING (question_id) WHERE b.answer IS NOT NULL AND truth IS NOT NULL),
walk(result_id, i, best) AS (
  SELECT result_id, 0, list_transform(p, lambda x: 0::BIGINT) FROM base WHERE len(p) > 0 AND len(r) > 0
  UNION ALL
  SELECT result_id, i + 1, list_transform(generate_series(1, len(c)), lambda j: list_max(list_slice(c, 1, j)))
  FROM (SELECT w.result_id, i, list_transform(generate_series(1, len(p)), lambda j: CASE WHEN p[j] = r[i + 1] THEN coalesce(CASE WHEN j > 1 THEN best[j - 1] END, 0) + 1 ELSE best[j] END) AS c FROM walk w JOIN base USING (result_id) WHERE i < len(r))
), n AS (SELECT w.result_id, best[len(best)] AS n FROM walk w JOIN base b ON b.result_id = w.result_id AND w.i = len(b.r)),
f AS (SELECT b.method, CASE WHEN n IS NULL THEN 0.0 ELSE 2.0 * (n / len(p)::DOUBLE) * (n / len(r)::DOUBLE) / greatest(n / len(p)::DOUBLE + n / len(r)::DOUBLE, 1e-12) END AS f FROM base b LEFT JOIN n USING (result_id))
SELECT method, count(*) AS results, round(avg(f), 6) AS rouge_l FROM f GROUP BY method""",
    "exact_text_match": """
WITH u AS (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text HAVING count(*) = 1), r AS (SELECT result_id, unnest(contexts) AS text FROM backend_results)
SELECT doc_id IS NOT NULL AS matched, count(*) AS contexts FROM r LEFT JOIN u USING (text) GROUP BY 1""",
}
