"""Queries over model output and rendered contexts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import parsers as P
from ..functions import text as X
from ..streaming.events import parse_lines
from .tables import table

_ONE = '{"statement": "a", "reason": "r"}'
#: (kind, output, evidence, expected error, statements, score): outputs of a judge and what they are worth.
VERDICTS = (
    ("statements", '["a", "b"]', [], None, 2, None),
    ("statements", '```json\n{"items": ["a"]}\n```', [], None, 1, None),
    ("statements", '```json\n["a"]', [], "FENCE", 0, None),
    ("statements", "[]", [], "STATEMENTS", 0, None),
    ("statements", '["a", " "]', [], "STATEMENTS", 0, None),
    ("statements", '["a"', [], "JSON", 0, None),
    ("correctness", f'{{"TP": [{_ONE}, {_ONE}], "FP": [{_ONE}], "FN": []}}', [], None, 3, 0.8),
    ("correctness", '{"TP": [], "FP": []}', [], "FIELDS", 0, None),
    ("correctness", '{"TP": [], "FP": [], "FN": 1}', [], "LIST", 0, None),
    ("correctness", '{"TP": [{"statement": "a"}], "FP": [], "FN": []}', [], "ITEM", 0, None),
    ("correctness", '{"TP": [], "FP": [], "FN": []}', [], "EMPTY", 0, None),
    ("evidence", '{"classifications": [{"statement": "t(11, 22)", "reason": "r", "attributed": 1}, {"statement": "B", "reason": "r", "attributed": 0}]}', ["t(11;22)", "b"], None, 2, 0.5),
    ("evidence", '{"classifications": [{"statement": "a", "reason": "r", "attributed": true}]}', ["a"], "ATTRIBUTED", 0, None),
    ("evidence", '{"classifications": [{"statement": "a", "reason": "r", "attributed": 1}]}', ["a", "b"], "EVIDENCE", 0, None),
)
#: (output, expected error, high, low)
KEYWORDS = (
    ('{"high_level_keywords": ["a"], "low_level_keywords": ["b", "c"]}', None, "a", "b|c"),
    ('```json\n{"high_level_keywords": ["a"], "low_level_keywords": ["b"]}\n```', None, "a", "b"),
    ('{{"high_level_keywords": ["a"], "low_level_keywords": ["b"]}}', None, "a", "b"),
    ('{"high_level_keywords": [], "low_level_keywords": ["b"]}', "KEYWORDS_EMPTY", "", ""),
    ('{"high_level_keywords": ["a"], "low_level_keywords": [" "]}', "KEYWORDS_EMPTY", "", ""),
    ('{"high_level_keywords": ["a"]}', "KEYWORDS_INVALID", "", ""),
    ('{"high_level_keywords": "a", "low_level_keywords": ["b"]}', "KEYWORDS_INVALID", "", ""),
    ("not json", "KEYWORDS_INVALID", "", ""),
)


def judge_verdicts(spark, d):
    """Outputs of a judge: the error code, or the statements and the score."""
    rows = spark.createDataFrame([(i, k, t, e) for i, (k, t, e, *_) in enumerate(VERDICTS)], "id int, kind string, text string, evidence array<string>")
    return rows.select("id", P.parse_verdicts("text", "kind", "evidence").alias("v")).select("id", "v.error", "v.statements", F.round("v.score", 6).alias("score"))


def keyword_lists(spark, d):
    rows = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(KEYWORDS)], "id int, text string")
    return rows.select("id", P.parse_keywords("text").alias("v")).select("id", "v.error", F.array_join("v.high", "|").alias("high"), F.array_join("v.low", "|").alias("low"))


def _rendered(spark, d):
    """Results as one text of labelled sections, the form a path retriever hands on."""
    r = table(spark, d, "backend_results").where((F.size("contexts") > 0) & F.col("entities").isNotNull() & F.col("relations").isNotNull())
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.coalesce(x, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    section = lambda label, head, rows: F.concat(F.lit(f"-----{label}-----\n```csv\n{head}\n"), F.array_join(rows, "\n"), F.lit("\n```\n"))
    entities = F.transform("entities", lambda e, i: F.concat_ws(",", i.cast("string"), quoted(e["entity_name"]), quoted(e["entity_type"])))
    relations = F.transform("relations", lambda e, i: F.concat_ws(",", i.cast("string"), F.concat(F.lit('"The entity '), F.coalesce(e["src_id"], F.lit("x")), F.lit(" is a drug. The entity "), F.coalesce(e["tgt_id"], F.lit("y")), F.lit(' is a condition."'))))
    sources = F.transform("contexts", lambda c, i: F.concat_ws(",", i.cast("string"), quoted(c)))
    text = F.concat(
        section("high-level entity information", "id, entity,type", entities), section("low-level relationship information", "id,context", relations), section("Sources", "id,content", sources)
    )
    return r.select("result_id", text.alias("text"), F.size("contexts").alias("n"))


def sectioned_contexts(spark, d):
    """Labelled sections read back: contexts, entities, relations and the paths named in them."""
    parsed = _rendered(spark, d).select("result_id", P.parse_sections("text").alias("s"))
    return parsed.select(
        "result_id", F.size("s.contexts").alias("contexts"), F.size("s.entities").alias("entities"), F.size("s.relations").alias("relations"), F.size("s.paths").alias("paths"),
        F.md5(F.array_join(F.transform("s.entities", lambda e: e["entity"]), "|")).alias("entities_md5"),
    )


def numbered_records(spark, d):
    """Contexts written as numbered records over several lines and read back."""
    r = table(spark, d, "backend_results").where(F.size("contexts") > 0)
    lines = F.transform("contexts", lambda c, i: F.concat(i.cast("string"), F.lit(",\t"), c))
    text = F.concat(F.lit("id,\tcontent\n"), F.array_join(lines, "\n"))
    return r.select("result_id", P.numbered_records(text).alias("r")).select("result_id", F.size("r").alias("records"), F.md5(F.array_join("r", "|")).alias("records_md5"))


def serialised_sections(spark, d):
    """Retrieval results as headed JSON sections; empty ones are left out."""
    r = table(spark, d, "backend_results").withColumn("e", F.transform("entities", lambda e: F.struct(e["entity_name"].alias("name"))))
    text = P.serialised({"entities": F.col("e"), "chunks": F.transform("contexts", lambda c: F.struct(F.length(c).alias("characters")))})
    return r.select("result_id", F.md5(text).alias("text_md5"))


def stream_lines(spark, d):
    """Newline-delimited events: what can't be read becomes an error."""
    rows = spark.createDataFrame([(json.dumps({"type": "routing", "run_id": "a", "payload": "p"}),), ("{broken",), (json.dumps({"type": "result", "run_id": "a"}),)], "value string")
    return parse_lines(rows).groupBy("type").agg(F.count("*").alias("n"))


def iso_stamps(spark, d):
    """Times in UTC as ISO 8601, and as stamps of backups."""
    t = F.col("created_at").cast("timestamp")
    return table(spark, d, "backend_results").where(F.col("created_at").isNotNull()).select("result_id", X.iso_utc(t).alias("iso"), X.backup_stamp(t).alias("stamp"))


def error_codes(spark, d):
    names = ["ReadTimeout", "AuthenticationError", "PermissionDenied", "RateLimitError", "rate_limit_exceeded", "ValueError"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    return rows.select("name", X.error_code(F.col("name")).alias("code"), X.error_code(F.col("name"), "ADAPTER_ERROR").alias("adapter_code"))


def lexical_diagnostics(spark, d):
    """Per result: share of the reference answer's content terms that the answer holds."""
    r = table(spark, d, "backend_results").where(F.col("answer").isNotNull()).select("result_id", "question_id", X.content_terms(F.col("answer")).alias("have"))
    q = table(spark, d, "p0_questions").where(F.col("id").isNotNull()).groupBy(F.col("id").alias("question_id")).agg(F.max("answer").alias("truth"))
    want = X.content_terms(F.col("truth"))
    return r.join(q.where(F.col("truth").isNotNull()), "question_id").select("result_id", F.round(F.size(F.array_intersect(want, "have")) / F.greatest(F.size(want), F.lit(1)), 6).alias("coverage"))


QUERIES = {
    f.__name__: f
    for f in (judge_verdicts, keyword_lists, sectioned_contexts, numbered_records, serialised_sections, stream_lines, iso_stamps, error_codes, lexical_diagnostics)
}


def _sql(x) -> str:
    return "NULL" if x is None else repr(x) + "::DOUBLE" if isinstance(x, float) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) v({names})"


def _terms(column: str) -> str:
    from .text import _terms_sql

    return _terms_sql(column)


_USED = "FROM backend_results WHERE len(contexts) > 0 AND entities IS NOT NULL AND relations IS NOT NULL"
ORACLE_SQL = {
    "judge_verdicts": _values([(i, e, n, s) for i, (_, _, _, e, n, s) in enumerate(VERDICTS)], "id, error, statements, score"),
    "keyword_lists": _values([(i, *r[1:]) for i, r in enumerate(KEYWORDS)], "id, error, high, low"),
    "sectioned_contexts": f"""SELECT result_id, len(list_filter(contexts, lambda c: trim(c) <> '')) AS contexts, len(entities) AS entities, len(relations) AS relations, len(relations) AS paths,
  md5(array_to_string(list_transform(entities, lambda e: trim(coalesce(e['entity_name'], ''))), '|')) AS entities_md5 {_USED}""",
    "numbered_records": "SELECT result_id, len(contexts) AS records, md5(array_to_string(contexts, '|')) AS records_md5 FROM backend_results WHERE len(contexts) > 0",
    "serialised_sections": """WITH t AS (SELECT result_id,
  CASE WHEN len(entities) > 0 THEN concat('## Entities', chr(10), '[', array_to_string(list_transform(entities, lambda e: CASE WHEN e['entity_name'] IS NULL THEN '{}' ELSE concat('{"name":', to_json(e['entity_name']), '}') END), ','), ']') END AS e,
  CASE WHEN len(contexts) > 0 THEN concat('## Chunks', chr(10), '[', array_to_string(list_transform(contexts, lambda c: concat('{"characters":', length(c), '}')), ','), ']') END AS c FROM backend_results)
SELECT result_id, md5(CASE WHEN e IS NULL AND c IS NULL THEN NULL ELSE concat_ws(chr(10) || chr(10), e, c) END) AS text_md5 FROM t""",
    "stream_lines": "SELECT * FROM (VALUES ('routing', 1), ('error', 1), ('result', 1)) v(type, n)",
    "iso_stamps": "SELECT result_id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(created_at, '%Y%m%dT%H%M%SZ') AS stamp FROM backend_results WHERE created_at IS NOT NULL",
    "error_codes": "SELECT * FROM (VALUES ('ReadTimeout', 'LLM_TIMEOUT', 'LLM_TIMEOUT'), ('AuthenticationError', 'LLM_AUTH_FAILED', 'LLM_AUTH_FAILED'), ('PermissionDenied', 'LLM_AUTH_FAILED', 'LLM_AUTH_FAILED'), ('RateLimitError', 'LLM_RATE_LIMITED', 'LLM_RATE_LIMITED'), ('rate_limit_exceeded', 'LLM_RATE_LIMITED', 'LLM_RATE_LIMITED'), ('ValueError', 'QUERY_FAILED', 'ADAPTER_ERROR')) v(name, code, adapter_code)",
    "lexical_diagnostics": f"""WITH q AS (SELECT id AS question_id, max(answer) AS truth FROM p0_questions WHERE id IS NOT NULL GROUP BY id), x AS (SELECT result_id, {_terms('answer')} AS have, truth FROM (SELECT result_id, b.answer AS answer, truth FROM backend_results b JOIN q USING (question_id) WHERE b.answer IS NOT NULL AND truth IS NOT NULL)),
y AS (SELECT result_id, have, {_terms('truth')} AS want FROM x)
SELECT result_id, round(len(list_intersect(want, have)) / greatest(len(want), 1), 6) AS coverage FROM y""",
}
