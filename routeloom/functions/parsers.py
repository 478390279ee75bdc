"""Readers of model output and of rendered contexts: judge verdicts, keywords, sections, numbered records."""

from __future__ import annotations

import csv
import io
import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys under which a list of statements may stand.
STATEMENT_KEYS = ("statements", "answers", "items", "list", "output", "result")
# Sections of a rendered context.
SECTIONS = {
    "high_entities": "high-level entity information",
    "high_relations": "high-level relationship information",
    "sources": "Sources",
    "low_entities": "low-level entity information",
    "low_relations": "low-level relationship information",
}
# Headings of serialised retrieval results, in their order.
HEADINGS = {"entities": "Entities", "relationships": "Relationships", "chunks": "Chunks", "references": "References"}


class Unreadable(ValueError):
    """Output that can't be used; ``code`` is stable."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def unfenced(text: str) -> str:
    """The text inside a code fence that opens and closes the whole; a fence that doesn't is an error."""
    text = text.strip()
    if not text.startswith("```"):
        return text
    head, _, rest = text.partition("\n")
    body, _, tail = rest.rpartition("\n")
    if head.strip().lower() not in ("```", "```json") or (tail if body or rest.startswith("\n") else rest) != "```":
        raise Unreadable("FENCE")
    return body


def _load(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        raise Unreadable("JSON") from None


def _filled(value) -> bool:
    return isinstance(value, str) and bool(value.strip())


def normal_statement(text) -> str:
    return "".join(str(text).split()).replace(";", ",").lower()


def judge_statements(text: str) -> list[str]:
    """A list of non-blank statements, bare or under one of the usual keys."""
    data = _load(unfenced(text))
    if isinstance(data, dict):
        data = next((data[k] for k in STATEMENT_KEYS if isinstance(data.get(k), list)), data)
    if not isinstance(data, list) or not data or not all(map(_filled, data)):
        raise Unreadable("STATEMENTS")
    return data


def _classified(data, keys: tuple[str, ...]) -> dict:
    if not isinstance(data, dict) or not all(k in data for k in keys):
        raise Unreadable("FIELDS")
    for k in keys:
        if not isinstance(data[k], list):
            raise Unreadable("LIST")
        if not all(isinstance(x, dict) and _filled(x.get("statement")) and _filled(x.get("reason")) for x in data[k]):
            raise Unreadable("ITEM")
    return data


def judge_correctness(text: str) -> dict[str, int]:
    """Counts of true positives, false positives and false negatives; at least one statement must be classified."""
    data = _classified(_load(unfenced(text)), ("TP", "FP", "FN"))
    counts = {k: len(data[k]) for k in ("TP", "FP", "FN")}
    if not any(counts.values()):
        raise Unreadable("EMPTY")
    return counts


def judge_evidence(text: str, evidence: list[str]) -> float:
    """Share of the reference statements that are attributed; each must be classified exactly once, in any punctuation."""
    items = _classified(_load(unfenced(text)), ("classifications",))["classifications"]
    if not all(type(x.get("attributed")) is int and x["attributed"] in (0, 1) for x in items):
        raise Unreadable("ATTRIBUTED")
    if Counter(normal_statement(x["statement"]) for x in items) != Counter(map(normal_statement, evidence)):
        raise Unreadable("EVIDENCE")
    return sum(x["attributed"] for x in items) / max(1, len(items))


def judge_verdict(text: str | None, kind: str, evidence: list[str] | None) -> tuple[str | None, int, float | None]:
    """(error code, statements, score) of a judge's output; a score only for correctness (F1) and evidence (recall)."""
    try:
        if not isinstance(text, str):
            raise Unreadable("JSON")
        if kind == "statements":
            return None, len(judge_statements(text)), None
        if kind == "correctness":
            n = judge_correctness(text)
            return None, sum(n.values()), 2 * n["TP"] / (2 * n["TP"] + n["FP"] + n["FN"])
        found = judge_evidence(text, list(evidence if evidence is not None else []))
        return None, len(evidence), found
    except Unreadable as bad:
        return bad.code, 0, None


_VERDICT = T.StructType([T.StructField("error", T.StringType()), T.StructField("statements", T.IntegerType()), T.StructField("score", T.DoubleType())])


@F.pandas_udf(_VERDICT)
def parse_verdicts(texts: pd.Series, kinds: pd.Series, evidence: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([judge_verdict(t, k, e) for t, k, e in zip(texts, kinds, evidence)], columns=["error", "statements", "score"])


def keyword_lists(text: str | None) -> tuple[str | None, list[str], list[str]]:
    """(error code, high-level, low-level keywords): both lists must have non-blank words. One extra pair of outer braces is forgiven."""
    text = (text or "").strip()
    fence = re.fullmatch(r"```(?:json)?(.*)```", text, re.S | re.I)
    text = fence.group(1).strip() if fence else text
    try:
        try:
            data = _load(text)
        except Unreadable:
            if text[:2] != "{{" or text[-2:] != "}}":
                raise
            data = _load(text[1:-1])
    except Unreadable:
        return "KEYWORDS_INVALID", [], []
    lists = [data.get(k) if isinstance(data, dict) else None for k in ("high_level_keywords", "low_level_keywords")]
    if not all(isinstance(x, list) and all(isinstance(w, str) for w in x) for x in lists):
        return "KEYWORDS_INVALID", [], []
    if not all(x and all(map(_filled, x)) for x in lists):
        return "KEYWORDS_EMPTY", [], []
    return None, *lists


_LISTS = T.StructType([T.StructField("error", T.StringType()), T.StructField("high", T.ArrayType(T.StringType())), T.StructField("low", T.ArrayType(T.StringType()))])


@F.pandas_udf(_LISTS)
def parse_keywords(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([keyword_lists(t if isinstance(t, str) else None) for t in texts], columns=["error", "high", "low"])


def csv_records(text: str) -> list[dict[str, str]]:
    """Rows of a CSV text under its trimmed header; surplus commas belong to the last column, one more layer of quotes is taken off."""
    rows = list(csv.reader(io.StringIO(text.strip())))
    if not rows:
        return []
    names = [h.strip() for h in rows[0]]
    out = []
    for row in rows[1:]:
        if not "".join(row).strip():
            continue
        last = len(names) - 1
        cells = row[:last] + [",".join(row[last:])] if len(row) > len(names) else row
        cells = [c.strip() for c in cells]
        cells = [c[1:-1].replace('""', '"') if len(c) > 1 and c[0] == c[-1] == '"' else c for c in cells]
        out.append(dict(zip(names, cells)))
    return out


def section_of(context: str, label: str) -> str | None:
    found = re.search(rf"-----{re.escape(label)}-----\s*```csv\s*(.*?)\s*```", context, re.S)
    return found.group(1) if found else None


def sectioned_context(context: str | None) -> tuple[list[str], list[dict], list[dict], list[list[str]]]:
    """(contexts, entities, relations, paths) of a rendered context of five labelled sections."""
    parts = {k: csv_records(s) if (s := section_of(context or "", label)) is not None else [] for k, label in SECTIONS.items()}
    named = [re.findall(r"The entity (.+?) is a ", r.get("context", "")) for r in parts["low_relations"]]
    return (
        [r["content"] for r in parts["sources"] if r.get("content")],
        parts["high_entities"] + parts["low_entities"],
        parts["high_relations"] + parts["low_relations"],
        [n for n in named if len(n) > 1],
    )


_ROWS = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
SECTIONED = T.StructType([
    T.StructField("contexts", T.ArrayType(T.StringType())), T.StructField("entities", _ROWS), T.StructField("relations", _ROWS),
    T.StructField("paths", T.ArrayType(T.ArrayType(T.StringType()))),
])


@F.pandas_udf(SECTIONED)
def parse_sections(contexts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sectioned_context(c if isinstance(c, str) else None) for c in contexts], columns=["contexts", "entities", "relations", "paths"])


def numbered_records(text: Column) -> Column:
    """Contents of ``number,<tab>content`` records, which may run over lines; null unless the head line and a first number stand.

    JVM only: a record begins at a line that starts with a number, a comma and a tab.
    """
    body = F.regexp_replace(text, r"^id,\tcontent(?:\n|$)", "")
    headed = text.rlike(r"^id,\tcontent(?:\n|$)")
    parts = F.split(body, r"\n(?=\d+,\t)")
    records = F.when(body == "", F.array().cast("array<string>")).when(body.rlike(r"^\d+,\t"), F.transform(parts, lambda p: F.regexp_replace(p, r"^\d+,\t", "")))
    return F.when(headed, records)


def serialised(columns: dict[str, Column]) -> Column:
    """Headed JSON sections of the lists that have elements, in the fixed order; null when none has."""
    parts = []
    for name, heading in HEADINGS.items():
        if name in columns:
            parts.append(F.when(F.size(columns[name]) > 0, F.concat(F.lit(f"## {heading}\n"), F.to_json(columns[name]))))
    text = F.concat_ws("\n\n", *parts)
    return F.when(text != "", text)
