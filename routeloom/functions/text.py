"""Text functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_PATTERN = r"[\p{L}\p{N}_]+(?:[-'][\p{L}\p{N}_]+)*"
# Words that carry no content in evidence and answers.
STOPWORDS = (
    "the a an and or of to in on for with is are was were be been being what which why "
    "how when where who whom whose does do did has have had from at by as that this these "
    "those it its patient patients"
).split()
# Words and marks that end a clause of a question.
CLAUSE_PATTERN = r"\b(?:and|with|while|versus|compared to|because|if)\b|[,;?]"


def non_empty(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def words(text: Column) -> Column:
    """Unicode words; hyphens and apostrophes join parts of one word."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def spaced_words(text: Column) -> Column:
    """Each word with what stands between it and the next one."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN + r"[^\p{L}\p{N}_]*"), F.lit(0))


def word_slice(pieces: Column, first: Column, count: int) -> Column:
    """The text from the first word's start to the last word's end of ``count`` pieces of ``spaced_words`` from place ``first`` on."""
    part = F.slice(pieces, first, count)
    return F.concat(F.array_join(F.slice(part, 1, F.size(part) - 1), ""), F.regexp_extract(F.element_at(part, -1), WORD_PATTERN, 0))


def whitespace_word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content_terms(text: Column) -> Column:
    """Distinct lower-case terms of two characters or more without stopwords."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_except(F.array_distinct(F.filter(ascii_tokens(text), lambda x: F.length(x) > 1)), stop)


def split_evidence(text: Column) -> Column:
    """Statements between semicolons, whatever brackets surround them."""
    return non_empty(F.split(text, ";"))


_PAIRS = {")": "(", "]": "[", "}": "{"}


def nested_statements(text: str) -> list[str]:
    """Statements between semicolons at depth zero of round, square and curly brackets, each counted by itself; a closing
    bracket without its opening one counts for nothing. One pass over the characters."""
    depth = dict.fromkeys("([{", 0)
    parts, start = [], 0
    for i, ch in enumerate(text):
        if ch in depth:
            depth[ch] += 1
        elif ch in _PAIRS:
            depth[_PAIRS[ch]] = max(0, depth[_PAIRS[ch]] - 1)
        elif ch == ";" and not any(depth.values()):
            parts.append(text[start:i])
            start = i + 1
    parts.append(text[start:])
    return [p.strip(" ") for p in parts if p.strip(" ")]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nested(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: nested_statements(t) if isinstance(t, str) else None)


def split_evidence_nested(text: Column) -> Column:
    """Statements between semicolons outside any bracket. Only texts with an opening bracket leave the JVM."""
    bracketed = text.rlike(r"[(\[{]")
    return F.when(bracketed, _nested(F.when(bracketed, text))).otherwise(split_evidence(text))


def normal_evidence(text: Column) -> Column:
    """Without whitespace, semicolons as commas, lower case."""
    return F.lower(F.translate(F.regexp_replace(text, r"\s+", ""), ";", ","))


def clauses(text: Column, most: int = 4) -> Column:
    """The first clauses of two words or more, lower case."""
    parts = non_empty(F.split(F.lower(text), CLAUSE_PATTERN))
    return F.slice(F.filter(parts, lambda x: whitespace_word_count(x) >= 2), 1, most)


def sentences(text: Column, least_words: int = 5) -> Column:
    """Sentences of at least so many words, cut after a sentence mark and whitespace."""
    return F.filter(non_empty(F.split(text, r"(?<=[.!?])\s+")), lambda x: whitespace_word_count(x) >= least_words)


def statement_recall(statement: Column, context: Column) -> Column:
    """Share of the statement's content terms that the context has."""
    terms = content_terms(statement)
    return F.size(F.array_intersect(terms, content_terms(context))) / F.greatest(F.size(terms), F.lit(1))


def render_contexts(contexts: Column, most_words: int) -> Column:
    """Numbered contexts joined by blank lines, layout kept, cut after so many words."""
    text = F.array_join(F.transform(contexts, lambda x, i: F.concat(F.lit("[Context "), (i + 1).cast("string"), F.lit("]\n"), x)), "\n\n")
    pieces = F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0))
    return F.array_join(F.slice(pieces, 1, most_words), "")


def prefixed_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(text))


def corpus_fingerprint(subset: Column, name: Column, context: Column) -> Column:
    zero = F.char(F.lit(0))
    return F.sha2(F.concat(F.coalesce(subset, F.lit("")), zero, name, zero, context, zero), 256)


def edge_id(source: Column, target: Column, index: Column) -> Column:
    zero = F.char(F.lit(0))
    return F.substring(F.sha2(F.concat(source, zero, target, zero, index.cast("string")), 256), 1, 20)


def capped(text: Column, most: int = 100_000) -> Column:
    """(text, truncated): the text cut to so many characters and whether it was."""
    return F.struct(F.substring(text, 1, most).alias("text"), (F.length(text) > most).alias("truncated"))


# Stable codes by what an error's name holds; the first that fits counts.
ERROR_CODES = (
    ("timeout", "LLM_TIMEOUT"), ("authentication", "LLM_AUTH_FAILED"), ("permission", "LLM_AUTH_FAILED"), ("ratelimit", "LLM_RATE_LIMITED"), ("rate_limit", "LLM_RATE_LIMITED"),
)


def error_code(name: Column, fallback: str = "QUERY_FAILED") -> Column:
    """Stable code of an error by its name; ``fallback`` for any other (an adapter has its own)."""
    code = F.lit(fallback)
    for part, value in reversed(ERROR_CODES):
        code = F.when(F.lower(name).contains(part), value).otherwise(code)
    return code


def iso_utc(stamp: Column) -> Column:
    """ISO 8601 to the second in UTC; the session's time zone is UTC."""
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def backup_stamp(stamp: Column) -> Column:
    """A stamp for names of backups."""
    return F.date_format(stamp, "yyyyMMdd'T'HHmmss'Z'")


def plain_url(url: Column) -> Column:
    """Whether an address is http(s) with a host and without credentials, query or fragment."""
    return url.rlike(r"^https?://[^/@?#\s]+(?:/[^?#\s]*)?$")
