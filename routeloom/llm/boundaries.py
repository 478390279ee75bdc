"""Oversized texts cut at natural boundaries by agglomerative merging.

A text starts as atomic segments (sentences, or clauses and single words where
a sentence alone is too large). Adjacent pairs wait in a heap by the strength
of the boundary between them; the weakest boundary whose pair fits together
with the overlap is merged first, so cuts remain at the strongest boundaries.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^ \t\r\n]+")
# Strengths of boundaries, weakest first.
WORD, COMMA, CLAUSE, SENTENCE, LINE, PARAGRAPH, HEADING = range(7)
_SENTENCE_END = re.compile(r"[.!?。！？][\"'”’»)\]]*$")
_MARKER = re.compile(r"(?:#{1,6}|[-*•+|]|\d{1,3}[.)])$|\|")


def word_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the runs of characters other than space, tab, carriage return and newline."""
    return [m.span() for m in _WORD.finditer(text)]


def boundary_strengths(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Strength of the boundary after each word but the last."""
    out = []
    for (a, b), (c, d) in zip(spans, spans[1:]):
        gap, word, after = text[b:c], text[a:b], text[c:d]
        lines = gap.count("\n") or gap.count("\r")
        if lines and after.startswith("#"):
            out.append(HEADING)
        elif lines > 1:
            out.append(PARAGRAPH)
        elif lines and (_MARKER.match(after) or _SENTENCE_END.search(word)):
            out.append(LINE)
        elif _SENTENCE_END.search(word):
            out.append(SENTENCE)
        elif word[-1] in ";:；：" or (lines and not word[-1].isalnum()):
            out.append(CLAUSE)
        elif word[-1] in ",，、":
            out.append(COMMA)
        else:
            out.append(WORD)
    return out


def cut_points(strengths: list[int], words: int, most: int, extra: int = 0) -> list[tuple[int, int]]:
    """(first, stop) word ranges of at most ``most`` words that cover all words, cut at the strongest boundaries.

    The first range may have ``extra`` words more: no overlap stands before it.
    """
    if words <= most:
        return [(0, words)]

    def flat(first: int, stop: int) -> list[tuple[int, int]]:
        """Sentences; within oversized ones clauses, then comma parts, then even runs of words."""
        parts = [(first, stop)]
        for level in (SENTENCE, CLAUSE, COMMA):
            finer: list[tuple[int, int]] = []
            for a, b in parts:
                if level != SENTENCE and b - a <= most:
                    finer.append((a, b))
                    continue
                at = a
                for k in range(a, b - 1):
                    if strengths[k] >= level:
                        finer.append((at, k + 1))
                        at = k + 1
                finer.append((at, b))
            parts = finer
        out: list[tuple[int, int]] = []
        for a, b in parts:
            pieces = -(-(b - a) // most)
            out += [(a + (b - a) * k // pieces, a + (b - a) * (k + 1) // pieces) for k in range(pieces)]
        return out

    segments = flat(0, words)
    start = [a for a, _ in segments]
    stop = [b for _, b in segments]
    left = list(range(-1, len(segments) - 1))
    right = [*range(1, len(segments)), -1]
    alive = [True] * len(segments)
    heap: list[tuple[int, int, int, int, int]] = []

    def push(i: int) -> None:
        j = right[i]
        if j >= 0 and stop[j] - start[i] <= most + (extra if start[i] == 0 else 0):
            heapq.heappush(heap, (strengths[stop[i] - 1], stop[j] - start[i], start[i], i, j))

    for i in range(len(segments)):
        push(i)
    while heap:
        _, size, _, i, j = heapq.heappop(heap)
        if not alive[i] or not alive[j] or right[i] != j or stop[j] - start[i] != size:
            continue
        stop[i], right[i], alive[j] = stop[j], right[j], False
        if right[i] >= 0:
            left[right[i]] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    return [(start[i], stop[i]) for i in range(len(segments)) if alive[i]]


def split_text(text: str, max_size: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """(first_word, words, new_words, first_char, last_char) of the pieces; each begins with the overlap before it."""
    spans = word_spans(text)
    if not spans:
        return []
    if len(spans) <= max_size:
        return [(0, len(spans), len(spans), spans[0][0], spans[-1][1])]
    cuts = cut_points(boundary_strengths(text, spans), len(spans), max_size - overlap, overlap)
    out = []
    for first, stop in cuts:
        begin = max(0, first - overlap)
        out.append((begin, stop - begin, stop - first, spans[begin][0], spans[stop - 1][1]))
    return out


def split_oversized(documents: DataFrame, max_size: int, overlap: int) -> DataFrame:
    """(corpus_doc_id, piece, pieces, first_word, words, new_words, text): every text in pieces of at most ``max_size`` words.

    Needs corpus_doc_id and context; counts stored beside the text are not trusted and other columns are ignored.
    A text within the limit is one piece. Neighbouring pieces share exactly ``overlap`` words, or all words of the
    earlier ones where they have fewer. Null, empty and blank texts have no piece; repeated rows are each cut. No
    row is shuffled: every text is cut where it is read.
    """
    if not 0 <= overlap < max_size:
        raise ValueError("overlap must be smaller than max_size")
    rows = documents.select(F.col("corpus_doc_id").cast("long").alias("corpus_doc_id"), F.col("context").cast("string").alias("context"))
    rows = rows.where(F.col("context").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text in zip(pdf["corpus_doc_id"], pdf["context"]):
                pieces = split_text(text, max_size, overlap)
                out += [(key, k, len(pieces), f, n, new, text[a:b]) for k, (f, n, new, a, b) in enumerate(pieces)]
            yield pd.DataFrame(out, columns=["corpus_doc_id", "piece", "pieces", "first_word", "words", "new_words", "text"])

    return rows.mapInPandas(run, "corpus_doc_id long, piece int, pieces int, first_word int, words int, new_words int, text string")
