"""Evaluation passages inside corpus documents.

One Aho-Corasick automaton holds every run of ``run`` consecutive words of the
held-out items, written without separators, so spacing, line breaks and
hyphenation in a document cannot hide a run. A document is folded and scanned
once; hits on the same diagonal form stretches, and the heaviest chain of
stretches that keeps the item's word order gives the leaked share.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .textforms import WORD, fold, fold_with_offsets

RUN = 7
MIN_SHARE = 0.5
#: Held-out items in one automaton. Larger sets are scanned in blocks of this size.
BLOCK_ITEMS = 20_000

SCHEMA = "doc_id long, item_id long, share double, leaked_words int, item_words int, stretches int, first_char int, last_char int"


def item_words(text: str | None) -> list[str]:
    return WORD.findall(fold(text or ""))


def build_automaton(items: list[tuple[int, str]], run: int = RUN):
    """The automaton over all runs of the items (None when no item has one), and each item's word starts and size."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    patterns: dict[str, list[tuple[int, int]]] = defaultdict(list)
    meta: dict[int, tuple[list[int], int]] = {}
    for item_id, text in items:
        words = item_words(text)
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w)
        starts.append(at)
        size = min(run, len(words))
        if not words:
            continue
        meta[item_id] = (starts, len(words))
        if len(words) < run:
            continue
        for k in range(len(words) - size + 1):
            patterns["".join(words[k : k + size])].append((item_id, k))
    for pattern, places in patterns.items():
        automaton.add_word(pattern, (len(pattern), places))
    if not patterns:
        return None, meta
    automaton.make_automaton()
    return automaton, meta


_built: dict[str, tuple] = {}


def worker_automaton(name: str, shared, run: int) -> tuple:
    """(automaton, meta, item ids) of a broadcast block of items, built once in a worker process and kept for its next task."""
    if name not in _built:
        _built.clear()
        rows = shared.value
        automaton, meta = build_automaton([(n, text) for n, (_, text) in enumerate(rows)], run)
        _built[name] = (automaton, meta, [item_id for item_id, _ in rows])
    return _built[name]


def _squeeze(folded: str) -> tuple[str, bytearray, list[tuple[int, int]]]:
    """Letters and digits only; marks at places where a word starts (1) or ends (2); the words' spans."""
    spans = [m.span() for m in WORD.finditer(folded)]
    parts = [folded[a:b] for a, b in spans]
    text = "".join(parts)
    marks = bytearray(len(text) + 1)
    at = 0
    for p in parts:
        marks[at] |= 1
        at += len(p)
        marks[at] |= 2
    return text, marks, spans


def _chain(stretches: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int, int]]]:
    """Heaviest chain of (doc_start, item_first, item_last) stretches in the order of both; shared words count once.

    The best chain is kept by the item word at which it ends, so a document that repeats an item many times costs
    its stretches times the item's words.
    """
    stretches.sort()
    by_end: dict[int, tuple[int, int]] = {}  # item word: (words, stretch)
    back = [-1] * len(stretches)
    value = [0] * len(stretches)
    waiting: list[int] = []  # stretches of one document place can't follow each other
    for i, (doc, first, last) in enumerate(stretches):
        if waiting and stretches[waiting[0]][0] < doc:
            for j in waiting:
                end = stretches[j][2]
                if value[j] > by_end.get(end, (0, -1))[0]:
                    by_end[end] = (value[j], j)
            waiting = []
        value[i] = last - first + 1
        for end, (words, j) in by_end.items():
            if end < last:
                gain = words + last - max(first, end + 1) + 1
                if gain > value[i]:
                    value[i], back[i] = gain, j
        waiting.append(i)
    if not stretches:
        return 0, []
    k = max(range(len(stretches)), key=lambda i: value[i])
    total, path = value[k], []
    while k >= 0:
        path.append(stretches[k])
        k = back[k]
    return total, path[::-1]


def scan(text: str, automaton, meta, run: int = RUN, min_share: float = MIN_SHARE) -> list[tuple]:
    """(item_id, share, leaked_words, item_words, stretches, first_char, last_char) of each item held by ``text``."""
    squeezed, marks, _ = _squeeze(fold(text))
    hits: dict[int, dict[int, list[int]]] = {}
    for end, (length, places) in automaton.iter(squeezed):
        start = end - length + 1
        if not marks[start] & 1 and not marks[end + 1] & 2:
            continue
        for item_id, k in places:
            diagonal = start - meta[item_id][0][k]
            hits.setdefault(item_id, {}).setdefault(diagonal, []).append(k)
    out = []
    for item_id, by in hits.items():
        starts, total = meta[item_id]
        covered = {w for ks in by.values() for k in ks for w in range(k, k + run)}
        if len(covered) < min_share * total:
            continue
        stretches = []
        for diagonal, ks in by.items():
            ks = sorted(set(ks))
            first = prev = ks[0]
            for k in ks[1:] + [None]:
                if k is None or k > prev + run:
                    stretches.append((diagonal + starts[first], first, prev + run - 1))
                    first = k
                prev = k
        leaked, path = _chain(stretches)
        if leaked < min_share * total:
            continue
        folded, places = fold_with_offsets(text)
        chars = [i for m in WORD.finditer(folded) for i in range(*m.span())]
        begin = path[0][0]
        last_doc, f, l = path[-1]
        stop = last_doc + starts[l + 1] - starts[f] - 1
        first_char = places[chars[min(begin, len(chars) - 1)]]
        last_char = places[chars[min(stop, len(chars) - 1)]]
        out.append((item_id, leaked / total, leaked, total, len(path), first_char, last_char))
    return out


def leaked_passages(
    documents: DataFrame,
    items: DataFrame,
    run: int = RUN,
    min_share: float = MIN_SHARE,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Every (document, item) in which at least ``min_share`` of the item's words stand in order.

    ``documents`` needs ``doc_id`` and ``text``, ``items`` ``item_id`` and ``text``; other columns are ignored.
    Null or empty texts and items shorter than ``run`` words match nothing; repeated documents each report
    their items; an empty side gives no rows; an item id that repeats is scanned under each of its texts and
    reported once, with its highest share. Documents are only streamed, never shuffled. The items are a stated
    query set: they are fetched and broadcast in blocks of at most ``block_items``. Of several blocks each is scanned
    and its result written to the checkpoint folder before the next is fetched, so that what driver and executors
    hold is bounded whatever the number of items. A worker builds a block's automaton once.
    """
    spark = documents.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct()
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.where(F.col("text").isNotNull() & (F.length("text") > 0))
    total = items.count()
    blocks = max(1, -(-total // block_items))
    out = None
    for b in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        rows = sorted((r.item_id, r.text) for r in block.collect())
        shared = spark.sparkContext.broadcast(rows)
        name = uuid.uuid4().hex

        def run_scan(batches: Iterator[pd.DataFrame], shared=shared, name=name) -> Iterator[pd.DataFrame]:
            automaton, meta, by_id = worker_automaton(name, shared, run)
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            for pdf in batches:
                rows = []
                if automaton is not None:
                    for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                        found: dict[int, tuple] = {}
                        for n, *rest in scan(text, automaton, meta, run, min_share):
                            item = by_id[n]
                            if item not in found or rest[0] > found[item][0]:
                                found[item] = tuple(rest)
                        rows += [(doc_id, item, *rest) for item, rest in found.items()]
                yield pd.DataFrame(rows, columns=names)

        found = docs.mapInPandas(run_scan, SCHEMA)
        if blocks > 1:
            found = cut_lineage(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def leak_report(matches: DataFrame) -> DataFrame:
    """Leaking documents and the mean leaked share of each item."""
    return matches.groupBy("item_id").agg(
        F.count("*").alias("documents"),
        F.round(F.avg("share"), 6).alias("mean_share"),
        F.max("leaked_words").alias("most_words"),
    )
