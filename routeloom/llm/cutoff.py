"""Texts that were cut off before their end.

Copies of a cut text often live on whole elsewhere: distinct texts are sorted,
where a strict prefix stands directly before all texts that continue it. What
has no longer copy, or copies that disagree, is judged by its structure, its
last word and the contexts in which the corpus ends its sentences (see
``completeness``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import completeness as C

#: A prefix shorter than this proves nothing: short texts begin many others.
LEAST_PREFIX = 24


#: How a longer copy continues a prefix, as bits: inside a word or sentence, or with a sentence mark.
GOES_ON, STOPS = 1, 2


def continuation(text: str, at: int) -> int:
    """The bits of what ``text`` holds from ``at`` on."""
    if text[at : at + 1].isalnum():
        return GOES_ON
    k = at
    while text[k : k + 1].isspace():
        k += 1
    ch = text[k : k + 1]
    if k > at and ch.islower():
        return GOES_ON
    return STOPS if ch and ch in ".!?。！？" else 0


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def longer_copies(texts: DataFrame, least: int = LEAST_PREFIX) -> DataFrame:
    """(hash, bits): texts that are strict prefixes of other ones, and how all of those continue (0: in neither way).

    ``texts`` has distinct ``core`` strings (without marks at the end) and their ``hash``. They are range-sorted, so
    the work is even whatever they share, and read once with a stack of the prefixes that are still open. A text
    tells the prefix it stands under directly: what follows there is the same for all texts under it, so every
    continuation counts and none is met twice. Prefixes open at the end of a partition meet the next ones through
    one row per partition: its first text, and how the texts that leave it at each place go on from there.
    """
    ordered = texts.select("core", "hash").repartitionByRange("core").sortWithinPartitions("core")
    names = ["hash", "bits", "core", "last", "leaves", "part"]

    def nested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first = last = None
        beside = True  # whether texts still share ``least`` characters with the first
        leaves: dict[int, int] = {}
        stack: list[list] = []
        for pdf in batches:
            rows = []
            for core, key in zip(pdf["core"], pdf["hash"]):
                if first is None:
                    first = core
                elif beside:
                    at = _common(first, core)
                    beside = at >= least
                    if beside:
                        k = at
                        while True:
                            leaves[k] = leaves.get(k, 0) | continuation(core, k)
                            if k == 0 or not core[k - 1].isspace():
                                break
                            k -= 1
                while stack and not core.startswith(stack[-1][0]):
                    done = stack.pop()
                    if stack and done[0][len(stack[-1][0]) :].isspace():  # blanks say nothing: what follows them does
                        stack[-1][2] |= done[2]
                    if done[3]:
                        rows.append((done[1], done[2], None, None, None, part))
                if stack:
                    stack[-1][2] |= continuation(core, len(stack[-1][0]))
                    stack[-1][3] = True
                if len(core) >= least:
                    stack.append([core, key, 0, False])
                last = core
            yield pd.DataFrame(rows, columns=names)
        if first is not None:
            rows = [(0, 0, first, last, json.dumps(leaves), part)]  # beside a null hashes would become floats and lose digits
            rows += [(key, bits | (4 if longer else 0), core, None, None, part) for core, key, bits, longer in stack]
            yield pd.DataFrame(rows, columns=names)

    found = cut_lineage(ordered.mapInPandas(nested, "hash long, bits int, core string, last string, leaves string, part int"))
    inside = found.where(F.col("core").isNull()).select("hash", "bits")

    def across(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        spans = {}
        for first, last, leaves, part in pdf.loc[pdf["leaves"].notna(), ["core", "last", "leaves", "part"]].itertuples(index=False, name=None):
            spans[part] = (first, last, {int(k): v for k, v in json.loads(leaves).items()})
        parts, out = sorted(spans), []
        for key_, bits, core, part in pdf.loc[pdf["leaves"].isna(), ["hash", "bits", "core", "part"]].itertuples(index=False, name=None):
            longer, bits = int(bits) >= 4, int(bits) & 3
            for other in parts[parts.index(part) + 1 :]:
                first, last, leaves = spans[other]
                if not first.startswith(core):
                    break
                longer = True
                bits |= continuation(first, len(core)) | leaves.get(len(core), 0)
                if not last.startswith(core):
                    break
            if longer:
                out.append((int(key_), bits))
        return pd.DataFrame(out, columns=["hash", "bits"])

    # One row per partition and the prefixes open at its end: a table of partition edges, matched in one task.
    edges = found.where(F.col("core").isNotNull())
    return inside.unionByName(edges.groupBy(F.lit(0).alias("one")).applyInPandas(across, "hash long, bits int"))


def truncated_texts(generations: DataFrame) -> DataFrame:
    """(generation_id, source, truncated, evidence) for every row.

    evidence is prefix (longer copies go on inside a word or sentence, and none with a sentence mark), structure,
    mark, word, sentence, or null where the text is whole. Needs generation_id and text; source where present. Null, empty and wordless texts
    are whole. Repeated rows are judged once per distinct text and each reported. Other columns are ignored:
    finish reasons and token counts are not trusted.
    """
    have = {c.lower() for c in generations.columns}
    rows = generations.select(
        F.col("generation_id").cast("long").alias("generation_id"),
        (F.col("source").cast("string") if "source" in have else F.lit(None).cast("string")).alias("source"),
        F.col("text").cast("string").alias("text"),
    ).withColumn("hash", F.xxhash64("text"))
    kept = rows.where(F.col("text").isNotNull() & (F.length(F.trim("text")) > 0))
    # Texts are read once: for the model, the words they finish, and what the ends of those show that aren't surely whole.
    # A text that ends with a mark is whole or has another reason than its words, and needs no longer copy.
    core_hash = F.when(F.right("text", F.lit(1)).isin(*".!?。！？"), F.lit(0).cast("long")).otherwise(F.xxhash64(C.without_notes(F.col("text"))))
    read = C.read_texts(C.distinct_texts(kept).withColumns({"hash": F.xxhash64("text"), "core_hash": core_hash, "parsed": C.parses(F.col("text"))}))
    model = C.end_model(read)
    shared = generations.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            rows = [(h, c, *C.end_state(s, t, model)) for h, c, s, t in zip(pdf["hash"], pdf["core_hash"], pdf["state"], pdf["tail"])]
            yield pd.DataFrame(rows, columns=["hash", "core_hash", "state", "word", "share"])

    ends = read.where(F.col("state").isNotNull()).select("hash", "core_hash", "state", "tail")
    states = cut_lineage(ends.mapInPandas(judge, "hash long, core_hash long, state string, word string, share double"))
    stops = cut_lineage(states.where(F.col("state") == "words").groupBy("word").agg(F.count("*").alias("ends")))
    finished = stops.join(C.finished(read, stops.select("word")), "word", "left")

    # Shorter cores are no prefix, and no prefix goes on in them.
    cores = kept.select(C.without_notes(F.col("text")).alias("core")).where(F.length("core") >= LEAST_PREFIX).distinct()
    prefixes = longer_copies(cores.withColumn("hash", F.xxhash64("core")))
    # Texts meet their core's finding by hashes; the texts themselves are shuffled once to drop copies and once to be sorted.
    links = states.where(F.col("state").isin("words", "named")).select("hash", "core_hash")
    longer = links.join(prefixes.select(F.col("hash").alias("core_hash"), "bits"), "core_hash").groupBy("hash").agg(F.bit_or("bits").alias("bits"))
    evidence = (
        F.when(F.col("state") == "open", F.lit("structure"))
        .when(F.col("state") == "cut", F.lit("mark"))
        .when(F.col("state") == "whole", F.lit(None).cast("string"))
        .when(F.col("bits") == GOES_ON, F.lit("prefix"))
        .when(F.col("bits") == STOPS, F.lit(None).cast("string"))
        .when((F.col("state") == "words") & C.unfinished(F.col("ends"), F.col("inner")), F.lit("word"))
        .when(F.col("share") < C.END_SHARE, F.lit("sentence"))
    )
    judged = states.join(finished, "word", "left").join(longer, "hash", "left").select("hash", evidence.alias("evidence")).where(F.col("evidence").isNotNull())
    return rows.select("generation_id", "source", "hash").join(judged, "hash", "left").select(
        "generation_id", "source", F.col("evidence").isNotNull().alias("truncated"), "evidence"
    )


def truncation_rates(judged: DataFrame) -> DataFrame:
    """Rows, cut rows and their share for each source."""
    return judged.groupBy("source").agg(
        F.count("*").alias("texts"),
        F.sum(F.col("truncated").cast("long")).alias("cut"),
        F.round(F.avg(F.col("truncated").cast("double")), 6).alias("cut_share"),
    )
