"""Texts into containers of fixed capacity by multiway differencing.

Sizes are tokens of a public tokenizer. Texts are dealt to shards by hash of
their id; each shard's sizes are split into near-equal windows by
Karmarkar-Karp multiway differencing: the two partial partitions of greatest
spread are merged with opposing orders until one is left. The window count
starts at the least possible and rises whenever a window exceeds the capacity.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of one shard. Larger shards waste less, by a part of a container each, and take longer.
SHARD_ITEMS = 2_000
TOKENIZER = "byte_bpe_50k.tiktoken"

_encoders: dict[str, object] = {}


def tokenizer_path(name_or_path: str) -> str:
    """A path as given, or the place of a named file of the installed public tokenizers."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return str(public_tokenizers.path(name_or_path))


def count_tokens(texts: list[str], tokenizer: str = TOKENIZER) -> list[int]:
    """Tokens of each text under a rank file (.tiktoken), a tokenizers file (.json) or a piece model (.model)."""
    path = tokenizer_path(tokenizer)
    encoder = _encoders.get(path)
    if encoder is None:
        if path.endswith(".tiktoken"):
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encoder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            encoder = Tokenizer.from_file(path)
            encoder.encode_special_tokens = True
        else:
            import sentencepiece

            encoder = sentencepiece.SentencePieceProcessor(model_file=path)
        _encoders[path] = encoder
    if path.endswith(".tiktoken"):
        return [len(x) for x in map(encoder.encode_ordinary, texts)]
    if path.endswith(".json"):
        return [len(x.ids) for x in encoder.encode_batch(texts, add_special_tokens=False)]
    return [len(x) for x in encoder.encode(texts, num_threads=1)]


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Indexes of ``sizes`` in ``windows`` groups of near-equal sums by multiway differencing.

    A partial partition keeps only its windows in use, largest first; the rest are empty. A merge lays the one's
    largest windows over the other's smallest.
    """
    if windows <= 1 or not sizes:
        return [list(range(len(sizes)))] + [[] for _ in range(max(0, windows - 1))]
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        overlap = len(a) + len(b) - windows
        if overlap <= 0:
            merged = sorted(a + b, key=lambda x: -x[0])
        else:
            head_a, tail_a = a[: len(a) - overlap], a[len(a) - overlap :]
            head_b, tail_b = b[: len(b) - overlap], b[len(b) - overlap :]
            both = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(tail_a, reversed(tail_b))]
            merged = sorted(head_a + head_b + both, key=lambda x: -x[0])
        low = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (low - merged[0][0], tick, merged))
        tick += 1
    groups = []
    for _, tree in heap[0][2]:
        stack, items = [tree], []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node)
            else:
                items.append(node)
        groups.append(sorted(items))
    return groups + [[] for _ in range(windows - len(groups))]


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The window of each size; every window's sum is at most ``capacity``, every size must be.

    The count rises in proportion to the excess, so few partitions are tried; then it falls while one less
    still holds.
    """
    total = sum(sizes)
    windows = max(1, -(-total // capacity))

    def attempt(n: int) -> list[list[int]] | None:
        groups = difference(sizes, n)
        return groups if all(sum(sizes[i] for i in g) <= capacity for g in groups) else None

    tried, step = windows, 1
    groups = attempt(windows)
    while groups is None:
        tried = windows
        windows = min(len(sizes), windows + step)
        step = max(1, min(step * 2, windows // 50 + 1))
        groups = attempt(windows)
    while windows - 1 > tried:
        fewer = attempt(windows - 1)
        if fewer is None:
            break
        groups, windows = fewer, windows - 1
    out = [0] * len(sizes)
    for w, g in enumerate(groups):
        for i in g:
            out[i] = w
    return out


def fill_containers(
    documents: DataFrame,
    capacity: int,
    tokenizer: str = TOKENIZER,
    shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """(doc_id, piece, tokens, container): the container of each text, or of each piece of a text over the capacity.

    Needs doc_id and text; other columns are ignored. A null or empty text has 0 tokens and still gets a
    container. A text over the capacity is cut into full pieces, each a container of its own, and a rest that is
    packed with the others. Repeated rows are packed each. An empty table gives no rows. A container is named by
    its shard and number. Only ids and sizes are shuffled; a shard holds about ``shard_items`` items whatever the
    table's size, and no id or source is hot in a hash.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": count_tokens(list(pdf["text"]), tokenizer)})

    sized = rows.mapInPandas(measure, "doc_id long, tokens long")
    shards = max(1, -(-documents.select("doc_id").count() // shard_items))
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("long"))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable")
        full, items = [], []
        for doc_id, tokens in zip(pdf["doc_id"].tolist(), pdf["tokens"].tolist()):
            piece = 0
            while tokens > capacity:
                full.append((doc_id, piece, capacity))
                tokens -= capacity
                piece += 1
            (full if tokens == capacity else items).append((doc_id, piece, tokens))
        items.sort(key=lambda x: (-x[2], -1 if x[0] is None or x[0] != x[0] else x[0], x[1]))
        windows = pack([x[2] for x in items], capacity) if items else []
        first = max(windows, default=-1) + 1
        out = [(*x, f"{shard:06d}-{w:06d}") for x, w in zip(items, windows)]
        out += [(*x, f"{shard:06d}-{first + k:06d}") for k, x in enumerate(full)]
        frame = pd.DataFrame(out, columns=["doc_id", "piece", "tokens", "container"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    # An explicit count of partitions: the shards are few bytes, and would be coalesced into one task otherwise.
    parts = max(1, min(shards, max(2 * documents.sparkSession.sparkContext.defaultParallelism, shards // 16)))
    return sized.repartition(parts, "shard").groupBy("shard").applyInPandas(place, "doc_id long, piece int, tokens long, container string")


def container_fill(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers, texts, and the used share of all room."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("used"), F.count("*").alias("items"))
    return per.agg(
        F.count("*").alias("containers"),
        F.sum("items").alias("items"),
        F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count("*") * F.lit(capacity)), 6).alias("used_share"),
    )
