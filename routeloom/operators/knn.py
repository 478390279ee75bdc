"""Exact scoring of vectors against a query set, and the exact k-nearest graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Queries in one broadcast block.
QUERY_BLOCK = 8_192
#: Vectors in one broadcast section of the graph, in one of its tasks, and in a tile of the dense product.
SECTION_ROWS, TASK_ROWS, TILE_ROWS, TILE_COLUMNS = 131_072, 2_048, 512, 8_192


def search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", qkey: str = "query_id", floor: float = -2.0) -> DataFrame:
    """(qkey, key, score): the k most similar vectors by inner product for each of a stated set of queries.

    Queries are broadcast in blocks; each partition keeps its best k per query, so what is shuffled is k rows per
    query and partition, never the pairs. Ties go to the smaller key; a query never finds its own key.
    """
    spark = vectors.sparkSession
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    base = vectors.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector)).where(F.col(vector).isNotNull())
    found = None
    for b in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(qkey), F.lit(blocks)) == b)
        rows = sorted((r[0], r[1]) for r in block.select(F.col(qkey).cast("long"), F.col(vector).cast("array<double>")).where(F.col(vector).isNotNull()).collect())
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64)))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qids, q = shared.value
            best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            for pdf in batches:
                if not len(pdf) or not len(qids):
                    continue
                pdf = pdf.sort_values(key, kind="stable")
                ids, data = pdf[key].to_numpy(), np.stack(pdf[vector].to_numpy())
                new = [best_pairs(qids[i : i + TILE_ROWS], q[i : i + TILE_ROWS], ids, data, k, floor) for i in range(0, len(qids), TILE_ROWS)]
                at, dst, sim = (np.concatenate([best[j], *[x[j] for x in new]]) for j in range(3))
                order = np.lexsort((dst, -sim, at))
                at, dst, sim = at[order], dst[order], sim[order]
                keep = np.arange(len(at)) - np.searchsorted(at, at, "left") < k
                best = (at[keep], dst[keep], sim[keep])
            yield pd.DataFrame({qkey: best[0], key: best[1], "score": best[2]})

        part = base.mapInPandas(scan, f"{qkey} long, {key} long, score double")
        if blocks > 1:  # one block's vectors at a time are held anywhere
            part = cut_lineage(part)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy(qkey).orderBy(F.desc("score"), F.asc(key))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_pairs(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best of ``data`` above the floor; ``ids`` is ascending.

    Tiles of the dense product are cut at the k-th score seen so far, less what rounding to six digits can lift.
    """
    at, dst, sim = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    least = np.full(len(qids), floor)
    odd = not (np.isfinite(q).all() and np.isfinite(data).all())
    for lo in range(0, len(ids), TILE_COLUMNS):
        own = ids[lo : lo + TILE_COLUMNS]
        sims = q @ data[lo : lo + TILE_COLUMNS].T
        if odd:
            sims[np.isnan(sims)] = -np.inf
        first, last = np.searchsorted(own, qids, "left"), np.searchsorted(own, qids, "right")
        for step in range(int((last - first).max(initial=0))):  # a query never finds its own id
            rows = np.flatnonzero(first + step < last)
            sims[rows, first[rows] + step] = -np.inf
        if lo == 0 and len(own) > k:
            least = np.maximum(least, np.partition(sims, -k, axis=1)[:, -k])
        r, c = np.nonzero(sims >= (least - 2e-6)[:, None])
        at, dst, sim = np.concatenate([at, r]), np.concatenate([dst, own[c]]), np.concatenate([sim, np.round(sims[r, c], 6)])
        order = np.lexsort((dst, -sim, at))
        order = order[sim[order] > floor]
        place = np.arange(len(order)) - np.searchsorted(at[order], at[order], "left")
        order = order[place < k]
        at, dst, sim = at[order], dst[order], sim[order]
        full = np.flatnonzero(np.bincount(at, minlength=len(qids)) >= k)
        if len(full):
            least[full] = np.maximum(least[full], sim[np.searchsorted(at, full, "right") - 1])
    return qids[at], dst, sim


def knn_graph(vectors: DataFrame, k: int = 8, floor: float = 0.05, key: str = "vec_id", vector: str = "embedding", section_rows: int = SECTION_ROWS) -> DataFrame:
    """(src, dst, sim): each vector's k most similar others above the floor, exactly, at every size.

    Every vector is scored against every other: sections of vectors are broadcast in turn, tasks hold a few thousand
    vectors each and keep the best k of a section, so the work is quadratic and what is shuffled is k rows per vector
    and section, never the pairs. Ties go to the smaller id.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[vector]
    kind = kind if kind == "array<float>" else "array<double>"  # single precision is shipped as it is and scored in double
    base = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).where(F.col("v").isNotNull() & F.col("id").isNotNull())
    n = base.count()
    if not n:
        return spark.createDataFrame([], "src long, dst long, sim double")
    asked = base.repartition(max(1, -(-n // TASK_ROWS)), "id")
    sections = -(-n // section_rows)
    parts = []
    for b in range(sections):
        pdf = (base if sections == 1 else base.where(F.pmod(F.xxhash64("id"), F.lit(sections)) == b)).toPandas().sort_values("id", kind="stable")
        if not len(pdf):
            continue
        shared = spark.sparkContext.broadcast((pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy())))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, data = shared.value
            data = data.astype(np.float64)
            for pdf in batches:
                for i in range(0, len(pdf), TILE_ROWS):
                    some = pdf.iloc[i : i + TILE_ROWS]
                    src, dst, sim = best_pairs(some["id"].to_numpy(), np.stack(some["v"].to_numpy()).astype(np.float64), ids, data, k, floor)
                    yield pd.DataFrame({"src": src, "dst": dst, "sim": sim})

        parts.append(asked.mapInPandas(scan, "src long, dst long, sim double"))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    order = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
