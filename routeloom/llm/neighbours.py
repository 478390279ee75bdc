"""The k most similar vectors of every vector.

Vectors fall into coarse cells; what each lacks from its centre is coded by a
product quantiser with 16 centres per dimension (four bits) whose training and
coding weigh the error along the vector more than across it (score-aware,
anisotropic loss). A query visits its nearest cells. In each, its lookup tables
of one byte an entry are scanned by the packed codes: a byte of the code names
the sum of two table entries, and sums of whole numbers rank the vectors. The
shortlist is scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

DIMENSIONS = 64
#: Vectors on which cells and codebooks are fitted, chosen by hash of the id: so many at least, and so many a cell.
FIT_VECTORS, FIT_PER_CELL = 20_000, 8
#: Vectors a cell should hold, and most cells (their centres are broadcast: 17 MB at most).
CELL_SIZE, MOST_CELLS = 512, 65_536
#: Cells above which centres are fitted and looked up over two levels.
FLAT_CELLS = 1024
#: A query visits the cells whose centre is at least so near to it as this share of the nearest centre's similarity,
#: but ``LEAST_PROBES`` at least and no more than ``PROBES``.
PROBES, LEAST_PROBES, PROBE_SHARE = 16, 3, 0.8
#: Rows of one block of a cell: vectors and queries.
BLOCK, QUERY_BLOCK = 4096, 8192
#: Candidates per block that are scored in single precision; the nearest few of them in double.
SHORTLIST = 160
#: Similarity from which an error along the vector matters (sets the anisotropic weight).
SCORE_THRESHOLD = 0.2


def anisotropic_weight(dimensions: int, threshold: float = SCORE_THRESHOLD) -> float:
    """How many times the parallel error outweighs the orthogonal one."""
    return (dimensions - 1) * threshold**2 / (1 - threshold**2)


class Quantiser:
    """Sixteen centres per subspace of ``width`` dimensions (one by default: four bits a dimension) under the anisotropic loss."""

    def __init__(self, dimensions: int, width: int = 1, threshold: float = SCORE_THRESHOLD):
        self.width, self.parts = width, dimensions // width
        self.extra = anisotropic_weight(dimensions, threshold) - 1.0
        self.centres = np.zeros((self.parts, 16, width))

    def fit(self, units: np.ndarray, base: np.ndarray, rounds: int = 5, seed: int = 7) -> Quantiser:
        """Centres for the residuals of ``units`` from their cell centres ``base``; the loss is along the units."""
        rng = np.random.default_rng(seed)
        target = units - base
        for m in range(self.parts):
            part = target[:, self._span(m)]
            centres = part[rng.choice(len(part), 16, replace=len(part) < 16)].astype(float)
            for _ in range(6):
                own = ((part[:, None] - centres[None]) ** 2).sum(2).argmin(1)
                for k in range(16):
                    if (own == k).any():
                        centres[k] = part[own == k].mean(0)
            self.centres[m] = centres
        for _ in range(rounds):
            codes = self.encode(units, base, sweeps=1)
            along = self._along(units, base, codes)
            for m in range(self.parts):
                t_all, x_all = target[:, self._span(m)], units[:, self._span(m)]
                rest = along.sum(1) - along[:, m]
                for k in range(16):
                    mine = codes[:, m] == k
                    if not mine.any():
                        continue
                    t, x, s = t_all[mine], x_all[mine], rest[mine]
                    left = mine.sum() * np.eye(self.width) + self.extra * x.T @ x
                    right = t.sum(0) + self.extra * (((t * x).sum(1) + s)[:, None] * x).sum(0)
                    self.centres[m, k] = np.linalg.solve(left, right)
        return self

    def _span(self, m: int) -> slice:
        return slice(m * self.width, (m + 1) * self.width)

    def _along(self, units: np.ndarray, base: np.ndarray, codes: np.ndarray) -> np.ndarray:
        residual = units - base - self.decode(codes)
        return (residual * units).reshape(len(units), self.parts, self.width).sum(2)

    def encode(self, units: np.ndarray, base: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent: each subspace picks the centre of least loss given the others."""
        target = units - base
        codes = np.empty((len(units), self.parts), dtype=np.uint8)
        for m in range(self.parts):
            codes[:, m] = ((target[:, None, self._span(m)] - self.centres[m][None]) ** 2).sum(2).argmin(1)
        along = self._along(units, base, codes)
        total = along.sum(1)
        for _ in range(sweeps):
            for m in range(self.parts):
                gap = target[:, None, self._span(m)] - self.centres[m][None]
                toward = (gap * units[:, None, self._span(m)]).sum(2)
                loss = (gap**2).sum(2) + self.extra * ((total - along[:, m])[:, None] + toward) ** 2
                codes[:, m] = loss.argmin(1)
                new = toward[np.arange(len(units)), codes[:, m]]
                total += new - along[:, m]
                along[:, m] = new
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.centres[np.arange(self.parts), codes].reshape(len(codes), -1)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes per byte."""
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def unpack(packed: np.ndarray) -> np.ndarray:
    codes = np.empty((packed.shape[0], packed.shape[1] * 2), dtype=np.uint8)
    codes[:, 0::2], codes[:, 1::2] = packed & 15, packed >> 4
    return codes


def table_scan(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """(vectors, queries) whole-number scores, greater for nearer vectors, of packed four-bit codes.

    ``tables`` is (queries, parts, 16): products of each query with each centre. They are brought to one byte an entry
    by query; the two tables of a byte of the code become one of 256 sums, whose rows are gathered and added.
    """
    low = tables.min(axis=2, keepdims=True)
    step = np.maximum((tables.max(axis=2, keepdims=True) - low).max(axis=1, keepdims=True), 1e-12) / 255.0
    entries = np.ascontiguousarray(np.rint((tables - low) / step).astype(np.uint16).transpose(1, 2, 0))  # parts, 16, queries
    total = np.zeros((len(packed), tables.shape[0]), dtype=np.uint16)
    row = np.empty_like(total)
    for j in range(packed.shape[1]):
        pair = (entries[2 * j + 1][:, None] + entries[2 * j][None]).reshape(256, -1)
        np.take(pair, packed[:, j], axis=0, out=row, mode="clip")
        total += row
    return total


def fit_cells(units: np.ndarray, cells: int, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """Unit cell centres: seeded in proportion to density, then moved by spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = units[rng.choice(len(units), min(cells, len(units)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(units[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(units), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    return centres


class Cells:
    """Cell centres, in one level or, beyond ``FLAT_CELLS``, in groups under upper centres."""

    def __init__(self, units: np.ndarray, cells: int):
        if cells <= FLAT_CELLS:
            self.upper, self.groups = None, []
            self.centres = fit_cells(units, cells).astype(np.float32)
            return
        upper = fit_cells(units, math.isqrt(cells)).astype(np.float32)
        own = np.concatenate([(units[i : i + 4096].astype(np.float32) @ upper.T).argmax(1) for i in range(0, len(units), 4096)])
        kept, parts, at = [], [], 0
        self.groups = []
        for g in range(len(upper)):
            mine = units[own == g]
            if len(mine):
                part = fit_cells(mine, max(1, round(cells * len(mine) / len(units))))
                kept.append(upper[g])
                parts.append(part.astype(np.float32))
                self.groups.append((at, at + len(part)))
                at += len(part)
        self.upper, self.centres = np.stack(kept), np.concatenate(parts)

    def nearest(self, units: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(cells, similarities) of the ``most`` nearest centres of each vector, nearest first."""
        units = units.astype(np.float32)
        if self.upper is None:
            return self._best(units @ self.centres.T, most, None)
        near = self.upper.shape[0] if self.upper.shape[0] <= 8 else 8
        rough = units @ self.upper.T
        visited = np.argpartition(-rough, near - 1, axis=1)[:, :near]
        width = max(b - a for a, b in self.groups)
        scores = np.full((len(units), near * width), -np.inf, dtype=np.float32)
        names = np.zeros((len(units), near * width), dtype=np.int32)
        for g, (a, b) in enumerate(self.groups):
            rows, slots = np.nonzero(visited == g)
            if len(rows):
                columns = slots[:, None] * width + np.arange(b - a)[None]
                scores[rows[:, None], columns] = units[rows] @ self.centres[a:b].T
                names[rows[:, None], columns] = np.arange(a, b, dtype=np.int32)[None]
        return self._best(scores, most, names)

    @staticmethod
    def _best(scores: np.ndarray, most: int, names: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        most = min(most, scores.shape[1])
        top = np.argpartition(-scores, most - 1, axis=1)[:, :most]
        held = np.take_along_axis(scores, top, 1)
        order = np.argsort(-held, axis=1, kind="stable")
        top, held = np.take_along_axis(top, order, 1), np.take_along_axis(held, order, 1)
        return (top if names is None else np.take_along_axis(names, top, 1)).astype(np.int32), held


def _units(blobs: pd.Series, dimensions: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), dtype="<f4").reshape(len(blobs), dimensions).astype(np.float64)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def usable_vectors(vectors: DataFrame, dimensions: int) -> DataFrame:
    """(id, raw, spot): one usable vector per id as bytes, and their hash."""
    have = {c.lower() for c in vectors.columns}
    stamp = F.col("cached_at") if "cached_at" in have else F.lit(0)
    good = (F.size("embedding") == dimensions) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    picked = (
        vectors.where(F.col("question_id").isNotNull() & F.col("embedding").isNotNull())
        .withColumn("embedding", F.col("embedding").cast("array<float>"))
        .where(good)
        .groupBy(F.col("question_id").cast("string").alias("id"))
        .agg(F.max_by("embedding", F.struct(stamp, F.col("embedding"))).alias("embedding"))
    )

    def to_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                yield pd.DataFrame({"id": [], "raw": []})
                continue
            raw = np.stack([np.asarray(v, dtype="<f4") for v in pdf["embedding"]]) + np.float32(0)  # one zero, not two
            yield pd.DataFrame({"id": pdf["id"], "raw": [r.tobytes() for r in raw]})

    return picked.mapInPandas(to_bytes, "id string, raw binary").select("id", "raw", F.xxhash64("raw").alias("spot"))


def nearest_neighbours(
    vectors: DataFrame,
    k: int = 5,
    dimensions: int = DIMENSIONS,
    cell_size: int = CELL_SIZE,
    probes: int = PROBES,
    probe_share: float = PROBE_SHARE,
    shortlist: int = SHORTLIST,
    fit_vectors: int = FIT_VECTORS,
) -> DataFrame:
    """(id, neighbour, similarity, rank): the k most similar other ids by cosine, ties to the smaller id.

    Needs question_id and embedding; of several usable vectors under an id the latest by cached_at counts (the
    greatest at ties). Null vectors, wrong lengths, vectors with null or non-finite elements and all-zero vectors
    take no part, nor do null ids. With fewer than k other ids all are returned; an empty table gives no rows.

    Equal vectors are searched once: of a group only its k + 1 smallest ids can be neighbours, found in two
    salted steps, so a group of any size costs one vector. Cells too large for a task are cut into blocks of
    vectors and of queries. Nothing unbounded reaches the driver: it holds the fit sample (at most ``FIT_PER_CELL``
    times ``MOST_CELLS`` vectors), the cell centres (at most ``MOST_CELLS``) and the codebook.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(usable_vectors(vectors, dimensions))
    near = Window.partitionBy("spot", "salt").orderBy("id")
    heads = (
        rows.select("spot", "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
        .withColumn("place", F.row_number().over(near))
        .where(F.col("place") <= k + 1)
        .groupBy("spot")
        .agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("heads"))
    )
    # Of equal vectors the one with the smallest id stands for all; only (spot, id) is shuffled to find the others.
    repeated = heads.where(F.size("heads") > 1).select("spot", F.col("heads")[0].alias("id"))
    stands = rows.join(repeated.select("spot", F.col("id").alias("least")), "spot", "left").where(F.col("least").isNull() | (F.col("least") == F.col("id")))
    distinct = cut_lineage(stands.select("spot", "raw"))
    n = distinct.count()
    if n == 0:
        return spark.createDataFrame([], "id string, neighbour string, similarity double, rank int")
    cells = max(1, min(MOST_CELLS, math.ceil(n / cell_size)))
    share = min(1.0, max(fit_vectors, FIT_PER_CELL * cells) / n)
    unit_hash = F.pmod(F.xxhash64("spot"), F.lit(1 << 30)) / float(1 << 30)
    sample = distinct.where(unit_hash < share).orderBy("spot").select("raw").toPandas()
    if not len(sample):
        sample = distinct.orderBy("spot").limit(1).select("raw").toPandas()
    fitted = _units(sample["raw"], dimensions)
    index = Cells(fitted, max(1, min(cells, len(fitted) // 4)))
    base = np.concatenate([index.centres[index.nearest(fitted[i : i + 4096], 1)[0][:, 0]] for i in range(0, len(fitted), 4096)]).astype(np.float64)
    # The codebook has 16 centres a dimension: FIT_VECTORS vectors are plenty for it.
    some = np.random.default_rng(3).permutation(len(fitted))[:fit_vectors]
    quantiser = Quantiser(dimensions).fit(fitted[some], base[some])
    shared = spark.sparkContext.broadcast((index, quantiser))
    visits = min(probes, len(index.centres))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, quantiser = shared.value
        for pdf in batches:
            for i in range(0, len(pdf), 4096):
                some = pdf.iloc[i : i + 4096]
                units = _units(some["raw"], dimensions)
                best, near = index.nearest(units, visits)
                wanted = (near >= probe_share * near[:, :1]) | (np.arange(near.shape[1]) < LEAST_PROBES)
                codes = pack(quantiser.encode(units, index.centres[best[:, 0]].astype(np.float64)))
                yield pd.DataFrame({"spot": some["spot"], "raw": some["raw"], "cell": best[:, 0], "cells": [b[w] for b, w in zip(best, wanted)], "code": [c.tobytes() for c in codes]})

    placed = cut_lineage(distinct.select("spot", "raw").mapInPandas(place, "spot long, raw binary, cell int, cells array<int>, code binary"))
    queries = placed.select("spot", "raw", F.explode("cells").alias("cell"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("nd")).join(queries.groupBy("cell").agg(F.count("*").alias("nq")), "cell", "inner")
    sizes = sizes.select("cell", F.ceil(F.col("nd") / BLOCK).cast("int").alias("db"), F.ceil(F.col("nq") / QUERY_BLOCK).cast("int").alias("qb"))
    sizes = F.broadcast(sizes)  # one row per cell, at most MOST_CELLS
    held = (
        placed.join(sizes, "cell")
        .withColumn("d", F.pmod(F.xxhash64("spot"), F.col("db")).cast("int"))
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
        .select("cell", "d", "q", "spot", "raw", "code")
    )
    asked = (
        queries.join(sizes, "cell")
        .withColumn("q", F.pmod(F.xxhash64("spot"), F.col("qb")).cast("int"))
        .withColumn("d", F.explode(F.sequence(F.lit(0), F.col("db") - 1)))
        .select(F.col("cell").alias("qcell"), F.col("d").alias("qd"), F.col("q").alias("qq"), F.col("spot").alias("asking"), F.col("raw").alias("query"))
    )

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["spot", "other", "similarity"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in columns})
        quantiser = shared.value[1]
        packed = np.frombuffer(b"".join(left["code"]), dtype=np.uint8).reshape(len(left), -1)
        exact = _units(left["raw"], dimensions)
        single = exact.astype(np.float32)
        ids, asking = left["spot"].to_numpy(), right["asking"].to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = min(shortlist + 1, len(ids))
        keep = min(k + 1, size)
        for i in range(0, len(asking), 256):
            units = _units(right["query"].iloc[i : i + 256], dimensions)
            if size < len(ids):
                tables = np.einsum("qpw,pcw->qpc", units.reshape(len(units), quantiser.parts, quantiser.width), quantiser.centres)
                rough = np.ascontiguousarray(table_scan(tables.astype(np.float32), packed).T)
                cand = np.argpartition(rough, len(ids) - size, axis=1)[:, len(ids) - size :]
                if size > keep + 8:
                    near = np.matmul(single[cand], units.astype(np.float32)[:, :, None])[:, :, 0]
                    cand = np.take_along_axis(cand, np.argpartition(near, size - keep - 8, axis=1)[:, size - keep - 8 :], 1)
                sims = np.einsum("qd,qcd->qc", units, exact[cand])
            else:
                cand = np.broadcast_to(np.arange(len(ids)), (len(units), len(ids)))
                sims = units @ exact.T
            sims[ids[cand] == asking[i : i + 256, None]] = -9.0
            held = sims.shape[1]
            top = np.argpartition(-sims, keep - 1, axis=1)[:, :keep] if keep < held else np.tile(np.arange(held), (len(units), 1))
            rows_ = np.repeat(np.arange(len(units)), top.shape[1])
            s = np.take_along_axis(sims, top, 1).ravel()
            o = ids[np.take_along_axis(cand, top, 1).ravel()]
            ok = s > -5.0
            out.append((asking[i : i + 256][rows_][ok], o[ok], s[ok]))
        return pd.DataFrame({c: np.concatenate([x[j] for x in out]) for j, c in enumerate(columns)})

    scored = held.groupBy("cell", "d", "q").cogroup(asked.groupBy("qcell", "qd", "qq")).applyInPandas(scan, "spot long, other long, similarity double")
    # The k + 1 nearest vectors hold the k nearest other ids: every vector has at least one id.
    best = Window.partitionBy("spot").orderBy(F.desc("similarity"), "other")
    closest = (
        scored.withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= k + 1)
        .join(heads.select(F.col("spot").alias("other"), F.col("heads").alias("ids")), "other")
        .select("spot", F.explode("ids").alias("neighbour"), F.round("similarity", 9).alias("similarity"))
    )
    own = heads.select("spot", F.explode("heads").alias("neighbour"), F.lit(1.0).alias("similarity"))
    lists = (
        closest.unionByName(own)
        .groupBy("spot")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("neighbour").alias("n")))), 1, k + 1).alias("found"))
    )
    return (
        rows.select("spot", "id")
        .join(lists, "spot")
        .select("id", F.posexplode(F.slice(F.filter("found", lambda x: x["n"] != F.col("id")), 1, k)).alias("rank", "x"))
        .select("id", F.col("x.n").alias("neighbour"), (-F.col("x.s")).alias("similarity"), (F.col("rank") + 1).alias("rank"))
    )
