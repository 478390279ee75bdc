"""Life of an index: its identity, its states, what must be true of its files, snapshots and rebuilding."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import SourceError

# States of an index; anything else counts as failed.
STATES = ("building", "ready", "failed", "interrupted")
MANIFEST = "id long, status string, corpus string, runtime string, name string, started double, ended double, error string"


def runtime_fingerprint(settings: dict) -> str:
    """sha256 of the settings as compact JSON under sorted names."""
    return sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


class IndexLog:
    """States of one index as an append-only table; the last row holds. Ready and different is an error, never a silent rebuild."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame | None:
        from pyspark.sql.utils import AnalysisException

        try:
            return self.spark.read.schema(MANIFEST).parquet(self.path)
        except AnalysisException:
            return None

    def last(self) -> dict | None:
        rows = self.rows()
        found = rows.orderBy(F.desc("id")).limit(1).collect() if rows is not None else []
        return found[0].asDict() if found else None

    def write(self, **row) -> None:
        before = self.last()
        row = {c.split()[0]: row.get(c.split()[0]) for c in MANIFEST.split(", ")} | {"id": (before["id"] + 1) if before else 1}
        self.spark.createDataFrame([tuple(row.values())], MANIFEST).coalesce(1).write.mode("append").parquet(self.path)

    def status(self, corpus: str, runtime: str) -> dict:
        """(status, reusable): not_built without rows; reusable when ready for the same corpus and settings."""
        last = self.last()
        if last is None:
            return {"status": "not_built", "reusable": False}
        status = last["status"] if last["status"] in STATES else "failed"
        return {"status": status, "reusable": status == "ready" and last["corpus"] == corpus and last["runtime"] == runtime}

    def interrupt(self) -> None:
        """Marks a build that nobody finished, as after a lost driver."""
        last = self.last()
        if last and last["status"] == "building":
            self.write(**{**last, "status": "interrupted", "ended": time.time()})

    def ensure(self, corpus: str, runtime: str, name: str, build: Callable[[], None], verify: Callable[[], DataFrame]) -> str:
        """reused or built: reuses an index that is ready, equal and whole, builds where none is ready, and raises when one
        is ready for something else. A build that raises, or whose rules don't hold, leaves the state failed."""
        last = self.last()
        if last and last["status"] == "ready":
            if (last["corpus"], last["runtime"]) != (corpus, runtime):
                raise SourceError("INDEX_CONFIG_MISMATCH", "the index was built for other data or settings")
            require(verify())
            return "reused"
        base = {"corpus": corpus, "runtime": runtime, "name": name, "started": time.time()}
        self.write(**base, status="building")
        try:
            build()
            require(verify())
        except Exception as failed:
            self.write(**base, status="failed", ended=time.time(), error=type(failed).__name__)
            raise
        self.write(**base, status="ready", ended=time.time())
        return "built"


def require(rules: DataFrame) -> None:
    """Raises when one of the rules (rule, violations) is broken; a handful of rows reach the driver."""
    broken = [r["rule"] for r in rules.where(F.col("violations") > 0).collect()]
    if broken:
        raise SourceError("INVALID_INDEX", "; ".join(broken))


def index_states(rows: DataFrame, key: str, corpus: DataFrame) -> DataFrame:
    """(key, status, reusable): the state of many indexes at once, from their last rows and the current corpus and settings."""
    last = rows.groupBy(key).agg(F.max_by(F.struct("status", "corpus", "runtime"), "id").alias("m"))
    status = F.when(F.col("m").isNull(), "not_built").when(F.col("m.status").isin(*STATES), F.col("m.status")).otherwise("failed")
    same = (F.col("m.corpus") == F.col("corpus")) & (F.col("m.runtime") == F.col("runtime"))
    return corpus.join(last, key, "left").select(key, status.alias("status"), F.coalesce((status == "ready") & same, F.lit(False)).alias("reusable"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges, empty): an index with neither is no graph."""
    n, m = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    return n.join(F.broadcast(m)).withColumn("empty", (F.col("nodes") == 0) | (F.col("edges") == 0))  # one row each


def graph_export(nodes: DataFrame, edges: DataFrame, manifest: dict | None) -> DataFrame:
    """The row that goes with an exported graph: counts, flags and a hash that doesn't depend on the order of rows.

    An empty side or a missing manifest is an error.
    """
    if not manifest:
        raise SourceError("MANIFEST_MISSING", "a graph is exported with its manifest only")
    row = graph_stats(nodes, edges)
    digest = edges.select(F.sha2(F.concat_ws("\x1f", "src", "dst"), 256).alias("h")).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.substring("h", 1, 16)))), 256).alias("sha256"))
    checked = F.when(F.col("empty"), F.raise_error(F.lit("EMPTY_GRAPH")).cast("string")).otherwise(F.col("sha256"))
    return row.join(F.broadcast(digest)).select("nodes", "edges", checked.alias("sha256"), F.lit(bool(manifest.get("directed", False))).alias("directed"), F.lit(bool(manifest.get("multigraph", False))).alias("multigraph"))


def rebuilt_stores(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunk rows, entity rows, relation rows) of a graph's stores: md5 ids by kind, names without quotes, sources split.

    ``nodes`` has node, description, source_id; ``edges`` src, dst, keywords, description, source_id; ``chunks`` content.
    """
    bare = lambda c: F.trim(F.col(c), F.lit('"'))
    ident = lambda prefix, *parts: F.concat(F.lit(prefix), F.md5(F.concat(*parts)))
    sources = F.split("source_id", "<SEP>")
    return (
        chunks.select(ident("chunk-", F.col("content")).alias("id"), "content"),
        nodes.select(ident("ent-", bare("node")).alias("id"), bare("node").alias("name"), F.concat_ws(" ", bare("node"), "description").alias("content"), sources.alias("sources")),
        edges.select(ident("rel-", bare("src"), bare("dst")).alias("id"), bare("src").alias("src"), bare("dst").alias("dst"), F.concat_ws(" ", "keywords", bare("src"), bare("dst"), "description").alias("content"), sources.alias("sources")),
    )


def store_rules(rebuilt: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Rules for a rebuilt store: it has exactly the ids of the one that exists."""
    from .gates import verdicts

    a, b = rebuilt.select(key).distinct(), stored.select(key).distinct()
    return verdicts([("no id missing", b.subtract(a)), ("no id added", a.subtract(b))])


def folder_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, bytes, sha256) of the files of a folder; files that only point to large storage are an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    pointer = F.substring(F.col("content").cast("string"), 1, 40).startswith("version https://git-lfs")
    digest = F.when(pointer, F.raise_error(F.concat(F.lit("LFS_POINTER: "), "path")).cast("string")).otherwise(F.sha2("content", 256))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), digest.alias("sha256"))


def snapshot_key(files: DataFrame) -> str:
    """A name for a folder by its content: the hash of its files' names and hashes. One small row per file."""
    rows = sorted((r["name"], r["sha256"]) for r in files.select("name", "sha256").collect())
    return sha256("\n".join(f"{n}:{h}" for n, h in rows).encode()).hexdigest()


def snapshot(source: DataFrame, spark: SparkSession, files: DataFrame, root: str) -> str:
    """The path of the snapshot of a folder under its content key: written once; one that exists must hold the same files."""
    path = f"{root.rstrip('/')}/{snapshot_key(files)[:16]}"
    from pyspark.sql.utils import AnalysisException

    try:
        held = spark.read.parquet(f"{path}/files")
    except AnalysisException:
        source.write.mode("errorifexists").parquet(f"{path}/rows")
        files.write.mode("errorifexists").parquet(f"{path}/files")
        return path
    if held.exceptAll(files.select(*held.columns)).limit(1).count() or files.select(*held.columns).exceptAll(held).limit(1).count():
        raise SourceError("SNAPSHOT_MISMATCH", path)
    return path


def replaced(new: DataFrame, path: str, stamp: str) -> str:
    """Writes a new version beside the old one and names it current; the old version stays."""
    spark = new.sparkSession
    target = f"{path.rstrip('/')}/version={stamp}"
    new.write.mode("errorifexists").parquet(target)
    spark.createDataFrame([(stamp,)], "version string").coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/current")
    return target
