"""Structured Streaming: windows over events, ordered run stages, resume and bounded history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Stages of a run in the order in which they may be emitted; the last two end it.
STAGES = {"routing": 0, "retrieval": 1, "result": 2, "error": 2}


def event_stream(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Events of a Parquet folder as a stream, in UTC time and with a watermark."""
    raw = spark.readStream.schema(EVENT_SCHEMA).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, length: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


def sliding(events: DataFrame, length: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n"
    )


def unique_runs(rows: DataFrame, key: str, stamp: str = "ts") -> DataFrame:
    """Rows whose key wasn't seen within the watermark: incremental resume."""
    return rows.dropDuplicatesWithinWatermark([key])


def ordered_stages(events: DataFrame, quiet_ms: int | None = 15_000) -> DataFrame:
    """(run_id, seq, type, payload): each run's stages in order, ended by its result or error; heartbeats on silence.

    Heartbeats need a stream that keeps running; None turns them off, as a run over what is there must.
    A stage that arrives early waits in the run's state; what comes after the end is dropped. The state of a run is
    at most one event per stage.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_stage, seq, waiting = state.get if state.exists else (0, 0, "")
        held = dict(x.split("\x1f", 1) for x in waiting.split("\x1e") if x)
        out = []
        if state.hasTimedOut:
            if next_stage <= 2:
                out.append((key[0], seq, "heartbeat", None))
                state.setTimeoutDuration(quiet_ms)
                state.update((next_stage, seq + 1, waiting))
            yield pd.DataFrame(out, columns=["run_id", "seq", "type", "payload"])
            return
        for pdf in batches:
            for kind, payload in zip(pdf["type"], pdf["payload"]):
                if kind in STAGES:
                    held.setdefault(kind, payload or "")
        while next_stage <= 2:
            ready = [k for k in ("routing", "retrieval", "result", "error") if k in held and STAGES[k] == next_stage]
            if not ready and "error" in held:
                ready = ["error"]
            if not ready:
                break
            out.append((key[0], seq, ready[0], held.pop(ready[0])))
            seq += 1
            next_stage = 3 if ready[0] in ("result", "error") else next_stage + 1
        state.update((next_stage, seq, "\x1e".join(f"{k}\x1f{v}" for k, v in held.items()) if next_stage <= 2 else ""))
        if quiet_ms is not None and next_stage <= 2:
            state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame(out, columns=["run_id", "seq", "type", "payload"])

    return events.groupBy("run_id").applyInPandasWithState(
        step, "run_id string, seq int, type string, payload string", "next int, seq int, waiting string", "append",
        GroupStateTimeout.NoTimeout if quiet_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """(type, run_id, payload) of newline-delimited JSON events; broken lines become errors."""
    parsed = F.from_json("value", "type string, run_id string, payload string")
    return lines.select(parsed.alias("e"), "value").select(
        F.coalesce("e.type", F.lit("error")).alias("type"), F.col("e.run_id").alias("run_id"), F.coalesce("e.payload", "value").alias("payload")
    )


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Processes what is there, ends, and gives the result table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def require_results(events: DataFrame) -> DataFrame:
    """(run_id, seq, type, payload): the events, and for each run that ended its list without result or error a MISSING_RESULT error.

    For a finished batch of events: an open stream can't tell that a run will have no more.
    """
    ended = events.groupBy("run_id").agg(F.max("seq").alias("seq"), F.max(F.col("type").isin("result", "error").cast("int")).alias("done"))
    lost = ended.where(F.col("done") == 0).select("run_id", (F.col("seq") + 1).alias("seq"), F.lit("error").alias("type"), F.lit("MISSING_RESULT").alias("payload"))
    return events.select("run_id", "seq", "type", "payload").unionByName(lost)


def keep_newest(stream: DataFrame, path: str, checkpoint: str, keep: int = 100, stamp: str = "created_at", key: str = "id"):
    """A query that keeps the newest rows of a stream under ``path``: each batch is merged with what is kept and written as a
    version of its own; the newest version is the history. A batch that is run again overwrites its version.
    """
    from ..sources.writers import newest

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = newest_version(spark, path, number)
        rows = batch if before is None else batch.unionByName(before.select(*batch.columns))
        newest(rows, keep, stamp, key).write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def newest_version(spark: SparkSession, path: str, below: int = 1 << 62) -> DataFrame | None:
    """The history of the last batch before number ``below``; None before the first."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    number = rows.where(F.col("version") < below).agg(F.max("version")).first()[0]
    return None if number is None else spark.read.parquet(f"{path.rstrip('/')}/version={number}")


class Run:
    """A started stream that its reader can leave: stopping it frees what it holds, also when the reader failed."""

    def __init__(self, writer):
        self.query = writer.start()

    def __enter__(self):
        return self.query

    def __exit__(self, *_):
        self.query.stop()
        return False
