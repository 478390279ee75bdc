"""The boundary to models: embedders, chat and judges as plug-ins that run on the workers, with fakes that need no network.

A client is made on the worker by a factory, so nothing but the factory is shipped, and is called in batches.
"""

from __future__ import annotations

import math
import re
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from hashlib import blake2b
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsers as P
from ..functions import text as X
from ..functions.sequences import rouge_l
from ..sources.readers import SourceError
from ..sources.writers import missing_embeddings

# Statuses after which a call is tried again, besides all from 500 on.
RETRIED = frozenset({408, 409, 429})


class CallFailed(RuntimeError):
    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[tuple[int, list[float]]]:
        """(place in the batch, vector) in any order."""


class Chat(Protocol):
    def reply(self, prompt: str) -> tuple[str, int, int]:
        """(text, input tokens, output tokens)."""


class Backend(ABC):
    """A retrieval method with an index of its own."""

    @abstractmethod
    def index(self, documents: DataFrame) -> DataFrame: ...

    @abstractmethod
    def query(self, questions: DataFrame) -> DataFrame: ...

    def close(self) -> None:
        return None


class HashEmbedder:
    """A fake: words hashed to places, so equal texts have equal vectors and shared words bring texts near."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts):
        out = []
        for i, t in enumerate(texts):
            v = [0.0] * self.dimensions
            for w in re.findall(r"\w+", t.lower()) or [""]:
                h = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            v[0] += 1e-3  # never all zero
            out.append((i, v))
        return out[::-1]


class EchoChat:
    """A fake: answers with the first sentence of what follows the last heading of the prompt."""

    def reply(self, prompt):
        text = prompt.rsplit("\n", 1)[-1].split(". ")[0]
        return text, len(prompt.split()), len(text.split())


def client_factory(kind: str, **config) -> Callable[[], object]:
    """A factory by the name in a configuration; other names are for plug-ins."""
    known = {"hash": lambda: HashEmbedder(**config), "echo": lambda: EchoChat(**config)}
    if kind not in known:
        raise SourceError("UNKNOWN_CLIENT", kind)
    return known[kind]


def with_retries(call: Callable[[], object], tries: int = 5, sleep: Callable[[float], None] = time.sleep):
    """The call's result; calls that failed for a while are made again, after 1, 2, 4 and then 8 seconds."""
    for n in range(tries):
        try:
            return call()
        except CallFailed as failed:
            if n + 1 == tries or not (failed.status in RETRIED or failed.status >= 500):
                raise
            sleep(min(2.0**n, 8.0))


def embed_texts(texts: DataFrame, key: str, text: str, factory: Callable[[], Embedder], dimensions: int, batch: int = 64) -> DataFrame:
    """(key, embedding): unit vectors in the order of the batch's places. A wrong count, width, number or a zero vector fails the job."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in batches:
            rows: list[np.ndarray] = []
            for i in range(0, len(pdf), batch):
                some = list(pdf[text].iloc[i : i + batch])
                found = sorted(with_retries(lambda some=some: client.embed(some)), key=lambda x: x[0])
                if [p for p, _ in found] != list(range(len(some))) or any(len(v) != dimensions for _, v in found):
                    raise ValueError("embedder gave another count or width")
                for _, v in found:
                    a = np.asarray(v, dtype=float)
                    length = float(np.linalg.norm(a))
                    if not math.isfinite(length) or length == 0:
                        raise ValueError("embedder gave a vector of no direction")
                    rows.append((a / length).astype(np.float32))
            yield pd.DataFrame({key: pdf[key], "embedding": rows})

    return texts.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def load_or_embed(cache: DataFrame | None, texts: DataFrame, key: str, text: str, factory: Callable[[], Embedder], dimensions: int) -> DataFrame:
    """(key, embedding) of all texts: from the cache where it has a vector of the right width, embedded only where it hasn't."""
    if cache is None:
        return embed_texts(texts, key, text, factory, dimensions)
    good = cache.where(F.col("embedding").isNotNull() & (F.size("embedding") == dimensions)).groupBy(key).agg(F.first("embedding").alias("embedding"))
    todo = texts.join(missing_embeddings(texts, good, key), key, "left_semi").dropDuplicates([key])
    kept = good.join(texts.select(key).distinct(), key, "left_semi").select(key, F.col("embedding").cast("array<float>").alias("embedding"))
    return kept.unionByName(embed_texts(todo, key, text, factory, dimensions))


def prompts(questions: DataFrame, contexts: str = "contexts", most_words: int = 4000) -> DataFrame:
    """Adds ``prompt``: the rendered contexts, capped, under the question; and whether the cap cut them."""
    capped = X.capped(X.render_contexts(F.col(contexts), most_words))
    return questions.withColumn("_c", capped).withColumn("prompt", F.concat_ws("\n", F.concat(F.lit("Question: "), "question"), F.lit("Context:"), F.col("_c.text"))).withColumn("truncated", F.col("_c.truncated")).drop("_c")


def generate_answers(asked: DataFrame, key: str, factory: Callable[[], Chat]) -> DataFrame:
    """(key, answer, input_tokens, output_tokens, error) for rows with a prompt: a failed call or a blank answer is an error row."""
    kind = asked.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in batches:
            out = []
            for k, prompt in zip(pdf[key], pdf["prompt"]):
                try:
                    text, n, m = with_retries(lambda prompt=prompt: client.reply(prompt))
                    out.append((k, text, n, m, None if text.strip() else "EMPTY_ANSWER"))
                except CallFailed as failed:
                    out.append((k, None, 0, 0, f"STATUS_{failed.status}"))
            yield pd.DataFrame(out, columns=[key, "answer", "input_tokens", "output_tokens", "error"])

    return asked.select(key, "prompt").mapInPandas(run, f"{key} {kind}, answer string, input_tokens long, output_tokens long, error string")


def judge_rows(rows: DataFrame, key: str, factory: Callable[[], Chat], tries: int = 2) -> DataFrame:
    """(key, rouge_l, answer_correctness, evidence_recall, status, errors): three metrics of each answered row.

    The judge is asked for correctness and evidence; an output that can't be read is asked for again. A metric that
    fails makes all three null and the row failed. Needs answer, ground_truth and evidence (an array).
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in batches:
            out = []
            for k, answer, truth, evidence in zip(pdf[key], pdf["answer"], pdf["ground_truth"], pdf["evidence"]):
                seen: dict[str, float | None] = {}
                errors = []
                for what in ("correctness", "evidence"):
                    for _ in range(tries):
                        text, *_ = with_retries(lambda what=what: client.reply(f"{what}\n{answer}\n{truth}"))
                        error, _, score = P.judge_verdict(text, what, list(evidence) if evidence is not None else [])
                        if error is None:
                            break
                    seen[what] = score
                    if error is not None:
                        errors.append(f"{what}:{error}")
                scores = (None, None, None) if errors else (rouge_l(answer, truth), seen["correctness"], seen["evidence"])
                out.append((k, *scores, "failed" if errors else "ok", errors))
            yield pd.DataFrame(out, columns=[key, "rouge_l", "answer_correctness", "evidence_recall", "status", "errors"])

    return rows.select(key, "answer", "ground_truth", "evidence").mapInPandas(run, f"{key} {kind}, rouge_l double, answer_correctness double, evidence_recall double, status string, errors array<string>")


def run_pending(todo: DataFrame, written: DataFrame | None, key: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows to append: answers for the questions without a good row yet. A question with two good rows fails the job."""
    if written is None:
        return answer(todo)
    good = written.where(F.col("error").isNull())
    counted = good.groupBy(key).agg(F.count("*").alias("n"))
    once = counted.select(key, F.when(F.col("n") > 1, F.raise_error(F.lit("DUPLICATE_RESULT"))).alias("_d"))
    return answer(todo.join(once.where(F.coalesce(F.col("_d").cast("string"), F.lit("")) == ""), key, "left_anti"))
