"""Longest common subsequence scores."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"[a-z0-9]+")


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence by bit-parallel rows: one big-integer step per token of ``b``."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & places.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def rouge_l(prediction: str | None, reference: str | None) -> float:
    """F1 of the longest common subsequence of lower-case ASCII tokens; 0 when either side has none."""
    p, r = _TOKEN.findall((prediction or "").lower()), _TOKEN.findall((reference or "").lower())
    if not p or not r:
        return 0.0
    n = lcs_length(p, r)
    precision, recall = n / len(p), n / len(r)
    return 2 * precision * recall / max(precision + recall, 1e-12)


@F.pandas_udf(T.DoubleType())
def rouge_l_score(predictions: pd.Series, references: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(p, r) for p, r in zip(predictions, references)], dtype=float)
