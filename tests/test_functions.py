"""Golden cases of the column functions."""

import itertools

import pytest
from pyspark.sql import functions as F

from routeloom.functions import scores as S
from routeloom.functions import text as X
from routeloom.functions.sequences import lcs_length, rouge_l
from routeloom.functions.vectors import dot, norm, unit
from routeloom.operators.chunking import token_windows, word_chunks


def one(spark, expr, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(expr.alias("x")).first()["x"]


def test_overlapping_chunks(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = word_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), size=10, overlap=2).orderBy("chunk_no").collect()
    assert len(rows) > 3 and {r["doc_id"] for r in rows} == {1}
    assert "word8" in rows[1]["chunk"].split() and rows[-1]["chunk"].endswith("word29")
    assert [r["start_word"] for r in rows] == [0, 8, 16, 24]
    with pytest.raises(ValueError):
        word_chunks(spark.range(1), size=5, overlap=5)


def test_chunks_cover_all_words(spark):
    for n, size, overlap in itertools.product((1, 9, 10, 11, 25), (10,), (0, 3)):
        text = " ".join(str(i) for i in range(n))
        rows = word_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), size=size, overlap=overlap).orderBy("chunk_no").collect()
        seen = list(dict.fromkeys(w for r in rows for w in r["chunk"].split()))
        assert seen == text.split() and all(r["n_words"] <= size for r in rows)


def test_token_windows_stop_early_or_not(spark):
    class Codec:
        def encode(self, t):
            return list(t)

        def decode(self, ids):
            return "".join(ids)

    df = spark.createDataFrame([(1, "abcdefghij")], "k long, t string")
    assert [r["chunk"] for r in token_windows(df, "k", "t", Codec, 6, 2).orderBy("chunk_no").collect()] == ["abcdef", "efghij"]
    assert [r["chunk"] for r in token_windows(df, "k", "t", Codec, 6, 2, stop_early=False).orderBy("chunk_no").collect()] == ["abcdef", "efghij", "ij"]


def test_evidence_splitters(spark):
    text = "Ewing shows t(11;22) translocation.; A second statement."
    assert one(spark, X.split_evidence_nested(F.col("e")), e=text) == ["Ewing shows t(11;22) translocation.", "A second statement."]
    assert len(one(spark, X.split_evidence(F.col("e")), e=text)) == 3
    assert one(spark, X.split_evidence_nested(F.col("e")), e="a) b; c") == ["a) b", "c"]


def test_statement_recall(spark):
    assert one(spark, X.statement_recall(F.col("s"), F.col("c")), s="Basal cell carcinoma is skin cancer.", c="basal cell carcinoma is a skin cancer") == 1.0
    assert one(spark, X.statement_recall(F.col("s"), F.col("c")), s="the of", c="x") == 0.0


def test_sentences_and_clauses(spark):
    assert one(spark, X.sentences(F.col("t")), t="One two three four five. Too short. Six seven eight nine ten!") == ["One two three four five.", "Six seven eight nine ten!"]
    assert one(spark, X.clauses(F.col("t")), t="Compare old drugs and new drugs, one; two words if three more") == ["compare old drugs", "new drugs", "two words", "three more"]


def test_rouge_against_dynamic_programming():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b):
                cur = row[j + 1]
                row[j + 1] = prev + 1 if x == y else max(row[j + 1], row[j])
                prev = cur
        return row[-1]

    import random

    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 25))] for _ in range(2))
        assert lcs_length(a, b) == slow(a, b)
    assert rouge_l("a b c", "A, b; c") == 1.0 and rouge_l("", "a") == 0.0 and rouge_l(None, None) == 0.0


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>").select(
        dot(F.col("a"), F.col("b")).alias("d"), norm(F.col("a")).alias("n"), unit(F.col("a")).alias("u"), unit(F.col("z")).alias("z")
    ).first()
    assert row["d"] == 11.0 and row["n"] == 5.0 and row["u"] == [0.6, 0.8] and row["z"] is None


def test_scores(spark):
    df = spark.createDataFrame([(0.5, float("nan"), None)], "a double, b double, c double")
    row = df.select(S.valid_score(F.col("a")).alias("a"), S.valid_score(F.col("b")).alias("b"), S.valid_score(F.col("c")).alias("c"), S.harmonic(F.lit(0.0), F.lit(0.0)).alias("h")).first()
    assert (row["a"], row["b"], row["c"], row["h"]) == (True, False, False, 0.0)


def test_urls_and_errors(spark):
    for url, good in (("https://host/v1", True), ("http://u:p@host/", False), ("https://host/x?y=1", False), ("ftp://host", False)):
        assert one(spark, X.plain_url(F.col("u")), u=url) is good
    assert one(spark, X.error_code(F.col("m")), m="ReadTimeoutError") == "LLM_TIMEOUT"
    assert one(spark, X.error_code(F.col("m")), m="weird") == "QUERY_FAILED"
    assert one(spark, X.capped(F.col("t"), 3), t="abcdef").asDict() == {"text": "abc", "truncated": True}
