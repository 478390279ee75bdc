"""Languages of documents and of their segments by Bayesian evidence fusion.

The posterior of a segment combines the likelihood of its words under word
models fitted on labelled rows with a prior. The prior fuses, as independent
evidence, a host prior (smoothed from all documents to the source to the
corpus), the language declared by markup in the text, the address suffix of
links in it and, weakly, the row's own label.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .textforms import fold, repair, words

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt", "zh")
#: Documents per language from which the word models are fitted, and words kept per language.
FIT_ROWS = 2_000
FIT_WORDS = 4_000
#: Pseudo-rows with which a source is drawn to all documents, and a corpus to its source.
SMOOTHING = 20.0

# Other names and codes of the languages.
SPELLINGS = {
    "de": "de deu ger german deutsch",
    "en": "en eng english englisch",
    "es": "es spa spanish espanol español castellano castilian",
    "fr": "fr fra fre french francais français",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands flemish",
    "pt": "pt por portuguese portugues português",
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语",
}
# Frequent function words, the model's start before any labelled row is seen.
FUNCTION_WORDS = {
    "de": "der die das und in zu den mit von nicht ist ein eine bei nach im auf fur als auch sich wird wurde oder aber",
    "en": "the of and to in a is that for with was were on as by at from this which or had but not are be",
    "es": "el la los las de que y en un una con por para se del al no es fue como pero su sin despues hasta",
    "fr": "le la les de des et en un une du que qui dans pour par sur avec est au aux ne pas ont mais apres",
    "it": "il lo la i gli le di che e in un una con per del della dei al da non sono ma dopo hanno nel",
    "nl": "de het een en van in op met voor te dat niet bij aan na door werd werden zijn maar als om ook naar",
    "pt": "o a os as de que e em um uma com por para do da dos das no na nao foi mas depois ate ao",
    "zh": "的 了 在 是 和 不 人 有 中 对 从 为 这 个 上 们 到 使 用 患",
}
# Address suffixes that point to a language.
SUFFIXES = {"de": "de", "at": "de", "uk": "en", "us": "en", "au": "en", "es": "es", "mx": "es", "fr": "fr", "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "cn": "zh", "tw": "zh"}

_DECLARED = re.compile(r"""\b(?:xml:)?lang\s*=\s*["']?([A-Za-z]{2,3})""")
_LINK = re.compile(r"\bhttps?://[^\s/<>\"']*?\.([a-z]{2})(?=[/:\s<>\"']|$)", re.I)
_BREAK = re.compile(
    r"[.!?]+[\"'”’»)\]]*(?=\s|<|$)|[。！？]+[”’」]?"
    r"|\n[ \t>]*\n|\n(?=[ \t>]*(?:[-*•+]|#{1,6}|\d{1,3}[.)])[ \t])|</?(?:p|div|li|ul|ol|h\d|tr|td|table)\b[^<>]*>"
)
_BROKEN = re.compile(r"[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]")

SCHEMA = (
    "doc_id long, declared string, lang string, confidence double, "
    "languages array<struct<lang:string,confidence:double,sentences:int>>, "
    "segments array<struct<first:int,last:int,lang:string,confidence:double,sentence:boolean>>"
)


def label_code(column: Column) -> Column:
    """The two-letter code that a label names in any usual spelling; null when it names none of the languages."""
    pairs = [F.lit(x) for code, names in SPELLINGS.items() for name in names.split() for x in (name, code)]
    table = F.create_map(*pairs)
    clean = F.lower(F.trim(column))
    return F.coalesce(F.element_at(table, clean), F.element_at(table, F.split(clean, "[-_ ]").getItem(0)))


def count_words(docs: DataFrame, fit_rows: int = FIT_ROWS, fit_words: int = FIT_WORDS) -> tuple[dict[str, dict[str, float]], dict[str, int]]:
    """(documents with each word, documents) per language of a bounded sample of labelled rows (``fit_rows`` per language).

    The sample is chosen by a hash of the id, so it doesn't depend on the layout; each sampled text is read
    whole. At most ``fit_words`` words per language reach the driver.
    """
    labelled = docs.where(F.col("code").isNotNull())
    sizes = {r["code"]: r["n"] for r in labelled.groupBy("code").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    for code, n in sizes.items():
        keep = keep | ((F.col("code") == code) & (unit < min(1.0, fit_rows / n)))

    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(set(words(fold(t)))))

    counts = (
        labelled.where(keep)
        .select("code", F.explode(tokens("text")).alias("word"))
        .groupBy("code", "word")
        .agg(F.count("*").alias("n"))
    )
    top = Window.partitionBy("code").orderBy(F.desc("n"), "word")
    rows = counts.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= fit_words).collect()
    seen: dict[str, dict[str, float]] = {code: {} for code in LANGUAGES}
    for r in rows:
        seen[r["code"]][r["word"]] = float(r["n"])
    return seen, {code: min(fit_rows, sizes.get(code, 0)) for code in LANGUAGES}


def fit_words(docs: DataFrame, fit_rows: int = FIT_ROWS, fit_words: int = FIT_WORDS) -> dict[str, tuple[float, ...]]:
    """Log-likelihoods of words, a tuple in the order of the languages, from ``count_words`` and the function words."""
    seen, sampled = count_words(docs, fit_rows, fit_words)
    docs_per = {code: sampled[code] + 10.0 for code in LANGUAGES}
    for code, text in FUNCTION_WORDS.items():
        for w in text.split():
            seen[code][w] = seen[code].get(w, 0.0) + 5.0
    vocabulary = set().union(*seen.values())
    return {w: tuple(math.log((seen[code].get(w, 0.0) + 0.5) / (docs_per[code] + 1.0)) for code in LANGUAGES) for w in vocabulary}


#: Hosts whose priors are broadcast; the documents of more are joined to them by salted host.
BROADCAST_HOSTS = 50_000
#: Parts into which a host's documents are dealt where its prior is joined by a shuffle.
HOST_SALT = 32


def host_priors(docs: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(source, corpus_name, prior): log-priors of the languages in order, smoothed all documents > source > corpus.

    The rows are counted once; all three levels are sums of those counts.
    """
    counts = docs.where(F.col("code").isNotNull()).groupBy("source", "corpus_name")
    arrays = cut_lineage(counts.agg(*[F.count_if(F.col("code") == c).cast("double").alias(c) for c in LANGUAGES]))
    sources = arrays.groupBy("source").agg(*[F.sum(c).alias(f"s_{c}") for c in LANGUAGES])
    everything = arrays.agg(*[F.sum(c).alias(f"g_{c}") for c in LANGUAGES])
    total = lambda prefix: sum((F.col(prefix + c) for c in LANGUAGES), F.lit(0.0))
    fixed = float(len(LANGUAGES))
    joined = arrays.join(sources, "source").join(F.broadcast(everything))  # one row
    priors = []
    for c in LANGUAGES:
        whole = (F.col(f"g_{c}") + 1.0) / (total("g_") + fixed)
        source = (F.col(f"s_{c}") + smoothing * whole) / (total("s_") + smoothing)
        priors.append(F.log((F.col(c) + smoothing * source) / (total("") + smoothing)))
    return joined.select("source", "corpus_name", F.array(*priors).alias("prior"))


def with_priors(docs: DataFrame, priors: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """``docs`` with the prior of their host: broadcast up to ``broadcast_hosts`` hosts (some 10 MB), joined by salted host beyond."""
    priors = cut_lineage(priors)
    host = ["source", "corpus_name"]
    if priors.limit(broadcast_hosts + 1).count() <= broadcast_hosts:
        return docs.join(F.broadcast(priors), host, "left")
    salted = docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(HOST_SALT)).cast("int"))
    spread = priors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(HOST_SALT - 1))))
    return salted.join(spread, [*host, "salt"], "left").drop("salt")


def _posterior(scores: list[float]) -> list[float]:
    top = max(scores)
    raw = [math.exp(s - top) for s in scores]
    total = sum(raw)
    return [x / total for x in raw]


def _pieces(text: str) -> list[tuple[int, int, bool]]:
    """(first, last, ends with a sentence mark) of the text's segments."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        mark = m.group()[0] in ".!?。！？"
        out.append((at, m.end() if mark else m.start(), mark))
        at = m.end()
    out.append((at, len(text), False))
    return [x for x in out if text[x[0] : x[1]].strip()]


def classify(text: str, prior: list[float], model: dict[str, tuple[float, ...]]):
    """Document posterior, its languages with full sentences, and its segments.

    A segment is a full sentence when it has at least five words (six characters of Chinese), at least three
    of them in the model, ends with a sentence mark or is long, and its language wins clearly.
    """
    if _BROKEN.search(text):
        text = repair(text)
    declared = [m.group(1).lower()[:2] for m in _DECLARED.finditer(text)]
    links = [SUFFIXES[m.group(1).lower()] for m in _LINK.finditer(text) if m.group(1).lower() in SUFFIXES]
    base = list(prior)
    for k, code in enumerate(LANGUAGES):
        base[k] += 2.0 * (code in declared) + 1.0 * (code in links)
    whole = [0.0] * len(LANGUAGES)
    segments, found = [], {}
    for first, last, mark in _pieces(text):
        tokens = words(fold(text[first:last]))
        logs = [model[t] for t in tokens if t in model and t < "⺀"]
        known, han = len(logs), 0 if text.isascii() else sum(t > "⺀" for t in tokens)
        score = [sum(c) for c in zip(*logs)] if logs else [0.0] * len(LANGUAGES)
        score[-1] += 3.0 * han
        for k in range(len(LANGUAGES)):
            whole[k] += score[k]
        post = _posterior([b + s for b, s in zip(base, score)])
        best = max(range(len(LANGUAGES)), key=lambda k: post[k])
        code = LANGUAGES[best]
        gap = score[best] - max(s for k, s in enumerate(score) if k != best)
        latin = len(tokens) - han
        full = (code == "zh" and han >= 6) or (
            code != "zh" and latin >= 5 and known >= 3 and gap > 3.0 and (mark or latin >= 9)
        )
        segments.append((first, last, code, post[best], full))
        if full:
            conf, n = found.get(code, (0.0, 0))
            found[code] = (max(conf, post[best]), n + 1)
    if not segments:
        return None
    post = _posterior([b + w for b, w in zip(base, whole)])
    best = max(range(len(LANGUAGES)), key=lambda k: post[k])
    return LANGUAGES[best], post[best], found, segments


def identify_languages(documents: DataFrame, fit_rows: int = FIT_ROWS, fit_words_kept: int = FIT_WORDS, smoothing: float = SMOOTHING, with_segments: bool = True) -> DataFrame:
    """One row per document: best language, confidence, languages with full sentences, segments with offsets.

    Without ``with_segments`` the segments are judged all the same but not written out.

    Needs doc_id and text; lang, source and corpus_name are used where present (missing columns and nulls count
    as unknown). Null, empty or letterless texts get a null language, confidence 0 and empty lists. Repeated
    documents are judged each on its own. Offsets are characters of the text, or of its mended form where the
    encoding was broken. What leaves the driver is the model (bounded) and the priors of a counted number of hosts.
    """
    have = {c.lower() for c in documents.columns}
    text_of = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        label_code(text_of("lang")).alias("code"),
        F.coalesce(text_of("source"), F.lit("")).alias("source"),
        F.coalesce(text_of("corpus_name"), F.lit("")).alias("corpus_name"),
    )
    usable = docs.where(F.col("text").isNotNull())
    model = fit_words(usable, fit_rows, fit_words_kept)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    priors = host_priors(usable.select("code", "source", "corpus_name"), smoothing)
    flat = [math.log(1.0 / len(LANGUAGES))] * len(LANGUAGES)

    width = 6 if with_segments else 5

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            rows = []
            for doc_id, text, code, prior in zip(pdf["doc_id"], pdf["text"], pdf["code"], pdf["prior"]):
                logs = list(flat) if prior is None else [float(x) for x in prior]
                if isinstance(code, str):
                    logs[LANGUAGES.index(code)] += 1.0
                code = code if isinstance(code, str) else None
                result = classify(text, logs, model) if isinstance(text, str) and text.strip() else None
                if result is None:
                    rows.append((doc_id, code, None, 0.0, [], [])[:width])
                    continue
                lang, conf, found, segments = result
                listed = [{"lang": k, "confidence": c, "sentences": n} for k, (c, n) in sorted(found.items())]
                rows.append((doc_id, code, lang, conf, listed, *([segments] if with_segments else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "declared", "lang", "confidence", "languages", "segments"][:width])

    return with_priors(docs, priors).select("doc_id", "text", "code", "prior").mapInPandas(run, SCHEMA if with_segments else SCHEMA[: SCHEMA.index(", segments")])


def label_problems(identified: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence, sentences, declared) of documents whose label is missing, wrong or too narrow."""
    held = F.transform("languages", lambda x: x["lang"])
    wrong = F.col("declared").isNull() | ~F.array_contains(held, F.col("declared")) | (F.size("languages") > 1)
    return (
        identified.where((F.size("languages") > 0) & wrong)
        .select("doc_id", "declared", F.explode("languages").alias("x"))
        .select("doc_id", F.col("x.lang").alias("lang"), F.col("x.confidence").alias("confidence"), F.col("x.sentences").alias("sentences"), "declared")
    )
