"""Same or near-same questions across splits by a weighted cosine join.

1. A question becomes a set of terms: folded words without function words,
   synonyms under one name, and words seen rarely replaced by the frequent word
   they misspell (a join of deletion variants over the vocabulary). Words of
   courtesy and framing stay at a quarter of their weight. Questions with equal
   sets form one class.
2. Classes are joined between splits over inverted lists. Terms weigh by
   rarity and stand in descending weight. A pair at the threshold t that shares
   its first two terms at places i and j of a class leaves the mass of the
   other terms before j unshared; by Cauchy and Schwarz that mass is at most
   1 - t^2. A class is listed under just those pairs of terms, and under a
   single term only where its weight alone reaches t, so no pair is lost and
   none meets on frequent terms alone. Lists carry the two weights, and the
   norm, greatest weight and sum of the rest. Where two classes meet, their
   partial product plus the lesser of the product of the residual norms and
   the maximum-weight bound is the most their cosine can be; pairs below t are
   dropped before their vectors are fetched. Exact dot products follow.
3. An exact check compares what two classes at or above the threshold don't
   share: a pair holds when all of it is framing or pairs up as misspellings.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .labels import split_name
from .textforms import fold, words

#: Least weighted cosine of a pair; of those at or above it the exact check keeps the ones whose rest is misspelling.
THRESHOLD = 0.80

# Words under one name.
SYNONYMS = {
    "which": "what", "people": "patients", "persons": "patients", "individuals": "patients", "kids": "children",
    "outline": "summarise", "summarize": "summarise", "impaired": "reduced", "therapy": "treatment", "described": "reported",
    "surveillance": "monitoring", "needed": "required", "tumor": "tumour", "center": "centre", "leukemia": "leukaemia",
}
# Function words, left out of all terms.
FUNCTION = frozenset(
    "a an the of is are was were be been being do does did in on at to for by from as and or it its this that these those "
    "i me my we you your us "
    "le la les l un une des du de d el los las una unos unas der die das den dem ein eine einen einem il lo gli i o os um uma het een "
    "und et y e en".split()
)
# Words of courtesy and framing. They stay in the vectors at a small weight, and don't decide.
FRAMING = frozenset(
    "please kindly just so then well really actually usually basically simply exactly currently "
    "q question quick thanks thank ta cheers hi hello hey hmm ok okay tell know like want would could can should explain say "
    "answer briefly short shortly sentence one justify reason reasons according text based context passage document given provided "
    "bitte danke merci gracias grazie obrigado por favor svp s vous plait".split()
)
IDLE = FUNCTION | FRAMING
#: Weight of a framing word against what its rarity gives.
FRAMING_WEIGHT = 0.25
_CITATION = re.compile(r"\[\s*\d{1,4}\s*\]")
_FRAME = re.compile(r"^\s*(?:\[\w{1,4}\]|\(\w{1,4}\)|\d{1,4}\s*[.):]|q\d*\s*[:.)]|question\s*\d*\s*[:.)]|[-*•>#]+)\s*", re.I)


def question_terms(text: str | None) -> list[str]:
    """Distinct folded words of a question without its leading list or question mark, in order."""
    if not text:
        return []
    folded = _CITATION.sub(" ", fold(text))
    while True:
        shorter = _FRAME.sub("", folded, count=1)
        if shorter == folded:
            break
        folded = shorter
    return list(dict.fromkeys(words(folded)))


def edits(a: str, b: str, most: int) -> bool:
    """Whether b is within ``most`` insertions, deletions, substitutions or neighbour swaps of a."""
    if abs(len(a) - len(b)) > most:
        return False
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            best = min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                best = min(best, prev2[j - 2] + 1)
            cur.append(best)
        if min(cur) > most:
            return False
        prev2, prev = prev, cur
    return prev[-1] <= most


def _reach(word: str) -> int:
    return 0 if len(word) < 4 or not word.isalpha() else 1 if len(word) < 8 else 2


def _misspells(rare: str, rare_n: int, common: str, common_n: int) -> bool:
    reach = min(_reach(rare), _reach(common))
    return reach > 0 and rare_n <= max(2, common_n // 50) and common_n > 4 * rare_n and edits(rare, common, reach)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _terms(texts: pd.Series) -> pd.Series:
    return texts.map(question_terms)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _deletions(tokens: pd.Series) -> pd.Series:
    def of(word: str) -> list[str]:
        out, layer = {word}, {word}
        for _ in range(min(1, _reach(word))):
            layer = {w[:k] + w[k + 1 :] for w in layer for k in range(len(w))}
            out |= layer
        return sorted(out)

    return tokens.map(of)


#: Terms of a vocabulary or spelling table that are broadcast as a dictionary; larger ones are joined.
BROADCAST_TERMS = 400_000


def spelling_table(vocabulary: DataFrame) -> DataFrame:
    """(term, fixed): rare terms and the frequent term each misspells, from (term, n).

    Terms meet in a shared deletion variant, so the vocabulary is never compared all against all.
    """
    known = F.array(*[F.lit(w) for w in sorted(IDLE | set(SYNONYMS))])
    eligible = vocabulary.where((F.length("term") >= 4) & F.col("term").rlike("^\\p{L}+$"))
    variants = eligible.select("term", "n", F.explode(_deletions("term")).alias("variant"))
    rare = variants.where(~F.array_contains(known, F.col("term"))).select(F.col("term").alias("rare"), F.col("n").alias("rare_n"), "variant")
    common = variants.where(F.col("n") > 4).select(F.col("term").alias("common"), F.col("n").alias("common_n"), "variant")
    met = (
        rare.join(common, "variant")
        .where((F.col("rare_n") <= F.greatest(F.lit(2), F.floor(F.col("common_n") / 50))) & (F.col("common_n") > 4 * F.col("rare_n")) & (F.col("rare") != F.col("common")))
        .select("rare", "rare_n", "common", "common_n")
        .distinct()
    )

    @F.pandas_udf(T.BooleanType())
    def close(rare: pd.Series, rare_n: pd.Series, common: pd.Series, common_n: pd.Series) -> pd.Series:
        return pd.Series([_misspells(a, int(n), b, int(m)) for a, n, b, m in zip(rare, rare_n, common, common_n)], dtype=bool)

    return (
        met.where(close("rare", "rare_n", "common", "common_n"))
        .groupBy(F.col("rare").alias("term"))
        .agg(F.max_by("common", F.struct("common_n", "common")).alias("fixed"))
    )


def _small(table: DataFrame, most: int) -> list | None:
    """The rows of a table of at most ``most`` rows; None when it has more."""
    return table.collect() if table.limit(most + 1).count() <= most else None


def _named(term: str) -> str:
    return SYNONYMS.get(term, term)


def term_sets(forms: DataFrame, fixes: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """``forms`` with ``terms``: the sorted distinct terms of ``raw`` as spelled right, under common names, without function words.

    Up to ``broadcast_terms`` misspellings are broadcast and looked up in place, without a shuffle; more are joined.
    """
    fixes = cut_lineage(fixes)
    rows = _small(fixes, broadcast_terms)
    if rows is not None:
        shared = forms.sparkSession.sparkContext.broadcast({r["term"]: r["fixed"] for r in rows})

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def named(raw: pd.Series) -> pd.Series:
            table = shared.value
            return raw.map(lambda ts: sorted({n for t in ts if (n := _named(table.get(t, t))) not in FUNCTION}))

        return forms.withColumn("terms", named("raw"))
    synonyms = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    function = F.array(*[F.lit(w) for w in sorted(FUNCTION)])
    tokens = (
        forms.select("form", F.explode("raw").alias("term"))
        .join(fixes, "term", "left")
        .withColumn("term", F.coalesce("fixed", "term"))
        .withColumn("term", F.coalesce(F.element_at(synonyms, F.col("term")), F.col("term")))
        .where(~F.array_contains(function, F.col("term")))
    )
    return forms.join(tokens.groupBy("form").agg(F.sort_array(F.collect_set("term")).alias("terms")), "form")


def question_classes(questions: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> tuple[DataFrame, DataFrame]:
    """Members (class_id, id, split, source) and classes (class_id, terms, train, eval).

    Rows with a null question or without any word that says something belong to no class. A class is named by the
    md5 of its terms.
    """
    base = (
        questions.where(F.col("question").isNotNull())
        .select("id", "split", "source", "question")
        .withColumn("raw", _terms("question"))
        .drop("question")
        .where(F.size("raw") > 0)
    )
    rows = cut_lineage(base.withColumn("form", F.md5(F.array_join("raw", " "))))
    forms = rows.groupBy("form").agg(F.first("raw").alias("raw"))
    vocabulary = forms.select(F.explode("raw").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    framing = F.array(*[F.lit(w) for w in sorted(FRAMING)])
    named = term_sets(rows, spelling_table(cut_lineage(vocabulary)), broadcast_terms).where(F.size(F.array_except("terms", framing)) > 0)
    named = cut_lineage(named.select("id", "split", "source", "terms", F.md5(F.array_join("terms", " ")).alias("class_id")))
    members = named.groupBy("class_id", "id", "split").agg(F.min("source").alias("source"))
    train = F.col("split") == "train"
    classes = named.groupBy("class_id").agg(F.first("terms").alias("terms"), F.max(train.cast("int")).alias("train"), F.max((~train).cast("int")).alias("eval"))
    return members, classes


def unit_vector(terms: list[str], weights: list[float]) -> tuple[list[str], list[float]]:
    """Terms and weights in descending weight (ties by term), at length one."""
    length = math.sqrt(sum(w * w for w in weights)) or 1.0
    order = sorted(range(len(terms)), key=lambda k: (-weights[k], terms[k]))
    return [terms[k] for k in order], [weights[k] / length for k in order]


VECTOR = "v array<struct<term:string,w:double,n:long>>, lists array<struct<key:string,a:double,b:double,norm:double,most:double,total:double>>"


def weighted_vectors(classes: DataFrame, threshold: float, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(class_id, train, eval, v, lists): unit vectors in descending weight with their terms' frequencies, and the lists a
    class stands in.

    Up to ``broadcast_terms`` terms their frequencies are broadcast and looked up in place; more are joined.
    """
    spark = classes.sparkSession
    total = classes.count()
    df = cut_lineage(classes.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")))
    rows = _small(df, broadcast_terms)
    if rows is not None:
        shared = spark.sparkContext.broadcast({r["term"]: r["n"] for r in rows})
        source = classes.select("class_id", "train", "eval", "terms", F.lit(None).cast("array<long>").alias("counts"))
    else:
        shared = None
        pairs = classes.select("class_id", F.explode("terms").alias("term")).join(df, "term").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("term", "n"))).alias("p"))
        source = classes.select("class_id", "train", "eval").join(pairs, "class_id").select("class_id", "train", "eval", F.col("p.term").alias("terms"), F.col("p.n").alias("counts"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for class_id, train, held, terms, counts in pdf[["class_id", "train", "eval", "terms", "counts"]].itertuples(index=False, name=None):
                known = dict(zip(terms, counts)) if shared is None else {t: shared.value[t] for t in terms}
                # A term of one class can't be shared: it only lengthens the vector.
                weights = [(FRAMING_WEIGHT if t in FRAMING else 1.0) * (math.log1p(total / known[t]) if known[t] > 1 else 1.0) for t in terms]
                terms, w = unit_vector(list(terms), weights)
                out.append((class_id, train, held, [(t, x, int(known[t])) for t, x in zip(terms, w)], list_keys(terms, w, threshold)))
            yield pd.DataFrame(out, columns=["class_id", "train", "eval", "v", "lists"])

    return source.mapInPandas(build, f"class_id string, train int, eval int, {VECTOR}")


def list_keys(terms: list[str], weights: list[float], threshold: float) -> list[tuple]:
    """(key, first weight, second weight, norm, greatest weight and sum of the terms after them) of the lists of a unit
    vector in descending weight: pairs of terms that can be a match's first two, and single terms that alone can reach
    the threshold."""
    slack = 1.0 - threshold * threshold + 1e-9
    mass = [float(w) * float(w) for w in weights]
    after_mass, after_sum = [0.0] * (len(terms) + 1), [0.0] * (len(terms) + 1)
    for k in range(len(terms) - 1, -1, -1):
        after_mass[k], after_sum[k] = after_mass[k + 1] + mass[k], after_sum[k + 1] + float(weights[k])

    def rest(k: int) -> tuple[float, float, float]:
        return math.sqrt(after_mass[k]), float(weights[k]) if k < len(terms) else 0.0, after_sum[k]

    keys = [(terms[i], float(weights[i]), 0.0, *rest(i + 1)) for i in range(len(terms)) if mass[i] >= threshold * threshold - 1e-9]
    before = 0.0  # mass before place i
    for i in range(len(terms)):
        if before > slack:
            break
        skipped = before
        for j in range(i + 1, len(terms)):
            if skipped > slack:
                break
            keys.append((terms[i] + " " + terms[j], float(weights[i]), float(weights[j]), *rest(j + 1)))
            skipped += mass[j]
        before += mass[i]
    return keys


def same_question(a: dict[str, int], b: dict[str, int]) -> bool:
    """Exact check of two classes' terms with their frequencies: what they don't share must be framing or pair up as misspellings."""
    only_a, only_b = ([t for t in x if t not in y and t not in FRAMING] for x, y in ((a, b), (b, a)))
    if len(only_a) != len(only_b):
        return False
    for t in only_a:
        for k, u in enumerate(only_b):
            if _misspells(t, a[t], u, b[u]) or _misspells(u, b[u], t, a[t]):
                del only_b[k]
                break
        else:
            return False
    return True


def similar_classes(vectors: DataFrame, threshold: float) -> DataFrame:
    """(train_class, eval_class, cosine) of different classes between splits at or above the threshold, checked."""
    listed = vectors.select("class_id", "train", "eval", F.explode("lists").alias("x")).select("class_id", "train", "eval", F.xxhash64("x.key").alias("key"), "x.a", "x.b", "x.norm", "x.most", "x.total")

    def side(flag: str, name: str) -> DataFrame:
        columns = [F.col(c).cast("float").alias(c + name) for c in ("a", "b", "norm", "most", "total")]
        return listed.where(F.col(flag) == 1).select("key", F.col("class_id").alias(name), *columns)

    # Exact for a pair's first two shared terms; on its other keys a pair may be dropped, but never under that one.
    shared = F.col("ax") * F.col("ay") + F.col("bx") * F.col("by")
    residual = F.col("normx") * F.col("normy")
    heaviest = F.least(F.col("mostx") * F.col("totaly"), F.col("mosty") * F.col("totalx"))
    bound = shared + F.least(residual, heaviest)
    met = side("train", "x").join(side("eval", "y"), "key").where((F.col("x") != F.col("y")) & (bound >= threshold - 1e-5))
    candidates = met.select("x", "y").distinct()
    of = lambda c: vectors.select(F.col("class_id").alias(c), *[F.col(f"v.{f}").alias(f + c) for f in ("term", "w", "n")])
    pairs = candidates.join(of("x"), "x").join(of("y"), "y")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for x, y, tx, wx, nx, ty, wy, ny in pdf[["x", "y", "termx", "wx", "nx", "termy", "wy", "ny"]].itertuples(index=False, name=None):
                other = dict(zip(ty, wy))
                cosine = sum(w * other[t] for t, w in zip(tx, wx) if t in other)
                if cosine >= threshold - 1e-9 and same_question(dict(zip(tx, nx)), dict(zip(ty, ny))):
                    rows.append((x, y, cosine))
            yield pd.DataFrame(rows, columns=["train_class", "eval_class", "cosine"])

    return pairs.mapInPandas(judge, "train_class string, eval_class string, cosine double")


def split_overlaps(questions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(train_id, eval_id, eval_split, train_source, eval_source, cosine): each pair of ids asking the same across splits.

    Needs id, question, split; source where present. Rows with a null id, split or question, with a split that is
    neither train, validation nor test, or without any word form no pair. An id with rows on both sides pairs with
    itself. Repeated rows count once. Exact copies are joined as one class and expanded only in the result, which
    must name every pair of ids.
    """
    have = {c.lower() for c in questions.columns}
    rows = questions.select(
        F.col("id").cast("string").alias("id"),
        F.col("question").cast("string").alias("question"),
        split_name(F.col("split").cast("string")).alias("split"),
        (F.col("source").cast("string") if "source" in have else F.lit(None).cast("string")).alias("source"),
    ).where(F.col("id").isNotNull() & F.col("split").isin("train", "validation", "test"))
    members, classes = question_classes(rows)
    members, classes = cut_lineage(members), cut_lineage(classes)
    vectors = cut_lineage(weighted_vectors(classes, threshold))
    links = similar_classes(vectors, threshold)
    own = classes.where((F.col("train") == 1) & (F.col("eval") == 1)).select(F.col("class_id").alias("train_class"), F.col("class_id").alias("eval_class"), F.lit(1.0).alias("cosine"))
    links = links.unionByName(own)
    train = members.where(F.col("split") == "train").select(F.col("class_id").alias("train_class"), F.col("id").alias("train_id"), F.col("source").alias("train_source"))
    held = members.where(F.col("split") != "train").select(F.col("class_id").alias("eval_class"), F.col("id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"))
    return (
        links.join(train, "train_class")
        .join(held, "eval_class")
        .groupBy("train_id", "eval_id", "eval_split")
        .agg(F.min("train_source").alias("train_source"), F.min("eval_source").alias("eval_source"), F.round(F.max("cosine"), 6).alias("cosine"))
    )


def overlap_counts(pairs: DataFrame) -> DataFrame:
    """Pairs and distinct evaluation ids per split and source of the evaluation side."""
    return pairs.groupBy("eval_split", "eval_source").agg(
        F.count("*").alias("pairs"), F.countDistinct("eval_id").alias("eval_ids"), F.countDistinct("train_id").alias("train_ids")
    )
