"""Question overlaps, answer defects, truncated texts."""

import itertools
from collections import Counter

import pytest

from routeloom.llm import completeness as C
from routeloom.llm import cutoff, defects, overlap

Q = "Which warning sign is most often reported after vomerrilirel for tafezesaitis in patients on blood thinners?"
SAME = [
    Q.upper(), "Q: " + Q, "[4] " + Q + " Thanks!", Q.replace("Which", "What").replace("patients", "people"), Q.replace("reported", "reportd"), Q.replace(" ", "&nbsp;", 3),
    "In patients on blood thinners, which warning sign is most often reported after vomerrilirel for tafezesaitis?", Q.replace("warning", "wаrning"), "I would like to know: " + Q,
]
OTHER = [Q.replace("vomerrilirel", "zorlihuvofane"), Q.replace("tafezesaitis", "gagatinopathia"), Q.replace(" on blood thinners", ""), Q.replace("warning sign", "risk factor"), Q.replace("?", " after 12 weeks?")]


def filler(n=120):
    """Questions that make the words frequent, each about another pair."""
    drugs = [f"{a}{b}orel" for a, b in itertools.product("bcdfghjklm", ("anil", "orip", "ulem"))]
    return [(f"f{i}", Q.replace("vomerrilirel", drugs[i % 30]).replace("tafezesaitis", f"{drugs[(i * 7 + i // 30) % 30]}osis"), "train" if i % 2 else "none") for i in range(n)]


def test_overlaps_find_variants_and_no_other_question(spark):
    rows = filler() + [("t", Q, "train"), ("t", Q, "test"), ("n", None, "train"), ("m", None, "test"), ("w", "???", "test"), (None, Q, "test"), ("z", Q, None)]
    rows += [(f"s{k}", q, "Dev") for k, q in enumerate(SAME)] + [(f"o{k}", q, "TEST") for k, q in enumerate(OTHER)] + [("s0", SAME[0], "validation")]
    df = spark.createDataFrame(rows, "id string, question string, split string").withColumnRenamed("id", "id")
    got = {(r["train_id"], r["eval_id"]) for r in overlap.split_overlaps(df).collect()}
    assert got == {("t", "t")} | {("t", f"s{k}") for k in range(len(SAME))}
    again = {(r["train_id"], r["eval_id"]) for r in overlap.split_overlaps(df.repartition(5)).collect()}
    assert got == again
    assert overlap.split_overlaps(df.limit(0)).count() == 0


def test_join_loses_no_pair_at_the_threshold(spark):
    rows = filler(60) + [(f"e{i}", q, "test") for i, (_, q, _) in enumerate(filler(60))]
    df = spark.createDataFrame(rows, "id string, question string, split string")
    members, classes = overlap.question_classes(df.selectExpr("id", "question", "case when split = 'none' then 'train' else split end split", "null source"))
    vectors = overlap.weighted_vectors(classes, 0.8).collect()
    cos = lambda a, b: sum(x["w"] * {t["term"]: t["w"] for t in b["v"]}.get(x["term"], 0) for x in a["v"])
    brute = {(x["class_id"], y["class_id"]) for x in vectors for y in vectors if x["train"] and y["eval"] and x["class_id"] != y["class_id"] and cos(x, y) >= 0.8 and overlap.same_question({t["term"]: t["n"] for t in x["v"]}, {t["term"]: t["n"] for t in y["v"]})}
    got = {(r["train_class"], r["eval_class"]) for r in overlap.similar_classes(overlap.weighted_vectors(classes, 0.8), 0.8).collect()}
    assert got == brute


@pytest.mark.parametrize("a,b,k,ok", [("treated", "tretaed", 1, True), ("treated", "treted", 1, True), ("abc", "abd", 0, False), ("kitten", "sitting", 3, True), ("kitten", "sitting", 2, False)])
def test_edits(a, b, k, ok):
    assert overlap.edits(a, b, k) is ok


WHOLE = "Adults treated for the condition tolerated the drug at {} mg after {} weeks of care."


def corpus():
    return [WHOLE.format(a, b) + " " + WHOLE.format(b, a) for a in range(3, 40, 2) for b in range(2, 30, 3)]


CASES = {
    None: ["Yes.", "vomerrilirel", "- aspirin\n- ibuprofen 40 mg\n- weeks", "Adults treated for the condition tolerated the drug at 5 mg after 9 weeks of care", "Sorry to hear about the delay. Patients cannot receive aspirin together with other drugs on the ward."],
    "empty": [None, "", " \t", "​", "N/A", "**Answer:** ", "```\n```", "[]", '""', "null", "...", "Answer:"],
    "refusal": ["I'm sorry, but I can’t help with that.", "Unable to answer based on the given passages.", "Hmm. I don't know.", "It is not possible for me to discuss this because this needs a licensed clinician.", "As a language model I am not able to answer this question."],
    "copies_question": [Q, Q.lower().replace("?", ""), f"Question: {Q} Answer:", f"{Q} {Q}", "You asked: " + Q],
    "other_language": ["Die Patienten mit dieser Krankheit wurden nach der Behandlung nicht mehr auf das Mittel umgestellt.", "接受治疗的成年人反应良好，观察时间为8周。"],
    "truncated": ["Adults treated for the condition tolerated the dr", "Adults treated for the condition tolerated the drug at", "Adults treated for the condition (at 5 mg", "Adults treated for the…", '{"answer": "adults trea'],
}


def test_answer_defects(spark):
    rows = [(k, "q", "vector", a) for k, a in enumerate(corpus())]
    expected = {}
    for kind, answers in CASES.items():
        for a in answers:
            key = 10_000 + len(expected)
            rows.append((key, "q", "vector", a))
            expected[key] = kind
    rows += [(20_000, "gone", "vector", "Die Patienten wurden mit dem Mittel nicht behandelt."), (20_001, None, None, None)]
    df = spark.createDataFrame(rows, "result_id long, question_id string, method string, answer string").selectExpr("*", "'x' question")
    asked = spark.createDataFrame([("q", Q), ("q", None), (None, Q)], "id string, question string")
    got = {r["result_id"]: r["defect"] for r in defects.answer_defects(df, asked).collect()}
    assert len(got) == len(rows)
    wrong = {dict((r[0], r[3]) for r in rows)[k]: (got[k], v) for k, v in expected.items() if got[k] != v}
    assert not wrong
    assert got[20_000] is None and got[20_001] == "empty" and not any(got[k] for k in range(len(corpus())))
    assert defects.answer_defects(df.limit(0), asked).count() == 0
    assert defects.answer_defects(df, asked.limit(0)).where("defect = 'copies_question'").count() == 0


def test_copies_of_any_length(spark):
    long_question = " ".join(f"{Q} Drug {a}{b}ol?" for a in ("bar", "cor", "dul", "fen") for b in ("anil", "orip", "ulem", "asit") for _ in range(8))
    rows = [(k, "q", "vector", a) for k, a in enumerate(corpus())]
    rows += [(10_000, "q", "vector", " ".join([Q] * 40)), (10_001, "q", "vector", " ".join([Q] * 900)), (10_002, "long", "vector", long_question + " " + " ".join(corpus()[:3]))]
    df = spark.createDataFrame(rows, "result_id long, question_id string, method string, answer string")
    asked = spark.createDataFrame([("q", Q), ("long", long_question)], "id string, question string")
    got = {r["result_id"]: r["defect"] for r in defects.answer_defects(df, asked).where("defect is not null").collect()}
    assert got == {10_000: "copies_question", 10_001: "copies_question"}
    assert len(long_question.split()) > 2_000


def test_tiles_take_the_longest_runs_first():
    assert defects.tiles("x a b c d b c a".split(), "a b c y b c d z c a".split()) == [False, True, True, True, False, True, True, False]
    assert defects.tiles("a b c d".split(), "a b x b c d".split()) == [False, True, True, True]


def test_answers_in_another_language_that_share_function_words_with_the_question_language(spark):
    foreign = [
        "As crianças com a doença foram tratadas no hospital e as doses não foram a causa da dor, mas a febre voltou depois.",
        "Los pacientes con la enfermedad no se trataron as in the past a las dosis que el hospital de la ciudad fue a dar por un mes.",
        "Die Patienten mit der Krankheit wurden nach der Behandlung, auch in der Studie The Origin of the Pain and of the Fever, nicht auf das Mittel umgestellt, aber die Dosis ist bei den Frauen und im Alter nicht die gleiche, und das wird sich zu der Zeit auch nicht mit dem Mittel von der Klinik ändern.",
    ]
    kept = "Adults treated for the condition tolerated the drug at 5 mg, as stated in the report Os Lusiadas de Camoes, and had no pain."
    rows = [(k, "q", "vector", a) for k, a in enumerate(corpus())] + [(10_000 + k, "q", "vector", a) for k, a in enumerate(foreign)] + [(20_000, "q", "vector", kept)]
    df = spark.createDataFrame(rows, "result_id long, question_id string, method string, answer string")
    got = {r["result_id"]: r["defect"] for r in defects.answer_defects(df, spark.createDataFrame([("q", Q)], "id string, question string")).where("defect is not null").collect()}
    assert got == {10_000 + k: "other_language" for k in range(len(foreign))}


def test_truncated_texts(spark):
    rows = [(k, "s", t) for k, t in enumerate(corpus())]
    cut = ["Adults treated for the condition tolerated the dr", "Adults treated for the condition tolerated the drug at 5 mg after", '{"entities": [{"name": "x"}', "aspirin, ibuprofen,", "Adults treated for the condition tolera�", "Adults treated&am"]
    whole = ["Adults treated for the condition tolerated the drug at 5 mg after 9 weeks of care", '{"a": [1, 2]}', "treated, tolerated", None, "", "No.", WHOLE.format(1, 2) + " (see table 2)", "- " + WHOLE.format(3, 4)[:-1] + "\n- " + WHOLE.format(4, 3)[:-1]]
    rows += [(1000 + k, "c", t) for k, t in enumerate(cut)] + [(2000 + k, "w", t) for k, t in enumerate(whole)] + [(1000, "c", cut[0])]
    df = spark.createDataFrame(rows, "generation_id long, source string, text string").selectExpr("*", "1 hash")
    out = cutoff.truncated_texts(df).collect()
    assert len(out) == len(rows)
    got = {r["generation_id"]: r["truncated"] for r in out}
    assert {k: got[1000 + k] for k in range(len(cut))} == {k: True for k in range(len(cut))}
    assert {k: got[2000 + k] for k in range(len(whole))} == {k: False for k in range(len(whole))}
    rates = {r["source"]: r["cut_share"] for r in cutoff.truncation_rates(cutoff.truncated_texts(df)).collect()}
    assert rates["c"] == 1.0 and rates["w"] == 0.0
    assert cutoff.truncated_texts(df.limit(0)).count() == 0


def test_prefix_join_matches_brute_force(spark):
    import random

    rng = random.Random(4)
    base = ["".join(rng.choice("ab ") for _ in range(rng.randint(20, 60))) for _ in range(60)]
    texts = sorted({t for b in base for t in (b, b[: rng.randint(24, 60)])})
    df = spark.createDataFrame([(t, k) for k, t in enumerate(texts)], "core string, hash long")
    got = {r["hash"] for r in cutoff.longer_copies(df).collect()}
    assert got == {k for k, t in enumerate(texts) if len(t) >= 24 and any(u != t and u.startswith(t) for u in texts)}


def test_structures():
    for text, state in (('{"a": ["x"', "json"), ('{"a": 1}', None), ("```\ncode", "fence"), ("see (figure 2", "bracket"), ("a) b", None), ("he said “no", "quote"), ("x <div", "tag")):
        assert C.open_structure(text) == state


def test_structures_before_a_sentence_mark():
    open_ = {"See ```code here.": "fence", "See (an open one.": "bracket", "He said “this is it.": "quote", "<b>bold.": "tag", "a\n1. b\n2.": "list", "<!-- a ( b": "tag", 'He said "stop it now': "marks"}
    closed = ["„Gut“ ist es.", "»Gut« ist es.", "«bon» oui.", 'He "said" it, 5" tall.', "<p>para <br> ok.", "```\n( [\n``` done.", "a) first; b) second."]
    assert {t: C.open_structure(t) for t in open_} == open_
    assert [C.open_structure(t) for t in closed] == [None] * len(closed)


def test_no_structure_is_passed_unparsed(spark):
    from pyspark.sql import functions as F

    rows = [(1, "See ```code here."), (2, "See (an open one."), (3, "He said “this is it."), (4, "All is well."), (5, "Two items:\n1. one\n2."), (6, '{"a": 1}'), (7, '{"a": 1'), (8, None), (9, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: r["w"] for r in df.select("id", C.surely_whole(F.col("text")).alias("w")).collect()}
    assert got[4] and got[6] and not any(got[k] for k in (1, 2, 3, 5, 7)) and not got[8] and not got[9]
    texts = spark.createDataFrame([(100 + k, t) for k, t in enumerate(corpus())] + rows[:4], "generation_id long, text string")
    cut = {r["generation_id"]: r["evidence"] for r in cutoff.truncated_texts(texts).where("truncated").collect()}
    assert cut == {1: "structure", 2: "structure", 3: "structure"}


def test_every_continuation_of_a_prefix_counts(spark):
    base = "a text of more than twenty-four characters"
    rows = [base, base + ", and so on", base + " goes on", base + ". Then more", base + "s", base + " goes on here", "b" * 30, "b" * 30 + ".", "c" * 30, "c" * 30 + "(x)"]
    df = spark.createDataFrame([(t, k) for k, t in enumerate(rows)], "core string, hash long")
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["hash"]: r["bits"] for r in cutoff.longer_copies(df).collect()}
        assert got == {0: cutoff.GOES_ON | cutoff.STOPS, 2: cutoff.GOES_ON, 6: cutoff.STOPS, 8: 0}
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_prefixes_open_at_the_end_of_a_partition_keep_their_hash(spark):
    base = [f"{k:03d} a text of more than twenty-four characters" for k in range(40)]
    keys = {t: 2**60 + 2 * k + 1 for k, t in enumerate(x + more for x in base for more in ("", " goes on"))}
    df = spark.createDataFrame([*keys.items()], "core string, hash long")
    for parts in (1, 13, 80):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r["hash"]: r["bits"] for r in cutoff.longer_copies(df).collect()}
        assert got == {keys[t]: cutoff.GOES_ON for t in base}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ends_are_told_as_by_the_patterns():
    import random
    import re

    cjk = C._CJK
    token = re.compile(rf"[{cjk}]|(?:(?![{cjk}])[^\W_])+|[,;:，；：、]")
    sentence = re.compile(r"(?<=[.!?。！？])[\"”’»)\]}*\s]*(?=\s|$)|(?<=[。！？])|\n(?=\s*(?:[-*•+]|\d{1,3}[.)])\s)")
    rng = random.Random(5)
    bits = [*".!?。！？؟\"”’»)]}*_ \n\t([“„<…�&\\-•✓:;,，abZ1é中", "..", "\n- ", "\n1. ", "[cut]", "(cut)", "[3]", " (see x)", "&am", "\x1c", "\u2003", "İ", "²", "\r\n", "word "]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 20)))
        assert C.tokens_of(text) == token.findall(text.lower()), repr(text)
        pieces = C.sentences_of(text)
        assert pieces == [x for x in sentence.split(text) if x and x.strip()], repr(text)
        assert C.without_neutral(text) == C.NEUTRAL.sub("", text), repr(text)
        assert C.cut_entities(text) == C.CUT_MARK.sub("", text), repr(text)
        assert C.stops(text) == bool(C.STOP.search(text)), repr(text)
        assert C.stop_shape(text, pieces) == C.stop_shape(text), repr(text)


def test_the_table_of_texts_is_read_three_times_only(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    texts = [*corpus(), "Adults treated for the condition tolerated the dr"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "generation_id long, text string").mapInPandas(counted, "generation_id long, text string")
    assert [r["generation_id"] for r in cutoff.truncated_texts(df).where("truncated").collect()] == [len(texts) - 1]
    assert read.value == 3 * len(texts)  # for distinct texts, for their beginnings, and for the result's rows


def test_finished_words_are_those_of_the_pattern(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    bits = [*".!?。\"')]}_ \n\t([{<-:;,/aZ1é中–", "\x1c", "word", "word ", "two, ", "end. ", "\r\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3_000)] + ["one two"] * 3 + ["One two. Three", None, "", "a, b", "Two: one"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)(?=[\s,;:'\"()\[\]/–-]+[\p{L}\p{N}]|[.!?。！？])"), 1)
    right = {r["word"]: r["n"] for r in df.select(F.explode(F.array_distinct(tokens)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    wanted = spark.createDataFrame([(w,) for w in [*right, "none"]], "word string")
    assert {r["word"]: r["inner"] for r in C.finished_words(df, wanted).collect()} == right and right["one"] >= 4


def test_texts_that_are_surely_whole_are_so_in_both_engines(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(7)
    bits = [*".!?。؟\"”*_ \n([<`19a中", "word", '{"a": 1}', "[", "{"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(3_000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", C.parses(F.col("text")).alias("parsed"), C.surely_whole(F.col("text")).alias("whole"))
    for r in df.collect():
        assert (C.plainly_whole(r["text"]) if r["parsed"] is None else r["parsed"]) == bool(r["whole"]), repr(r["text"])


def test_a_chance_occurrence_does_not_finish_a_word(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, None), (1, 1), (60, 1), (60, 2)], "ends int, inner int")
    assert [r[0] for r in df.select(C.unfinished(F.col("ends"), F.col("inner"))).collect()] == [True, False, True, False]
    texts = spark.createDataFrame([("one two.",), ("two three",), (None,)], "text string")
    wanted = spark.createDataFrame([("two",), ("four",)], "word string")
    assert {r["word"]: r["inner"] for r in C.finished_words(texts, wanted).collect()} == {"two": 2}


def test_refusals_in_other_languages():
    for text in ("Ich kann diese Frage leider nicht beantworten.", "Lo siento, no puedo responder a esta pregunta.", "Je ne peux pas répondre à cette question.", "Non posso rispondere a questa domanda.", "Não posso responder a esta pergunta.", "Ik kan deze vraag niet beantwoorden.", "抱歉，我无法回答这个问题。", " ".join(["I cannot answer this question."] * 60)):
        assert defects.is_refusal(text), text
    for text in ("Die Patienten können das Mittel nicht vertragen.", "Los pacientes no pueden tomar el medicamento.", "患者无法耐受该药物，治疗后停用。"):
        assert not defects.is_refusal(text), text


def test_language_of_questions_with_few_function_words():
    seen = {k: {} for k in defects.LANGUAGES}
    seen["en"] = {"why": 900.0, "does": 900.0, "option": 300.0}
    seen["es"] = {"por": 30.0, "que": 30.0, "para": 25.0}
    shares = defects.word_shares(seen, {k: {"en": 1000, "es": 30}.get(k, 0) for k in defects.LANGUAGES})
    assert defects.likely_language("Why does it? No option", shares, 1.0) == "en"
    assert defects.likely_language("¿Por qué X para Y?", shares, 1.0) == "es"
    assert defects.likely_language("xyz", shares) is None


def test_bounds_prune_no_pair_and_terms_are_joined_beyond_the_broadcast(spark):
    rows = filler(60) + [("t", Q, "train")] + [(f"s{k}", q, "test") for k, q in enumerate(SAME)]
    df = spark.createDataFrame(rows, "id string, question string, split string").selectExpr("id", "question", "case when split = 'none' then 'train' else split end split", "null source")
    results = []
    for most in (400_000, 3):
        _, classes = overlap.question_classes(df, broadcast_terms=most)
        vectors = overlap.weighted_vectors(classes, 0.8, broadcast_terms=most)
        results.append((sorted((r["class_id"], r["train"], r["eval"], [(x["term"], round(x["w"], 9)) for x in r["v"]]) for r in vectors.collect()), {tuple(r)[:2] for r in overlap.similar_classes(vectors, 0.8).collect()}))
    assert results[0] == results[1]


def plain_end_model(texts):
    """The end model by plain loops over all texts."""
    parsed = [(t.split(" "), whole) for text in texts for t, whole in C.sentence_rows(text)]
    words = Counter(w for t, _ in parsed for w in t)
    model = C.EndModel(common={w for w, n in words.items() if n >= max(5.0, C.RARE_SHARE * sum(words.values()))})
    seen, ends, pairs = Counter(), Counter(), Counter()
    for tokens, whole in parsed:
        tokens = tokens if whole else tokens[:-1]
        kinds = ["^", *map(model.kind, tokens)]
        for i in range(1, len(kinds)):
            for c in [tuple(kinds[i - k + 1 : i + 1]) for k in (1, 2, 3, 4) if i - k + 1 >= 0] + [("=", tokens[i - 1])]:
                seen[c] += 1
                ends[c] += whole and i == len(kinds) - 1
            pairs[kinds[i - 1], tokens[i - 1]] += 1
    long = {w for t, whole in parsed for w in (t if whole else t[:-1]) if len(w) >= 7 and w.isalpha()}
    model.endings = {t for t, n in Counter(w[-3:] for w in long).items() if n >= max(4, 0.01 * len(long))}
    model.seen = {c: n for c, n in seen.items() if n >= C.LEAST_SEEN}
    model.ends = {c: n for c, n in ends.items() if n and c in model.seen}
    model.pairs = {c: n for c, n in pairs.items() if n > 1}
    for before, word in sorted(model.pairs):
        model.after.setdefault(before, []).append(word)
    return model


def test_end_model_counts_all_texts(spark, data, monkeypatch):
    monkeypatch.setattr(C, "HELD_COUNTS", 3000)
    rows = [r["text"] for r in spark.read.parquet(f"{data}/generations.parquet").where("text is not null").select("text").collect()]
    texts = rows + rows[:50] + [f"Case {i} was seen. The ward {i % 7}b closed early" for i in range(13_000)] + ["", "。", None]
    model = C.fit_end_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert model == plain_end_model({t for t in texts if t})
    assert model.seen["^", "case", "#", "was"] == model.seen["case", "#", "was"] >= 13_000
