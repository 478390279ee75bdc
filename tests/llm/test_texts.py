"""Folding, leaks, languages, boundaries."""

import random

from routeloom.llm import boundaries, language, leakage
from routeloom.llm.textforms import fold, fold_with_offsets, repair, words

ITEM = "In the older cohort, biopsies taken from the liver lost response to treatment through the course. Carriers of the variant did best after twelve weeks of care."


def test_fold_and_offsets_agree():
    for text in ("Plain text", "Café ﬁne <b>bold</b>&nbsp;x", "dÃ­a seguÃ­", "bro-\n> ken li­ne", "Ünïcode​ nеw", "", "&NBSP;A&#65;", "a < b > c"):
        folded, places = fold_with_offsets(text)
        assert folded == fold(text) and len(places) == len(folded) and all(0 <= p < max(1, len(text)) for p in places)
    assert fold("nеw") == "new" and words(fold("bro-\n> ken")) == ["broken"] and fold("dÃ­a") == "dia"
    assert repair("dÃ­a") == "día"
    assert words(fold("用药3周")) == ["用", "药", "3", "周"]


def brute(text, items, run=7):
    """Word by word: the best ordered cover by runs of at least ``run`` words, by dynamic programming over positions."""
    d = leakage.item_words(text)
    out = {}
    for key, t in items:
        w = leakage.item_words(t)
        runs = []
        for i in range(len(d)):
            for j in range(len(w)):
                if d[i] == w[j] and (i == 0 or j == 0 or d[i - 1] != w[j - 1]):
                    n = 0
                    while i + n < len(d) and j + n < len(w) and d[i + n] == w[j + n]:
                        n += 1
                    if n >= run:
                        runs.append((i, j, n))
        runs.sort()
        best = []
        for i, j, n in runs:
            best.append(n + max([b for (a, c, m), b in zip(runs, best) if a + m <= i and c + m <= j], default=0))
        if w and max(best, default=0) >= 0.5 * len(w):
            out[key] = max(best) / len(w)
    return out


def test_leaks_match_brute_force_on_damaged_copies(spark):
    rng = random.Random(5)
    vocab = [f"w{k}x" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(14, 30)))) for k in range(12)]
    docs = []
    for n in range(80):
        item = rng.choice(items)[1].split()
        a = rng.randint(0, len(item) - 3)
        b = rng.randint(a + 3, len(item))
        filler = lambda: [rng.choice(vocab) for _ in range(rng.randint(0, 12))]
        docs.append((n, " ".join(filler() + item[a:b] + filler())))
    got = {}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("text", "text")
    for r in leakage.leaked_passages(df, spark.createDataFrame(items, "item_id long, text string")).collect():
        got.setdefault(r["doc_id"], {})[r["item_id"]] = round(r["share"], 6)
    expected = {k: {i: round(v, 6) for i, v in brute(t, items).items()} for k, t in docs}
    assert got == {k: v for k, v in expected.items() if v}


def test_leaks_survive_layout_and_report_places(spark):
    damaged = "<p>" + ITEM.upper().replace("RESPONSE", "RES-\n> PONSE").replace(" ", " ") + "</p>"
    docs = spark.createDataFrame([(1, "x " + damaged, "c"), (1, "x " + damaged, "c"), (2, ITEM[:40], "c"), (3, None, "c"), (4, "", "c")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "short"), (7, ITEM)], "item_id long, text string")
    rows = leakage.leaked_passages(docs, items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in rows] == [(1, 7), (1, 7)] and rows[0]["share"] == 1.0
    found = ("x " + damaged)[rows[0]["first_char"] : rows[0]["last_char"] + 1]
    assert found.startswith("IN") and found.endswith("CARE")
    assert leakage.leaked_passages(docs.limit(0), items).count() == 0 and leakage.leaked_passages(docs, items.limit(0)).count() == 0
    blocks = leakage.leaked_passages(docs, items, block_items=1).collect()
    assert [(r["doc_id"], r["item_id"]) for r in blocks] == [(1, 7), (1, 7)]


SENTENCES = {
    "en": "The patients who were treated with the drug had a lower need for surgery in the first weeks.",
    "de": "Die Patienten, die mit dem Mittel behandelt wurden, mussten in den ersten Wochen nicht operiert werden.",
    "fr": "Les patients qui ont reçu le produit n'ont pas été opérés dans les premières semaines de la cure.",
    "zh": "接受治疗的病人在手术后的情况稳定，所以不需要重新检查。",
}


def test_languages(spark):
    docs = [(k, SENTENCES[c] + " " + SENTENCES[c], c, "s", "c") for k, c in enumerate(SENTENCES)]
    docs += [(10, SENTENCES["en"] + " " + SENTENCES["fr"], "en-GB", "s", "c"), (11, SENTENCES["de"], "und", None, None), (12, SENTENCES["en"] + " (cited as “Leitfaden zur Nachsorge”)", "English", "s", "c")]
    docs += [(13, None, "en", "s", "c"), (14, "", None, "s", "c"), (15, "???", None, "s", "c"), (16, SENTENCES["fr"], "de", "s", "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, corpus_name string")
    rows = {r["doc_id"]: r for r in language.identify_languages(df).collect()}
    assert len(rows) == len(docs)
    for k, c in enumerate(SENTENCES):
        assert [x["lang"] for x in rows[k]["languages"]] == [c] and rows[k]["confidence"] > 0.9
    assert {x["lang"] for x in rows[10]["languages"]} == {"en", "fr"} and rows[13]["lang"] is None and not rows[14]["segments"]
    found = {(r["doc_id"], r["lang"]) for r in language.label_problems(language.identify_languages(df)).collect()}
    assert found == {(10, "en"), (10, "fr"), (11, "de"), (16, "fr")}
    seg = [s for s in rows[10]["segments"] if s["lang"] == "fr"][0]
    assert docs[4][1][seg["first"] : seg["last"]].strip() == SENTENCES["fr"]
    assert language.identify_languages(df.limit(0)).count() == 0
    assert language.identify_languages(df.select("doc_id", "text")).count() == len(docs)


def test_language_accuracy_on_held_out_labels(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = language.identify_languages(docs).collect()
    known = [r for r in rows if r["declared"] and len(r["languages"]) == 1]
    assert sum(r["languages"][0]["lang"] == r["declared"] for r in known) / len(known) > 0.9


def check_split(text, size, overlap):
    pieces = boundaries.split_text(text, size, overlap)
    all_words = text.split()
    assert all(n <= size for _, n, _, _, _ in pieces)
    assert [w for f, n, new, a, b in pieces for w in text[a:b].split()[n - new :]] == all_words
    for (f, n, _, _, _), (g, m, new, _, _) in zip(pieces, pieces[1:]):
        assert f + n - g == min(overlap, f + n) and m - new == f + n - g
    return pieces


def test_split_sizes_overlaps_and_round_trip():
    rng = random.Random(8)
    for layout in ("", ".", ",", ".\n", "\n\n"):
        for n in (1, 39, 40, 41, 97, 400):
            text = " ".join(f"w{i}" + (layout if layout and rng.random() < 0.2 else "") for i in range(n))
            pieces = check_split(text, 40, 7)
            assert (len(pieces) > 1) == (n > 40)


def test_cuts_fall_on_the_strongest_boundaries():
    part = "One two three four five six seven eight nine ten. "
    text = (part * 3).strip() + "\n\n" + (part * 3).strip()
    pieces = boundaries.split_text(text, 35, 5)
    assert [p[2] for p in pieces] == [30, 30]


def test_split_table_edges(spark):
    rows = [(1, "a " * 50, "x"), (1, "a " * 50, "x"), (2, None, "x"), (3, " \n\t", "x"), (4, "word", None), (5, "x" * 100_000, None), (6, "long " * 30_000, None)]
    df = spark.createDataFrame(rows, "corpus_doc_id long, context string, piece string")
    out = boundaries.split_oversized(df, 40, 4).collect()
    by = {}
    for r in out:
        by.setdefault(r["corpus_doc_id"], []).append(r)
    assert set(by) == {1, 4, 5, 6} and len(by[1]) == 4 and len(by[5]) == 1 and all(r["words"] <= 40 for r in out)
    assert boundaries.split_oversized(df.limit(0), 40, 4).count() == 0


def test_blocks_of_items_and_repeated_passages(spark):
    from routeloom.llm import leakage

    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = spark.createDataFrame([(1, "x " + passage + " y"), (2, " . ".join([passage] * 300)), (3, "nothing here"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(k, passage if k % 2 else f"other words {k} " + " ".join(f"w{k}{j}" for j in range(9))) for k in range(6)], "item_id long, text string")
    one = {(r["doc_id"], r["item_id"], r["leaked_words"]) for r in leakage.leaked_passages(docs, items).collect()}
    many = {(r["doc_id"], r["item_id"], r["leaked_words"]) for r in leakage.leaked_passages(docs, items, block_items=2).collect()}
    assert one == many == {(d, i, 12) for d in (1, 2) for i in (1, 3, 5)}


def test_chains_keep_the_order_of_both_sides():
    from routeloom.llm.leakage import _chain

    assert _chain([]) == (0, [])
    assert _chain([(0, 0, 6), (50, 7, 13)])[0] == 14
    assert _chain([(0, 7, 13), (50, 0, 6)])[0] == 7
    assert _chain([(0, 0, 6), (50, 4, 12)])[0] == 13
    assert _chain([(k * 10, 0, 6) for k in range(2000)])[0] == 7


def test_priors_beyond_the_broadcast_are_joined(spark):
    from routeloom.llm import language

    docs = spark.createDataFrame([(k, "en" if k % 3 else "de", f"s{k % 4}", f"c{k % 2}") for k in range(60)], "doc_id long, code string, source string, corpus_name string")
    priors = language.host_priors(docs)
    few = {r["doc_id"]: r["prior"] for r in language.with_priors(docs, priors).collect()}
    assert few == {r["doc_id"]: r["prior"] for r in language.with_priors(docs, priors, broadcast_hosts=1).collect()} and len(few) == 60
