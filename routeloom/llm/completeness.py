"""Does a text stop before its end?

Three kinds of evidence, used by the operators on answers and generations:

* structure: a pushdown parser over fences, brackets, quotations, lists, JSON
  strings and markup tells what is still open where the text stops;
* words: a last word that the corpus shows as a finished word far less often
  than at such a stop was cut;
* sentence ends: a small n-gram model of the contexts in which sentences end,
  counted over the sentences of all distinct texts.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: A class of context must have been seen so often to be trusted.
LEAST_SEEN = 10
#: Contexts that end a sentence less often than this are inside one.
END_SHARE = 0.02
#: Words rarer than this share of the fitted words are one class.
RARE_SHARE = 3e-4
#: A last word was cut when the corpus finishes it less than once in so many texts that stop in it. A share, so
#: that the verdict doesn't turn with a single chance occurrence as the corpus grows.
FINISHED_EVERY = 50
#: Counts that a task holds before it adds up equal ones.
HELD_COUNTS = 1_000_000
#: Words that are looked up among the corpus's by a broadcast; more are looked up by a shuffle.
BROADCAST_WORDS = 200_000

_CJK = "぀-ヿ㐀-䶿一-鿿"
_TOKEN, _PLAIN_TOKEN = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+|[,;:，；：、]"), re.compile(r"[a-z0-9]+|[,;:]")
#: A sentence's last mark and what goes with it, or the line break before a list item. It begins with what it looks for,
#: not with a look behind, so that texts are searched fast.
_SENTENCE = re.compile(r"[.!?。！？][\"”’»)\]}*\s]*(?=\s|$)|[。！？]|\n(?=\s*(?:[-*•+]|\d{1,3}[.)])\s)")
#: Marks that say nothing about where a text stops: notes, references, ticks, closing emphasis and quotes.
_NEUTRAL = r"(?:\s|[✓✔*_`\"”’»]|\[\d{1,4}\]|\([^()\[\]]{1,30}\))+$"
#: Marks left by a cut.
_CUT_MARK = r"(?:…|\.{2,}|�|\[(?:…|\.{3}|cut|truncated|continued)\]|\((?:cut|truncated|continued)\)|&[A-Za-z#0-9]{0,8}|<[/A-Za-z]{0,12}|\\\\(?:u[0-9a-fA-F]{0,3})?)\s*$"
_STOP = r"[.!?。！？؟][\"”’»)\]}*_\s]*$"
NEUTRAL, CUT_MARK, STOP = re.compile(_NEUTRAL), re.compile(_CUT_MARK.replace("\\\\\\\\", "\\\\")), re.compile(_STOP)


#: Single characters that say nothing about where a text stops.
_QUIET = " \t\r\n✓✔*_`\"”’»"
#: What a prefix is compared without: quiet characters, marks of a cut and sentence marks.
_TRAIL = _QUIET + "…�."


def without_trail(column: Column) -> Column:
    """The text without quiet characters, cut marks and full stops at its end."""
    return F.rtrim(column, F.lit(_TRAIL))


def without_notes(column: Column) -> Column:
    """The text without what ``without_trail`` takes off, and without notes in brackets at its end."""
    bare = without_trail(column)
    notes = F.rtrim(F.regexp_replace(bare, r"(?:\s*(?:\[\w{1,12}\]|\([^()\[\]]{1,30}\)))+$", ""), F.lit(_TRAIL))
    return F.when(F.right(bare, F.lit(1)).isin(")", "]"), notes).otherwise(bare)


#: What can open a structure: without any of it a text has none.
_OPENS = "[(\\[{<`“„«»\"]"


#: Marks that end sentences; the last isn't one for ``surely_whole``.
_MARKS = tuple(".!?。！？؟")
_OPEN_SIGN = re.compile(_OPENS)


def parses(column: Column) -> Column:
    """Whether a text that opens with a brace or bracket is JSON; null for others."""
    structured = F.left(F.ltrim(column), F.lit(1)).isin("{", "[")
    return F.when(structured, F.try_parse_json(F.trim(column)).isNotNull())


def surely_whole(column: Column) -> Column:
    """True for texts that end with a sentence mark before quiet characters and hold nothing that opens a structure.

    Runs in the JVM over whole texts, so that only the rest goes to the parser in Python; a note after the mark and
    a number before it (perhaps a bare list mark) are left to that too. Texts that open with a brace or bracket are
    whole only when they parse as JSON.
    """
    parsed = parses(column)
    end = F.right(F.rtrim(column, F.lit(_QUIET)), F.lit(2))
    marked = F.right(end, F.lit(1)).isin(*".!?。！？") & (end != "..") & ~end.rlike("^[0-9]")
    return F.when(parsed.isNotNull(), parsed).otherwise(marked & ~column.rlike(_OPENS))


def plainly_whole(text: str) -> bool:
    """What ``surely_whole`` says of a text that opens with neither brace nor bracket."""
    end = text.rstrip(_QUIET)[-2:]
    return end[-1:] in _MARKS[:6] and end != ".." and end[0] not in "0123456789" and not _OPEN_SIGN.search(text)


#: What a neutral end can end with besides blanks, and the longest mark of a cut that isn't dots.
_NEUTRAL_SIGNS, _NEUTRAL_NOTE, _CUT_LENGTH = "✓✔*_`\"”’»", re.compile(r"(?:\[\d{1,4}\]|\([^()\[\]]{1,30}\))$"), 16


def without_neutral(text: str) -> str:
    """``NEUTRAL.sub("", text)``, from the end: neutral signs and notes are told by their last character."""
    while True:
        bare = text.rstrip().rstrip(_NEUTRAL_SIGNS)
        if bare[-1:] in ("]", ")") and (m := _NEUTRAL_NOTE.search(bare, max(0, len(bare) - 32))):
            bare = bare[: m.start()]
        if len(bare) == len(text):
            return text
        text = bare


def cut_mark_at(text: str) -> int:
    """Where ``CUT_MARK`` matches, looked for at the end only; -1 without a mark."""
    bare = text.rstrip()
    if bare[-1:] == ".":
        dots = len(bare.rstrip("."))
        return dots if len(bare) - dots > 1 else -1
    m = CUT_MARK.search(bare, max(0, len(bare) - _CUT_LENGTH))
    return m.start() if m else -1


def cut_entities(text: str) -> str:
    at = cut_mark_at(text)
    return text if at < 0 else text[:at]


_STRUCTURE = re.compile(
    r"```|<!--|-->|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]{0,400})?/?>|[()\[\]{}“”„«»]"
    r"|(?<![\w\"])\"(?=\w)|(?<=[\w.,!?;:%)…])\"(?!\w)"
)
#: Markup whose end may be left out, or that has none.
_UNPAIRED = frozenset("p br hr img input meta link wbr col li dt dd tr td th thead tbody tfoot option html body head".split())
_CLOSES = {")": "(", "]": "[", "}": "{", "”": "“"}
_KINDS = {"(": "bracket", "[": "bracket", "{": "bracket", "“": "quote", "„": "quote", "«": "quote", "»": "quote", '"': "marks", "<!--": "tag", "```": "fence"}


#: Without any of these a text has no structure but lists.
_SIGN = re.compile("[`<()\\[\\]{}“”„«»\"]")
_ITEM = re.compile(r"[ \t]*(?:[-*•+]|\d{1,3}[.)])")


def _bare_item(text: str) -> bool:
    """Whether the text's last line is a list mark with nothing after it."""
    bare = text.rstrip()
    return bare[-1:] in tuple("-*•+.)") and bool(_ITEM.fullmatch(bare, bare.rfind("\n") + 1))


def open_structure(text: str) -> str | None:
    """What is still open at the end of a text: json, fence, bracket, quote, marks, tag, list or None.

    A pushdown automaton reads the whole text once. A text that opens as JSON is open unless it can be parsed.
    In prose fences, comments, paired markup, brackets, quotations of several kinds and straight quotation marks go
    on a stack; a closing sign takes everything off it down to its partner, and counts for nothing without one.
    Inside a fence or comment only its end counts. A list mark with nothing after it leaves the list open.
    """
    if text.lstrip()[:1] in ("{", "[") and re.match(r"[\[{]\s*[\[{\"\]}]", text.lstrip()[:40]):
        try:
            json.loads(text)
        except (ValueError, RecursionError):
            return "json"
        return None
    if not _SIGN.search(text):
        return "list" if _bare_item(text) else None
    stack: list[str] = []
    held: dict[str, int] = {}  # how often each sign is on the stack

    def push(sign: str) -> None:
        stack.append(sign)
        held[sign] = held.get(sign, 0) + 1

    def close(sign: str) -> bool:
        if not held.get(sign):
            return False
        while True:
            top = stack.pop()
            held[top] -= 1
            if top == sign:
                return True

    for m in _STRUCTURE.finditer(text):
        sign = m.group()
        if held.get("```"):
            if sign == "```":
                close("```")
        elif held.get("<!--"):
            if sign == "-->":
                close("<!--")
        elif sign in _CLOSES:
            if not close(_CLOSES[sign]) and sign == "”":
                close("„")
        elif sign == "“":  # closes a low opening mark, opens otherwise
            if not close("„"):
                push(sign)
        elif sign in "«»":  # either may open
            if not close("»" if sign == "«" else "«") and (sign == "«" or text[m.end() : m.end() + 1].isalpha()):
                push(sign)
        elif sign == '"':
            opens = text[m.end() : m.end() + 1].isalnum() and not (m.start() and text[m.start() - 1].isalnum())
            push(sign) if opens else close(sign)
        elif sign[0] == "<" and sign != "<!--":
            name = re.match(r"</?([A-Za-z0-9]+)", sign).group(1).lower()
            if sign[1] == "/":
                close("<" + name)
            elif name not in _UNPAIRED and not sign.endswith("/>"):
                push("<" + name)
        elif sign != "-->":
            push(sign)
    if stack:
        return _KINDS.get(stack[-1], "tag")
    if re.search(r"<[A-Za-z/][^<>]{0,400}$", text):
        return "tag"
    return "list" if _bare_item(text) else None


def tokens_of(text: str) -> list[str]:
    low = text.lower()
    return (_PLAIN_TOKEN if low.isascii() else _TOKEN).findall(low)


def sentences_of(text: str) -> list[str]:
    pieces, begun = [], 0
    for m in _SENTENCE.finditer(text):
        at = m.start()
        pieces.append(text[begun : at if text[at] == "\n" else at + 1])
        begun = m.end()
    pieces.append(text[begun:])
    return [s for s in pieces if s and not s.isspace()]


@dataclass
class EndModel:
    """Counts of contexts and of the sentence ends among them; small enough to broadcast."""

    common: set[str] = field(default_factory=set)
    seen: dict[tuple, int] = field(default_factory=dict)
    ends: dict[tuple, int] = field(default_factory=dict)
    after: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[tuple, int] = field(default_factory=dict)
    endings: set[str] = field(default_factory=set)

    def kind(self, word: str) -> str:
        if word.isdigit():
            return "#"
        if any(c.isdigit() for c in word):
            return "@"
        return word if word in self.common else "*"

    def contexts(self, tokens: list[str]) -> list[tuple]:
        """Contexts of 4, 3, 2 and 1 classes before the end, and the last word itself."""
        kinds = ["^"] + [self.kind(t) for t in tokens[-5:]] if len(tokens) < 5 else [self.kind(t) for t in tokens[-5:]]
        return [tuple(kinds[-k:]) for k in (4, 3, 2, 1) if len(kinds) >= k] + [("=", tokens[-1])]

    def stub(self, tokens: list[str]) -> bool:
        """Whether the last word, not known after the one before it, begins words that are."""
        before = self.kind(tokens[-2]) if len(tokens) > 1 else "^"
        word = tokens[-1]
        if (before, word) in self.pairs:
            return False
        known = self.after.get(before, [])
        count = 0
        for k in range(bisect_right(known, word), len(known)):
            if not known[k].startswith(word):
                break
            count += self.pairs[before, known[k]]
        return count >= LEAST_SEEN // 2

    def ends_like_word(self, word: str) -> bool:
        """Whether an unseen long word ends the way many whole words do."""
        return len(word) >= 7 and word[-3:] in self.endings

    def end_share(self, tokens: list[str]) -> float:
        """Share of the longest trusted context's occurrences that end a sentence; 0 for a word that never does."""
        if self.stub(tokens):
            return 0.0
        *contexts, word = self.contexts(tokens)
        if self.seen.get(word, 0) >= 2 * LEAST_SEEN and not self.ends.get(word):
            return 0.0
        for c in contexts:
            if c in self.seen:
                return self.ends.get(c, 0) / self.seen[c]
        return math.nan


#: What may stand after a sentence mark, besides blanks.
_AFTER_MARK = tuple("\"”’»)]}*_")


def stops(text: str) -> bool:
    """Whether ``STOP`` matches."""
    last = text[-1:]
    return last in _MARKS or ((last in _AFTER_MARK or last.isspace()) and bool(STOP.search(text)))


def whole_sentences(text: str, pieces: list[str]) -> Iterator[tuple[list[str], bool]]:
    """(tokens, whether the sentence ends where it stops) of each of a text's sentences that has tokens."""
    bare = text.rstrip()
    for s in pieces:
        tokens = tokens_of(s)
        if tokens:
            yield tokens, stops(s) or (s is not text and s.rstrip() != bare and text.find(s) + len(s) < len(bare))


def sentence_rows(text: str) -> Iterator[tuple[str, bool]]:
    """(tokens with blanks between, whether the sentence ends where it stops) of each sentence of a text."""
    return ((" ".join(tokens), whole) for tokens, whole in whole_sentences(text, sentences_of(text)))


#: Classes of words that aren't words themselves; common words are numbered after them, 12 bits a class.
_CLASSES, _BITS = ("", "^", "#", "@", "*"), 12
#: Words of a task are numbered below so many bits.
_WORD_BITS = 40


def summed(keys: list[np.ndarray], seen: list[np.ndarray], ends: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the sums of both counts."""
    ids, distinct = pd.factorize(np.concatenate(keys))
    return distinct, *(np.bincount(ids, weights=np.concatenate(n), minlength=len(distinct)).astype(np.int64) for n in (seen, ends))


def context_counts(blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]], model: EndModel, numbers: dict[str, int]) -> Iterator[pd.DataFrame]:
    """(code, word, seen, ends): counts of contexts of one to four classes, by code, and of words after a class.

    A block has its sentences' tokens as places in its list of words, the sentences' lengths (1 at least), and whether they end.
    """
    contexts: tuple[list, list, list] = ([], [], [])
    words: tuple[list, list, list] = ([], [], [])
    known: dict[str, int] = {}  # numbers of the task's words
    size = 0

    def counts() -> pd.DataFrame:
        codes, seen, ends = summed(*contexts)
        keys, seen_words, ends_words = summed(*words)
        names = np.array([*known], dtype=object)[keys & ((1 << _WORD_BITS) - 1)]
        return pd.DataFrame({
            "code": np.concatenate([codes, keys >> _WORD_BITS]), "word": np.concatenate([np.full(len(codes), "", dtype=object), names]),
            "seen": np.concatenate([seen, seen_words]), "ends": np.concatenate([ends, ends_words]),
        })

    for ids, sizes, wholes, own in blocks:
        kinds = np.array([numbers[model.kind(w)] for w in own], dtype=np.int64)[ids]
        lasts = np.cumsum(sizes) - 1
        ending = np.zeros(len(ids), dtype=bool)
        ending[lasts] = wholes
        place = np.arange(len(ids)) - np.repeat(lasts - sizes + 1, sizes)  # 0 is a sentence's first word
        older = np.where(place == 0, numbers["^"], np.concatenate([[0], kinds[:-1]]))
        code, codes, ended = kinds, [kinds], [ending]
        for k in range(2, 5):
            at = place >= k - 2  # a context may begin with the class of the sentence's start
            first = np.where(place == k - 2, numbers["^"], np.concatenate([np.zeros(k - 1, dtype=np.int64), kinds[: -(k - 1)]])[: len(ids)])
            code = code | first << (_BITS * (k - 1))
            codes.append(code[at])
            ended.append(ending[at])
        numbered = np.array([known.setdefault(w, len(known)) for w in own], dtype=np.int64)[ids]
        for held, keys, end in ((contexts, np.concatenate(codes), np.concatenate(ended)), (words, older << _WORD_BITS | numbered, ending)):
            ids_, distinct = pd.factorize(keys)
            held[0].append(distinct)
            held[1].append(np.bincount(ids_, minlength=len(distinct)))
            held[2].append(np.bincount(ids_[end], minlength=len(distinct)))
            size += len(distinct)
        if size > HELD_COUNTS:
            contexts, words = (tuple([x] for x in summed(*held)) for held in (contexts, words))
            size = len(contexts[0][0]) + len(words[0][0])
            if 2 * size > HELD_COUNTS:
                yield counts()
                contexts, words, known, size = ([], [], []), ([], [], []), {}, 0
    if size:
        yield counts()


#: Words that more of the sentence or its mark follows, in any text and in one of ASCII only.
_BETWEEN = r" \t\n\x0b\f\r,;:'\"()\[\]/"
_FINISHED = re.compile(rf"[^\W_]++(?=[{_BETWEEN}–-]+[^\W_]|[.!?。！？])")
_PLAIN_FINISHED = re.compile(rf"[a-z0-9]++(?=[{_BETWEEN}-]+[a-z0-9]|[.!?])")
#: Without these signs, and marks behind signs, every word but the last is finished.
_UNUSUAL = re.compile(rf"[^a-z0-9{_BETWEEN}.!?-]|[{_BETWEEN}-][.!?]")
_USUAL_END = " \t\n\x0b\f\r,;:'\"()[]/-.!?"


def finished_in(text: str) -> tuple[list[str] | None, bool]:
    """(the words that are finished in a text, as often as they are, or null for all its words; but perhaps not its last)."""
    low = text.lower()
    if not low.isascii():
        return _FINISHED.findall(low), False
    if _UNUSUAL.search(low):
        return _PLAIN_FINISHED.findall(low), False
    bare = low.rstrip(_USUAL_END)
    return None, low[len(bare) : len(bare) + 1] not in (".", "!", "?")


#: Tokens that a task holds before it writes them.
HELD_TOKENS = 500_000
_READ = "ids binary, sizes binary, wholes binary, words string, word string, n long, whole boolean, inner long, hash long, core_hash long, state string, tail string"


def read_texts(texts: DataFrame) -> DataFrame:
    """One pass over distinct texts (text, copies): what the end model, ``finished`` and ``end_state`` are made from.

    Rows are of three kinds: blocks of sentences as numbers of words (``words``); how often a task met each ``word``,
    whether it stood whole, and the copies of texts it is finished in (``inner``); and, of texts that aren't surely
    whole, what their end shows (``hash``, ``state``, ``tail``), with their ``core_hash``. The last kind needs the
    columns hash, core_hash and ``parsed``, which is as ``parses`` gives it.
    """
    names = [x.split()[0] for x in _READ.split(", ")]
    judged = "parsed" in texts.columns

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        inner: Counter = Counter()
        standing: set[str] = set()  # words that stand whole
        fresh = lambda: (defaultdict(count().__next__), *([] for _ in range(7)))
        # Of the sentences held: words with their numbers, the tokens' numbers, tokens and end of each; of their texts: copies,
        # tokens, places of tokens that aren't finished, and words finished in texts whose tokens don't tell.
        numbers, ids, sizes, wholes, times, lengths, unfinished, others = fresh()

        def block() -> list[tuple]:
            """The sentences held, without the last words of those that don't end: these may be cut."""
            words = list(numbers)
            if not times:
                return []
            at, length, whole = np.array(ids, dtype=np.int32), np.array(sizes, dtype=np.int32), np.array(wholes, dtype=bool)
            told = np.ones(len(at), dtype=bool)
            told[unfinished] = False
            owner = np.repeat(np.arange(len(times)), lengths)
            told &= ~np.isin(owner, [k for k, _ in others])
            owners = [owner[told], *(np.full(len(w), k) for k, w in others)]
            pairs = pd.unique(np.concatenate(owners) * len(words) + np.concatenate([at[told], *(w for _, w in others)])).astype(np.int64)
            within = np.bincount(pairs % max(1, len(words)), weights=np.array(times)[pairs // max(1, len(words))], minlength=len(words)).astype(np.int64)
            for w, n, m in zip(words, np.bincount(at, minlength=len(words)).tolist(), within.tolist()):
                seen[w] += n
                if m:
                    inner[w] += m
            kept = np.ones(len(at), dtype=bool)
            kept[(np.cumsum(length) - 1)[~whole]] = False
            at, length = at[kept], length - ~whole
            standing.update(words[k] for k in np.flatnonzero(np.bincount(at, minlength=len(words))))
            whole, length = whole[length > 0], length[length > 0]
            return [(at.tobytes(), length.astype(np.int32).tobytes(), whole.tobytes(), " ".join(words), *[None] * 8)] if len(at) else []

        def met() -> list[tuple]:
            return [(*[None] * 4, w, seen[w], w in standing, inner[w], *[None] * 4) for w in seen.keys() | inner.keys()]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names, dtype=object)

        for pdf in batches:
            rows = []
            keys = zip(pdf["hash"].tolist(), pdf["core_hash"].tolist(), pdf["parsed"].tolist()) if judged else repeat((0, 0, True))
            for text, copies, (key, core, parsed) in zip(pdf["text"], pdf["copies"].tolist(), keys):
                pieces, all_tokens = sentences_of(text), []
                for tokens, whole in whole_sentences(text, pieces):
                    all_tokens += tokens
                    sizes.append(len(tokens))
                    wholes.append(whole)
                ids += map(numbers.__getitem__, all_tokens)
                lengths.append(len(all_tokens))
                found, but_last = finished_in(text)
                if found is not None:
                    others.append((len(times), list(map(numbers.__getitem__, found))))
                elif but_last and all_tokens:
                    unfinished.append(len(ids) - 1 - next((k for k, t in enumerate(reversed(all_tokens)) if t not in ",;:"), 0))
                times.append(copies)
                if not (plainly_whole(text) if parsed is None else parsed):
                    rows.append((*[None] * 8, key, core, *stop_shape(text, pieces)))
                if len(ids) > HELD_TOKENS:
                    rows += block()
                    numbers, ids, sizes, wholes, times, lengths, unfinished, others = fresh()
            yield frame(rows)
            if max(len(seen), len(inner)) > HELD_COUNTS:
                yield frame(met())
                for held in (seen, inner, standing):
                    held.clear()
        yield frame(block())
        yield frame(met())

    return cut_lineage(texts.select("text", "copies", *(["hash", "core_hash", "parsed"] if judged else [])).mapInPandas(read, _READ))


def distinct_texts(texts: DataFrame) -> DataFrame:
    """(text, copies): the distinct texts of a column ``text``."""
    return texts.where(F.col("text").isNotNull()).groupBy("text").agg(F.count("*").alias("copies"))


def fit_end_model(texts: DataFrame) -> EndModel:
    """The end model of a column ``text``, counted over all its distinct texts."""
    return end_model(read_texts(distinct_texts(texts)))


def end_model(read: DataFrame) -> EndModel:
    """The end model of what ``read_texts`` gives.

    Words, then contexts are counted in tasks and added up by shuffles. What is fetched are
    the common words, contexts seen often enough and words seen twice after a class: they grow more slowly than the texts.
    """
    spark = read.sparkSession
    words = cut_lineage(read.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n"), F.max("whole").alias("known")))
    model = EndModel()
    total = words.agg(F.sum("n")).first()[0] or 0
    model.common = {r["word"] for r in words.where(F.col("n") >= max(5.0, RARE_SHARE * total)).select("word").collect()}
    long = words.where(F.col("known") & (F.length("word") >= 7) & F.col("word").rlike(r"^\p{L}+$"))
    least = max(4, 0.01 * long.count())
    model.endings = {r["tail"] for r in long.groupBy(F.right("word", F.lit(3)).alias("tail")).agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()}

    classes = [*_CLASSES, *sorted(model.common)]
    shared = spark.sparkContext.broadcast((model, {w: i for i, w in enumerate(classes)}))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = np.int32, np.int32, bool
        blocks = ((*map(np.frombuffer, row[:3], kinds), row[3].split(" ")) for pdf in batches for row in pdf.itertuples(index=False, name=None))
        yield from context_counts(blocks, *shared.value)

    parts = read.where(F.col("words").isNotNull()).select("ids", "sizes", "wholes", "words").mapInPandas(counted, "code long, word string, seen long, ends long")
    counts = cut_lineage(parts.groupBy("code", "word").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends")))
    for r in counts.where((F.col("word") == "") & (F.col("seen") >= LEAST_SEEN)).collect():
        places = [r["code"] >> (_BITS * k) & ((1 << _BITS) - 1) for k in range(4)]
        context = tuple(classes[c] for c in reversed(places) if c)
        model.seen[context] = r["seen"]
        if r["ends"]:
            model.ends[context] = r["ends"]
    after = counts.where(F.col("word") != "")
    for r in after.groupBy("word").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends")).where(F.col("seen") >= LEAST_SEEN).collect():
        model.seen["=", r["word"]] = r["seen"]
        if r["ends"]:
            model.ends["=", r["word"]] = r["ends"]
    model.pairs = {(classes[r["code"]], r["word"]): r["seen"] for r in after.where(F.col("seen") > 1).collect()}
    for before, word in sorted(model.pairs):
        model.after.setdefault(before, []).append(word)
    return model


def word_shape(core: str, pieces: list[str] | None = None) -> tuple[list[str], list[str], bool]:
    """(all tokens of the last sentence, its words without separators, whether the text is a bare list of terms)."""
    pieces = sentences_of(core) if pieces is None else pieces
    tokens = tokens_of(pieces[-1]) if pieces else []
    words = [t for t in tokens if t not in ",;:，；：、"]
    listed = len(pieces) > 1 and all(re.match(r"\s*(?:[-*•+]|\d{1,3}[.)])\s", x) and len(tokens_of(x)) <= 4 for x in pieces)
    bare = listed or len(pieces) == 1 and all(len(tokens_of(x)) <= 3 for x in re.split(r"[,;，；、\n]", core))
    return tokens, words, bare


def stop_shape(text: str, pieces: list[str] | None = None) -> tuple[str, str]:
    """(state, last tokens with blanks between) as the text alone tells: state is cut, open, whole, bare, quoted or plain.

    cut: a mark of the cut or a hanging separator; open: an unfinished structure; bare: a list of terms; quoted and
    plain: the words decide, in an open quotation or outside. ``pieces`` are the text's sentences, where they are known.
    """
    at = cut_mark_at(text)
    had_mark = at >= 0 and not re.search(r"[.!?。！？]\s*(?:…|\.{2,})\s*$", text)
    core = without_neutral(text)
    structure = open_structure(text[:at] if at >= 0 and not text.lstrip()[:1] in "{[" else text)
    if structure in ("json", "fence", "list"):
        return "open", ""
    bare_core = cut_entities(core).rstrip()
    tokens, words, bare = word_shape(bare_core, pieces if len(bare_core) == len(text) else None)
    if not words:
        return "whole", ""
    known = next(k for k in range(len(tokens) - 1, -1, -1) if tokens[k] == words[-1])
    last = " ".join(tokens[max(0, min(known, len(tokens) - 5)) :])
    if had_mark:
        return "cut", last
    ended = stops(core)
    if structure in ("bracket", "tag") or (structure == "quote" and ended):
        return "open", last
    if ended:
        return "whole", last
    if tokens[-1] in ",;，；、" or (tokens[-1] in ":：" and len(words) > 3):
        return "cut", last
    return "bare" if bare else "quoted" if structure in ("quote", "marks") else "plain", last


def end_state(state: str, last: str, model: EndModel) -> tuple[str, str, float]:
    """(state, last word, end share) of what ``stop_shape`` says: state is cut, open, whole, words or named.

    words: cut if the corpus has the last word nowhere finished, or by the end share; named: the last word ends like
    whole words do, or is a CJK character, so the end share alone decides.
    """
    tokens = last.split(" ")
    word = next((t for t in reversed(tokens) if t not in ",;:，；：、"), "")
    if state in ("cut", "open", "whole"):
        return state, word, 1.0 if state == "whole" else 0.0
    named = "named" if word > "⺀" or model.ends_like_word(word) else "words"
    if state == "bare":
        return named, word, 1.0
    share = model.end_share(tokens)
    if state == "quoted" and not share > END_SHARE:
        return "open", word, 0.0
    return named, word, 1.0 if math.isnan(share) else share


def stop_state(text: str, model: EndModel) -> tuple[str, str, float]:
    """(state, last word, end share) of a text, see ``end_state``."""
    return end_state(*stop_shape(text), model)


def finished_words(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(word, inner): in how many ``texts`` each wanted word stands with more of the sentence, or its mark, after it."""
    return finished(read_texts(distinct_texts(texts)), wanted)


def finished(read: DataFrame, wanted: DataFrame) -> DataFrame:
    """``finished_words`` of the texts that ``read_texts`` has read. Up to ``BROADCAST_WORDS`` wanted words are broadcast."""
    words = read.where(F.col("inner") > 0).select("word", "inner")
    few = wanted.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    return words.join(F.broadcast(wanted) if few else wanted, "word", "left_semi").groupBy("word").agg(F.sum("inner").alias("inner"))


def unfinished(ends: Column, inner: Column) -> Column:
    """Whether a word that ``ends`` texts stop in, and ``inner`` texts finish, was cut."""
    return F.coalesce(inner, F.lit(0)) * FINISHED_EVERY < ends
