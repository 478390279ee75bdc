"""Character-level normal forms shared by the text operators.

``fold`` maps a text to a form in which letter case, accents, ligatures,
markup, entities, line layout and broken encodings no longer matter.
``fold_with_offsets`` gives the same form with, for each character, the place
in the original text it came from.
"""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "аеорсухіѕјһԁԛԝ"
    "АВЕКМНОРСТХІЅЈ"
    "οναρΟΑΒΕΖΗΙΚΜΝΡΤΧ",
    "aeopcyxisjhdqw" "ABEKMHOPCTXISJ" "ovapOABEZHIKMNPTX",
)
_PRE = re.compile(
    r"<!--.*?-->|</?[a-zA-Z][^<>]{0,200}>"  # markup
    r"|&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8});"  # entities
    r"|[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]{1,3}"
    r"|[-­]\r?\n(?:[ \t]*>)*[ \t]*",  # a word broken over two lines
    re.S,
)
_INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_CJK = "぀-ヿ㐀-䶿一-鿿"
WORD = re.compile(rf"[{_CJK}]|(?:(?![{_CJK}])[^\W_])+")


def _bytes(chunk: str) -> bytes:
    out = bytearray()
    for ch in chunk:
        try:
            out += ch.encode("cp1252")
        except UnicodeEncodeError:
            out += ch.encode("latin-1")
    return bytes(out)


def _replacement(chunk: str) -> str:
    first = chunk[0]
    if first == "<":
        return " "
    if first == "&":
        plain = html.unescape(chunk)
        return plain if plain != chunk else html.unescape(chunk.lower())
    if first in "-­":
        return "​"  # joins the halves; removed later
    for end in range(len(chunk), 1, -1):  # UTF-8 read as a single-byte encoding
        try:
            return _bytes(chunk[:end]).decode("utf-8") + chunk[end:]
        except (UnicodeDecodeError, UnicodeEncodeError):
            continue
    return chunk


_UNSEEN = re.compile("[" + "".join(map(chr, _INVISIBLE)) + "]")
_ALIKE = re.compile("[" + "".join(map(chr, LOOKALIKES)) + "]")
#: Combining marks of Latin letters, and the ranges in which there are others.
_ACCENTS = re.compile("[\u0300-\u034e\u0350-\u036f]+")
_OTHER_MARKS = re.compile("[\u0483-\u0487\u0591-\u1dff\u20d0-\u20f0\u2cef-\u2cf1\u2d7f\u2de0-\u2dff\u302a-\u302f\u3099\u309a\ua66f-\uabed\ufb1e\ufe20-\ufe2f\U00010000-\U0010ffff]")


def _fold_plain(text: str) -> str:
    if text.isascii():
        return text.lower()
    if _UNSEEN.search(text):
        text = text.translate(_INVISIBLE)
    text = unicodedata.normalize("NFKD", text)
    if _ALIKE.search(text):
        text = text.translate(LOOKALIKES)
    text = _ACCENTS.sub("", text)
    if _OTHER_MARKS.search(text):
        text = "".join(c for c in text if not unicodedata.combining(c))
    return text.lower()


#: Without any of these an ASCII text has neither markup, entities nor words broken over lines.
_MARKS = re.compile(r"[<&]|-\r?\n")


def fold(text: str) -> str:
    """Lower-case, accent-free text without markup, entities and broken encodings."""
    if text.isascii() and not _MARKS.search(text):
        return text.lower()
    return _fold_plain(_PRE.sub(lambda m: _replacement(m.group()), text))


def fold_with_offsets(text: str) -> tuple[str, list[int]]:
    """``fold(text)`` and the original position of each of its characters."""
    out: list[str] = []
    places: list[int] = []

    def add(piece: str, start: int, moving: bool) -> None:
        for k, ch in enumerate(piece):
            for c in _fold_plain(ch):
                out.append(c)
                places.append(start + k if moving else start)

    at = 0
    for m in _PRE.finditer(text):
        add(text[at : m.start()], at, True)
        add(_replacement(m.group()), m.start(), False)
        at = m.end()
    add(text[at:], at, True)
    return "".join(out), places


def repair(text: str) -> str:
    """The text with entities resolved, broken encodings mended and markup blanked; case and accents stay."""
    text = _PRE.sub(lambda m: _replacement(m.group()), text)
    return text if text.isascii() else unicodedata.normalize("NFKC", text.translate(_INVISIBLE))


def words(folded: str) -> list[str]:
    """Letter and digit runs of a folded text; a CJK character is a word of its own."""
    return WORD.findall(folded)
