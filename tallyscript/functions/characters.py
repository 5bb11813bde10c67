"""Character tables: which code points become which ASCII text."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

#: Punctuation that stands for an apostrophe, a hyphen or a slash. Mathematical signs stay out: tokenizers keep them.
APOSTROPHES = "`´ʼ‘’‛′＇"
HYPHENS = "‐‑‒–—―⸚⸺⸻︱︲﹘﹣－"
SLASHES = "／"

_NAME = re.compile(r"LATIN (SMALL|CAPITAL) (?:LETTER|LIGATURE) ([A-Z]{1,2})(?: WITH .*| DIGRAPH)?")
#: Letters whose name doesn't say what they are in ASCII.
_LETTERS = {
    "ß": "ss", "ẞ": "SS", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ı": "i", "ŋ": "ng", "Ŋ": "NG", "ĸ": "k", "ſ": "s", "ƿ": "w",
    "ə": "e", "Ə": "E", "ɛ": "e", "Ɛ": "E", "ɔ": "o", "Ɔ": "O", "ʃ": "s", "ʒ": "z", "Ʒ": "Z", "ȷ": "j", "ɪ": "I", "ʊ": "u", "ʌ": "v", "ƒ": "f",
}
#: Signs whose compatibility decomposition isn't what stands for them in ASCII.
_SIGNS = {
    "“": '"', "”": '"', "„": '"', "‟": '"', "‘": "'", "’": "'", "‚": ",", "‛": "'", "‹": "<", "›": ">", "«": "<<", "»": ">>",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "--", "―": "--", "…": "...", "·": "*", "•": "*", "‣": ">", "¡": "!", "¿": "?",
    "¦": "|", "¨": '"', "¯": "-", "´": "'", "¸": ",", "¬": "!", "±": "+-", "÷": "/", "−": "-", "∕": "/", "⁄": "/", "∗": "*",
    "≤": "<=", "≥": ">=", "≠": "!=", "′": "'", "″": '"', "‴": "'''", "‾": "-", "⁃": "-", "。": ".", "、": ",", "「": "[", "」": "]",
}


def _ascii(char: str) -> str | None:
    """The ASCII base characters of a decomposed code point, or None."""
    base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)).replace("⁄", "/")
    return base if base and base.isascii() else None


@cache
def latin_letters() -> dict[str, str]:
    """Each non-ASCII Latin letter that has an ASCII transliteration, and that."""
    found = {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.category(char)[0] != "L" or not (name := unicodedata.name(char, "")).startswith("LATIN"):
            continue
        to = _LETTERS.get(char) or _ascii(char)
        if to is None and (m := _NAME.fullmatch(name)):
            to = m[2] if m[1] == "CAPITAL" else m[2].lower()
        if to is not None:
            found[char] = to
    return found


@cache
def signs() -> dict[str, str]:
    """Each non-ASCII mark, symbol or punctuation character that becomes ASCII of these categories, and that.

    Combining marks of the general blocks become nothing.
    """
    found = {}
    for code in range(0x80, 0x10000):
        char = chr(code)
        if unicodedata.category(char)[0] not in "MSP":
            continue
        if 0x300 <= code <= 0x36F or 0x1AB0 <= code <= 0x1AFF or 0x1DC0 <= code <= 0x1DFF or 0x20D0 <= code <= 0x20FF:
            found[char] = ""
            continue
        to = _SIGNS.get(char) or _ascii(char)
        if to is not None and all(unicodedata.category(c)[0] in "MSP" for c in to):
            found[char] = to
    return found


def parts(table: dict[str, str], preserve: str = "") -> tuple[str, str, dict[str, str]]:
    """A table as (from, to) of a character-by-character translation, which deletes what is beyond `to`, and the rest,
    the characters that become several."""
    kept = {k: v for k, v in table.items() if k not in preserve}
    single = {k: v for k, v in kept.items() if len(v) == 1}
    gone = [k for k, v in kept.items() if not v]
    return "".join([*single, *gone]), "".join(single.values()), {k: v for k, v in kept.items() if len(v) > 1}
