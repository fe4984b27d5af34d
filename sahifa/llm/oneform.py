"""One stored form for all texts that look the same (problem 2).

A longest-match transducer over grapheme clusters. A cluster is a starter with the marks and
unseen characters after it. One table, compiled from rules when the module is loaded, holds all
rewritings: single characters (widths, presentation forms, blanks, unseen characters,
look-alike letters, letters that carry their accent) and clusters of several characters (a
starter with its accents in canonical order, conjoining letters). Keys of several characters
form a trie whose nodes are starters; the walk from a cluster's starter takes the longest key
there is, passing over marks that belong to no key. Some letters look like another one only
where they join the next cluster (or only where they do not), so the transducer carries one
cluster of look-ahead.

The table is checked when it is compiled: two rules may not give one key different outputs, and
every output must be a fixed point of the whole transducer and in NFC.

The text is walked word by word and rewritten words are kept in a bounded memo, since a
collection repeats its words far more often than it has new ones.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

# Blanks besides those Unicode calls white space.
_MORE_BLANKS = "\u2800"
# Unseen characters besides the format characters (category Cf) and controls.
_MORE_UNSEEN = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
# Format characters that are drawn (Arabic number signs and end of verse).
_SEEN_FORMAT = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2"
# Look-alikes wherever they stand, left as stored, right as the plain letter.
_ALIKE = {
    "ۃ": "ة", "ە": "ه", "ٵ": "أ", "ٶ": "ؤ", "ٸ": "ئ",
    "۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨", "۹": "٩",
    "‐": "-", "‑": "-",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "У": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o",
}
# Look-alikes only where the letter joins the next one.
_ALIKE_JOINED = {"ک": "ك", "ی": "ي"}
# Look-alikes only where the letter ends its run.
_ALIKE_ENDING = {"ی": "ى", "ہ": "ه"}
# Ligature signs whose compatibility form reads otherwise than it looks.
_KEPT_SIGNS = "".join(map(chr, [*range(0xFDF0, 0xFDF2), *range(0xFDF3, 0xFDFE)]))

# Clusters that look like one letter but have no composition of their own.
_CLUSTERS = {"ى\u0654": "ئ"}

_POINTS = [chr(i) for i in chain(range(0x20000), range(0xE0000, 0xE1000))]  # no rule reaches the planes between
BLANKS = "".join(c for c in _POINTS if c.isspace()) + _MORE_BLANKS
_BLANK_SET = frozenset(BLANKS)
_MEMO = 400_000


def _unseen() -> frozenset[str]:
    found = set(_MORE_UNSEEN)
    for c in _POINTS:
        code = ord(c)
        kind = unicodedata.category(c)
        if kind in ("Cf", "Cc") and c not in _SEEN_FORMAT and c not in _BLANK_SET:
            found.add(c)
        elif 0xFE00 <= code <= 0xFE0F or 0xE0000 <= code <= 0xE0FFF:
            found.add(c)
    return frozenset(found)


UNSEEN = _unseen()


def _plain_width(c: str) -> str:
    """Compatibility form where it keeps the look: full and half width, presentation forms, ligatures."""
    code = ord(c)
    if c in _KEPT_SIGNS:
        return c
    if 0xFB00 <= code <= 0xFB06 or 0xFB50 <= code <= 0xFDFF or 0xFE80 <= code <= 0xFEFC or 0xFF01 <= code <= 0xFFEE:
        return unicodedata.normalize("NFKC", c)
    if 0xFE70 <= code <= 0xFE7F:  # marks drawn alone or on a stroke
        return unicodedata.normalize("NFKC", c).replace(" ", "")
    if c == "…":
        return "..."
    return c


def _apart(text: str) -> str:
    """Look-alikes replaced, accents split off."""
    return "".join(_ALIKE.get(x, x) for x in unicodedata.normalize("NFD", text))


def _compile() -> tuple[dict[str, str], dict[tuple[str, str], str]]:
    """``(table, steps)``: every key with its output, and the trie of the keys of several characters.

    ``steps[starter, character]`` is the starter that stands for both; conflicts end the import.
    """
    table: dict[str, str] = {}

    def put(key: str, value: str) -> None:
        if table.setdefault(key, value) != value:
            raise ValueError(f"two outputs for {ascii(key)}")

    for c in BLANKS:
        put(c, " ")
    for c in UNSEEN:
        put(c, "")
    steps: dict[tuple[str, str], str] = {}
    for c in _POINTS:
        if c in table or "\uac00" <= c <= "\ud7a3":
            continue
        parts = unicodedata.decomposition(c)
        wide = _plain_width(c)
        if not parts and wide == c and c not in _ALIKE:
            continue
        apart = _apart(wide)
        if apart != c:
            put(c, apart)
        if parts and parts[0] != "<" and " " in parts and unicodedata.normalize("NFC", c) == c:
            first, second = (chr(int(x, 16)) for x in parts.split())
            if first not in _ALIKE and second not in _ALIKE:
                put(first + second, c)
                steps[first, second] = c
    for lead in range(19):  # conjoining letters: lead and vowel, and that with a tail
        for vowel in range(21):
            both = 0xAC00 + (lead * 21 + vowel) * 28
            steps[chr(0x1100 + lead), chr(0x1161 + vowel)] = chr(both)
            steps.update(((chr(both), chr(0x11A7 + tail)), chr(both + tail)) for tail in range(1, 28))
    for key, value in _CLUSTERS.items():
        put(key, value)
        steps[key[0], key[1]] = value
    contextual = set(_ALIKE_JOINED) | set(_ALIKE_ENDING)
    if contextual & set(table):
        raise ValueError("a letter has both a fixed and a contextual output")
    return table, steps


TABLE, _STEPS = _compile()
_SINGLE = {k: v for k, v in TABLE.items() if len(k) == 1}
_CONTEXT = frozenset(_ALIKE_JOINED) | frozenset(_ALIKE_ENDING)
_TO_SPACE = str.maketrans({c: " " for c in BLANKS})
_ORDINARY = re.compile("^[\\x21-\\x7e\\u0621-\\u064a\\u060c\\u061b\\u061f\\u0660-\\u0669]*$")


def _joins(following: str) -> bool:
    """Whether a letter before the starter ``following`` joins it."""
    return following == "\u0640" or ("\u0620" <= following <= "\u08ff" and following != "\u0621" and unicodedata.category(following) == "Lo")


def _close(starter: str, marks: list[tuple[int, str]], following: str) -> str:
    """The output of a cluster whose next starter is ``following``: the longest key from its starter, then the marks no key took."""
    if starter in _CONTEXT:
        starter = (_ALIKE_JOINED if _joins(following) else _ALIKE_ENDING).get(starter, starter)
    if not marks:
        return starter
    if len(marks) > 1:
        marks.sort(key=lambda m: m[0])  # canonical order; stable, so marks of one class keep theirs
    rest, held = [], 0
    for order, mark in marks:
        longer = _STEPS.get((starter, mark)) if order != held else None  # a mark of the same class stands between
        if longer is not None:
            starter = longer
        else:
            rest.append(mark)
            held = order
    return starter + "".join(rest)


def transduce_word(word: str) -> str:
    """The one form of a word (no blanks in it), in one pass over its clusters."""
    out: list[str] = []
    starter, marks = "", []
    single, combining = _SINGLE, unicodedata.combining
    for stored in word:
        for c in single.get(stored, stored):
            order = combining(c)
            if order:
                marks.append((order, c))
                continue
            longer = _STEPS.get((starter, c)) if not marks else None
            if longer is not None:
                starter = longer
                continue
            if starter or marks:
                out.append(_close(starter, marks, c))
            starter, marks = c, []
    if starter or marks:
        out.append(_close(starter, marks, ""))
    return "".join(out)


def check_table() -> None:
    """Every output of the table is a fixed point of the transducer and in NFC."""
    for key, value in TABLE.items():
        if key not in _BLANK_SET:
            form = transduce_word(key)
            if transduce_word(form) != form or unicodedata.normalize("NFC", form) != form:
                raise ValueError(f"the output of {ascii(key)} is no fixed point")


class _Memo(dict):
    def __missing__(self, word: str) -> str:
        if len(self) >= _MEMO:
            self.clear()
        form = word if _ORDINARY.match(word) else transduce_word(word)
        self[word] = form
        return form


_WORDS = _Memo()


def one_form(text: str | None) -> str:
    """The one form of a text; empty for null.

    Each blank, of whatever kind, is one space, so a run of blanks keeps its length; blanks at
    the ends go. Unseen characters go wherever they stand.
    """
    if not text:
        return ""
    words = _WORDS
    parts = text.split()
    if _MORE_BLANKS in text or " ".join(parts) != text:
        parts = text.translate(_TO_SPACE).split(" ")
    return " ".join(map(words.__getitem__, parts)).strip(" ")


@lru_cache(maxsize=None)
def table_size() -> int:
    """Number of rules in the compiled table, contextual ones included."""
    return len(TABLE) + len(_ALIKE_JOINED) + len(_ALIKE_ENDING)


@F.pandas_udf(T.StringType())
def one_form_udf(texts: pd.Series) -> pd.Series:
    """Arrow form of :func:`one_form`; null gives an empty text."""
    return texts.map(one_form)


def one_form_column(text: Column) -> Column:
    return one_form_udf(text)
