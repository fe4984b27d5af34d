"""Character classes. All are distinct on purpose; see each use before swapping one for another.

Patterns are written for Java regular expressions (``\\uXXXX`` inside raw strings); the same
text works in Python's ``re``. ``duck()`` turns one into RE2 spelling.
"""

from __future__ import annotations

import re

# Marks (and kashida) that normalization removes.
DIAC_NORM = r"[\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06DC\u06DF-\u06E8\u06EA-\u06ED\u0640]"
# Marks that make a text count as vocalized.
DIAC_HAS = r"[\u064B-\u065F\u0670]"
# Marks the 16 classes are built from, with the dagger alef that they cannot hold.
MARK_MODEL = r"[\u064B-\u0652\u0670]"
NOT_MARK_MODEL = r"[^\u064B-\u0652\u0670]"
# Marks counted by the density gate.
MARK_BUILD = r"[\u064B-\u0652]"
# Letters, kashida included.
LETTER = r"[\u0621-\u064A]"
# Blocks of the script, for header and column detection.
SCRIPT = r"[\u0600-\u06FF\u0750-\u077F\uFB50-\uFDFF\uFE70-\uFEFF]"
# Letters folded by normalization, from and to.
FOLD_FROM = "\u0622\u0623\u0625\u0671\u0629\u0649\u0624\u0626"
FOLD_TO = "\u0627\u0627\u0627\u0627\u0647\u064a\u0621\u0621"
# Unicode white space as str.split() sees it.
WS_SET = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_SET}]"
NONWS = f"[^{WS_SET}]"
# Vowel signs in the order of their class (0 = none).
VOWELS = ["", "\u064e", "\u064f", "\u0650", "\u0652", "\u064b", "\u064c", "\u064d"]
SHADDA = "\u0651"
VOWEL_SIGN = r"[\u064B-\u0650\u0652]"
# Viewer calls and page stamps left in exported text.
JUNK = r"AddHistory\([^)]*\)[^;]*;?|\[\d+/\d+\]"
# First characters a spreadsheet takes for a formula.
FORMULA = r"^[=+\-@\t\r]"
# A number that opens a unit.
HNUM = r"^\p{Nd}+[-–.)\]]*$"


def duck(pattern: str) -> str:
    """The RE2 spelling of a pattern, for DuckDB."""
    out = re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", pattern)
    return re.sub(r"\\x(8[0-9a-fA-F]|[9a-fA-F][0-9a-fA-F])(?![0-9a-fA-F}])", r"\\x{\1}", out)
