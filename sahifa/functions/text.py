"""Orthography as Column expressions: everything stays in the JVM and folds into the scan's projection.

Null texts count as empty wherever a text comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sahifa.functions import charclasses as C


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip_diacritics(text: Column) -> Column:
    """Without marks and kashida; letters and punctuation stay."""
    return F.regexp_replace(_text(text), C.DIAC_NORM, "")


def normalize_arabic(text: Column) -> Column:
    """Marks stripped, letter variants folded, blanks collapsed and trimmed."""
    folded = F.translate(strip_diacritics(text), C.FOLD_FROM, C.FOLD_TO)
    return F.trim(F.regexp_replace(folded, f"{C.WS}+", " "))


def has_tashkeel(text: Column) -> Column:
    return _text(text).rlike(C.DIAC_HAS)


def is_blank(text: Column) -> Column:
    return ~_text(text).rlike(C.NONWS)


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(_text(text), f"^{C.WS}+|{C.WS}+$", "")


def split_of(key: Column) -> Column:
    """Deterministic split of a key: its md5 as a 128-bit number modulo 100, 90 / 5 / 5 percent.

    The digest is cut into four 32-bit parts; 2**32 leaves 96 modulo 100, so the parts weigh
    36, 16, 96 and 1. A null key has no split.
    """
    digest = F.md5(key)
    total = F.lit(0).cast("long")
    for at, weight in ((1, 36), (9, 16), (17, 96), (25, 1)):
        total = total + F.conv(F.substring(digest, at, 8), 16, 10).cast("long") * F.lit(weight)
    bucket = F.pmod(total, F.lit(100))
    return F.when(bucket < 90, "train").when(bucket < 95, "dev").when(bucket < 100, "test")


def remove_junk(text: Column) -> Column:
    """Viewer calls and page stamps become a space."""
    return F.regexp_replace(_text(text), C.JUNK, " ")


def script_score(text: Column) -> Column:
    """Number of characters of the script's blocks."""
    return F.regexp_count(_text(text), F.lit(C.SCRIPT))


def letter_count(text: Column) -> Column:
    return F.regexp_count(_text(text), F.lit(C.LETTER))


def mark_count(text: Column) -> Column:
    return F.regexp_count(_text(text), F.lit(C.MARK_BUILD))


def mark_density(text: Column) -> Column:
    """Marks per letter; null where there are no letters."""
    letters = letter_count(text)
    return F.when(letters > 0, mark_count(text) / letters)


def densely_vocalized(text: Column, min_letters: int = 60, min_density: float = 0.6) -> Column:
    letters = letter_count(text)
    return (letters >= min_letters) & (mark_count(text) >= F.lit(min_density) * letters)


def is_unit_number(word: Column) -> Column:
    return word.rlike(C.HNUM)


def csv_safe(cell: Column) -> Column:
    """A cell that a spreadsheet would run gets an apostrophe in front."""
    return F.when(cell.rlike(C.FORMULA), F.concat(F.lit("'"), cell)).otherwise(cell)


def markdown_cell(cell: Column) -> Column:
    return F.replace(F.replace(_text(cell), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def clean_header(value: Column) -> Column:
    return strip(F.regexp_replace(_text(value), r"[\r\n]+", " "))


def lines_of(text: Column) -> Column:
    """Lines of a pasted text, blank ones kept."""
    return F.split(F.regexp_replace(_text(text), "\r\n?", "\n"), "\n", -1)


def clean_word_text(raw: Column) -> Column:
    """Word's in-band control codes: field instructions go, paragraph, cell, line and page marks become line ends."""
    text = F.regexp_replace(_text(raw), r"\x13[^\x14\x15]*[\x14\x15]?", "")
    text = F.regexp_replace(text, r"[\x14\x15]", "")
    text = F.translate(text, "\r\x07\x0b\x0c\x1e\xa0", "\n\n\n\n- ")
    return F.regexp_replace(text, r"[\x00-\x08\x0e-\x1f\ufeff]", "")


def sanitize_filename(name: Column, fallback: str = "input") -> Column:
    """Last path part, letters, digits and the script only, at most 120 characters.

    The compatibility forms of letters are folded for the ASCII block only (full width), which
    is what could hide a separator; other compatibility letters become underscores.
    """
    wide, narrow = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
    flat = F.regexp_replace(F.translate(_text(name), wide, narrow), r"\\", "/")
    base = F.regexp_replace(F.regexp_replace(flat, r"/+$", ""), r"^.*/", "")
    safe = F.regexp_replace(base, r"[^A-Za-z0-9._\u0600-\u06FF -]", "_")
    trimmed = F.regexp_replace(safe, r"^[ .]+|[ .]+$", "")
    short = F.substring(F.regexp_replace(trimmed, r"_{2,}", "_"), 1, 120)
    return F.when(short == "", fallback).otherwise(short)
