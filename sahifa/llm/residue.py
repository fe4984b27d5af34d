"""Template residue and error-page text (problem 9).

One automaton (Aho-Corasick) holds every phrase of all languages, the openers of every pattern
with a free part (a slot, a stack line, a status line) and the values a template prints for what
it could not fill. It runs once over a text that was brought to one form, folded and
lower-cased. A phrase hit counts at once where whole words match; any other hit only says at
which place its pattern or its surroundings are looked at, so no pattern is searched for over
the whole text. (One word repeated over a whole line is told by the line's first word.)

Hits give spans, and spans give the coverage. A document is left out when residue covers at
least ``min_coverage`` of it. TESTDATA.md counts residue that is a part of a text as well, so the
same share is asked of each sentence; a document covered to that share has such a sentence.
Slots, stack lines, status objects and script notices are of a form no text has by chance and
count whatever stands around them. Spans and sentences are walked once, side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from sahifa.functions import charclasses as C
from sahifa.llm.oneform import one_form
from sahifa.operators.rowmap import map_rows

# Our own list: phrases of pages that want scripts.
SCRIPT_PHRASES = [
    "javascript is disabled", "javascript is required", "javascript is not enabled", "javascript must be enabled", "requires javascript", "needs javascript",
    "please enable javascript", "enable javascript to", "you need to enable javascript", "turn on javascript", "switch on javascript", "activate javascript", "javascript to continue", "without javascript",
    "you have to enable scripts", "enable scripts to", "scripts are disabled", "scripts are required", "scripts required", "allow scripts", "cookies and scripts to continue", "allow cookies and", "enable cookies", "checking your browser before",
    "browser does not support javascript", "browser doesn't support javascript", "browser does not support scripts",
    "تفعيل جافا سكربت", "تفعيل جافاسكربت", "تفعيل الجافاسكربت", "تفعيل الجافا سكربت", "تفعيل جافا سكريبت", "تفعيل الجافاسكريبت", "تفعيل جافاسكريبت", "تفعيل السكربتات", "تشغيل الجافاسكريبت", "تشغيل جافا سكربت", "تشغيل السكربتات",
    "شغل الجافاسكريبت", "شغل جافا سكربت", "شغل الجافاسكربت", "فعل الجافاسكريبت", "فعل جافا سكربت", "لا يدعم السكربتات", "لا يدعم جافا سكربت", "لا يدعم الجافاسكريبت", "الجافاسكريبت معطل", "جافا سكربت معطل", "يتطلب جافا سكربت",
    "جاوا اسکریپت را فعال کنید", "مرورگر شما از جاوا اسکریپت پشتیبانی نمی کند", "veuillez activer javascript", "javascript est désactivé", "bitte aktivieren sie javascript", "javascript ist deaktiviert", "active javascript", "habilite javascript",
]
# Our own list: phrases of error pages.
ERROR_PHRASES = [
    "page not found", "page you asked for could not be found", "page you requested could not be found", "page you are looking for", "page cannot be found", "page could not be found", "could not find the page", "file not found", "404 not found",
    "internal server error", "bad gateway", "service temporarily unavailable", "service unavailable", "gateway timeout", "gateway time-out", "too many requests", "request timed out", "upstream timed out", "connection timed out", "rate limited",
    "access denied", "access forbidden", "403 forbidden", "401 unauthorized", "your session has expired", "session expired", "session has expired", "please log in again", "an error occurred", "an error has occurred", "something went wrong", "please try again later", "try again later",
    "no such book", "database error", "sql error", "fatal error", "unhandled exception", "traceback (most recent call last)", "nullpointerexception", "segmentation fault", "stack trace", "could not connect to the server",
    "الصفحة غير موجودة", "الصفحة التي تبحث عنها", "الصفحة المطلوبة غير موجودة", "تعذر العثور على الصفحة", "لم يتم العثور على الصفحة", "لم نعثر على الصفحة", "الصفحة المطلوبة", "خلل داخلي في الخادم", "خطا داخلي في الخادم", "حدث خلل في الخادم", "حدث خطا في الخادم", "حدث خطا غير متوقع", "خطا في الخادم",
    "الخدمة غير متاحة", "تعذر الاتصال بالخادم", "تعذر الاتصال بقاعدة البيانات", "انتهت الجلسة", "انتهت مهلة الطلب", "سجل الدخول من جديد", "تم رفض الوصول", "ليست لديك صلاحية", "لا تملك صلاحية", "اعد المحاولة بعد قليل", "اعد المحاولة لاحقا", "حاول مرة اخرى لاحقا",
    "صفحه مورد نظر یافت نشد", "صفحه پیدا نشد", "خطای سرور", "دسترسی غیر مجاز", "page introuvable", "erreur interne du serveur", "seite nicht gefunden", "interner serverfehler", "página no encontrada", "error interno del servidor",
]
# Our own list: filler of pages that were never written.
FILLER_PHRASES = [
    "dolor sit amet", "content goes here", "text goes here", "your text here", "insert text here", "sample paragraph", "sample text", "placeholder text", "dummy text", "replace before publishing", "coming soon", "under construction", "to be added later", "asdf asdf", "test test test", "xxx xxx xxx", "blah blah blah",
    "فقرة نموذجية", "نص نموذجي", "نص تجريبي", "تحذف قبل النشر", "لملء الفراغ", "هنا يوضع نص", "يوضع النص هنا", "ادخل النص", "اكتب النص هنا", "ضع النص هنا", "النص هنا", "سيضاف المحتوى", "سيضاف النص", "المحتوى قريبا", "قيد الانشاء", "تحت الانشاء", "نص نص نص", "لوريم ايبسوم",
    "متن آزمایشی", "متن نمونه", "texte d'exemple", "beispieltext", "texto de ejemplo",
]
# Our own list: an opener, and the pattern with a free part that must stand at it (after folding).
_NAME = r"[\w.\- ]{1,40}"
SLOTS = [
    ("{{", r"\{\{[#/>!&]?\s*[\w.\- |]{1,60}\}\}"),
    ("{%", r"\{%[^%{}\n]{1,80}%\}"),
    ("<%", r"<%[=\-#]?[^%<>\n]{1,80}%>"),
    ("&lt;%", r"&lt;%[^%\n]{1,80}%&gt;"),
    ("${", r"\$\{[^{}\n]{1,60}\}"),
    ("#{", r"#\{[^{}\n]{1,60}\}"),
    ("%(", r"%\(\w[\w.]{0,40}\)[sdif]"),
    ("@@", rf"@@{_NAME}@@"),
    ("__", r"__[^\W_][\w.]{0,40}?__"),
    ("[[", rf"\[\[\s*{_NAME}\s*\]\]"),
    ("[todo", r"\[todo\b[^\]\n]{0,60}\]"),
    ("[insert", r"\[insert\b[^\]\n]{0,60}\]"),
    ("<insert", r"<insert\b[^>\n]{0,60}>"),
    ("<your", r"<your\b[^>\n]{0,60}>"),
    ("غير محدد]", r"غير محدد\]"),
    ("&lt;", r"&lt;[^\W\d][\w.]{0,40}&gt;"),
    ("[ادخل", r"\[ادخل\b[^\]\n]{0,60}\]"),
    ("[اكتب", r"\[اكتب\b[^\]\n]{0,60}\]"),
    ("[ضع", r"\[ضع\b[^\]\n]{0,60}هنا\]"),
    ("[your", r"\[your\b[^\]\n]{0,60}\]"),
]
# Our own list: the same for filler that goes on after its opener.
FILLERS = [
    ("lorem ipsum", r"lorem ipsum[^\n]*"),
    ("اكتب نص", r"اكتب نص\s[^\n]{0,40}?(?:هذا الموضع|هذا المكان|هنا)"),
    ("ادخل نص", r"ادخل نص\s[^\n]{0,40}?(?:هذا الموضع|هذا المكان|هنا)"),
    ("ضع نص", r"ضع نص\s[^\n]{0,40}?(?:هذا الموضع|هذا المكان|هنا)"),
]
# Our own list: the same for notices that scripts are required.
NOTICES = [("<noscript", r"<noscript\b[^\n]*?(?:</noscript>|$|\n)")]
STACKS = [
    ('{"status', r'\{"status":\s*[45]\d\d\s*,\s*"(?:error|message)"'),
    ('{"error', r'\{"(?:error|errors|message)":'),
    ('file "', r'file "[^"\n]{1,80}", line \d+'),
    ("at ", r"at [a-z_$][\w$]*(?:\.[\w$<>]+)+\([\w$]+\.java:\d+\)"),
]
TRACES = [
    ("http ", r"http\s+[1-5]\d\d\b"),
    ("http/", r"http/\d(?:\.\d)?\s+[1-5]\d\d\b"),
    ("error 4", r"error 4\d\d\b"),
    ("error 5", r"error 5\d\d\b"),
    ("خطا ", r"خطا\s+[45]\d\d\s*:?"),
    ("خطا ", r"خطا\s+[٤٥][٠-٩]{2}\s*:?"),
    ("sql error", r"sql error\s*\d*:?"),
    ("keyerror", r"keyerror: '"),
    ("typeerror", r"typeerror: "),
    ("valueerror", r"valueerror: "),
    ("exception", r"exception\b(?:: |\s+at |\s+in |$|\n)"),
]
# Our own list: values a template prints for a slot it could not fill, and the words of such a line.
EMPTY_VALUES = ["undefined", "null", "nan", "none", "nil", "%d", "%s"]
_NUMBERED = re.compile(r"(?:page|chapter|volume|part|الصفحة|صفحة|الجزء|جزء|الباب|المجلد)\s+.{0,60}?(?:\bof|من|/)\s+$")
_WORD_SIDE = re.compile(r"[^\W_]")
_WORD_CHARACTER = re.compile(r"\w").match
_FIRST_WORD = re.compile(r"[^\w\n]*(\w{2,12})").match
_SENTENCE_END = re.compile(r"[.!?؟۔]+ |\n")
_REPEATED = re.compile(r"^[^\w\n]*(\w{2,12})(?:[ ,.]+\1){3,}[^\w\n]*(?:\(ref \d+\)|#\d+)?[^\w\n]*$", re.M)
_MARKS = re.compile(C.DIAC_NORM)
# Folding before the match.
_FOLD = str.maketrans("آأإٱى", "ااااى")
_LINES = re.compile(r"[\n\r\x0b\x0c\x1c-\x1e\x85  ]+")


class _Folded(dict):
    """Raw word -> the word the automaton reads; bounded."""

    def __missing__(self, word: str) -> str:
        if len(self) >= 400_000:
            self.clear()
        folded = " ".join(_MARKS.sub("", one_form(word)).translate(_FOLD).lower().split())
        self[word] = folded
        return folded


_FOLDED = _Folded()


def fold(text: str) -> str:
    """The text the automaton reads: one form, marks gone, alefs folded, lower case, single blanks, lines kept."""
    memo = _FOLDED
    return "\n".join([" ".join(map(memo.__getitem__, line.split())) for line in _LINES.split(text)])


@lru_cache(maxsize=1)
def _machine():
    """The multi-pattern automaton with the patterns each opener leads to."""
    import ahocorasick

    entries: dict[str, list[tuple[str, str, object]]] = {}
    for kind, phrases in (("script", SCRIPT_PHRASES), ("error", ERROR_PHRASES), ("filler", FILLER_PHRASES)):
        for phrase in phrases:
            entries.setdefault(fold(phrase), []).append((kind, "phrase", None))
    for kind, how, patterns in (("slot", "sure", SLOTS), ("error", "sure", STACKS), ("error", "pattern", TRACES), ("filler", "pattern", FILLERS), ("script", "sure", NOTICES)):
        for opener, pattern in patterns:
            entries.setdefault(opener, []).append((kind, how, re.compile(pattern)))
    for value in EMPTY_VALUES:
        entries.setdefault(value, []).append(("slot", "value", None))
    machine = ahocorasick.Automaton()
    for key, value in entries.items():
        machine.add_word(key, (key, value))
    machine.make_automaton()
    return machine


def find_residue(text: str | None) -> list[tuple[int, int, str]]:
    """Spans ``(start, end, kind)`` of residue in the folded text, in order."""
    return [(a, b, kind) for a, b, kind, _ in _spans(fold(text))] if text else []


def _unfilled(folded: str, start: int, end: int) -> bool:
    """Whether a template printed the value at ``start``: it ends its line and opens it or follows a mark of a field, or it is the number of pages of which one is named."""
    line = folded.rfind("\n", 0, start) + 1
    before = folded[line:start].rstrip()
    if (end == len(folded) or folded[end] == "\n") and (not before or before[-1] in ":|="):
        return True
    return not (end < len(folded) and _WORD_CHARACTER(folded[end])) and _NUMBERED.search(folded, max(line, start - 100), start) is not None


def _spans(folded: str) -> list[tuple[int, int, str, bool]]:
    """``(start, end, kind, sure)`` of the residue, in order; what is sure counts whatever stands around it."""
    found = []
    for last, (key, entries) in _machine().iter(folded):
        start, end = last - len(key) + 1, last + 1
        for kind, how, pattern in entries:
            if how == "phrase":
                if not (start and _WORD_SIDE.match(folded[start - 1])) and not (end < len(folded) and _WORD_SIDE.match(folded[end])):
                    found.append((start, end, kind, False))
            elif how == "value":
                if _unfilled(folded, start, end):
                    found.append((start, end, kind, True))
            elif m := pattern.match(folded, start):
                if not (kind in ("error", "filler") and start and _WORD_SIDE.match(folded[start - 1])) or key == "exception":
                    found.append((start, m.end(), kind, how == "sure"))
    return sorted(found)


def _repeats(line: str) -> bool:
    """Whether a line is one word over and over: only lines in which the first word is found again are read word by word."""
    first = _FIRST_WORD(line)
    return first is not None and line.count(first[1]) >= 4 and _REPEATED.match(line) is not None


def coverage(text: str | None, min_coverage: float = 0.2) -> tuple[float, list[str]]:
    """Share of the text's characters that residue covers, and the kinds found.

    A sentence's residue counts when it covers the sentence to ``min_coverage`` at least, or
    when it is sure: a sentence that merely speaks of an error among much else is content.
    """
    if not text:
        return 0.0, []
    folded = fold(text)
    spans = _spans(folded)
    covered, kinds, at = 0, set(), 0
    for start, end in _sentences(folded):
        seen = reach = 0
        first = at
        while at < len(spans) and spans[at][0] < end:
            a, b = max(spans[at][0], reach), spans[at][1]
            seen += max(b - a, 0)
            reach = max(reach, b)
            at += 1
        if at > first and (any(s[3] for s in spans[first:at]) or seen >= min_coverage * (end - start)):
            covered += seen
            kinds.update(s[2] for s in spans[first:at])
    for line in folded.split("\n"):
        if _repeats(line):
            covered += len(line)
            kinds.add("filler")
    return min(1.0, covered / max(1, len(folded))), sorted(kinds)


def _sentences(folded: str) -> Iterator[tuple[int, int]]:
    """Bounds of the sentences: cut at line breaks, and after a mark that ends a sentence before a blank."""
    at = 0
    for m in _SENTENCE_END.finditer(folded):
        yield at, m.end()
        at = m.end()
    yield at, len(folded) + 1


def residue_report(df: DataFrame, min_coverage: float = 0.2) -> DataFrame:
    """``(doc_id, coverage, kinds)`` of every row; null, empty and blank texts have none; repeated rows each have one."""

    def run(ids, texts):
        found = [coverage(t, min_coverage) for t in texts]
        return [ids, [c for c, _ in found], [k for _, k in found]]

    return map_rows(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, coverage double, kinds array<string>")


def residue_documents(df: DataFrame, min_coverage: float = 0.2) -> DataFrame:
    """Ids of the documents that hold residue, as the whole text or a part of it."""
    return residue_report(df, min_coverage).where(F.size("kinds") > 0).select("doc_id")


def without_residue(df: DataFrame, min_coverage: float = 0.2) -> DataFrame:
    """The documents that hold none, all columns kept; the test runs beside the row, so nothing is joined."""
    @F.pandas_udf(T.BooleanType())
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: not coverage(t, min_coverage)[1]).astype(bool)

    return df.where(clean(F.col("text")))
