"""Names of the tag codes in English and Arabic, and their display forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DEFAULT_LANGUAGE = "ar"
# Code, English name, Arabic name of each part of speech.
POS = [
    ("abbrev", "abbreviation", "اختصار"),
    ("adj", "adjective", "صفة"),
    ("adv", "adverb", "ظرف"),
    ("adv_interrog", "interrogative adverb", "ظرف استفهام"),
    ("adv_rel", "relative adverb", "ظرف موصول"),
    ("conj", "conjunction", "حرف عطف"),
    ("conj_sub", "subordinating conjunction", "حرف مصدري"),
    ("digit", "number", "رقم"),
    ("interj", "interjection", "أداة تعجب"),
    ("noun", "noun", "اسم"),
    ("noun_prop", "proper noun", "اسم علم"),
    ("part", "particle", "حرف"),
    ("part_interrog", "interrogative particle", "أداة استفهام"),
    ("part_neg", "negation particle", "أداة نفي"),
    ("part_verb", "verbal particle", "حرف مختص بالفعل"),
    ("part_voc", "vocative particle", "أداة نداء"),
    ("prep", "preposition", "حرف جر"),
    ("pron", "pronoun", "ضمير"),
    ("pron_dem", "demonstrative pronoun", "اسم إشارة"),
    ("pron_interrog", "interrogative pronoun", "اسم استفهام"),
    ("pron_rel", "relative pronoun", "اسم موصول"),
    ("punc", "punctuation", "علامة ترقيم"),
    ("verb", "verb", "فعل"),
    ("verb_pseudo", "pseudo-verb", "حرف مشبه بالفعل"),
]
# The same for the spans of a unit.
STRUCTURE = [
    ("HNUM", "hadith number", "رقم الحديث"),
    ("ISNAD", "isnād", "الإسناد"),
    ("MATN", "matn", "المتن"),
    ("HEADING", "heading", "العنوان"),
]
SETS = {"pos": POS, "structure": STRUCTURE}
# Headings of tabular exports.
COLUMNS = {
    ("pos", "en"): ("word", "tag"),
    ("pos", "ar"): ("الكلمة", "الوسم"),
    ("structure", "en"): ("segment", "label"),
    ("structure", "ar"): ("المقطع", "التصنيف"),
}
# Wording of a narrator list.
NARRATOR_WORDS = {
    "en": {"heading": "narrators", "n": "#", "verb": "verb", "name": "narrator"},
    "ar": {"heading": "رواة الإسناد", "n": "#", "verb": "صيغة التحمل", "name": "الراوي"},
}


def language(lang: Column) -> Column:
    """A language there is: the first two letters of what was asked for, else Arabic."""
    short = F.substring(F.lower(F.trim(F.coalesce(lang, F.lit("")))), 1, 2)
    return F.when(short.isin("en", "ar"), short).otherwise(DEFAULT_LANGUAGE)


def language_of(lang: str | None) -> str:
    short = (lang or "").strip().lower()[:2]
    return short if short in ("en", "ar") else DEFAULT_LANGUAGE


def label_map(kind: str, lang: str) -> Column:
    """Literal map of a tag set: the sets have a fixed size, so no join is needed."""
    at = 2 if language_of(lang) == "ar" else 1
    pairs = [F.lit(x) for entry in SETS.get(kind, []) for x in (entry[0], entry[at])]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def name(kind: str, code: Column, lang: str = DEFAULT_LANGUAGE) -> Column:
    """Display name of a code; codes the set does not have pass through."""
    return F.coalesce(F.element_at(label_map(kind, lang), code), code)


def columns(kind: str, lang: str = DEFAULT_LANGUAGE) -> tuple[str, str]:
    return COLUMNS.get((kind, language_of(lang)), ("item", "label"))


def glossary(spark: SparkSession, kind: str) -> DataFrame:
    return spark.createDataFrame(SETS.get(kind, []), "code string, en string, ar string")


def format_pos(pairs: Column, lang: str = DEFAULT_LANGUAGE) -> Column:
    """``word/tag`` items of ``array<struct<word, code>>`` in reading order."""
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws("/", p["word"], name("pos", p["code"], lang))), " ")


def format_structure(pairs: Column, narrators: Column, lang: str = DEFAULT_LANGUAGE) -> Column:
    """Lines of ``array<struct<code, text>>`` with the chain of each segment (``array<struct<seg, n, verb, name>>``) below it."""
    heading = NARRATOR_WORDS[language_of(lang)]["heading"]

    def segment(pair: Column, i: Column) -> Column:
        chain = F.filter(narrators, lambda h: h["seg"] == i)
        first = F.concat(F.lit("["), name("structure", pair["code"], lang), F.lit("] "), pair["text"])
        lines = F.transform(chain, lambda h: F.concat(F.lit("      "), h["n"].cast("string"), F.lit(". "), h["verb"], F.lit(" — "), h["name"]))
        listed = F.concat(F.array(F.lit(f"    {heading}:")), lines)
        return F.concat_ws("\n", first, F.when(F.size(chain) > 0, F.array_join(listed, "\n")))

    return F.array_join(F.transform(pairs, segment), "\n")
