from __future__ import annotations

import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from sahifa.functions import labels as L, marks as M, text as X, tokens as K
from sahifa.operators import runs, vocab
from sahifa.sources import corpus


def values(spark, items, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("function", "given", "expected"),
    [
        (X.normalize_arabic, "أَحْمَد", "احمد"),
        (X.normalize_arabic, "مكتبة", "مكتبه"),
        (X.normalize_arabic, "على", "علي"),
        (X.normalize_arabic, "\x1fسؤال\xa0  x ", "سءال x"),
        (X.normalize_arabic, None, ""),
        (X.has_tashkeel, "قَالَ", True),
        (X.has_tashkeel, "قال", False),
        (X.strip_diacritics, "أَحْمَد", "أحمد"),
        (X.strip_diacritics, "مَكْتَبَة", "مكتبة"),
        (X.csv_safe, "=cmd", "'=cmd"),
        (X.csv_safe, "+1+1", "'+1+1"),
        (X.csv_safe, "-2+3", "'-2+3"),
        (X.csv_safe, "@SUM(1:1)", "'@SUM(1:1)"),
        (X.csv_safe, "\t=1+1", "'\t=1+1"),
        (X.csv_safe, "قال", "قال"),
        (X.csv_safe, None, None),
        (X.clean_header, " a\r\nb ", "a b"),
        (X.markdown_cell, "a|b\nc", "a\\|b c"),
        (X.remove_junk, "x AddHistory(4,'p'); y [3/12]", "x   y  "),
        (X.clean_word_text, "a\x13HYPERLINK \"x\"\x14b\x15c\rd\x1ee\xa0f\x07", "abc\nd-e f\n"),
        (X.sanitize_filename, "..\\..\\a/b c؟*.txt", "b c؟_.txt"),
        (X.sanitize_filename, "....", "input"),
        (X.is_unit_number, "١٢٤٨-", True),
        (X.is_unit_number, "1248", True),
        (X.is_unit_number, "12a", False),
    ],
)
def test_golden(spark, function, given, expected):
    assert values(spark, [given], function) == [expected]


def test_split_is_the_digest_modulo_hundred(spark):
    keys = [str(i) for i in range(500)] + ["قال", ""]

    def plain(key):
        bucket = int(hashlib.md5(key.encode()).hexdigest(), 16) % 100
        return "train" if bucket < 90 else "dev" if bucket < 95 else "test"

    assert values(spark, keys, X.split_of) == [plain(k) for k in keys]


def random_texts(n=200, seed=1):
    rng = random.Random(seed)
    pool = "قالعن مبح" + "ًَِّْٰ" + "  \xa0 \x1c😀aZ.ـ\n"
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_tokens_slice_back(spark):
    texts = random_texts()
    for text, toks in zip(texts, values(spark, texts, K.tokens)):
        assert [t["text"] for t in toks] == text.split()
        assert all(text[t["start"] : t["end"]] == t["text"] and t["idx"] == i for i, t in enumerate(toks))


def test_running_sums_of_long_and_short_arrays(spark):
    rng = random.Random(2)
    made = [(i, [rng.randint(0, 9) for _ in range(n)]) for i, n in enumerate([0, 1, 511, 512, 513, 1024, 5000])]
    df = spark.createDataFrame(made, "id int, a array<int>")
    got = {r["id"]: r["s"] for r in df.select("id", K.running_sums(F.col("a")).alias("s")).collect()}
    assert all(got[i] == [sum(a[: k + 1]) for k in range(len(a))] for i, a in made)


def test_marks_come_apart_and_together(spark):
    texts = random_texts(300, 2)
    plain_marks = "ًٌٍَُِّْٰ"
    order = ["", "َ", "ُ", "ِ", "ْ", "ً", "ٌ", "ٍ"]

    def plain(text):
        out = []
        for c in text:
            if c not in plain_marks:
                out.append([c, 0, 0])
            elif out:
                if c == "ّ":
                    out[-1][2] = 8
                elif c in order and not out[-1][1]:
                    out[-1][1] = order.index(c)
        return [(b, v + s) for b, v, s in out]

    for text, got in zip(texts, values(spark, texts, M.split_marks)):
        assert [(x["base"], x["label"]) for x in got] == plain(text)
    nfc = lambda t: unicodedata.normalize("NFC", t)
    whole = ["قَالَ رَسُولُ اللَّهِ مُحَمَّدٌ", "هَذَا"]
    back = values(spark, whole, lambda v: M.join_marks(M.split_marks(v)))
    assert [nfc(b) for b in back] == [nfc(w) for w in whole]
    assert values(spark, whole, lambda v: M.canonical_marks(M.join_marks(M.split_marks(v)))) == [nfc(w) for w in whole]
    assert values(spark, ["هَٰذَا"], lambda v: M.join_marks(M.split_marks(v))) == ["هَذَا"]
    assert values(spark, ["مُحَمَّدٌ"], M.mark_labels) == [[2, 1, 9, 6]]
    applied = values(spark, ["محمد"], lambda v: M.apply_marks(v, F.array(F.lit(2), F.lit(1), F.lit(9))))
    assert applied == ["م\u064fح\u064eم\u0651\u064e"]


def test_windows_hold_all_words(spark):
    texts = [" ".join("و" * random.Random(i).randint(1, 30) for _ in range(i)) for i in range(40)] + ["", "x" * 50, "a " + "x" * 50 + " b"]
    for text, wins in zip(texts, values(spark, texts, lambda v: K.windows(v, 40))):
        assert " ".join(wins).split() == text.split()
        assert all(len(w) <= 39 or " " not in w for w in wins)
        for a, b in zip(wins, wins[1:]):  # a window was flushed only when the next word did not fit
            assert len(a) + 1 + len(b.split()[0]) + 1 > 40
    assert values(spark, ["   ", "aa bb cc"], lambda v: K.wrap_words(v, 5)) == [[""], ["aa bb", "cc"]]


def test_blocks_and_padding(spark):
    got = values(spark, [list("abcdefg"), [], None], lambda v: K.blocks(v, 3), "array<string>")
    assert got[:2] == [[["a", "b", "c"], ["d", "e", "f"], ["g"]], []]
    assert values(spark, [[1, 2], []], lambda v: K.pad(v, F.lit(3)), "array<int>") == [[1, 2, 0], [0, 0, 0]]
    assert values(spark, [["noun"] * 130], lambda v: K.fit_tags(v, F.lit(131), "?"), "array<string>")[0][-12:] == ["noun"] + ["?"] * 11


def test_character_tags_follow_plain_spaces(spark):
    def plain(text, tags):
        out, word = [], 0
        for c in text:
            out.append(tags[word] if word < len(tags) else "x")
            word += c == " "
        return out

    for text in ["ab  c\xa0d e", "", " a", "a b c d"]:
        assert values(spark, [text], lambda v: K.char_tags(v, F.array(F.lit("n"), F.lit("v"))))[0] == plain(text, ["n", "v"])


def test_word_characters(spark):
    vocabulary = F.create_map(F.lit("ق"), F.lit(2), F.lit("ا"), F.lit(3))
    assert values(spark, [["قال", ""]], lambda v: K.encode_word_chars(v, vocabulary, 2), "array<string>") == [[[2, 3], [1]]]


def test_gaps_outside_quotations(spark):
    text = "قَالَ رسول الله ﴿الحمد لله﴾ وقال {قل هو} 12 ثم ﴿ x"
    got = values(spark, [text], lambda v: runs.gap_fill_eligible(K.tokens(v), v))[0]
    quoted = [m.span() for m in re.finditer(r"﴿[^﴾]*﴾|\{[^}]*\}", text)]
    want = [m.group() for m in re.finditer(r"\S+", text) if re.search("[ء-ي]", m.group()) and not re.search("[ً-ْٰ]", m.group()) and not any(m.start() < b and m.end() > a for a, b in quoted)]
    assert [t["text"] for t in got] == want == ["رسول", "الله", "وقال", "ثم"]


def test_labels(spark):
    assert values(spark, ["noun", "new_tag", None], lambda v: L.name("pos", v, "en")) == ["noun", "new_tag", None]
    assert values(spark, ["noun"], lambda v: L.name("pos", v, "fr")) == ["اسم"]
    assert values(spark, ["EN-us", "fr", None], L.language) == ["en", "ar", "ar"]
    assert L.columns("pos", "en") == ("word", "tag") and L.columns("other") == ("item", "label")
    assert L.glossary(spark, "structure").count() == 4


def test_structure_output(spark):
    df = spark.createDataFrame([([("ISNAD", "حدثنا مالك"), ("MATN", "قال")], [(0, 1, "حدثنا", "مالك")])], "pairs array<struct<code:string,text:string>>, narrators array<struct<seg:int,n:int,verb:string,name:string>>")
    out = df.select(L.format_structure(F.col("pairs"), F.col("narrators"), "en")).first()[0]
    assert out == "[isnād] حدثنا مالك\n    narrators:\n      1. حدثنا — مالك\n[matn] قال"


def test_vocabulary_ties_go_to_the_first(spark):
    items = "b a a b c d".split()
    df = spark.createDataFrame(list(enumerate(items)), "at int, item string")
    built = vocab.build(df, "item", ["at"], 3)
    assert {r["item"]: r["id"] for r in built.collect()} == {"b": 2, "a": 3, "c": 4}
    assert {r["item"]: r["id"] for r in vocab.encode_rows(df.select("item"), "item", built).collect()} == {"b": 2, "a": 3, "c": 4, "d": 1}
    assert df.select(K.encode(F.array("item"), vocab.as_map(built))[0]).first()[0] == 2
    assert vocab.build(df.limit(0), "item", ["at"], 3).count() == 0


def test_pasted_units(spark):
    df = spark.createDataFrame([(1, "قال\r\n\r\nوقال\rx"), (2, None)], "id int, text string")
    got = sorted((r["id"], r["n"], r["source"]) for r in corpus.pasted_units(df, "id", "text").collect())
    assert got == [(1, 1, "قال"), (1, 2, ""), (1, 3, "وقال"), (1, 4, "x"), (2, 1, "")]
    cut = corpus.pasted_units(df.where("id = 1"), "id", "text", 2, 2).orderBy("n").collect()
    assert [(r["source"], r["truncated"]) for r in cut] == [("قا", True), ("", True)]
