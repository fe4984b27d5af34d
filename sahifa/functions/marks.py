"""Splitting vocalized text into letters and mark classes, and putting marks back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sahifa.functions import charclasses as C

_CLUSTER = f"(?s){C.NOT_MARK_MODEL}{C.MARK_MODEL}*"


def split_marks(text: Column) -> Column:
    """``array<struct<base string, label int>>``: one element per base character.

    A cluster is one base character with the marks after it; marks with no base before them are
    dropped. The label is the first vowel sign of the cluster (0 for none), plus 8 with shadda.
    Any base has a label, blanks and punctuation too; metrics mask what is no letter.
    """
    clusters = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_CLUSTER), F.lit(0))
    signs = F.array(*[F.lit(v) for v in C.VOWELS[1:]])

    def label(cluster: Column) -> Column:
        vowel = F.array_position(signs, F.regexp_extract(cluster, f"({C.VOWEL_SIGN})", 1)).cast("int")
        return F.struct(F.substring(cluster, 1, 1).alias("base"), (vowel + F.when(F.contains(cluster, F.lit(C.SHADDA)), 8).otherwise(0)).alias("label"))

    return F.transform(clusters, label)


def bare_text(text: Column) -> Column:
    return F.array_join(F.transform(split_marks(text), lambda x: x["base"]), "")


def mark_labels(text: Column) -> Column:
    return F.transform(split_marks(text), lambda x: x["label"])


def _marked(base: Column, label: Column) -> Column:
    vowels = F.array(*[F.lit(v) for v in C.VOWELS])
    shadda = F.when(label >= 8, C.SHADDA).otherwise("")
    return F.when(base.rlike(f"^{C.LETTER}$") & (label > 0), F.concat(base, shadda, F.element_at(vowels, (label % 8 + 1).cast("int")))).otherwise(base)


def join_marks(split: Column) -> Column:
    """The text of a split array; shadda stands before the vowel."""
    return F.array_join(F.transform(split, lambda x: _marked(x["base"], x["label"])), "")


def apply_marks(text: Column, labels: Column) -> Column:
    """``text`` with the marks of ``labels`` after its letters; the shorter of both decides the length."""
    bases = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?s)."), F.lit(0))
    n = F.least(F.size(bases), F.size(labels))
    pairs = F.zip_with(F.slice(bases, F.lit(1), n), F.slice(labels, F.lit(1), n), _marked)
    return F.array_join(pairs, "")


def canonical_marks(text: Column) -> Column:
    """Canonical order of shadda and the signs that sort before it, for comparing texts."""
    return F.regexp_replace(text, r"\u0651([\u064B-\u0650])", "$1\u0651")


def letter_errors(gold: Column, predicted: Column) -> Column:
    """``struct<letters, wrong, marked, marked_wrong>`` of two split arrays over the same letters."""
    pairs = F.filter(F.arrays_zip(gold.alias("g"), predicted.alias("p")), lambda x: x["g"]["base"].rlike(f"^{C.LETTER}$"))
    wrong = lambda x: x["g"]["label"] != x["p"]["label"]
    marked = lambda x: x["g"]["label"] > 0
    return F.struct(
        F.size(pairs).alias("letters"),
        F.size(F.filter(pairs, wrong)).alias("wrong"),
        F.size(F.filter(pairs, marked)).alias("marked"),
        F.size(F.filter(pairs, lambda x: marked(x) & wrong(x))).alias("marked_wrong"),
    )
