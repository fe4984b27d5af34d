"""Runs of equal labels over words: segments, spans, labels by boundary, usability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sahifa.functions import charclasses as C
from sahifa.functions.tokens import let

SEGMENT = "array<struct<code:string,text:string>>"
SPAN = "array<struct<start:int,end:int,label:string>>"


def _runs(items: Column, label: str, made) -> Column:
    """``made(items, first, end)`` of each run of equal ``label``; places count from 0 and ends are exclusive.

    The places where a run starts are found first, so nothing is rebuilt from word to word.
    """

    def starts(x: Column) -> Column:
        places = F.transform(x["of"], lambda _, i: i)
        return F.filter(places, lambda i: (i == 0) | ~F.get(x["of"], i)[label].eqNullSafe(F.get(x["of"], i - 1)[label]))

    def cut(x: Column) -> Column:
        ends = F.concat(F.slice(x["starts"], F.lit(2), F.size(x["of"])), F.array(F.size(x["of"])))
        pairs = F.zip_with(x["starts"], ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.transform(pairs, lambda p: made(x["of"], p["a"], p["b"]))

    empty = lambda x: F.when(F.size(x["of"]) > 0, let(cut, of=x["of"], starts=starts(x)))
    return let(empty, of=items)


def merge_runs(pairs: Column) -> Column:
    """``array<struct<code, text>>`` of ``array<struct<word, code>>``: words of a run joined by one space; a null array has none."""

    def made(items: Column, a: Column, b: Column) -> Column:
        text = F.array_join(F.transform(F.slice(items, a + 1, b - a), lambda p: p["word"]), " ")
        return F.struct(F.get(items, a)["code"].alias("code"), text.alias("text"))

    return F.coalesce(_runs(pairs, "code", made).cast(SEGMENT), F.array().cast(SEGMENT))


def run_ids(df: DataFrame, by: list[str], order: str, label: str) -> DataFrame:
    """Exploded form of the same: ``run`` numbers the runs of ``label`` in ``order`` within ``by``, from 0."""
    w = W.partitionBy(*by).orderBy(order)
    new = F.when(F.lag(order).over(w).isNull() | ~F.lag(label).over(w).eqNullSafe(F.col(label)), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w) - 1).drop("_new")


def merged_segments(df: DataFrame, by: list[str], order: str, label: str, word: str) -> DataFrame:
    """One row per run: label, words joined in order, first and last position."""
    runs = run_ids(df, by, order, label).groupBy(*by, "run", label)
    words = F.array_sort(F.collect_list(F.struct(order, word)))
    return runs.agg(F.array_join(F.transform(words, lambda x: x[word]), " ").alias("text"), F.min(order).alias("first"), F.max(order).alias("last"))


def unit_labels(tokens: Column, boundary: Column, max_words: int = 220) -> Column:
    """Label of each of the first ``max_words`` tokens: a number that opens the unit, then chain up to the raw offset ``boundary``, then report."""
    kept = F.slice(tokens, 1, max_words)
    return F.transform(
        kept,
        lambda t: F.when((t["idx"] == 0) & t["text"].rlike(C.HNUM), "HNUM").when(t["start"] < boundary, "ISNAD").otherwise("MATN"),
    )


def spans(tokens: Column, labels: Column, min_words: int = 12) -> Column:
    """Spans ``[start, end, label]`` over raw offsets; none on a page with fewer than ``min_words`` words.

    Runs go on across tagging blocks; a span ends where its last word ends.
    """

    def made(items: Column, a: Column, b: Column) -> Column:
        return F.struct(F.get(items, a)["start"].alias("start"), F.get(items, b - 1)["end"].alias("end"), F.get(items, a)["label"].alias("label"))

    pairs = F.zip_with(tokens, labels, lambda t, l: F.named_struct(F.lit("start"), t["start"], F.lit("end"), t["end"], F.lit("label"), l))
    none = F.array().cast(SPAN)
    return let(lambda x: F.when(F.size(x["p"]) < min_words, none).otherwise(F.coalesce(_runs(x["p"], "label", made).cast(SPAN), none)), p=pairs)


def span_mass(spans: Column, label: str) -> Column:
    return F.aggregate(F.filter(spans, lambda s: s["label"] == label), F.lit(0), lambda a, s: a + s["end"] - s["start"])


def usable(spans: Column, min_chain: int = 30, min_report: int = 40) -> Column:
    """Whether the spans hold both a chain and a report of substance."""
    return (span_mass(spans, "ISNAD") >= min_chain) & (span_mass(spans, "MATN") >= min_report)


def quotations(text: Column) -> Column:
    """``array<struct<a, b>>``: offsets of quotations (``﴿...﴾`` or ``{...}``)."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)[^﴿{]+|﴿[^﴾]*﴾|\{[^}]*\}|."), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        end = s["at"] + F.length(p)
        quoted = F.named_struct(F.lit("a"), s["at"], F.lit("b"), end)
        return F.named_struct(F.lit("at"), end, F.lit("out"), F.when((F.length(p) > 1) & p.rlike("^[﴿{]"), F.array_append(s["out"], quoted)).otherwise(s["out"]))

    return F.aggregate(pieces, start, step, lambda s: s["out"])


def _fillable(t: Column, quoted: Column) -> Column:
    return t["text"].rlike(C.LETTER) & ~t["text"].rlike(C.MARK_MODEL) & ~F.exists(quoted, lambda q: (t["start"] < q["b"]) & (t["end"] > q["a"]))


def gap_fill_flags(tokens: Column, text: Column) -> Column:
    """For each token whether a gap filler may mark it: it has a letter, no marks, and lies outside quotations."""
    return let(lambda x: F.transform(x["t"], lambda t: _fillable(t, x["q"])), t=tokens, q=quotations(text))


def gap_fill_eligible(tokens: Column, text: Column) -> Column:
    """The tokens of which :func:`gap_fill_flags` is true."""
    return let(lambda x: F.filter(x["t"], lambda t: _fillable(t, x["q"])), t=tokens, q=quotations(text))
