"""Pluggable word taggers, and count-based ones trained in Spark.

A tagger takes words and gives one label each. Trained weights of neural taggers are not part
of this repository; ``apply_tagger`` runs any such function in Arrow batches, and the
count-based taggers here honour the same contracts on their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from sahifa.functions import charclasses as C, marks, tokens
from sahifa.operators.rowmap import with_columns

Tagger = Callable[[Sequence[str]], Sequence[str]]


def apply_tagger(df: DataFrame, words: str, load: Callable[[], Tagger], block: int | None = None, max_words: int | None = None, overflow: str = "?") -> DataFrame:
    """``df`` with ``labels`` of ``words`` beside each row, by the tagger ``load()`` makes once per task.

    With ``block``, words are tagged in consecutive blocks without overlap; with ``max_words``,
    words beyond it get ``overflow``. Null arrays are empty.
    """

    def run(tag, rows):
        out = []
        for row in rows:
            row = list(row or ())
            head = row if max_words is None else row[:max_words]
            size = block or max(len(head), 1)
            labels = [x for i in range(0, len(head), size) for x in tag(head[i : i + size])]
            out.append(labels + [overflow] * (len(row) - len(head)))
        return [out]

    return with_columns(df, [words], run, "labels array<string>", init=load)


def count_labels(df: DataFrame, word: str, label: str, ordinal: list[str]) -> DataFrame:
    """``(word, label, n, round, first)``: what a lexicon is made of; ``round`` is 0 for counts of one training."""
    first = F.to_json(F.struct(*ordinal)) if len(ordinal) > 2 else F.struct(*(F.col(c).cast("long").alias(f"o{i}") for i, c in enumerate(ordinal)))
    return df.groupBy(F.col(word).alias("word"), F.col(label).alias("label")).agg(F.count("*").alias("n"), F.min(first).alias("first")).withColumn("round", F.lit(0))


def fine_tuned(earlier: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts of a training that goes on from ``earlier`` ones: both add up, and what was seen before comes first."""
    both = earlier.unionByName(counts.withColumn("round", F.lit(1) + F.col("round")))
    return both.groupBy("word", "label").agg(F.sum("n").alias("n"), F.min(F.struct("round", "first")).alias("o")).select("word", "label", "n", F.col("o.first").alias("first"), F.col("o.round").alias("round"))


def best_labels(counts: DataFrame) -> DataFrame:
    """``(word, label, n)``: the most frequent label of each word, ties by first occurrence."""
    best = counts.groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("minus"), "round", "first", "label")).alias("b"))
    return best.select("word", "b.label", (-F.col("b.minus")).alias("n"))


def train_lexicon(df: DataFrame, word: str, label: str, ordinal: list[str]) -> DataFrame:
    return best_labels(count_labels(df, word, label, ordinal))


def suffix_lexicon(counts: DataFrame, length: int) -> DataFrame:
    """``(word, label, n)`` of endings of ``length`` characters: what :func:`tag_words` falls back on for unknown words."""
    ends = counts.where(F.length("word") > length).withColumn("word", F.substring("word", -length, length))
    summed = ends.groupBy("word", "label").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.min("round").alias("round"))
    return best_labels(summed)


def majority(df: DataFrame, label: str, ordinal: list[str]) -> str | None:
    row = df.groupBy(label).agg(F.count("*").alias("n"), F.min(F.struct(*ordinal)).alias("first")).orderBy(F.desc("n"), F.asc("first")).select(label).first()
    return row[0] if row else None


def tag_words(df: DataFrame, word: str, lexicon: DataFrame, default: str | None, endings: dict[int, DataFrame] | None = None) -> DataFrame:
    """Adds ``predicted``: the lexicon's label or, for words it does not have, that of the longest ending ``endings`` (by length) has, else ``default``."""
    known = lexicon.select(F.col("word").alias(word), F.col("label").alias("predicted"))
    out = df.join(known, word, "left")
    for length in sorted(endings or (), reverse=True):
        ending = endings[length].select(F.col("word").alias("_ending"), F.col("label").alias("_label"))
        out = out.withColumn("_ending", F.when(F.col("predicted").isNull(), F.substring(word, -length, length))).join(ending, "_ending", "left")
        out = out.withColumn("predicted", F.coalesce("predicted", "_label")).drop("_ending", "_label")
    return out.withColumn("predicted", F.coalesce("predicted", F.lit(default)))


def train_diacritizer(df: DataFrame, text: str, ordinal: str) -> DataFrame:
    """``(word, label, n)``: the most frequent vocalization of each bare word that carries marks."""
    words = df.select(ordinal, F.posexplode(tokens.words(F.col(text))).alias("at", "form")).where(F.col("form").rlike(C.MARK_MODEL))
    return train_lexicon(words.withColumn("word", F.regexp_replace("form", C.MARK_MODEL, "")), "word", "form", [ordinal, "at"])


def _by_text(df: DataFrame, text: str, made: Callable[[DataFrame], DataFrame], column: str) -> DataFrame:
    """``df`` with ``column`` beside each row, made once for each distinct text.

    ``made`` turns ``(digest, whole)`` into ``(digest, column)``. What is gathered again is one
    text, and rows meet it by the digest of their own text, so keys may repeat or be null.
    """
    keyed = df.withColumn("_digest", F.md5(F.coalesce(F.col(text), F.lit("")))).drop(*({column} - {text}))
    texts = keyed.select("_digest", F.coalesce(F.col(text), F.lit("")).alias("_whole")).dropDuplicates(["_digest"])
    return keyed.join(made(texts), "_digest").drop("_digest")


def _rewrite(df: DataFrame, text: str, lexicon: DataFrame, flags) -> DataFrame:
    """``df`` with ``output``: its texts with each flagged word replaced by its vocalization; blanks and letters stay as they are.

    A word carries the blanks before it, the blanks at the end are an item of their own.
    """

    def items(x):
        before = F.concat(F.array(F.lit(0)), F.transform(x["t"], lambda t: t["end"]))
        zipped = F.arrays_zip(x["t"].alias("t"), x["ok"].alias("ok"), F.slice(before, F.lit(1), F.size(x["t"])).alias("b"))
        each = F.transform(
            zipped,
            lambda z: F.named_struct(F.lit("gap"), F.substring(x["text"], z["b"] + 1, z["t"]["start"] - z["b"]), F.lit("piece"), z["t"]["text"], F.lit("ok"), z["ok"]),
        )
        last = F.element_at(before, -1)
        tail = F.named_struct(F.lit("gap"), F.substring(x["text"], last + 1, F.length(x["text"]) - last), F.lit("piece"), F.lit(""), F.lit("ok"), F.lit(False))
        return F.concat(each, F.array(tail))

    def made(texts: DataFrame) -> DataFrame:
        flagged = texts.withColumn("t", tokens.tokens(F.col("_whole")))
        listed = tokens.let(lambda x: tokens.let(items, t=x["t"], ok=flags(x["t"], x["text"]), text=x["text"]), t=F.col("t"), text=F.col("_whole"))
        words = flagged.select("_digest", F.posexplode_outer(listed).alias("at", "i")).select("_digest", "at", "i.gap", "i.piece", F.when(F.col("i.ok"), F.regexp_replace("i.piece", C.MARK_MODEL, "")).alias("word"))
        filled = words.join(lexicon.select("word", "label"), "word", "left")
        new = F.concat("gap", F.coalesce("label", "word", "piece"))
        out = filled.groupBy("_digest").agg(F.array_sort(F.collect_list(F.struct("at", new.alias("piece")))).alias("parts"))
        return out.select("_digest", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("output"))

    return _by_text(df, text, made, "output")


def diacritize(df: DataFrame, text: str, lexicon: DataFrame) -> DataFrame:
    """``df`` with ``output``: all marks restored from the bare letters; blank texts stay as they are."""
    return _rewrite(df, text, lexicon, lambda toks, _: F.transform(toks, lambda t: F.lit(True)))


def fill_gaps(df: DataFrame, text: str, lexicon: DataFrame) -> DataFrame:
    """``df`` with ``output``: only fully bare words outside quotations get marks."""
    from sahifa.operators.runs import gap_fill_flags

    return _rewrite(df, text, lexicon, gap_fill_flags)


def tag_texts(df: DataFrame, text: str, lexicon: DataFrame, default: str | None, max_words: int = 120, overflow: str = "?") -> DataFrame:
    """``df`` with ``pairs`` ``array<struct<word, code>>``: the lexicon's tag of each of the first ``max_words`` words, ``overflow`` for the rest."""

    def made(texts: DataFrame) -> DataFrame:
        words = texts.select("_digest", F.posexplode_outer(tokens.words(F.col("_whole"))).alias("at", "word"))
        tagged = tag_words(words, "word", lexicon, default).withColumn("code", F.when(F.col("at") < max_words, F.col("predicted")).otherwise(F.lit(overflow)))
        listed = F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("at", "word", "code"))))
        return tagged.groupBy("_digest").agg(F.transform(listed, lambda p: F.struct(p["word"].alias("word"), p["code"].alias("code"))).alias("pairs"))

    return _by_text(df, text, made, "pairs")


def letters_unchanged(before: str, after: str):
    """Contract of both: texts differ in marks alone."""
    return marks.bare_text(F.col(before)) == marks.bare_text(F.col(after))
